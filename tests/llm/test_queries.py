"""All operators as registered: columns, and the ones that SQL expresses against it."""

import os
import subprocess
import sys

import duckdb
import pytest

from classmeter.llm.oracle import ORACLE
from classmeter.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "size", "source_size", "target", "taken"],
    2: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    3: ["doc_id", "held_out", "score", "predicted"],
    4: ["doc_id", "held_out", "score", "predicted"],
    5: ["query_id", "rank", "vec_id", "score"],
    6: ["vec_id", "n_links", "component_id", "kept"],
    7: ["doc_id", "fingerprint", "component_id"],
    8: ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    9: ["doc_id", "start", "length", "secret_sha256", "label", "score", "predicted"],
    10: ["page_id", "host", "path", "rule", "verdict"],
    11: ["lang", "source", "part", "item", "value", "rank"],
    12: ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    13: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", QUERIES)
def test_columns(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.columns == COLUMNS[int(name[2:].split("_")[0])]
    assert frame.count() > 0


@pytest.mark.parametrize("name", ORACLE)
def test_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{SF}/{file}'")
    relation = db.sql(ORACLE[name])
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    assert sorted(relation.columns) == columns
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, relation.select(*columns).fetchall()))


def test_the_library_does_without_this_package(tmp_path):
    code = (
        "import sys; sys.modules['classmeter.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert not any(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries())\n"
        "assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=root)


def test_all_are_registered():
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())
