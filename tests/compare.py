"""Compare queries with their SQL: `python tests/compare.py [sf_dir] [key ...]`."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from classmeter.session import spark_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value):
    """Equal cells of both engines in one form; numbers by their exact double."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(cell(row[i]) for i in order) for row in rows]
    key = lambda row: tuple((v is None, type(v).__name__, v) for v in row)
    return [columns[i] for i in order], sorted(shaped, key=key)


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def differences(spark, con, sf_dir, query, sql):
    """None when equal, else a short account."""
    frame = query(spark, sf_dir)
    ours = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return (
            f"rows {len(ours[1])} / {len(theirs[1])}; only ours {str(sorted(a - b, key=str)[:2])[:500]}; "
            f"only theirs {str(sorted(b - a, key=str)[:2])[:500]}"
        )
    return None if ours[1] else "empty"


def main():
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = spark_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in sys.argv[2:] or sorted(set(queries) & set(sql)):
        start = time.time()
        try:
            found = differences(spark, con, sf_dir, queries[key], sql[key])
        except Exception as error:
            found = f"error {str(error)[:700]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {key} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{bad} differ; without SQL: {sorted(set(queries) - set(sql))}; SQL only: {sorted(set(sql) - set(queries))}")


if __name__ == "__main__":
    main()
