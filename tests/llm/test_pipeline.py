"""The pipeline against plain versions of its stages, each on its own input."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from classmeter.llm import bpe, mixing, quality
from classmeter.llm.common import saved
from classmeter.llm.queries import SEED

from .test_linededup import plain as plain_lines
from .test_simhash import plain_fingerprint, reach

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, SF), "stage")
        out.append((docs, after))
        docs = after
    return out


def test_five_stages_in_order():
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["quality", "line", "SimHash", "mixing", "byte-level"]


def test_columns_stay(stages):
    assert all(after.columns == docs.columns for docs, after in stages[:4])


def test_quality(spark, stages):
    docs, after = stages[0]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    scores = model.scores(np.array([quality.statistics((r.text or "").encode()) for r in rows]))
    assert sorted(after.collect()) == sorted(r for r, s in zip(rows, scores) if s >= 0.3)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    left = {r.doc_id for r in after.collect()}
    assert len(bad & left) <= 0.2 * len(bad) and len(left) > 0.7 * len(rows)


def test_line_dedup(stages):
    docs, after = stages[1]
    rows = docs.collect()
    expected = [(r.doc_id, t, len(t) if dropped else r.n_chars) for r, (t, _, dropped) in zip(rows, plain_lines([r.text for r in rows], 10))]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in after.collect()) == sorted(expected)


def test_near_dedup(stages):
    docs, after = stages[2]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    group = reach(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for doc_id, fp in prints.items():
        first[group[fp]] = min(doc_id, first.get(group[fp], doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())
    assert len(first) < len(prints)


def test_mix(stages):
    docs, after = stages[3]
    rows = docs.collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    whole = [sum(size[r.doc_id] for r in rows if r.source == n) for n in names]
    quota = dict(zip(names, mixing.quotas(mixing.targets(whole, [(5, 2, 1)[i % 3] for i in range(len(names))], sum(whole), 3))))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    expected = Counter()
    for name, total in zip(names, whole):
        mine = sorted((md5(f"{SEED}:{r.doc_id}:{md5(r.text or '')}")[:15], r.doc_id) for r in rows if r.source == name)
        before = 0
        for _, doc_id in mine:
            expected[doc_id] = quota[name] // total + (2 * before + size[doc_id] <= 2 * (quota[name] % total))
            before += size[doc_id]
    assert Counter(r.doc_id for r in after.collect()) == +expected
    assert max(expected.values()) <= 3


def test_ids(stages):
    docs, after = stages[4]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        packed = np.array(ids, "<u4").tobytes()
        expected.append((r.doc_id, r.source, len(ids), packed, hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(r.doc_id, r.source, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in after.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_run_chains_the_stages(spark, stages):
    key = ["doc_id", "n_tokens", "ids_sha256"]
    run = corpus_pipeline.run(spark, SF).select(key).collect()
    assert sorted(run) == sorted(stages[-1][1].select(key).collect())


def test_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            assert name.startswith("byte") or sorted(after.columns) == sorted(docs.columns)
            assert (after.count() == 0) == (docs.count() == 0)
