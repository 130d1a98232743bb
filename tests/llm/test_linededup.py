import numpy as np
import pytest

from classmeter.llm import linededup
from classmeter.llm.linededup import CuckooFilter, LineIndex

BLANKS = " \t\n\x0b\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(texts, min_docs):
    counts = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            counts[k] = counts.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts.get(key(x), 0) < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.fixture()
def docs(spark):
    texts = [f"Line {i % 4}\n  common LINE\t\nown {i}\n\nother {i % 7}\ncommon line" for i in range(40)] + ["Common Line", None, "", "\n", " common line"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_filter_holds_deletes_and_grows():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 62, (3_000, 2))
    cuckoo = CuckooFilter.holding(keys)
    assert cuckoo.may_hold(keys).all()
    assert cuckoo.may_hold(rng.integers(0, 1 << 62, (20_000, 2))).mean() < 0.01
    for k in keys[:1_000].tolist():
        cuckoo.remove(*k)
    assert CuckooFilter.read(cuckoo.write()).may_hold(keys[1_000:]).all()
    assert cuckoo.may_hold(keys[:1_000]).mean() < 0.01
    small = CuckooFilter(4)
    assert not all(small.add(*k) for k in keys[:50].tolist())


@pytest.mark.parametrize("min_docs", [1, 2, 6, 10, 41, 100])
def test_all_documents(docs, min_docs):
    texts, frame = docs
    found = linededup.dedup_lines(frame, min_docs=min_docs).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_dropped) for r in found] == plain(texts, min_docs)


def state(index):
    counts = sorted((bytes(r.key), r.n_docs) for r in index.counts.collect())
    common = [k for k, n in counts if n >= index.min_docs]
    for r in index.filters.collect():
        cuckoo = CuckooFilter.read(bytes(r.filter))
        mine = [bytes(x.key) for x in index.counts.where(f"shard = {r.shard} and n_docs >= {index.min_docs}").collect()]
        if mine:
            assert cuckoo.may_hold(linededup._halves(mine)).all()
        assert int((cuckoo.table > 0).sum()) == len(mine)
    return counts, common


def test_insert_and_delete(spark, docs):
    texts, frame = docs
    first, second = frame.where("doc_id < 20"), frame.where("doc_id >= 20")
    empty = LineIndex.empty(spark, shards=3)
    one = empty.insert(first)
    both = one.insert(second)
    assert state(both) == state(empty.insert(frame))
    back = both.delete(second)
    assert state(back) == state(one)
    assert state(back.delete(first)) == ([], [])
    rows = back.drop_common(first).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_dropped) for r in rows] == plain(texts[:20], 10)
    # documents that came later are judged by what the index holds
    assert back.drop_common(second).agg({"n_dropped": "sum"}).first()[0] > 0


def test_edges(edge_docs, no_docs):
    out = linededup.dedup_lines(edge_docs, min_docs=3)
    assert sorted(out.columns) == sorted(edge_docs.columns)
    rows = edge_docs.collect()
    expected = sorted(zip(map(str, (r.doc_id for r in rows)), *zip(*plain([r.text for r in rows], 3))))
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in out.collect()) == expected
    assert linededup.dedup_lines(no_docs).collect() == []


def test_shortest_keys(spark):
    frame = spark.createDataFrame([(i, "éé\nabc") for i in range(3)], "doc_id long, text string")
    rows = linededup.dedup_lines(frame, min_docs=2, min_chars=3).collect()
    assert {(r.text, r.n_dropped) for r in rows} == {("éé", 1)}


def test_many_salts(monkeypatch, docs):
    monkeypatch.setattr(linededup, "ASKED_TOGETHER", 5)
    monkeypatch.setattr(linededup, "KEYS_IN_SHARD", 10)
    texts, frame = docs
    found = linededup.dedup_lines(frame).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_dropped) for r in found] == plain(texts, 10)


def test_copies_ask_once(monkeypatch, spark):
    """No task gets a row for each copy of a text."""
    texts = ["one\ntwo\nthree"] * 400 + [f"own {i}\ntwo" for i in range(40)] + [None] * 20
    real = linededup._halves

    def few(keys):
        keys = list(keys)
        assert len(keys) <= 100, len(keys)
        return real(keys)

    monkeypatch.setattr(linededup, "_halves", few)
    monkeypatch.setattr(linededup, "ASKED_TOGETHER", 50)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = linededup.dedup_lines(frame).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_dropped) for r in found] == plain(texts, 10)
