import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from classmeter.llm import neardup, topk

ODD = [
    (900, None),
    (901, []),
    (902, [0.0, 0.0]),
    (903, [1.0, None]),
    (904, [float("nan"), 1.0]),
    (905, [float("inf"), 1.0]),
    (None, [0.5, 0.5]),
    (906, [-0.0, 1.0]),
    (906, [-0.0, 1.0]),
    (907, [0.0, 1.0]),
    (908, [0.0, 2.0]),
    (909, [0.0, 2.0, 1.0]),
    (910, [1e-200, 1e-200]),
]

TOP = 2**63 - 1  # scores are cut to a long


def frame(spark, rows, width="double"):
    rows = [(*r, "v!", "node!", 5) for r in rows]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{width}>, v string, node string, label int").repartition(3)


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_top(rows, every, k, scale=256.0):
    """Each row is a candidate of all others, also of those with its id; a null id comes last in a tie."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if sound(v)]
    out = []
    for own, (q, mine) in enumerate(whole):
        if q is None or q % every:
            continue
        scored = [
            (-max(-TOP, min(TOP, sum(a * b for a, b in zip(mine, v)))), i is None, i or 0, i) for at, (i, v) in enumerate(whole) if at != own
        ]
        out += [(q, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return in_order(out)


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("seed, dims, spread", [(0, 64, 1.0), (1, 5, 0.01), (2, 40, 30.0), (3, 17, 1e12)])
def test_top_k(spark, seed, dims, spread):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, dims)) * spread * rng.random(dims) ** 3
    x[100:140] = x[0]  # ties
    rows = [(i, v) for i, v in enumerate(x.tolist())] + ODD
    for sample in (None, 2, 40):
        found = topk.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, shard_rows=70, query_rows=9, sample_rows=sample)
        assert in_order(found.collect()) == plain_top(rows, 10, 5)


def test_rows_that_repeat_an_id(spark):
    """Each of them is a query, and a candidate of the others; a row without an id is a candidate only."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [0.5, 0.25]), (None, [1.0, 2.0]), (2, None)]
    for parts in (1, 2, 5):
        found = topk.nearest(frame(spark, rows).repartition(parts), F.col("vec_id") % 50 == 0, k=5, shard_rows=3, query_rows=2)
        got = in_order(found.collect())
        assert got == plain_top(rows, 50, 5)
        assert [r[0] for r in got] == [0] * 15


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0]), (1, [0.5]), (50, [-1.0])]
    found = topk.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, k=5).collect()
    assert in_order(found) == plain_top(rows, 50, 5)
    assert topk.nearest(frame(spark, rows[:1]), F.col("vec_id") == 0).collect() == []
    assert topk.nearest(frame(spark, []), F.col("vec_id") == 0).collect() == []


def test_bounds_drop_candidates(spark):
    """On the vectors of the sandbox's table, under half of the products are computed, with first floors from a sample."""
    got = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(got.embedding.to_numpy()).astype(float))
    own = np.arange(0, len(x), 50)
    score = x[own] @ x.T
    score[np.arange(len(own)), own] = -np.inf
    best = -np.sort(-score, axis=1)[:, :5]
    places = np.arange(len(x))
    for floors, share in ((np.full(len(own), -np.inf), 0.65), (-np.sort(-score[:, :1024], axis=1)[:, 4], 0.5)):
        computed = 0
        for i, (alive, scores, products) in enumerate(topk._search(x[own], own, floors, np.ascontiguousarray(x.T), places, 5)):
            assert (-np.sort(-scores)[:5] == best[i]).all() and (scores == score[i, alive]).all()
            computed += products
        assert computed < share * len(own) * x.size


def plain_links(rows, least):
    vectors = [(i, np.array(v, float) if sound(v) and any(v) else None) for i, v in rows]
    n = len(vectors)
    unit = [v / np.abs(v).max() if v is not None else None for _, v in vectors]
    unit = [v / math.sqrt((v * v).sum()) if v is not None else None for v in unit]
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    component = [None] * n
    for i in range(n):
        if component[i] is None:
            part, todo = {i}, [i]
            while todo:
                for y in linked[todo.pop()]:
                    if y not in part:
                        part.add(y)
                        todo.append(y)
            ids = [vectors[x][0] for x in part if vectors[x][0] is not None]
            for x in part:
                component[x] = (min(ids) if ids else None,)
    return sorted((str(vectors[i][0]), len(linked[i]), str(component[i][0]), vectors[i][0] == component[i][0]) for i in range(n))


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 40, "block_rows": 13}, {"cell_rows": 40, "block_rows": 50, "probes": 8}])
def test_near_dedup(spark, sizes):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    x = np.r_[base, base[:30] + rng.normal(size=(30, 16)) * 0.15, base[:1] + rng.normal(size=(120, 16)) * 0.12, np.repeat(base[5:6], 50, axis=0), base[7:8] * 3]
    rows = list(enumerate(x.tolist())) + ODD
    found = neardup.linked(frame(spark, rows), **sizes).collect()
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in found)
    expected = plain_links(rows, 0.95)
    links, all_links = (sum(n for _, n, *_ in x) for x in (got, expected))
    assert len(got) == len(expected) and 0.9 * all_links <= links <= all_links
    if not sizes or sizes.get("probes"):
        assert got == expected


def recall(spark, ids, x, **sizes):
    """The share of the links of brute force that are found; none is found that is no link."""
    found = {r.vec_id: r.n_links for r in neardup.linked(frame(spark, list(zip(ids, x.tolist()))), **sizes).collect()}
    x = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    total = lost = 0
    for a in range(0, len(x), 2_000):
        n = (x[a : a + 2_000] @ x.T >= 0.95).sum(axis=1) - 1
        mine = np.array([found[i] for i in ids[a : a + 2_000]])
        assert (mine <= n).all()
        total, lost = total + n.sum(), lost + (n - mine).sum()
    assert total
    return 1 - lost / total


def test_recall_on_table_vectors(spark):
    """The vectors of the sandbox's table, each with one that is moved a little, in about 100 cells."""
    got = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.stack(got.embedding.to_numpy()).astype(float)
    moved = np.random.default_rng(1).normal(size=x.shape) * np.sqrt((x**2).mean(axis=1, keepdims=True)) * 0.3
    x = np.r_[x, x + moved]
    assert recall(spark, list(range(len(x))), x, cell_rows=40) >= 0.9


@pytest.mark.parametrize("cells", [50, 256, 1024])
def test_recall_of_many_cells(spark, cells):
    """Vectors without any structure, each with a neighbour just beyond the threshold."""
    rng = np.random.default_rng(cells)
    base = rng.normal(size=(2_560, 64))
    x = np.r_[base, base + rng.normal(size=base.shape) * 0.3]
    share = recall(spark, list(range(len(x))), x, cell_rows=len(x) // cells)
    print(f"{cells} cells: recall {share:.4f}")
    assert share >= 0.9


def test_forest_joins_what_is_linked():
    hit = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 0]], bool)
    assert neardup._forest(hit).tolist() == [0, 0, 0, 3, 0, 0, 3, 7]


def test_no_vectors(spark):
    assert neardup.linked(frame(spark, [])).collect() == []
    rows = neardup.linked(frame(spark, ODD[:3])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == [(i, 0, i, True) for i in (900, 901, 902)]
