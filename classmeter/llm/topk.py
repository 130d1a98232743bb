"""Exact top-k search by columnar branch and bound.

Vectors are turned into whole numbers, floor(scale * x). A task gets a block
of queries and a shard of the candidates and keeps the shard in vertical
layout: one row for each dimension. A query adds up scores a block of
dimensions at a time, those where it is largest first, so that little of its
mass is left early. After each block a candidate's score lies within its
partial score plus or minus the product of the two remaining norms (the mass
that is left). The k-th best lower bound is a floor that the query's results
cannot fall below; it starts at the k-th best score among a bounded sample of
the candidates, which every shard gets with the query. Candidates whose upper
bound lies below the floor are dropped, and the query goes on with the others,
moved together.

Queries x candidates is the work, in blocks: a shard holds about `shard_rows`
candidates, a block `query_rows` queries, both constants for vectors of one
width; their numbers grow with the table. Each pair of block and shard gives
at most k rows for each query, and a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from classmeter.llm.common import saved
from classmeter.llm.vectors import finite, matrix

# Numbers in a shard or a block, and in the sample that first floors come from, about.
SHARD_NUMBERS, SAMPLE_NUMBERS = 1 << 19, 1 << 16
# Dimensions that are added at once.
DIMENSIONS = 8
# Below it, sums of products of whole numbers are exact in doubles.
_EXACT = 2.0**53


def _search(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, columns: np.ndarray, places: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each query, the candidates that can be among its k best, their scores, and how many products were computed.

    `queries` has a row for each query, `columns` a row for each dimension; both
    hold whole numbers whose scores are exact in doubles. `own` and `places`
    number rows of the table: a query is no candidate of its own. No candidate
    below a query's floor is given; ties with the k-th best all are.
    """
    squares = columns**2
    mass = squares.sum(axis=0)
    for query, row, floor in zip(queries, own, floors):
        order = np.argsort(-np.abs(query), kind="stable")
        q_left = np.append(np.cumsum((query[order] ** 2)[::-1])[::-1], 0.0)
        alive = np.flatnonzero(places != row)
        partial, rest, done = np.zeros(len(alive)), mass[alive], 0
        for start in range(0, len(order), DIMENSIONS):
            dims = order[start : start + DIMENSIONS]
            at = np.ix_(dims, alive)
            partial = partial + query[dims] @ columns[at]
            done += len(dims) * len(alive)
            left = q_left[start + len(dims)]
            if left == 0:
                break
            rest = rest - squares[at].sum(axis=0)
            slack = np.sqrt(rest * left) * (1 + 1e-9)
            if len(alive) >= k:
                floor = max(floor, np.partition(partial - slack, len(alive) - k)[len(alive) - k])
            wanted = partial + slack >= floor
            alive, partial, rest = alive[wanted], partial[wanted], rest[wanted]
        if len(alive) > k:
            floor = max(floor, np.partition(partial, len(alive) - k)[len(alive) - k])
        wanted = partial >= floor
        yield alive[wanted], partial[wanted], done


def _whole(scaled: np.ndarray) -> bool:
    """Whether all inner products are exact in doubles."""
    return not scaled.size or float(np.abs(scaled).max()) ** 2 * scaled.shape[1] < _EXACT


def _slow(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The same for numbers too large for doubles, with Python's integers and no bounds; scores are cut to the range of a long."""
    top = 2**63 - 1
    whole = [[int(x) for x in row] for row in rows.tolist()]
    for query, row in zip(queries.tolist(), own):
        q = [int(x) for x in query]
        there = np.flatnonzero(places != row)
        found = [max(-top, min(top, sum(a * b for a, b in zip(q, whole[i])))) for i in there]
        yield there, np.array(found, np.int64), len(q) * len(there)


def _best(found: Iterator[tuple[np.ndarray, np.ndarray, int]], queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best of each query as rows; ties go to the smaller id, a null one last."""
    null = candidates.column("id").is_null().to_numpy(zero_copy_only=False)
    ids = candidates.column("id").fill_null(0).to_numpy()
    taken, scores, sizes = [], [], []
    for alive, score, _ in found:
        first = np.lexsort((ids[alive], null[alive], -score))[:k]
        taken.append(alive[first])
        scores.append(score[first].astype(np.int64))
        sizes.append(len(first))
    at = np.concatenate([np.zeros(0, np.int64), *taken]).astype(np.int64)
    asked = np.repeat(np.arange(len(queries)), sizes)
    return pa.table(
        {
            "query_row": queries.column("row").take(pa.array(asked)),
            "query_id": queries.column("id").take(pa.array(asked)),
            "vec_id": candidates.column("id").take(pa.array(at)),
            "score": pa.array(np.concatenate([np.zeros(0, np.int64), *scores])),
        }
    )


def _first_floors(asked: DataFrame, sample: list, k: int, scale: float, width: int) -> DataFrame:
    """`asked` with `floor`: the k-th best score among the sampled candidates, which no result falls below."""
    flat = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        flat[i, : len(r.v)] = r.v
    places, there = np.array([r.row for r in sample], np.int64), np.floor(scale * flat)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = np.floor(scale * matrix(batch.column("v"), width))
            floor = np.full(len(queries), -np.inf)
            if len(there) > k and _whole(queries) and _whole(there):
                score = queries @ there.T
                score[batch.column("row").to_numpy()[:, None] == places[None, :]] = -np.inf
                floor = np.partition(score, len(there) - k, axis=1)[:, len(there) - k]
            yield batch.append_column("floor", pa.array(floor))

    return asked.mapInArrow(floors, "row long, id long, v array<double>, floor double")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int | None = None,
    query_rows: int | None = None,
    sample_rows: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest inner product for each row where `is_query` holds.

    Candidates of a query are all rows but its own, also those with the same
    id; ties go to the smaller id, a null one last. Rows that repeat an id are
    queries and candidates each, so a repeated query's id has k rows for each.
    Vectors that are null or hold a null or a number that is not finite take no
    part. Shorter vectors are padded with zeros. Other columns are not read.
    Scores beyond a long are cut to its range. `sample_rows` bounds the rows
    that first floors come from; they do not change the result.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    # A number for each row: the table is written once, so it stays.
    rows = saved(rows.where(finite(F.col("v"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q"), F.max(F.size("v")).alias("width")).first()
    width = max(1, size.width or 0)
    shard_rows = shard_rows or max(k + 1, SHARD_NUMBERS // width)
    query_rows = query_rows or max(1, SHARD_NUMBERS // width)
    sample_rows = sample_rows or max(k + 1, SAMPLE_NUMBERS // width)
    shards, blocks = max(1, -(-size.n // shard_rows)), max(1, -(-size.q // query_rows))
    part = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    sample = rows.select("row", "v").orderBy(F.xxhash64("row", F.lit(1)), "row").limit(sample_rows).collect()
    asked = saved(_first_floors(rows.where("q").select("row", "id", "v"), sample, k, scale, width), "queries")
    asked = asked.select(part(blocks).alias("block"), every(shards).alias("shard"), "row", "id", "v", "floor")
    there = rows.select(every(blocks).alias("block"), part(shards).alias("shard"), "row", "id", "v")

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        q_v, c_v = (np.floor(scale * matrix(t.column("v"), width)) for t in (q, c))
        own, floors, places = q.column("row").to_numpy(), q.column("floor").to_numpy(), c.column("row").to_numpy()
        if _whole(q_v) and _whole(c_v):
            found = _search(q_v, own, floors, np.ascontiguousarray(c_v.T), places, k)
        else:
            found = _slow(q_v, own, c_v, places)
        return _best(found, q, c, k)

    kind = "query_row long, query_id long, vec_id long, score long"
    found = asked.groupBy("block", "shard").cogroup(there.groupBy("block", "shard")).applyInArrow(search, kind)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
