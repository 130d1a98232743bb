"""Embedding near-dedup: spherical k-means cells, blocked cosines, one kept of each group.

Equal vectors are one row with a count before anything else. Centres are
fitted on the driver on at most `max_sample` vectors, the first in the order of
a hash; their number grows with the different vectors up to `max_cells`. Every
vector has a home cell, the nearest centre, and visits the next `probes` - 1.
Cells are cut into blocks by a hash; a task compares two blocks of a cell and
returns, for each vector, how many it is linked with there, and a spanning
forest of the links: never the pairs. So a cell of any size, a third of the
table even, is many tasks of one size.

Two vectors meet in the home cell of one if the other is at home or a visitor
there. A pair that meets in two cells counts in the one with the smaller
number. Pairs that meet nowhere are lost; the tests measure the recall against
brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from classmeter.functions.joins import left_join_sparse
from classmeter.llm.common import saved
from classmeter.llm.components import components, lowest
from classmeter.llm.vectors import finite, matrix

# Vectors that the centres are fitted on, at most; centres, at most; vectors for each centre, about.
MAX_SAMPLE, MAX_CELLS, CELL_ROWS = 20_000, 1_024, 1_000
# Vectors in a block, about.
BLOCK_ROWS = 1_500
PROBES = 4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest number first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def fit_centres(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Spherical k-means: unit centres of unit vectors. A centre without vectors stays where it is."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _forest(hit: np.ndarray) -> np.ndarray:
    """For each row and then each column of a block of links the least place in its component."""
    rows, columns = hit.shape
    row, column = np.arange(rows), rows + np.arange(columns)
    while True:
        new_row = np.minimum(row, np.where(hit, column[None, :], rows + columns).min(axis=1, initial=rows + columns))
        new_column = np.minimum(column, np.where(hit, new_row[:, None], rows + columns).min(axis=0, initial=rows + columns))
        if (new_row == row).all() and (new_column == column).all():
            return np.r_[row, column]
        row, column = new_row, new_column


def _meets(cell: int, home_a: np.ndarray, home_b: np.ndarray, probes_a: np.ndarray, probes_b: np.ndarray) -> np.ndarray:
    """Whether the pairs of two blocks of a cell are counted in it."""
    a, b = home_a[:, None], home_b[None, :]
    # a at home here, b visiting: counted unless they meet in b's cell too, and that is smaller.
    in_b = (b < cell) & (probes_a[:, None, :] == home_b[None, :, None]).any(axis=2)
    in_a = (a < cell) & (probes_b[None, :, :] == home_a[:, None, None]).any(axis=2)
    return ((a == cell) & ~in_b) | ((b == cell) & ~in_a)


def linked(
    vectors: DataFrame,
    least: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    max_sample: int = MAX_SAMPLE,
    max_cells: int = MAX_CELLS,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    probes: int = PROBES,
) -> DataFrame:
    """One row per row of `vectors`: its id, n_links, component_id and kept.

    Rows link if their cosine in double precision is at least `least`. Vectors
    that are null, empty, zero or hold a null or a number that is not finite
    link with nothing, and vectors of different lengths do not link. `n_links`
    counts other rows, also those that repeat an id. `component_id` is the
    smallest id that links reach; rows without an id take part and have a null
    component only if they reach no id. `kept` says whether the row's id is its
    component's. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = finite(F.col("v")) & F.exists(F.col("v"), lambda x: x != 0)
    rows = rows.withColumn("v", F.when(sound, F.transform("v", lambda x: x + 0.0)))  # 0.0 and -0.0 are one
    different = rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    different = saved(different, "different-vectors")
    salt = 0
    while True:  # a hash stands for its vector, so no two may share it; if two do, take another hash
        node = F.xxhash64("v", F.lit(salt))
        size = different.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(node).alias("nodes")).first()
        if size.n == size.nodes:
            break
        salt += 1
    different = different.withColumn("node", node)

    sample = different.select("v", "node").orderBy("node").limit(max_sample).toArrow()
    widths = pc.list_value_length(sample.column("v")).to_numpy() if len(sample) else np.zeros(0, int)
    width = int(np.bincount(widths).argmax()) if len(widths) else 1
    x = unit(matrix(sample.column("v").filter(pa.array(widths == width)), width)) if len(widths) else np.ones((1, 1))
    centres = fit_centres(x, max(1, min(max_cells, -(-size.n // cell_rows))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Home and visited cells; vectors of another length have one cell of their own for each length."""
        for batch in batches:
            lengths = pc.list_value_length(batch.column(0)).to_numpy()
            near = np.full((len(batch), min(probes, len(centres))), -1, np.int64)
            usual = lengths == width
            if usual.any():
                close = unit(matrix(batch.column(0).filter(pa.array(usual)), width)) @ centres.T
                near[usual] = np.argsort(-close, axis=1, kind="stable")[:, : near.shape[1]]
            near[~usual, 0] = len(centres) + lengths[~usual]
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["v", "node", "n", "probes"])

    placed = saved(different.select("v", "node", "n").mapInArrow(place, "v array<double>, node long, n long, probes array<long>"), "placed")
    guests = placed.withColumn("cell", F.explode("probes")).where("cell >= 0")
    blocks = guests.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    guests = guests.join(F.broadcast(blocks), "cell")  # a row for each cell, at most max_cells and one for each odd length
    mine = F.pmod(F.xxhash64("node", "cell"), "blocks").cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("mine", other).alias("a"), F.greatest("mine", other).alias("b"))
    )
    dealt = guests.withColumn("mine", mine).withColumn("pair", F.explode(pairs)).select("cell", "pair.a", "pair.b", "mine", "node", "n", "v", "probes")

    def compare(table: pa.Table) -> pa.Table:
        cell, a, b = (table.column(c)[0].as_py() for c in ("cell", "a", "b"))
        mine = table.column("mine").to_numpy()
        values = matrix(table.column("v"), len(table.column("v")[0]))
        nodes, counts = table.column("node").to_numpy(), table.column("n").to_numpy()
        near = matrix(table.column("probes"), len(table.column("probes")[0])).astype(np.int64)
        first, second = np.flatnonzero(mine == a), np.flatnonzero(mine == b)
        x = unit(values)
        hit = (x[first] @ x[second].T >= least) & _meets(cell, near[first, 0], near[second, 0], near[first], near[second])
        if a == b:
            np.fill_diagonal(hit, False)
        left, right = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        hit, first, second = hit[np.ix_(left, right)], first[left], second[right]
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        links[first] = hit @ counts[second]
        if a == b:  # both sides are the same vectors
            np.fill_diagonal(hit, True)
        else:
            links[second] = hit.T @ counts[first]
        both = np.r_[first, second]
        root[both] = both[_forest(hit)]
        some = np.flatnonzero(links)
        return pa.table([nodes[some], links[some], nodes[root[some]]], names=["node", "links", "root"])

    found = saved(dealt.groupBy("cell", "a", "b").applyInArrow(compare, "node long, links long, root long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    label = components(edges)
    nodes = different.select("node", "n", "low")
    known = nodes.join(links, "node", "left").join(lowest(label, nodes, component="low"), "node", "left").select(
        "node",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "low").alias("component"),
    )
    known = saved(known, "vector-classes")  # the join deals both sides anew, and Spark can split copies
    out = rows.select("id", F.when(F.col("v").isNotNull(), node).alias("node"))
    out = left_join_sparse(out, known, "node", ["id"])
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
