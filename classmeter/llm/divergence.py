"""Source divergence audit: how far the smoothed term shares of sources differ, exactly.

Term counts of each group (language, source) become integer shares p. The L1
distance of all pairs of groups of a language is worked out by Gustavson's row
accumulation in tiles: a tile has a block of groups as rows, a block as peers,
and a range of the language's terms. In it the peers' terms form a term-major
index, and each row scatters its terms through the index into one dense
accumulator over the peers. What a tile gives out is one number for each pair
of its groups, not one for each pair of postings.

A group that lacks a term has a share all the same, its baseline b. Let both
groups of a pair lack all terms of the range: they differ by |b - b'| for each
term. A row's own terms correct that against every peer's baseline (sorted
shares, prefix sums and a binary search), a peer's own terms against the row's
baseline, and the scattered products correct what both hold.

A tile holds at most BLOCK groups on each side and TILE shares on each side,
whatever the number of sources and terms, so that a language or source with a
third of all documents is many tiles. Counts are pre-aggregated for each batch of
documents and again in the map tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from classmeter.functions.numbering import number_within
from classmeter.llm.common import each, saved

# Fixed by the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(TERM.encode())
# Bytes from which a text's terms are counted one by one instead of as a list.
LONG = 1 << 20
MIN_DOCS, TOP_TERMS, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
# Groups on a side of a tile, and shares on a side of it, at most.
BLOCK, TILE = 256, 1 << 16


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, n_docs) for each term of each group; every row of `docs` is a document."""
    rows = docs.select(_group(lang_col).alias("lang"), _group(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms, and of documents that hold them, for each batch of documents."""
    for batch in each(batches):
        found: dict[tuple, tuple[Counter, Counter]] = {}
        for group, text in zip(zip(batch["lang"].to_pylist(), batch["source"].to_pylist()), batch["text"]):
            whole = text.as_buffer() if text.is_valid else None
            terms, in_docs = found.setdefault(group, (Counter(), Counter()))
            if whole is None:
                continue
            # In UTF-8 only A-Z change in lower(), and the bytes of other letters are all above 127.
            lowered = whole.to_pybytes().lower()
            if len(lowered) < LONG:
                words = _TERM_BYTES.findall(lowered)
                terms.update(words)
                in_docs.update(set(words))
            else:
                terms.update(m.group() for m in _TERM_BYTES.finditer(lowered))
                in_docs.update({m.group() for m in _TERM_BYTES.finditer(lowered)})
        for (lang, source), (terms, in_docs) in found.items():
            names = list(terms)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(names), pa.string()),
                    "source": pa.array([source] * len(names), pa.string()),
                    "term": pa.array(names, pa.binary()).cast(pa.string()),
                    "n": pa.array([terms[t] for t in names], pa.int64()),
                    "n_docs": pa.array([in_docs[t] for t in names], pa.int64()),
                }
            )


def _group(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _share(n: Column, total: Column, kept: Column, scale: int, prior: int) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * kept)), in whole numbers; 0 where no term is kept."""
    whole = lambda c: c.cast("decimal(20,0)")
    above = F.lit(scale).cast("decimal(12,0)") * whole(n + prior)
    below = whole(total + prior * kept)
    return F.when(kept > 0, F.call_function("div", above, below) + 1).otherwise(0).cast("long")


def _distances(row_block: pa.Table, peer_block: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, peers, distances over the tile's terms) for each row group of a tile.

    Both tables hold (group_id, term_id, share); a row without a term_id is a
    group's baseline, with the number of terms of the tile in `kept`.
    """
    rows, peers = (_sides(t) for t in (row_block, peer_block))
    ids, bases, kept, groups, terms, shares = peers
    order = np.argsort(terms, kind="stable")
    index_terms, index_groups, index_shares = terms[order], groups[order], shares[order]
    # A peer's own terms against any baseline: sorted shares and their sums, peer by peer.
    own = [np.sort(shares[groups == g]) for g in range(len(ids))]
    own_sums = [np.concatenate(([0], np.cumsum(s))) for s in own]
    row_ids, row_bases, _, row_groups, row_terms, row_shares = rows
    by_row = np.argsort(row_groups, kind="stable")
    cuts = np.searchsorted(row_groups[by_row], np.arange(len(row_ids) + 1))
    for g, base in enumerate(row_bases):
        mine = by_row[cuts[g] : cuts[g + 1]]
        gap = np.abs(base - bases)
        sums = kept * gap - len(mine) * gap - np.fromiter((len(s) for s in own), np.int64, len(own)) * gap
        sorted_mine = np.sort(row_shares[mine])
        sums += _away(sorted_mine, np.concatenate(([0], np.cumsum(sorted_mine))), bases)
        sums += np.fromiter((_away(s, c, np.array([base]))[0] for s, c in zip(own, own_sums)), np.int64, len(own))
        # Scatter: the postings of the row's terms, all in one go, into the accumulator.
        low = np.searchsorted(index_terms, row_terms[mine], "left")
        counts = np.searchsorted(index_terms, row_terms[mine], "right") - low
        total = int(counts.sum())
        if total:
            at = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
            p, q, to = np.repeat(row_shares[mine], counts), index_shares[at], index_groups[at]
            change = np.abs(p - q) - np.abs(p - bases[to]) - np.abs(q - base) + gap[to]
            np.add.at(sums, to, change)
        yield row_ids[g], ids, sums


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and baselines of a block's groups in order, the tile's number of terms, and (place of the group, term, share) of its shares."""
    ids = table["group_id"].to_numpy()
    terms = table["term_id"].fill_null(0).to_numpy()
    shares = table["share"].to_numpy()
    bases = terms == 0
    order = np.argsort(ids[bases])
    known = ids[bases][order]
    kept = int(table["kept"].to_numpy()[bases][0])
    return known, shares[bases][order], kept, np.searchsorted(known, ids[~bases]), terms[~bases], shares[~bases]


def _away(ordered: np.ndarray, sums: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The sum of |x - point| over the ordered numbers, for each point."""
    n = np.searchsorted(ordered, points)
    return points * n - sums[n] + (sums[-1] - sums[n]) - points * (len(ordered) - n)


def _tile(key: tuple[pa.Scalar, ...], both: pa.Table) -> pa.Table:
    same = key[1].as_py() == key[2].as_py()
    is_row = both["is_row"]
    found = [[], [], []]
    for row, peers, sums in _distances(both.filter(is_row), both.filter(pc.invert(is_row))):
        start = np.searchsorted(peers, row, "right") if same else 0
        found[0].append(np.full(len(peers) - start, row))
        found[1].append(peers[start:])
        found[2].append(sums[start:])
    row, peer, value = (np.concatenate(x).astype(np.int64) for x in found)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(row), pa.string()), "row": row, "peer": peer, "value": value})


def pair_distances(groups: DataFrame, shares: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, row, peer, value): the L1 distance of each pair of groups of a language, the smaller id as the row.

    `groups` holds (lang, group_id from 1, n_groups, kept, base), `shares` holds
    (lang, group_id, term_id from 1, share) where a group has the term.
    """
    width = F.lit(block).cast("long")
    # Terms in a tile, so that a block of groups has at most `tile` shares there.
    terms = F.expr(f"{tile} div least(n_groups, {block})")
    ranges = F.greatest(F.expr("kept") + 0, F.lit(1).cast("long"))
    dims = groups.withColumn("terms", terms).withColumns(
        {
            "blocks": F.ceil(F.col("n_groups") / width),
            "ranges": F.ceil(ranges / F.col("terms")),
            "block": F.expr(f"(group_id - 1) div {block}"),
        }
    )
    dims = dims.select("lang", "group_id", "kept", "base", "terms", "blocks", "ranges", "block")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1)).alias("range")
    bases = dims.select("lang", "group_id", "block", "blocks", "kept", "terms", F.col("base").alias("share"), part)
    inside = F.least(F.col("terms"), F.col("kept") - F.col("range") * F.col("terms"))
    bases = bases.select("lang", "group_id", F.lit(None).cast("long").alias("term_id"), "share", inside.cast("long").alias("kept"), "block", "blocks", "range")
    held = shares.join(dims.select("lang", "group_id", "block", "blocks", "terms"), ["lang", "group_id"])
    held = held.select("lang", "group_id", "term_id", "share", F.lit(0).cast("long").alias("kept"), "block", "blocks", F.expr("(term_id - 1) div terms").alias("range"))
    every = bases.union(held)
    # Each share as one of a row, in the tiles to its right, and as one of a peer, in those above.
    right = F.transform(F.sequence("block", F.col("blocks") - 1), lambda b: F.struct(F.lit(True).alias("is_row"), F.col("block").alias("row_block"), b.alias("peer_block")))
    above = F.transform(F.sequence(F.lit(0).cast("long"), "block"), lambda b: F.struct(F.lit(False).alias("is_row"), b.alias("row_block"), F.col("block").alias("peer_block")))
    dealt = every.withColumn("to", F.explode(F.concat(right, above)))
    dealt = dealt.select("lang", "to.row_block", "to.peer_block", "range", "to.is_row", "group_id", "term_id", "share", "kept")
    partial = dealt.groupBy("lang", "row_block", "peer_block", "range").applyInArrow(_tile, "lang string, row long, peer long, value long")
    return partial.groupBy("lang", "row", "peer").agg(F.sum("value").cast("long").alias("value"))


def audit(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    scale: int = SCALE,
    prior: int = PRIOR,
    block: int = BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for the groups (lang, source) of `docs`.

    Part `pair`: the distance to each other source of the language, all ranks.
    Part `term`: kept terms that the group uses more than its language does, by
    how much, the first `top_terms`. A term is kept in a language if at least
    `min_docs` of its documents hold it; null lang, source and text count as
    empty ones, and repeated rows are documents of their own. A group without
    kept terms has its baseline everywhere. No rows give no rows. Other columns
    are not read.
    """
    counts = saved(term_counts(docs, lang_col, source_col, text_col), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("in_docs"))
    kept = saved(number_within(kept.where(F.col("in_docs") >= min_docs).drop("in_docs"), ["lang"], [F.asc("term")], "term_id"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    held = saved(counts.drop("n_docs").join(kept, ["lang", "term"]), "kept-counts")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))

    groups = docs.select(_group(lang_col).alias("lang"), _group(source_col).alias("source")).distinct()
    groups = number_within(groups, ["lang"], [F.asc("source")], "group_id")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
    groups = groups.join(sizes, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.fillna(0, ["kept", "lang_total", "total"])
    zero = F.lit(0).cast("long")
    groups = saved(groups.withColumn("base", _share(zero, F.col("total"), F.col("kept"), scale, prior)), "groups")

    shares = held.join(groups.select("lang", "source", "group_id", "kept", "total", "lang_total"), ["lang", "source"])
    shares = shares.select(
        "lang", "source", "group_id", "term", "term_id", _share(F.col("n"), F.col("total"), F.col("kept"), scale, prior).alias("share"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), scale, prior).alias("lang_share"),
    )
    shares = saved(shares, "shares")

    line = [F.desc("value"), F.asc("item")]
    over = shares.withColumn("value", F.col("share") - F.col("lang_share")).where("value > 0")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    over = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*line))).where(F.col("rank") <= top_terms)

    distances = pair_distances(groups, shares.select("lang", "group_id", "term_id", "share"), block, tile)
    both = F.array(F.struct(F.col("row").alias("a"), F.col("peer").alias("b")), F.struct(F.col("peer").alias("a"), F.col("row").alias("b")))
    pairs = distances.select("lang", "value", F.explode(both).alias("to")).select("lang", "value", "to.a", "to.b")
    names = groups.select("lang", "group_id", "source")
    pairs = pairs.join(names.withColumnsRenamed({"group_id": "a"}), ["lang", "a"])
    pairs = pairs.join(names.withColumnsRenamed({"group_id": "b", "source": "item"}), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*line)))
    return pairs.union(over).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
