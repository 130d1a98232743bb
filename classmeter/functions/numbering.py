"""Row numbers inside a key without putting a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from classmeter.session import deal, written


# Rows of a hash bucket of keys that one task may number; and the number of buckets.
CROWD = 1_000_000
BUCKETS = 1 << 16


def number_within(
    df: DataFrame, keys: list[str], order: list[Column], name: str, settled: bool = False, by: str | None = None
) -> DataFrame:
    """Number the rows of each key from 1 in `order`; all rows, if there are no keys.

    The rows are written to the shared folder once and counted there by hash
    buckets of the keys. Those of a bucket with more than `CROWD` rows are
    numbered by ranges, see `_by_ranges`; the others meet by key in one shuffle,
    which joins and groups by the same keys can go on from. Rows that are equal
    in keys and order are told apart by a hash of their other columns. Rows that
    are `settled`, read from a written table, are not written again. With `by`,
    one of the keys, the rows are written dealt out by it and are numbered
    where they lie; the buckets that are counted are then those of this key.
    """
    if not keys:
        return _by_ranges(df, keys, order, name)
    tie = F.xxhash64(*df.columns)
    if by:
        rows = deal(df, "numbered", by).rows()
    else:
        rows = df if settled else written(df, "numbered")
    bucket = F.pmod(F.xxhash64(*([by] if by else keys)), F.lit(BUCKETS))
    full = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD)
    crowded = [row[0] for row in full.select("bucket").collect()]  # one number for each crowded bucket
    within = bucket.isin(crowded) if crowded else F.lit(False)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, tie)).cast("long")
    kept = [c for c in df.columns if c != name]
    numbered = (rows.filter(~within) if crowded else rows).withColumn("_place", place)
    numbered = numbered.select(*kept, F.col("_place").alias(name))
    return numbered.union(_by_ranges(rows.filter(within), keys, order, name)) if crowded else numbered


def _by_ranges(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Number rows without putting a whole key into one task.

    A plain window sorts a whole key in one task, and one key may hold a third
    of the table. Here rows are dealt out by ranges of (keys, order), which
    Spark takes from quantiles, so a hot key, a single day or sparse ids give
    blocks of about one size, and as many as there are shuffle partitions.
    Rows are numbered inside (key, block). A block's border cuts at most one
    key; the counts before the cut, no more rows than blocks, are added.

    The blocks are written to the shared folder first: their borders come from
    a sample and must be the same in all that follows. Rows that are equal in
    keys and order are told apart by a hash of their other columns.
    """
    blocks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    line = [*map(F.asc, keys), *order, F.asc("_tie")]
    dealt = df.withColumn("_tie", F.xxhash64(*df.columns)).repartitionByRange(blocks, *line)
    dealt = written(dealt.withColumn("_block", F.spark_partition_id()), "numbering")
    at = [*keys, "_block"]
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(before)).drop("_n").filter("_start > 0")
    place = F.row_number().over(Window.partitionBy(*at).orderBy(*order, "_tie"))
    placed = dealt.withColumn("_place", place)
    same = [placed[c].eqNullSafe(starts[c]) for c in keys] + [placed["_block"] == starts["_block"]]
    joined = placed.join(F.broadcast(starts), same, "left")  # at most one row for each block
    number = placed["_place"] + F.coalesce(starts["_start"], F.lit(0))
    kept = [placed[c] for c in df.columns if c != name]
    return joined.select(*kept, number.alias(name))
