"""Joins whose sides are very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def left_join_sparse(df: DataFrame, other: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Left join on an id that is mostly null in `df`.

    All nulls would meet in one partition. A second join column spreads the
    rows without an id over their `by` columns; it is 0 for every row with an
    id, on either side. A null id equals nothing, so no such row can match.
    """
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*by), F.lit(1 << 16))).otherwise(F.lit(0))
    # Always 0, but not a literal, which the optimizer would take out of the join.
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    salted = df.withColumn("_salt", salt.cast("long"))
    joined = salted.join(other.withColumn("_salt", zero.cast("long")), [key, "_salt"], "left")
    return joined.drop("_salt")
