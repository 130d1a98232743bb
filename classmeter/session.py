"""Session settings the jobs are written for."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def spark_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC; `conf` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        **conf,
    }
    builder = SparkSession.builder.appName("classmeter")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under `spark.checkpoint.dir`, or else under the session's warehouse.

    Both are on a file system that the driver and all executors see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df`, computed once into the shared folder and read back with its schema.

    Deltas and key sets are used several times and carry no statistics. Read
    from a table, their lineage runs once, and Spark's own size threshold
    decides whether they are broadcast.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# The column that tells the runs of a dealt table apart.
RUN = "_run"
# Joins on several keys may rely on rows that are dealt out by one of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _meeting_by_one_key(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


@dataclass(frozen=True)
class Dealt:
    """A written table whose rows are dealt out to buckets by one key, each run a partition of its own.

    What groups by this key and others, or numbers within them, reads a bucket
    of all runs in one task and needs no shuffle; so do joins of tables dealt
    out by the same key, inside `deal` and `add`. Rows of one key meet in one
    task, so the key is one that no large share of the rows has in common.
    A run is never changed: who holds some of the runs does not see later ones.
    """

    spark: SparkSession
    name: str
    path: str
    key: str
    order: tuple[str, ...]
    buckets: int
    columns: tuple[str, ...]
    runs: tuple[str, ...] = ()

    def rows(self) -> DataFrame:
        return self._of(self.runs)

    def last(self) -> DataFrame:
        """The rows of the last run."""
        return self._of(self.runs[-1:])

    def _of(self, runs: tuple[str, ...]) -> DataFrame:
        return self.spark.table(self.name).filter(F.col(RUN).isin(*runs)).select(*self.columns)

    def add(self, df: DataFrame) -> "Dealt":
        """The table with the rows of `df` as another run; they are shuffled if they are not dealt out by the key yet."""
        run = uuid.uuid4().hex
        dealt = df.select(*self.columns, F.lit(run).alias(RUN)).repartition(self.buckets, self.key)
        writer = dealt.write.mode("append").option("path", self.path).option("compression", "zstd")
        writer = writer.partitionBy(RUN).bucketBy(self.buckets, self.key).sortBy(*self.order)
        with _meeting_by_one_key(self.spark):
            writer.saveAsTable(self.name)
        return replace(self, runs=(*self.runs, run))


def buckets(spark: SparkSession) -> int:
    """Buckets of a dealt table: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame, purpose: str, key: str, order: tuple[str, ...] = ()) -> Dealt:
    """`df`, computed once and dealt out by `key`, sorted by `key` and `order` within a bucket.

    The table's name is in the session's catalog, its files are in the shared folder.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    name = f"{spark.catalog.currentDatabase()}.dealt_{path.rsplit('/', 1)[-1].replace('-', '_')}"
    line = tuple(dict.fromkeys((key, *order)))
    return Dealt(spark, name, path, key, line, buckets(spark), tuple(df.columns)).add(df)
