"""What the streams write: sinks with a folder for each micro-batch, state in runs, one record per batch.

A batch writes its folders, and then one commit record for all of them. Readers
follow the last record, so of a batch that was stopped between two sinks they
see nothing; its repeat replaces the folders and commits. A batch that is
committed is not run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from classmeter.sources.commits import CommitLog


# Keys that are few enough to be looked up in the state by themselves.
FEW = 100_000


class Batches:
    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out
        self.log = CommitLog(spark, f"{out}/_commits")

    def begin(self, record: Callable[[], dict]) -> None:
        """What the stream starts from, as batch -1; worked out once."""
        if self.log.last() is None:
            self.log.write(-1, record())

    def done(self, batch_id: int) -> bool:
        return self.log.has(batch_id)

    def before(self, batch_id: int) -> dict:
        return self.log.read(batch_id - 1)

    def write(self, rows: DataFrame, sink: str, batch_id: int, schema: T.StructType) -> DataFrame:
        """`rows` in the sink's folder of this batch, read back."""
        folder = f"{self.out}/{sink}/batch={batch_id}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(schema).parquet(folder)

    def read(self, sink: str, schema: T.StructType) -> DataFrame:
        """The rows of all committed batches."""
        folder, last = f"{self.out}/{sink}", self.log.last()
        if last is None or not self.log.folder_exists(folder):
            return self.spark.createDataFrame([], schema)
        placed = T.StructType([*schema, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(placed).parquet(folder).where(F.col("batch") <= last).select(*schema.names)

    def commit(self, batch_id: int, record: dict) -> None:
        """Publish a batch, and retire the record and the runs that neither it nor the one before it needs."""
        self.log.write(batch_id, record)
        old = [n for n in self.log.numbers() if n < batch_id - 1]
        kept = {run for n in (batch_id - 1, batch_id) if self.log.has(n) for run in self.log.read(n).get("runs", ())}
        for number in old:
            for run in self.log.read(number).get("runs", ()):
                if run not in kept:
                    self.log.remove_folder(run)
            self.log.forget(number)


class State:
    """The largest value of each key, as one base and at most `most_runs` deltas, each dealt out by buckets of the key.

    A batch reads the buckets of its own keys and adds a delta; when there are
    too many, all runs become a new base. So what a batch reads does not grow
    with the number of batches before it.
    """

    def __init__(self, batches: Batches, name: str, keys: list[str], value: str, schema: T.StructType, buckets: int = 16, most_runs: int = 8):
        self._batches, self._name, self._keys, self._value = batches, name, keys, value
        self._schema, self._buckets, self._most = schema, buckets, most_runs

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self._keys), F.lit(self._buckets)).cast("int")

    def largest(self, rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*self._keys).agg(F.max(self._value).alias(self._value))
        return found.select(*(F.col(f.name).cast(f.dataType) for f in self._schema))

    def write_run(self, rows: DataFrame, batch_id: int, kind: str = "delta") -> str:
        """A run of the largest value of each key in `rows`; nothing names it before the batch is committed."""
        folder = f"{self._batches.out}/{self._name}/{kind}-{batch_id}"
        # Dealt out by the tasks that group the keys; a shuffle by buckets would move every row once more.
        dealt = self.largest(rows).withColumn("_bucket", self._bucket())
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        return folder

    def read(self, runs: list[str], keys: DataFrame | None = None) -> DataFrame:
        """The rows of `runs`, several of a key maybe; with `keys` those of their buckets, and of few keys only theirs.

        A join of all state rows with many keys would shuffle and sort both
        sides, only for the caller to join them again.
        """
        spark = self._batches.spark
        placed = T.StructType([*self._schema, T.StructField("_bucket", T.IntegerType())])
        if not runs:
            return spark.createDataFrame([], self._schema)
        found = None
        for run in runs:
            one = spark.read.schema(placed).parquet(run)
            found = one if found is None else found.union(one)
        if keys is not None:
            touched = [row[0] for row in keys.select(self._bucket()).distinct().collect()]  # one number for each bucket
            found = found.where(F.col("_bucket").isin(touched))
            if keys.limit(FEW + 1).count() <= FEW:
                found = found.join(keys.distinct(), self._keys, "left_semi")
        return found.select(*self._schema.names)

    def add(self, runs: list[str], rows: DataFrame, batch_id: int) -> list[str]:
        """The runs after a batch that brings `rows`."""
        runs = [*runs, self.write_run(rows, batch_id)]
        if len(runs) <= self._most + 1:
            return runs
        return [self.write_run(self.read(runs), batch_id, "base")]
