"""Line dedup that documents can be added to and taken out of again.

State, in the shared folder:

* `counts` (shard, key, n_docs): for each line key (16 bytes of MD5) the exact
  number of documents that hold it;
* `filters` (shard, filter): a cuckoo filter for each shard with the keys that
  at least `min_docs` documents hold. A cuckoo filter can delete, so a key that
  falls below the threshold leaves it again.

`LineIndex.insert` and `LineIndex.delete` add or subtract the counts of a batch
of documents and move the keys that crossed the threshold; deleting what was
inserted gives the earlier state. `LineIndex.drop_common` asks the filters
about every line, checks what they let through against the exact counts, and
removes the lines found there.

Each row is a document, also if it repeats another row. Lines that occur twice
in one document count once. Counting is pre-aggregated in the map tasks. A
filter meets its lines by (shard, salt): a shard whose lines are many, be it
through one very common line, is asked in several tasks. Copies of a text ask once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from classmeter.llm.common import SPACES, each, saved

_SPACES = SPACES.encode()
# Rows of (document, key) that one task asks a filter about.
ASKED_TOGETHER = 250_000
# Distinct line keys in a shard, about.
KEYS_IN_SHARD = 500_000


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; add, remove, and ask for many keys at once."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    @classmethod
    def holding(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of the keys (n, 2), at most half full at first."""
        buckets = 64
        while buckets * cls.SLOTS < 2 * len(keys):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(made.add(*key) for key in keys.tolist()):
                return made
            buckets *= 2

    @classmethod
    def read(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, "<u2").reshape(-1, cls.SLOTS).copy())

    def write(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, key) -> tuple:
        """Fingerprint and first bucket of one key, or of arrays of both halves."""
        first, second = key
        return second % 0xFFFF + 1, first & self.mask

    def _other(self, bucket, mark):
        return bucket ^ (mark * 0x5BD1) & self.mask

    def add(self, first: int, second: int) -> bool:
        """False if there is no room; the filter must then be built anew, with more buckets."""
        mark, one = self._places((first, second))
        for bucket in (one, self._other(one, mark)):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = one
        for kick in range(self.KICKS):
            slot = (mark + kick) % self.SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def remove(self, first: int, second: int) -> None:
        mark, one = self._places((first, second))
        for bucket in (one, self._other(one, mark)):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether it may be held; never false for one that is."""
        mark, one = self._places((keys[:, 0], keys[:, 1]))
        other = self._other(one, mark)
        return (self.table[one] == mark[:, None]).any(axis=1) | (self.table[other] == mark[:, None]).any(axis=1)


def _halves(keys) -> np.ndarray:
    """Keys of 16 bytes as two columns of 62 bits."""
    return (np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2) >> np.uint64(2)).astype(np.int64)


def line_key(line: bytes, min_chars: int = 1) -> bytes | None:
    """Key of a line, or None if it is shorter than `min_chars` code points when stripped."""
    bare = line.strip(_SPACES)
    if len(bare) < min_chars or min_chars > 1 and len(bare.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.md5(bare.lower(), usedforsecurity=False).digest()


def _line_keys(min_chars: int):
    @F.arrow_udf("array<binary>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in each(batches):
            found = ({line_key(x, min_chars) for x in (text.as_py() or b"").split(b"\n")} - {None} for text in batch)
            yield pa.array([sorted(x) for x in found], pa.list_(pa.binary()))

    return keys


_CUT = T.StructType().add("text", "string").add("n_lines", "long").add("n_dropped", "long")


@F.arrow_udf(_CUT)
def _without(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch, drops in each(texts):
        kept, total, gone = [], [], []
        for text, drop in zip(batch, drops):
            lines = (text.as_py() or b"").split(b"\n")
            keys = set(drop.as_py() or ())
            left = [x for x in lines if line_key(x) not in keys] if keys else lines
            kept.append(b"\n".join(left)), total.append(len(lines)), gone.append(len(lines) - len(left))
        yield pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
            names=["text", "n_lines", "n_dropped"],
        )


class LineIndex:
    """Exact counts and filters of line keys; see the module's text.

    A null text is an empty one: one empty line, which has no key. Keys have at
    least `min_chars` code points. An index never changes; insert and delete
    return another.
    """

    def __init__(self, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int = 10, min_chars: int = 1):
        self.counts, self.filters, self.shards = counts, filters, shards
        self.min_docs, self.min_chars = min_docs, min_chars

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 16, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        return cls(
            spark.createDataFrame([], "shard int, key binary, n_docs long"),
            spark.createDataFrame([], "shard int, filter binary"),
            shards, min_docs, min_chars,
        )

    def _shard(self, key: str = "key"):
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def keys_of(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(doc, keys) for each row: a hash of its text, and the different keys of its lines."""
        text = F.col(text_col)
        return docs.select(F.xxhash64(text).alias("doc"), _line_keys(self.min_chars)(text.cast("binary")).alias("keys"))

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self.add_keys(self.keys_of(docs, text_col), 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Without documents that were inserted before."""
        return self.add_keys(self.keys_of(docs, text_col), -1)

    def add_keys(self, keys: DataFrame, sign: int) -> LineIndex:
        change = keys.select(F.explode("keys").alias("key")).groupBy("key").agg((sign * F.count(F.lit(1))).alias("change"))
        change = change.select(self._shard().alias("shard"), "key", F.lit(0).cast("long").alias("n_docs"), "change")
        both = self.counts.withColumn("change", F.lit(0).cast("long")).unionByName(change)
        now = both.groupBy("shard", "key").agg(F.sum("n_docs").alias("was"), F.sum(F.col("n_docs") + F.col("change")).alias("n_docs"))
        now = saved(now.where("n_docs > 0 OR was > 0"), "line-counts")
        least = F.lit(self.min_docs)
        crossed = now.where((F.col("was") >= least) != (F.col("n_docs") >= least)).select("shard", "key", (F.col("n_docs") >= least).alias("common"))
        common = now.where(F.col("n_docs") >= least).select("shard", "key", F.lit(None).cast("boolean").alias("common"))
        old = self.filters

        def update(shard: tuple, filters: pa.Table, moved: pa.Table) -> pa.Table:
            keys, common = moved.column("key").to_pylist(), moved.column("common").to_pylist()
            cross = [(k, c) for k, c in zip(keys, common) if c is not None]
            held = _halves(k for k, c in zip(keys, common) if c is None)
            cuckoo, fits = None, True
            if len(filters):
                cuckoo = CuckooFilter.read(filters.column("filter")[0].as_py())
                for key, (_, now_common) in zip(_halves(k for k, _ in cross).tolist(), cross):
                    if now_common:
                        fits = fits and cuckoo.add(*key)
                    else:
                        cuckoo.remove(*key)
            if cuckoo is None or not fits:  # none yet, or full: build it from the exact counts
                cuckoo = CuckooFilter.holding(held)
            return pa.table({"shard": pa.array([shard[0].as_py()], pa.int32()), "filter": pa.array([cuckoo.write()], pa.binary())})

        filters = old.groupBy("shard").cogroup(crossed.unionByName(common).groupBy("shard")).applyInArrow(update, "shard int, filter binary")
        return LineIndex(now.where("n_docs > 0").drop("was"), saved(filters, "line-filters"), self.shards, self.min_docs, self.min_chars)

    def common_lines(self, keys: DataFrame) -> DataFrame:
        """(doc, drop): for each doc that has some, the keys of its common lines."""
        sizes = self.counts.groupBy("shard").agg(F.sum("n_docs").alias("n"))
        salts = sizes.select("shard", F.ceil(F.col("n") / ASKED_TOGETHER).cast("int").alias("salts"))
        spread = self.filters.join(salts, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        # Once for each text, however many copies it has: they have one salt.
        asked = keys.select("doc", F.explode("keys").alias("key")).distinct().withColumn("shard", self._shard())
        asked = asked.join(F.broadcast(salts) if self.shards <= 100_000 else salts, "shard")
        asked = asked.select("shard", F.pmod("doc", "salts").cast("int").alias("salt"), "doc", "key")

        def ask(filters: pa.Table, lines: pa.Table) -> pa.Table:
            if not len(filters) or not len(lines):
                return lines.slice(0, 0).select(["doc", "key"])
            cuckoo = CuckooFilter.read(filters.column("filter")[0].as_py())
            hit = cuckoo.may_hold(_halves(lines.column("key").to_pylist()))
            return lines.select(["doc", "key"]).filter(pa.array(hit))

        passed = spread.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInArrow(ask, "doc long, key binary")
        common = self.counts.where(F.col("n_docs") >= self.min_docs).select("key")
        sure = passed.join(common, "key", "left_semi")
        return sure.groupBy("doc").agg(F.collect_list("key").alias("drop"))

    def drop_common(self, docs: DataFrame, text_col: str = "text", keys: DataFrame | None = None) -> DataFrame:
        """`docs` with the text of the lines that stay, n_lines and n_dropped.

        Columns of `docs` with the two added names are replaced. A null text
        comes back empty. A row that lost lines keeps a last line that stays
        without a line break; a text whose lines are all gone is empty.
        """
        # Written, so that the join deals both sides anew and Spark can split a text with many copies.
        drop = saved(self.common_lines(keys if keys is not None else self.keys_of(docs, text_col)), "line-drops")
        row = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("doc"))
        # Shuffled at every size: texts with common lines are of no bounded number.
        cut = row.join(drop.hint("merge"), "doc", "left").select("row", _without(F.col("row")[text_col].cast("binary"), F.col("drop")).alias("cut"))
        own = [F.col("row")[c].alias(c) if c != text_col else F.col("cut.text").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
        return cut.select(*own, "cut.n_lines", "cut.n_dropped")


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All of `docs` in one index, and their lines without those that `min_docs` documents share."""
    spark = docs.sparkSession
    index = LineIndex.empty(spark, min_docs=min_docs, min_chars=min_chars)
    keys = saved(index.keys_of(docs, text_col), "line-keys")
    total = keys.agg(F.sum(F.size("keys"))).first()[0] or 0
    index.shards = max(index.shards, -(-total // KEYS_IN_SHARD))
    return index.add_keys(keys, 1).drop_common(docs, text_col, keys)
