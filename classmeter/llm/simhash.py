"""SimHash near-dedup by fuzzy hashing with the Golay code.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each
padded to the 23 bits of the perfect binary Golay code. If two fingerprints
differ in at most 2 bits, one of the ordered segment pairs (1,2), (2,3),
(3,1) has no error in its first segment and at most one in its second: the
pigeonhole over segments. Every word of 23 bits is within 3 bits of exactly
one codeword, and a word one bit away from it within 4 bits of the same one.
So a fingerprint gets a home key for each pair (first segment, nearest
codeword of the second) and probe keys (first segment, every codeword within
4 bits of the second, 1 or 6 of them). Home keys are joined with probe keys,
and the differing bits of a candidate are counted inside that join.

Equal fingerprints are one row before any join, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from classmeter.llm.common import each, saved
from classmeter.llm.components import components, lowest

# Most bits that the segment keys are proven for.
MOST_BITS = 2
# Hashes whose bits are counted at once.
_BLOCK = 1 << 14
# The generator polynomial of the Golay code, and XXH64's seed.
_GENERATOR = 0b101011100011
_SEED = 42
# First bit and mask of each segment.
_SEGMENTS = ((0, (1 << 22) - 1), (22, (1 << 21) - 1), (43, (1 << 21) - 1))


def fingerprint_of(text: bytes | None, words: int) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    parts = (text or b"").lower().split()  # of bytes: A-Z only, and the six blanks only
    if not parts:
        return 0
    line = b" ".join(parts)
    size = min(words, len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    begin, end = (ends - lengths)[: len(parts) - size + 1], ends[size - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(begin), _BLOCK):
        spans = zip(begin[k : k + _BLOCK].tolist(), end[k : k + _BLOCK].tolist())
        hashes = np.array([digest(line[a:b], _SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(begin)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """SimHash of a text's word shingles, as a long (64 bits)."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in each(batches):
            yield pa.array([fingerprint_of(x.as_py(), words) for x in batch], pa.int64())

    return of(text.cast("binary"))


class Golay:
    """Nearest codewords of 23-bit words, by syndrome tables."""

    def __init__(self) -> None:
        bits = [self._remainder(1 << i) for i in range(23)]
        self._parts = [np.array([self._of(byte, bits[at : at + 8]) for byte in range(256)]) for at in (0, 8, 16)]
        self._leader = np.zeros(1 << 11, np.int64)
        codewords = np.array([(m << 11) | self._remainder(m << 11) for m in range(1 << 12)])
        seven = codewords[np.bitwise_count(codewords) == 7]
        self._near: list[np.ndarray] = [np.zeros(1, np.int64)] * (1 << 11)
        for weight in range(1, 4):
            for places in combinations(range(23), weight):
                error = sum(1 << i for i in places)
                at = int(self.syndrome(np.array([error]))[0])
                self._leader[at] = error
                if weight == 3:  # at a distance of 4 are the codewords whose seven ones hold the error's
                    self._near[at] = np.r_[0, seven[(seven & error) == error]]

    @staticmethod
    def _remainder(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= _GENERATOR << (i - 11)
        return word

    @staticmethod
    def _of(byte: int, bits: list[int]) -> int:
        out = 0
        for i, value in enumerate(bits):
            if byte >> i & 1:
                out ^= value
        return out

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        low, middle, high = self._parts
        return low[words & 255] ^ middle[words >> 8 & 255] ^ high[words >> 16]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index (12 bits) of the codeword within 3 bits."""
        return (words ^ self._leader[self.syndrome(words)]) >> 11

    def within_four(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word, index) for every codeword within 4 bits."""
        syndromes = self.syndrome(words)
        sizes = np.array([len(x) for x in self._near])[syndromes]
        place = np.repeat(np.arange(len(words)), sizes)
        shift = np.concatenate([self._near[s] for s in syndromes]) if len(words) else np.zeros(0, np.int64)
        return place, ((words ^ self._leader[syndromes])[place] ^ shift) >> 11


_CODE: list[Golay] = []


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _CODE:
        _CODE.append(Golay())
    code = _CODE[0]
    for batch in each(batches):
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        words = prints.view("<u8")
        segments = [(words >> np.uint64(at) & np.uint64(mask)).astype(np.int64) for at, mask in _SEGMENTS]
        for i in range(3):
            exact, fuzzy = segments[i], segments[(i + 1) % 3]
            stem = (i << 34) | (exact << 12)
            place, index = code.within_four(fuzzy)
            for home, key, owner in ((True, stem | code.nearest(fuzzy), prints), (False, stem[place] | index, prints[place])):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(np.full(len(key), home))], names=["key", "fp", "home"])


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b) with a < b, once for every two different values of `prints` (fp long)
    that differ in at most `max_bits` bits."""
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"the segment keys find at most {MOST_BITS} differing bits")
    keys = saved(prints.select("fp").distinct().mapInArrow(_keys, "key long, fp long, home boolean"), "golay-keys")
    home = keys.where("home").select("key", F.col("fp").alias("x"))
    probe = keys.where("NOT home").select("key", F.col("fp").alias("y"))
    close = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits)
    met = home.join(probe, (home.key == probe.key) & close)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, component_id, group) for each different fp of `prints` (id, fp).

    `component_id` is the smallest id that links reach, null if all of them are
    null; `group` is the smallest fp (as a signed number) of the component.
    """
    lows = prints.groupBy("fp").agg(F.min("id").alias("low"))
    label = components(saved(links(prints, max_bits), "links"))
    linked = lowest(label, lows.select("fp", "low", F.col("fp").alias("node")), component_id="low", group="fp")
    whole = lows.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    whole = whole.select("fp", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("group", "fp").alias("group"))
    return saved(whole, "classes")  # a join with it deals both sides anew, and Spark can split copies


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, fp (long), component_id and group; see `classes`.

    A null or empty text has the fingerprint 0 and is linked like any other.
    Rows with a null id take part. Repeated rows stay. Other columns are not read.
    """
    prints = saved(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp")), "fingerprints")
    found = prints.join(classes(prints, max_bits), "fp", "left")
    return found.select(F.col("id").alias(id_col), "fp", "component_id", "group")


def one_of_each(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: the one with the smallest id, null last.

    Of rows that repeat that id inside the component it is the one whose digest
    (SHA-256 of the row as JSON) is smallest; rows with one digest are equal, and
    one of them stays. So the result does not depend on partitions. Texts are
    hashed once. Representatives are picked by partial minima of each fingerprint
    before anything is joined by fingerprint, so copies meet in no task.
    """
    row = F.struct("*")
    marked = docs.select(F.col(id_col).alias("id"), F.sha2(F.to_json(row), 256).alias("digest"), row.alias("row"))
    prints = saved(marked.select("id", "digest", fingerprint(F.col(f"row.{text_col}"), words).alias("fp")), "fingerprints")
    best = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    lows = saved(prints.groupBy("fp").agg(F.min(best).alias("best")), "fingerprint-firsts")
    first = lows.join(classes(prints.select("id", "fp"), max_bits), "fp").groupBy("group").agg(F.min("best").alias("best"))
    first = saved(first.select(F.col("best.digest").alias("digest")), "representatives")
    met = marked.join(first, "digest")
    # Without equal rows nothing is shuffled for them.
    repeated = prints.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.join(first, "digest", "left_semi").isEmpty():
        met = met.dropDuplicates(["digest"])
    return met.select("row.*")


def hex_of(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
