"""Byte-level BPE encoding and decoding with DuckDB queries inside Spark's tasks.

A text is cut into pieces by the tokenizer's pattern. A piece that is a token
is that token. The other different pieces of a chunk of texts become rows
(piece, position, token), one for each byte, and a recursive query contracts
in every piece the leftmost pair of the smallest rank until no pair is left
in the merge table. Decoding joins the ids with the vocabulary and
concatenates the bytes of a text in an ordered aggregate.

Every row is encoded by itself, so nothing is shuffled. A task holds one
chunk of texts, a segment of a very long text, and a bounded set of pieces
that it has met; the vocabulary (under 1 MB) is sent once to each executor.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession, functions as F, types as T

from classmeter.llm.common import each, give_back

# Characters of text that go through the queries together. A worker's memory follows it: pieces that
# are contracted together, pieces remembered (met in two chunks, or in one; either kind is forgotten
# when there are too many) and the database's memory are shares of it.
CHUNK = 2_000_000
TOGETHER, REMEMBERED, NEW, BYTES = 1 / 64, 1 / 5, 3 / 20, 100
# The recursive query makes rows in the square of a piece's length. Longer
# pieces (in bytes) are contracted by `contract_long`, which gives the same ids.
LONG_PIECE = 256
# Steps of the recursive query keep the rank and the position in one number.
_POSITIONS = 1 << 20

_ENCODE = f"""
WITH RECURSIVE steps(piece, done, pos, id) AS (
    SELECT piece, false, pos, id FROM bytes_of
    UNION ALL
    (WITH placed AS (
        SELECT piece, pos, id,
               lead(piece) OVER line AS after_piece, lead(id) OVER line AS after_id,
               lag(piece) OVER line AS before_piece, lag(pos) OVER line AS before_pos
        FROM steps WHERE NOT done WINDOW line AS (ORDER BY piece, pos)
    ), pairs AS MATERIALIZED (
        SELECT p.piece, p.pos, p.id, CASE WHEN before_piece = p.piece THEN before_pos END AS before,
               m.merged::BIGINT * {_POSITIONS} + p.pos AS cost
        FROM placed p
        LEFT JOIN merges m ON m.left_id = p.id AND m.right_id = p.after_id AND p.after_piece = p.piece
    ), least AS (
        SELECT piece, min(cost) AS best FROM pairs GROUP BY piece
    )
    SELECT p.piece, best IS NULL, pos,
           CASE WHEN pos = best % {_POSITIONS} THEN (best // {_POSITIONS})::INTEGER ELSE id END
    FROM pairs p JOIN least USING (piece)
    WHERE best IS NULL OR before IS NULL OR before <> best % {_POSITIONS})
)
SELECT piece, list(id::UINTEGER ORDER BY pos) AS ids
FROM steps WHERE done GROUP BY piece ORDER BY piece
"""

_DECODE = """
SELECT r.text, string_agg(v.latin, '' ORDER BY r.pos) AS latin
FROM token_rows r JOIN vocabulary v ON v.id = r.id GROUP BY r.text
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64, blank, rank in each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def contract_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long piece: a heap of pairs over a linked list of tokens."""
    import heapq

    n = len(piece)
    start, after, before = list(range(n + 1)), list(range(1, n + 2)), list(range(-1, n))
    alive = [True] * n + [False]

    def pair(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        if j >= n:
            return None
        end = after[j] if after[j] <= n else n
        rank = ranks.get(piece[start[i] : end])
        return None if rank is None else (rank, i, end)

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        found = heapq.heappop(heap)
        i = found[1]
        if not alive[i] or pair(i) != found:
            continue
        j = after[i]
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    return [ranks[piece[i : min(after[i], n)]] for i in range(n) if alive[i]]


class Coder:
    """Vocabulary, merge table and the pieces met so far, in one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK):
        self.ranks, self.pattern, self.chunk = ranks, regex.compile(pattern), chunk
        self.together = max(1, int(TOGETHER * chunk))
        self.cut = regex.compile(r"(?<=\S)\s")
        self.known: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self._db: duckdb.DuckDBPyConnection | None = None
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        ids = pa.int32()
        latin = [t.decode("latin-1") for t in ranks]
        self.tables = {
            "merges": pa.table([pa.array(x, ids) for x in (left, right, merged)], names=["left_id", "right_id", "merged"]),
            "vocabulary": pa.table({"id": pa.array(list(ranks.values()), ids), "latin": latin}),
        }
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    @property
    def db(self) -> duckdb.DuckDBPyConnection:
        """A database in memory, opened when it is needed."""
        if self._db is None:
            self._db = duckdb.connect(config={"threads": 1, "memory_limit": f"{max(64, BYTES * self.chunk // 1_000_000)}MB", "preserve_insertion_order": False})
            for name, rows in self.tables.items():
                self._db.register("given", rows)
                self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
                self._db.unregister("given")
        return self._db

    def rest(self) -> None:
        """After a task: only the merges and the pieces met often stay in memory."""
        self.new.clear()
        if self._db is not None:
            self._db.close()
            self._db = None
        give_back()

    def segments(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a long one in several lists.

        It is cut before a white space that follows something else; no piece
        reaches across such a place or depends on what lies beyond it.
        """
        at = 0
        while len(text) - at > self.chunk:
            place = self.cut.search(text, at + self.chunk)
            if place is None:
                break
            yield self.pattern.findall(text, at, place.start())
            at = place.start()
        yield self.pattern.findall(text, at)

    def ids_of(self, pieces: set[str]) -> dict[str, bytes]:
        """The packed ids of each piece; the queries get those that are not known yet."""
        found: dict[str, bytes] = {}
        rest, rest_bytes, fresh = [], [], {}
        for piece in pieces:
            ids = self.known.get(piece)
            if ids is None:
                ids = self.new.pop(piece, None)
                if ids is not None:
                    self.known[piece] = ids
                else:
                    raw = piece.encode("utf-8", "replace")
                    rank = self.ranks.get(raw)
                    if rank is not None:
                        ids = fresh[piece] = rank.to_bytes(4, "little")
                    elif len(raw) > LONG_PIECE:
                        ids = np.array(contract_long(raw, self.ranks), "<u4").tobytes()
                    else:
                        rest.append(piece), rest_bytes.append(raw)
                        continue
            found[piece] = ids
        for at in range(0, len(rest), self.together):
            fresh.update(self._contract(rest[at : at + self.together], rest_bytes[at : at + self.together]))
        found.update(fresh)
        if len(self.known) > REMEMBERED * self.chunk:
            self.known.clear()
        if len(self.new) + len(fresh) > NEW * self.chunk:
            self.new.clear()
        self.new.update(fresh)
        return found

    def _contract(self, pieces: list[str], raw: list[bytes]) -> Iterator[tuple[str, bytes]]:
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        which = np.repeat(np.arange(len(raw)), lengths)
        pos = np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        self.db.register("bytes_of", pa.table({"piece": which.astype(np.int32), "pos": pos.astype(np.int32), "id": ids}))
        found = self.db.sql(_ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("bytes_of")
        packed = found.flatten().to_numpy().astype("<u4").tobytes()
        ends = (4 * found.value_lengths().to_numpy().astype(np.int64)).cumsum().tolist()
        return ((piece, packed[a:b]) for piece, a, b in zip(pieces, [0, *ends], ends))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def close() -> None:
            found = self.ids_of(set().union(*(pieces for _, pieces in held)))
            for i, pieces in held:
                out[i].append(b"".join([found[p] for p in pieces]))
            held.clear()

        for i, text in enumerate(texts):
            for pieces in self.segments(text or ""):
                held.append((i, pieces))
                size += sum(map(len, pieces))
                if size >= self.chunk:
                    close()
                    size = 0
        close()
        return [b"".join(x) for x in out]

    def decode(self, texts: list[bytes | None]) -> list[bytes]:
        """The bytes of each text's ids."""
        out: list[list[bytes]] = [[] for _ in texts]
        step = max(1, self.chunk // 4)
        parts = [(i, np.frombuffer(t, "<u4")[a : a + step]) for i, t in enumerate(texts) if t for a in range(0, len(t) // 4, step)]
        while parts:
            size, taken = 0, 0
            while taken < len(parts) and (not taken or size + len(parts[taken][1]) <= step):
                size += len(parts[taken][1])
                taken += 1
            group, parts = parts[:taken], parts[taken:]
            ids = np.concatenate([p for _, p in group]).astype(np.int32)
            which = np.repeat(np.arange(len(group), dtype=np.int32), [len(p) for _, p in group])
            self.db.register("token_rows", pa.table({"text": which, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            got = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("token_rows")
            for k, latin in sorted(zip(got.column("text").to_pylist(), got.column("latin").to_pylist())):
                out[group[k][0]].append(latin.encode("latin-1"))
        return [b"".join(x) for x in out]


_CODERS: dict[int, Coder] = {}


def _coder(shared, pattern: str, chunk: int) -> Coder:
    """One coder in each worker, for one vocabulary at a time."""
    if shared.id not in _CODERS:
        _CODERS.clear()
        _CODERS[shared.id] = Coder(shared.value, pattern, chunk)
    return _CODERS[shared.id]


class _Shared:
    """A vocabulary as a broadcast; `id` names it in the workers."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], id_: int):
        self.id, self._of = id_, spark.sparkContext.broadcast(ranks)

    @property
    def value(self) -> dict[bytes, int]:
        return self._of.value


def _groups(array: pa.Array, chunk: int) -> Iterator[pa.Array]:
    """Slices of a batch with about two chunks of bytes each."""
    size = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    mark = np.cumsum(size, dtype=np.int64) // (2 * chunk)
    starts = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]]) if len(mark) else np.array([0])
    for a, b in zip(starts, np.r_[starts[1:], len(array)]):
        yield array.slice(a, b - a)


class ByteBpe:
    """Column functions that encode and decode with the ranks in `path`.

    The rank file is read on the driver. Ids are packed: four bytes each,
    little-endian, unsigned. A null or empty text has no ids (empty binary);
    null or empty ids decode to no bytes. Characters that UTF-8 cannot hold
    are encoded as question marks. `chunk` bounds the memory of a Python worker:
    a smaller one needs less and takes longer; the ids are the same.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str, chunk: int = CHUNK):
        ranks = read_ranks(path)
        self._shared = _Shared(spark, ranks, hash((path, pattern, len(ranks), chunk)))
        self._pattern, self._chunk = pattern, chunk

    def _column(self, kind: T.DataType, work: Callable[[Coder, list], pa.Array]) -> Callable[[Column], Column]:
        """A column function that hands on slices of a few MB, so that a batch is never held twice."""
        shared, pattern, chunk = self._shared, self._pattern, self._chunk

        @F.arrow_udf(kind)
        def done(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            coder = _coder(shared, pattern, chunk)
            for batch in batches:
                for part in each(_groups(batch, chunk)):
                    yield work(coder, part.to_pylist())
            coder.rest()

        return done

    def encode(self, text: Column) -> Column:
        return self._column(T.BinaryType(), lambda coder, texts: pa.array(coder.encode(texts), pa.binary()))(text)

    def decode(self, ids: Column) -> Column:
        return self._column(T.BinaryType(), lambda coder, packed: pa.array(coder.decode(packed), pa.binary()))(ids)

    def round_trip(self, text: Column) -> Column:
        """Both in one Python worker: a struct of ids and decoded."""

        def both(coder: Coder, texts: list) -> pa.Array:
            ids = coder.encode(texts)
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(coder.decode(ids), pa.binary())], names=["ids", "decoded"])

        return self._column(T.StructType().add("ids", "binary").add("decoded", "binary"), both)(text)


def count(ids: Column) -> Column:
    """How many ids a packed column holds."""
    return (F.octet_length(ids) / 4).cast("long")
