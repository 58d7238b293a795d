"""Byte-level BPE: recursive DuckDB queries inside each task merge and decode token-position rows."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import KEPT, release
from .text import chunks

#: Characters of text that a task works on at a time (a longer text comes alone).
GROUP_CHARS = 1 << 22
#: Rows of a batch whose texts are Python objects at a time.
GROUP_ROWS = 1200
#: Bytes of distinct pieces in one recursive query.
QUERY_BYTES = 1 << 19
#: Longer pieces go through a heap instead of the recursive query, whose rows add up over the steps.
SHORT_PIECE = 64
#: Bytes of the pieces, with their ids, that a task's process remembers; PIECE_BYTES are counted for each beside its own.
CACHE_BYTES = 80 << 20
PIECE_BYTES = 150
#: Ids decoded in one query.
DECODE_IDS = 1 << 18

#: Contract each word's leftmost pair of least rank, a step at a time, until no pair of the word is in the merge table.
MERGE_SQL = """
WITH RECURSIVE steps(step, word, pos, id) AS (
  SELECT 0, word, pos, id FROM pieces
  UNION ALL
  SELECT s.step + 1, s.word, s.pos, CASE WHEN s.pos = (b.best // 256) % 256 THEN (b.best // 65536)::INT ELSE s.id END
  FROM steps s
  JOIN (
    SELECT a.word, min(m.id::BIGINT * 65536 + a.pos * 256 + a.next_pos) AS best
    FROM (
      SELECT word, pos, id, lead(id) OVER w AS next, lead(pos) OVER w AS next_pos FROM steps
      WINDOW w AS (PARTITION BY word ORDER BY pos)
    ) a
    JOIN merges m ON a.id = m.l AND a.next = m.r
    GROUP BY a.word
  ) b ON s.word = b.word AND s.pos <> b.best % 256
)
SELECT word, id FROM steps
WHERE (step, word) IN (SELECT max(step), word FROM steps GROUP BY word)
ORDER BY word, pos
"""
DECODE_SQL = """
SELECT word, unhex(array_to_string(list(hex ORDER BY pos), '')) AS raw FROM ids JOIN tokens USING (id) GROUP BY word
"""


class Codec:
    """Encoder and decoder of one rank file; lives in the worker process until a task of another operator comes."""

    _made: dict[int, Codec] = {}

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Codec:
        key = hash((ranks, pattern))
        if key not in cls._made:
            cls._made[key] = cls(ranks, pattern)
        return cls._made[key]

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.pattern = regex.compile(pattern)
        missing = [i for i in range(256) if bytes([i]) not in self.ranks]
        if missing:
            raise ValueError(f"the rank file lacks single bytes: {missing[:5]}")
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        rows = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        merges = np.array(rows, np.int32).reshape(-1, 3)
        self.db = duckdb.connect(":memory:")
        for setting in ("threads=1", "memory_limit='350MB'", "temp_directory=''"):
            self.db.execute(f"SET {setting}")
        tables = {
            "merges": pa.table({"l": merges[:, 0], "r": merges[:, 1], "id": merges[:, 2]}),
            "tokens": pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}),
        }
        for name, rows in tables.items():
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _rows(self, raws: list[bytes]) -> pa.Table:
        size = np.array([len(x) for x in raws])
        flat = np.frombuffer(b"".join(raws), np.uint8)
        word = np.repeat(np.arange(len(raws), dtype=np.int32), size)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        return pa.table({"word": word, "pos": pos, "id": self.single[flat]})

    @staticmethod
    def _split(rows: pa.Table, n: int) -> list[bytes]:
        word, ids = rows["word"].to_numpy(), np.ascontiguousarray(rows["id"].to_numpy().astype(np.int32))
        ends = np.searchsorted(word, np.arange(n), "right")
        return [ids[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]

    def merge(self, raws: list[bytes]) -> list[bytes]:
        """The ids (32-bit, little-endian) of short pieces by one recursive query."""
        self.db.register("pieces", self._rows(raws))
        out = self.db.sql(MERGE_SQL).to_arrow_table()
        self.db.unregister("pieces")
        return self._split(out, len(raws))

    def merge_long(self, raw: bytes) -> bytes:
        """The ids of one long piece by the same rule, from a heap of pairs: the steps of a recursive query
        would each copy all of the piece's rows, the square of its length in all."""
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(len(raw))]
        before, after = list(range(-1, len(raw) - 1)), list(range(1, len(raw) + 1))
        rank = self.ranks.get
        heap = [(r, i) for i in range(len(raw) - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(raw) or rank(parts[i] + parts[j]) != r:
                continue  # one of the two has been merged with another
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < len(raw):
                before[k] = i
                if (q := rank(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (q, i))
            h = before[i]
            if h >= 0 and (q := rank(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (q, h))
        return np.array([rank(x) for x in parts if x is not None], np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: its pieces by the pattern, each merged by itself."""
        split = [self.pattern.findall(t) for t in texts]
        new = {p for pieces in split for p in pieces if p not in self.known}
        fresh = {}
        todo = []
        for p in new:
            raw = p.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is not None:
                fresh[p] = np.int32(rank).tobytes()
            elif len(raw) > SHORT_PIECE:
                fresh[p] = self.merge_long(raw)
            else:
                todo.append((p, raw))
        for run in chunks(todo, lambda x: len(x[1]), QUERY_BYTES):
            fresh.update(zip((p for p, _ in run), self.merge([raw for _, raw in run])))
        self.known.update(fresh)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32) for pieces in split]
        for p, ids in fresh.items():
            size = PIECE_BYTES + len(p) + len(ids)
            if self.held + size > CACHE_BYTES:
                del self.known[p]
            else:
                self.held += size
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids, in order of position; an id outside the vocabulary is an error."""
        out: list[bytes] = []
        for run in chunks(ids, len, DECODE_IDS):
            size = np.array([len(x) for x in run])
            flat = np.concatenate(run).astype(np.int32)
            if len(flat) and not (0 <= flat.min() and np.isin(np.unique(flat), self._all()).all()):
                raise ValueError("an id is not in the vocabulary")
            word = np.repeat(np.arange(len(run), dtype=np.int32), size)
            self.db.register("ids", pa.table({"word": word, "pos": np.arange(len(flat)), "id": flat}))
            rows = self.db.sql(DECODE_SQL).to_arrow_table()
            self.db.unregister("ids")
            found = dict(zip(rows["word"].to_pylist(), rows["raw"].to_pylist()))
            out += [found.get(i, b"") for i in range(len(run))]
        return out

    def _all(self) -> np.ndarray:
        if not hasattr(self, "_ids"):
            self._ids = np.array(sorted(self.ranks.values()), np.int32)
        return self._ids


KEPT.append(Codec._made)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def _ids_of(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x or [], np.int32) for x in column.to_pylist()]


def _apply(df: DataFrame, ranks_path: str, pattern: str, source: str, outs: list[StructField], work) -> DataFrame:
    """Add columns made by ``work(codec, columns of a group) -> arrays`` in one pass over each partition."""
    names = [f.name for f in outs]
    kept = [c for c in df.columns if c not in names or c == source]
    src = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(source)
    shared = df.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    text = src.schema[source].dataType.typeName() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(shared.value, pattern)
        for b in batches:
            for top in range(0, b.num_rows, GROUP_ROWS):
                column = b.column(at).slice(top, GROUP_ROWS)
                values = [t or "" for t in column.to_pylist()] if text else _ids_of(column)
                start = top
                for group in chunks(values, lambda v: len(v) + 1, GROUP_CHARS):
                    part = b.slice(start, len(group))
                    start += len(group)
                    yield pa.RecordBatch.from_arrays([*part.columns, *work(codec, group)], names=[*kept, *names])
        release(Codec._made)

    return src.mapInArrow(run, StructType([*src.schema.fields, *outs]))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of each row's whole text (null: none), without special tokens. A column ``out`` is replaced."""
    return _apply(df, ranks_path, pattern, text, [StructField(out, ArrayType(IntegerType()))], lambda c, g: [_lists(c.encode(g))])


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "raw") -> DataFrame:
    """Add the bytes of each row's ids (null or empty: none). A column ``out`` is replaced."""
    return _apply(df, ranks_path, pattern, ids, [StructField(out, BinaryType())], lambda c, g: [pa.array(c.decode(g), pa.binary())])


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` and their decoded bytes ``raw`` in one pass: encode() and decode() in the same process."""

    def work(codec: Codec, group: list[str]) -> list[pa.Array]:
        ids = codec.encode(group)
        return [_lists(ids), pa.array(codec.decode(ids), pa.binary())]

    return _apply(df, ranks_path, pattern, text, [StructField("ids", ArrayType(IntegerType())), StructField("raw", BinaryType())], work)


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every document."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(rows, ranks_path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(joined, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.col("raw"), 256).alias("decoded_sha256"),
    )
