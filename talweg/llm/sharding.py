"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import bucket_bits, materialise

#: Bytes that a record takes in a shard besides its text.
RECORD_BYTES = 8


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. A key's shard changes with the count only to a new, last shard."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = jump[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = np.floor((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def _fresh(name: str, columns: list[str]) -> str:
    """The name, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def assign(df: DataFrame, key: str, shards: int, out: str = "shard", grown: str | None = None) -> DataFrame:
    """Add the shard of each row's key, and with ``grown`` the shard with one more.

    Ties: equal keys share a shard. A null key counts as the key 0. Columns named like the new ones are replaced, all
    others stay, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    names = [out, *([grown] if grown else [])]
    kept = [c for c in df.columns if c not in names]
    hashed = F.coalesce(F.xxhash64(F.col(_quoted(key))), F.lit(0))
    src = df.select(*[F.col(_quoted(c)) for c in kept], hashed.alias("_key"))
    plain = [f"c{i}" for i in range(len(kept) + 1)]  # names with dots don't pass mapInArrow
    fields = [StructField(p, f.dataType) for p, f in zip(plain, src.schema.fields[:-1])] + [StructField(n, IntegerType()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            more = [pa.array(jump_hash(keys, shards + i).astype(np.int32)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*plain[:-1], *names])

    return src.toDF(*plain).mapInArrow(run, StructType(fields)).toDF(*kept, *names)


def with_slots(df: DataFrame, group: str, order: str, out: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps, in order of a hash prefix and then ``order``.

    Counts by (group, hash prefix) give each prefix its first number, so the rows of a group are spread
    over many tasks. Rows with equal ``order`` are numbered in any order; their other columns decide nothing. Null groups
    are one group, null ``order`` comes like any value. A column named like the new one is replaced, all others stay.
    """
    df = materialise(df.drop(out) if out not in (group, order) else df)
    names = df.columns
    bits = bucket_bits(df.count())
    prefix, n, first, rank, own = (_fresh(c, names) for c in ("_hb", "_n", "_first", "_rank", "_group"))
    g, o = _quoted(group), _quoted(order)
    marked = df.withColumn(prefix, F.shiftrightunsigned(F.xxhash64(F.col(o)), 64 - bits))
    counts = marked.groupBy(F.col(g).alias(own), prefix).agg(F.count(F.lit(1)).alias(n))
    starts = counts.selectExpr(own, f"{prefix} as {prefix}o", f"sum({n}) over (partition by {own} order by {prefix}) - {n} as {first}")
    ranked = marked.selectExpr("*", f"row_number() over (partition by {g}, {prefix} order by {o}) - 1 as {rank}")
    joined = ranked.join(starts, ranked[g].eqNullSafe(starts[own]) & (ranked[prefix] == starts[f"{prefix}o"]))
    return joined.select(*[F.col(_quoted(c)) for c in names], (F.col(first) + F.col(rank)).cast("long").alias(out))


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Placement of every document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``key``: the id and the shard count decide. Null or empty text has size 8 and checksum 0.
    Repeated ids share a shard and take a slot each. A null id counts as the key 0. Texts of any length are only measured.
    Other columns of the table, whatever their names, are left out.
    """
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    placed = assign(rows, "doc_id", shards, "shard", "grown_shard")
    return with_slots(placed, "shard", "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, shards: int, path: str) -> None:
    """Write the rows into one folder per shard; a shard may hold several files."""
    assign(docs, "doc_id", shards, "shard").write.partitionBy("shard").mode("overwrite").parquet(path)
