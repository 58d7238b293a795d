"""Shards against the scalar algorithm over all documents, and columns of any name."""

import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from talweg.llm import sharding


def scalar_jump(key, shards):
    """One key's shard, drawn step by step."""
    at, jump = -1, 0
    while jump < shards:
        at = jump
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        jump = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_documents_by_the_scalar_algorithm(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    rows = sharding.shard_documents(docs, 24).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        key = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        assert (r.shard, r.grown_shard) == (scalar_jump(key, 24), scalar_jump(key, 25))
        assert r.grown_shard in (r.shard, 24)
        assert (r["size"], r.text_crc32, r.law) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "key")
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_columns_of_any_name_stay(spark):
    df = spark.range(40).select((F.col("id") % 9).alias("a.b"), F.col("id").alias("_key"), *[F.col("id").alias(c) for c in ("_hb", "_n", "_first", "_rank", "_group", "shard")])
    df = df.withColumn("a.b", F.when(F.col("_key") % 9 != 4, F.col("`a.b`")))
    placed = sharding.assign(df, "a.b", 5, "shard")
    assert placed.columns == df.columns
    out = sharding.with_slots(placed, "a.b", "shard").withColumnRenamed("a.b", "g").collect()
    assert sorted(r["_key"] for r in out) == list(range(40))
    assert all(r["_key"] == r["_hb"] == r["_n"] == r["_first"] == r["_rank"] == r["_group"] for r in out)
    groups = {}
    for r in out:
        groups.setdefault(r.g, []).append(r.slot)
    assert len(groups) == 9 and all(sorted(s) == list(range(len(s))) for s in groups.values())
