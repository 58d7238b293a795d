"""Shared plumbing of the corpus operators: word pattern, bounded key filters, sizes of buckets."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaClass, JavaObject
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut as materialise
from ..scratch import discard

__all__ = ["BUCKET_ROWS", "KEPT", "KEY_BUCKETS", "SPACE", "WORD", "bucket_bits", "bucket_flags", "collect_garbage", "discard", "key_bucket", "materialise", "release", "small_batches", "split_by_keys", "table"]

#: White space of the corpus contracts: the complement is a word character.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Hash buckets of the bounded key filter (a broadcast of at most this many longs).
KEY_BUCKETS = 1 << 20
#: Rows that one bucket of a distributed running sum should hold.
BUCKET_ROWS = 1 << 16
#: What operators hold in a process from task to task: dictionaries that a task of another operator empties.
KEPT: list[dict] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches: a few thousand long texts at a time would be most of a small executor's memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1024), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        try:
            now = int(spark.conf.get(key))
        except (ValueError, PySparkException):  # no such limit, or one with a unit
            now = 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def collect_garbage(spark: SparkSession) -> None:
    """Have executors and the driver give heap that is garbage back to the system before Python needs it: a JVM keeps what
    it has once taken. A few short tasks, as good as the scheduler spreads them; it changes no result."""
    release()
    spark.sparkContext._jvm.System.gc()
    n = max(2, spark.sparkContext.defaultParallelism)
    tasks = spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done"))
    tasks.write.format("noop").mode("overwrite").save()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Have the driver's JVM give back what its own code has freed outside the heap. Compiler threads and buffers take that
    by malloc, which keeps it: some 100 MB more with each run of the pipeline, however little is in use."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind: JavaClass, *items: object) -> JavaObject:
        out = gateway.new_array(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    try:  # by reflection: the server's class is hidden, its interface isn't
        named = jvm.Class.forName
        kinds = [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, *kinds))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = array(jvm.Object, commands, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String))
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # another JVM or C library
        pass


def release(keep: dict | None = None) -> None:
    """Give memory that a finished task has freed back to the system: Python workers stay for later tasks. What KEPT
    names goes too, all but ``keep``: the worker is at another operator now."""
    for held in KEPT:
        if held is not keep:
            held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def key_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS))


def split_by_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may occur in ``keys`` (one column), and rows whose key surely doesn't.

    A broadcast of at most KEY_BUCKETS bucket numbers decides, so the rows of the second part need
    no shuffle. Where the buckets are saturated every row is in the first part: slower, still right.
    """
    name = "_kb"
    while name in df.columns:
        name += "_"
    buckets = F.broadcast(keys.select(key_bucket(F.col(keys.columns[0])).alias(name)).distinct())
    tagged = df.withColumn(name, F.coalesce(key_bucket(F.col(key)), F.lit(-1)))
    return tagged.join(buckets, name, "left_semi").drop(name), tagged.join(buckets, name, "left_anti").drop(name)


def bucket_flags(keys: DataFrame) -> np.ndarray:
    """A table of KEY_BUCKETS flags: the buckets (low bits) of one column of hashes, gathered in 32 rows."""
    bucket = keys.select(F.col(keys.columns[0]).bitwiseAND(KEY_BUCKETS - 1).alias("k")).distinct()  # no more rows than flags
    row = KEY_BUCKETS // 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            k = b.column(0).to_numpy()
            for r in np.unique(k // row).tolist():
                found.setdefault(r, np.zeros(row, bool))[k[k // row == r] % row] = True
        rows = [np.packbits(v).tobytes() for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(rows, pa.binary())], names=["row", "bits"])

    flags = np.zeros(KEY_BUCKETS, bool)
    for r in bucket.repartition(32, F.floor(F.col("k") / row)).mapInArrow(run, "row long, bits binary").collect():
        flags[r["row"] * row : (r["row"] + 1) * row] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return flags


def bucket_bits(rows: int) -> int:
    """Bits of a hash prefix such that its buckets hold about BUCKET_ROWS of ``rows`` rows."""
    return max(4, min(30, (max(rows, 1) // BUCKET_ROWS).bit_length()))
