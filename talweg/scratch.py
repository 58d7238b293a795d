"""Tables between steps: lineage ends at Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a temporary one in local mode; elsewhere an error."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="talweg-"))
        place = spark.sparkContext.getCheckpointDir()
    return f"{place.rstrip('/')}/talweg-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def mounted_path(spark: SparkSession) -> str:
    """A new place in the shared folder as a path of the file system, where that folder is one."""
    path = urlparse(scratch_path(spark))
    if path.scheme not in ("", "file"):
        raise RuntimeError(f"a folder of the file system is needed, not {path.scheme}")
    Path(path.path).parent.mkdir(parents=True, exist_ok=True)
    return path.path


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder matches a pattern."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def cut(df: DataFrame) -> DataFrame:
    """Write a frame into the shared folder and read it again, so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames that cut() returned and that no later plan reads."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
