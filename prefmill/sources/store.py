"""Tables that are stored once and read several times: lineage ends here, and a lost executor costs a read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder in local mode, if it is unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="prefmill-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def note(path: str) -> str:
    """A path that release() shall delete."""
    _STORED.append(path)
    return path


def store(df: DataFrame, tag: str = "table") -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = note(f"{folder(spark)}/{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables stored so far, and says how many: for when no result that reads them is needed any more."""
    hadoop, n = spark._jvm.org.apache.hadoop.fs, len(_STORED)
    while _STORED:
        p = hadoop.Path(_STORED.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n
