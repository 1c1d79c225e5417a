"""Cutting lineage with tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir``.  Only where a session has none and runs
on this machine alone (tests, notebooks) a local folder is made and set; on a
cluster its absence is an error.  Files are written and
removed through Hadoop's file system API, so any store Spark can reach will do.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_run = uuid.uuid4().hex
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, ending without a slash."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="triagelake-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/triagelake-{_run}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and return it read back: later plans start from files, not from its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.triagelake_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the files behind a frame made by :func:`keep`; it can't be read afterwards."""
    remove(df.sparkSession, df.triagelake_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _purge() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session has gone; the folder's owner clears it
            return
