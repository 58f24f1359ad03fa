"""Tables that cut lineage: written into the folder that driver and executors share, then read back."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and driver and executors are one machine (as in tests) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "weftline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Spark's own clean-up of an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
#: By session: how many tables are being written, and the setting before the first of them.
_WRITING: dict[int, list] = {}


def _begin(spark: SparkSession) -> None:
    with _LOCK:
        state = _WRITING.setdefault(id(spark), [0, spark.conf.get(CLEANUP, "false")])
        state[0] += 1
        spark.conf.set(CLEANUP, "true")


def _end(spark: SparkSession) -> None:
    with _LOCK:
        state = _WRITING[id(spark)]
        state[0] -= 1
        if not state[0]:
            spark.conf.set(CLEANUP, _WRITING.pop(id(spark))[1])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder. It outlives the call because results are lazy.

    The shuffle files of this one execution are dropped when it ends, since its result is on disk. Threads may write at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    _begin(spark)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        _end(spark)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() made of these, once nothing that is still to be computed reads it."""
    for df in tables:
        spark = df.sparkSession
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/weftline/" in path:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
