"""Cutting lineage where a loop would let it grow."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint.

    The files are in the folder that ``spark.checkpoint.dir`` names, which all
    executors share. Only a local session that names none gets one of its own.
    They go when the driver ends.
    """
    path = _folder(df.sparkSession)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(path)
    return df.checkpoint()


def _folder(spark: SparkSession):
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ripplemark-"))
    return spark._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir().get())  # the session's own


class Written:
    """A table written beside the checkpoints, for rows by the million: columns take a fraction of a checkpoint's bytes.

    ``df`` reads it; ``drop()`` deletes its files once no reader needs them. Those that are not dropped go when the
    driver ends. The shuffles that made it, and those before it, go at once: Spark deletes them when the driver has
    collected what refers to them, which it would do too late for a loop.
    """

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark), f"written-{uuid.uuid4().hex}")
        self.store = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.store.deleteOnExit(self.path)
        spark._jvm.System.gc()  # what the last write still referred to when it ended
        df.write.option("compression", "zstd").parquet(self.path.toString())
        self.df = spark.read.schema(df.schema).parquet(self.path.toString())
        spark._jvm.System.gc()

    def drop(self) -> None:
        self.store.delete(self.path, True)
        self.store.cancelDeleteOnExit(self.path)
