"""Tables that cut lineage.

They are Parquet files in the folder that the cluster names in
``spark.checkpoint.dir``, which the driver and all executors share, so a lost
executor costs a re-read and not a recomputation. A result may read them long
after the operator has returned; those that are not dropped before go when the
driver ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is set, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ripplemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Saved:
    """A written table: ``df`` reads it, ``drop()`` deletes its files once no reader needs them."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{folder(self.spark).rstrip('/')}/ripplemark/{label}-{uuid.uuid4().hex}"
        path, store = self._stored()
        store.deleteOnExit(path)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def _stored(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        path, store = self._stored()
        store.delete(path, True)
        store.cancelDeleteOnExit(path)


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Saved(df, label).df
