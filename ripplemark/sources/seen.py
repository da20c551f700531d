"""Seen marks: which changed lines of which hunks somebody has looked at, kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions.extract import lines

SCHEMA = "path string, key string, line int"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, line) of a store; empty where there is none yet."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path).distinct()


def hunks(spark: SparkSession, diff: str) -> DataFrame:
    """(path, ord, start, changed, content, key) of a unified diff."""
    rows = [(h["path"], h["ord"], h["start"], h["changed"], h["content"], h["key"]) for h in lines.unified(diff)]
    return spark.createDataFrame(rows, "path string, ord int, start int, changed int, content string, key string")


def toggled(seen: DataFrame, hunks_: DataFrame, path: str) -> DataFrame:
    """The marks after a file is marked whole, or unmarked if it was."""
    of_file = hunks_.where(F.col("path") == path)
    every = of_file.select("path", "key", F.explode(F.sequence(F.lit(0), F.col("changed") - 1)).alias("line"))
    rest = seen.where(F.col("path") != path)
    missing = every.join(seen, ["path", "key", "line"], "left_anti")
    return rest if missing.isEmpty() else rest.unionByName(every)


def write(seen: DataFrame, path: str) -> None:
    seen.coalesce(1).write.mode("overwrite").json(path)
