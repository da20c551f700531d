"""Calls that an external resolver reports: lines of ``site target``, each ``path:line`` or ``path:line:column``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r"^\s*(\S+?):(\d+)(?::\d+)?\s+(\S+?):(\d+)(?::\d+)?\s*$"


def _relative(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    inside = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)) if root else F.lit(None)
    return F.regexp_replace(F.coalesce(inside, path), r"^(\./)+", "")


def parse(lines: DataFrame, root: str = "") -> DataFrame:
    """(from_path, from_line, to_path, to_line) of a column ``value``; other lines are skipped."""
    part = lambda n: F.regexp_extract("value", _LINE, n)
    rows = lines.where(F.col("value").rlike(_LINE)).select(
        _relative(part(1), root).alias("from_path"), part(2).cast("int").alias("from_line"),
        _relative(part(3), root).alias("to_path"), part(4).cast("int").alias("to_line"),
    )
    return rows.where(~F.startswith("from_path", F.lit("/")) & ~F.startswith("to_path", F.lit("/"))).distinct()


def read(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    return parse(spark.read.text(path), root)
