"""Results of external analysers, from SARIF 2.1 logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "runs array<struct<tool: struct<driver: struct<name: string>>, results: array<struct<ruleId: string, level: string, "
    "message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, "
    "region: struct<startLine: int>>>>>>>>"
)


def relative(uri: Column, root: str = "") -> Column:
    """A result's path within the repository."""
    path = F.regexp_replace(uri, "^file://", "")
    if root:
        prefix = root.rstrip("/") + "/"
        path = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    return F.regexp_replace(path, r"^(\./)+", "")


def read(spark: SparkSession, path: str | list[str], root: str = "") -> DataFrame:
    """(tool, rule_id, level, message, path, line) of results that say where they are."""
    log = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    run = log.select(F.explode("runs").alias("run"))
    each = run.select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    return each.select(
        "tool", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"),
        relative(place["artifactLocation"]["uri"], root).alias("path"), place["region"]["startLine"].alias("line"),
    ).where("path IS NOT NULL AND line IS NOT NULL")


def on_added_lines(results: DataFrame, added: DataFrame) -> DataFrame:
    """Findings of the results that sit on an added line; ``added`` has path, line, text."""
    rule_id = F.coalesce("rule_id", F.lit("result"))
    lines = added.groupBy("path", "line").agg(F.first("text").alias("text"))
    return results.join(lines, ["path", "line"]).select(
        F.concat(F.lower(F.coalesce("tool", F.lit("sarif"))), F.lit("/"), rule_id).alias("rule"),
        F.when(F.coalesce("level", F.lit("warning")) == "error", "medium").otherwise("low").alias("severity"),
        F.coalesce("message", rule_id).alias("title"), "path", "line", F.lit(None).cast("string").alias("function"),
        F.trim("text").alias("excerpt"),
    )
