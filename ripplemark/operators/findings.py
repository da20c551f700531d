"""Findings after the rules: order, duplicates, folds, counts, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: severities, the most severe first.
SEVERITIES = ("high", "medium", "low")


def severity_rank(severity: Column) -> Column:
    """0 for the most severe."""
    out = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, rule, path, line."""
    return findings.orderBy(severity_rank(F.col("severity")), "rule", "path", "line")


def without_repeats(findings: DataFrame) -> DataFrame:
    """One finding per rule, path, line and function: the most severe, then the first by title."""
    w = Window.partitionBy("rule", "path", "line", "function").orderBy(severity_rank(F.col("severity")), "title")
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fold(findings: DataFrame, folding: list[str]) -> DataFrame:
    """Of the rules named, one finding per rule, path and severity: the first, its title counting the rest."""
    group = Window.partitionBy("rule", "path", "severity")
    nth = F.row_number().over(group.orderBy("line", F.col("function").asc_nulls_first(), "title"))
    kept = findings.withColumn("_n", nth).withColumn("_all", F.count(F.lit(1)).over(group))
    folds = F.col("rule").isin(folding) if folding else F.lit(False)
    more = F.concat("title", F.lit(" (+"), (F.col("_all") - 1).cast("string"), F.lit(" more like it in this file)"))
    return (
        kept.where(~folds | (F.col("_n") == 1))
        .withColumn("title", F.when(folds & (F.col("_all") > 1), more).otherwise(F.col("title")))
        .drop("_n", "_all")
    )


def counts(findings: DataFrame) -> DataFrame:
    """One row: high, medium, low."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def fails(findings: DataFrame, level: str) -> DataFrame:
    """One row, whether any finding is at least as severe as ``level``."""
    bad = F.coalesce(F.bool_or(severity_rank(F.col("severity")) <= SEVERITIES.index(level)), F.lit(False))
    return findings.agg(bad.alias("fails"))
