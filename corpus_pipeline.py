"""From raw documents to a training mix: quality, exact and near duplicates, contamination, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the rows it keeps, all but the last with the columns of
``documents``. Between stages the rows are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.llm import decontaminate, exact_dedup, mixing, quality, simhash
from ripplemark.llm.scratch import Saved


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least a half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select(docs, labels, quality.label_grade(), quality.N_GRADES)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with similar five-word shingles, the row with the smallest doc_id."""
    return simhash.similar_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
]

#: A fitted classifier and components of fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (_, stage) in enumerate(STAGES[:-1]):
        now = Saved(stage(spark, docs, sf_dir), f"stage{n + 1}")
        if last:
            last.drop()
        docs, last = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
