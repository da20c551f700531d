"""Exact duplicates by a tree-merge of sorted digest runs. DataFrame functions only.

Every row belongs to one of ``runs`` runs. A run lists, in digest order, each
text it holds once: digest, retained row, number of rows. It is written in
sorted parts, dealt by digest, so that no task holds a whole run. Round after
round, ``fan_in`` runs are exchanged, merged in digest order, and written as
one: neighbours that agree are one text, of which the best row stays. The
rounds form a binomial tree (with ``fan_in`` 4, two of its steps at a time).
A text that a third of all rows share is one row per run from the start. The
result comes back down by way of the first level, where a popular digest is
again spread over the runs.

Neighbours are verified before they are merged: they must agree in SHA-256, in
length and in an independent 64-bit hash. The texts themselves are not compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Saved, saved

RUNS = 64
FAN_IN = 4
_KEY = ["_sha", "_len", "_xx"]


def _keyed(id_col: str, text_col: str, normalise) -> list[Column]:
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    return [
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(text).alias("_xx"),
    ]


def _best(keep: str) -> Column:
    """What sorts the row that stays first: known ids by size, then the first row."""
    size = -F.col("_id") if keep == "largest" else F.col("_id")
    return F.struct(F.col("_id").isNull().alias("none"), size.alias("by"), F.col("_row").alias("row"), F.col("_id").alias("id"))


def _merged(level: DataFrame, fan_in: int) -> Saved:
    """Every ``fan_in`` runs exchanged and merged: of neighbours in digest order that agree, the best stays."""
    text = Window.partitionBy("_run", *_KEY).orderBy("_best")
    size = F.sum("_size").over(text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    exchanged = level.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
    merged = exchanged.select("_run", *_KEY, "_best", size.alias("_size"), F.row_number().over(text).alias("_nth"))
    return Saved(merged.where("_nth = 1").drop("_nth"), "run")


def _levels(rows: DataFrame, keep: str, runs: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """The first level of runs and the last, which is one run."""
    distinct = rows.groupBy("_run", *_KEY).agg(F.min(_best(keep)).alias("_best"), F.count(F.lit(1)).alias("_size"))
    first = level = Saved(distinct.sortWithinPartitions("_run", *_KEY), "run")
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        before, level = level, _merged(level.df, fan_in)
        if before is not first:
            before.drop()
    return first.df, level.df.drop("_run")


def _dealt(docs: DataFrame, id_col: str, text_col: str, runs: int, normalise) -> DataFrame:
    """Digests of all rows, read once; rows are numbered, so that null or repeated ids are spread over the runs too."""
    rows = docs.select(*_keyed(id_col, text_col, normalise)).withColumn("_row", F.monotonically_increasing_id())
    return saved(rows.withColumn("_run", F.pmod(F.xxhash64("_row"), F.lit(runs)).cast("int")), "digests")


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    runs: int = RUNS,
    fan_in: int = FAN_IN,
    normalise=lambda text: text,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Ids are numbers. ``normalise`` maps the text column before comparing (by
    default nothing changes). Null text counts as the empty text. Null ids join
    the group of their text but are retained only where the group has no other
    id, and then keep_id is null. Of rows that repeat both id and text, one is
    kept. Extra columns, whatever their names, play no part. An empty table
    gives no rows.
    """
    rows = _dealt(docs, id_col, text_col, runs, normalise)
    first, last = _levels(rows, keep, runs, fan_in)
    answers = first.select("_run", *_KEY).join(last.select(*_KEY, "_best", "_size"), _KEY)
    # a written table, as only a join of two shuffles can split the rows of a popular text
    answers = saved(answers, "answers")
    return rows.join(answers, ["_run", *_KEY]).select(
        F.col("_id").alias(id_col),
        F.col("_best.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_best.row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    runs: int = RUNS,
    fan_in: int = FAN_IN,
    normalise=lambda text: text,
) -> DataFrame:
    """``docs`` with the retained row of each group of equal texts, all columns.

    Nulls and repeated rows as in :func:`exact_groups`; of repeated rows that
    differ in other columns the one with the smallest hash of those stays.
    """
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), *_keyed(id_col, text_col, normalise))
    _, last = _levels(_dealt(docs, id_col, text_col, runs, normalise), keep, runs, fan_in)
    won = last.select(*[F.col(c).alias(f"{c}_w") for c in _KEY], F.col("_best.id").alias("_keep"))
    match = F.col("_id").eqNullSafe(F.col("_keep"))
    for c in _KEY:
        match = match & (F.col(c) == F.col(f"{c}_w"))
    first = Window.partitionBy(*_KEY, "_id").orderBy(F.xxhash64("_whole"))
    return (
        marked.join(won, match, "left_semi")
        .withColumn("_nth", F.row_number().over(first))
        .where("_nth = 1")
        .select("_whole.*")
    )
