"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Each source is a queue of its documents in shuffled order, run through as often
as a document may repeat. A document's virtual finish time is the source's
cumulative size up to and including it, divided by the source's target. All
queues are merged by finish time and served until the total budget is spent.

Cumulative sums never run over a whole source or over the whole mix in one
task: both are sums per range bucket, a running sum over the few bucket totals,
and a running sum inside each bucket. A source with a third of all rows is
spread over ``_SLICES`` buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved
from .words import BLANKS, between

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Buckets of the shuffled order: as many as three hex digits tell apart.
_SLICES = 4096
#: Buckets of finish time: so many a unit up to 2, then so many for each doubling.
_TICKS, _TICKS_LATER = 2048, 1024


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; null has none."""
    return F.size(between(F.coalesce(text, F.lit("")), BLANKS)).cast("long")


def _running(by: list[str], order: list[Column], of: str) -> Column:
    """Sum of all rows before this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(of).over(w), F.lit(0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to (_source, source_size): weighted shares of the sum of
    all sizes, none above ``max_repeats`` times its source's size.

    Sources whose cap is smallest for their weight reach it first. So in the
    order of cap / weight a source is capped exactly when its cap is at most
    its weight's share of what the sources before it leave. The table has a row
    per source; ordering it is the only step in one task.
    """
    everyone, by_name = Window.partitionBy(), Window.partitionBy().orderBy("_source")
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = (
        sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.lit(max_repeats) * F.col("source_size"))
        .withColumn("_all", F.sum("source_size").over(everyone))
        .withColumn("_all_w", F.sum("_w").over(everyone))
    )
    order = [F.col("_cap") / F.col("_w"), F.col("_source")]
    tried = (
        ranked.withColumn("_caps", _running([], order, "_cap"))
        .withColumn("_ws", _running([], order, "_w"))
        .withColumn(
            "_capped",
            F.col("_cap") * (F.col("_all_w") - F.col("_ws")) <= F.col("_w") * (F.col("_all") - F.col("_caps")),
        )
    )
    rest = tried.withColumn(
        "_left", F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everyone), F.lit(0))
    ).withColumn("_left_w", F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everyone))
    share = (F.col("_w") * F.col("_left")).cast("double") / F.col("_left_w").cast("double")
    return rest.select(
        "_source", "source_size", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share).alias("target")
    )


def _tick(finish: Column) -> Column:
    """Range bucket of a finish time. The budget ends near 1, so buckets beyond 2 are only there to be left
    out; but a source far above its target has most of its rows there, and they must not meet in one."""
    later = F.floor(F.log2(finish / 2) * _TICKS_LATER) + 2 * _TICKS
    return F.when(finish < 2, F.floor(finish * _TICKS)).otherwise(later).cast("int")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes from the document, repeats
    included. Null text has size 0; null is a source of its own, the last.
    Documents of size 0 are never taken. The shuffle is the MD5 of the id as
    text (null: the empty text), so reruns agree; repeated rows are separate
    documents. Extra columns, whatever their names, play no part. An empty
    table gives no rows.
    """
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = saved(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("_name"),
            F.when(F.col(source_col).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(source_col))).alias("_source"),
            n_words(F.col(text_col)).alias("_size"),
            md5.alias("_key"),
            F.conv(F.substring(md5, 1, 3), 16, 10).cast("int").alias("_slice"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "mix",
    )
    slices = rows.groupBy("_source", "_slice").agg(F.sum("_size").alias("_in_slice"))
    sources = targets(
        slices.groupBy("_source").agg(F.sum("_in_slice").alias("source_size")), weights, max_repeats
    )
    offsets = slices.withColumn("_before", _running(["_source"], [F.col("_slice")], "_in_slice")).join(sources, "_source")
    inside = Window.partitionBy("_source", "_slice").orderBy("_key", "_id", "_row").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("_upto", F.sum("_size").over(inside)).join(
        offsets.select("_source", "_slice", "_before", "source_size", "target"), ["_source", "_slice"]
    )
    turn = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("_turn")
    served = F.col("_turn") * F.col("source_size") + F.col("_before") + F.col("_upto")
    items = (
        queued.where("_size > 0")
        .select("_row", "_source", "_key", "_size", "_before", "_upto", "source_size", "target", turn)
        .select("_row", "_source", "_key", "_size", (served.cast("double") / F.col("target")).alias("_finish"))
        .withColumn("_tick", _tick(F.col("_finish")))
    )
    budget = F.lit(sources.agg(F.floor(F.sum("target"))).first()[0] or 0)  # one number
    ticks = (
        items.groupBy("_tick")
        .agg(F.sum("_size").alias("_in_tick"))
        .withColumn("_earlier", _running([], [F.col("_tick")], "_in_tick"))
        .where(F.col("_earlier") < budget)
    )
    line = Window.partitionBy("_tick").orderBy("_finish", "_source", "_key", "_row").rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        items.join(ticks.select("_tick", "_earlier"), "_tick")
        .withColumn("_spent", F.col("_earlier") + F.sum("_size").over(line))
        .where(F.col("_spent") <= budget)
        .groupBy("_row")
        .agg(F.sum("_size").alias("taken"))
    )
    return queued.join(taken, "_row", "left").select(
        F.col("_id").alias(id_col),
        F.col("_name").alias(source_col),
        F.col("_size").alias("size"),
        F.col("source_size"),
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )
