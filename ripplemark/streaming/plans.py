"""Plans of a stream of edits: every batch of changed files is planned against the base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ripplemark.plans import plan


def follow(edits: DataFrame, base: DataFrame, then: Callable[[plan.Plan, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query over ``edits`` (path, text; a null text deletes), newest last within a batch.

    ``base`` has path and text. Each batch's edits stand alone: the head is the base with them applied.
    ``then`` gets the plan and the batch's number, and may see a batch again after a failure.
    """

    def run(batch: DataFrame, number: int) -> None:
        newest = batch.withColumn("_n", F.monotonically_increasing_id()).groupBy("path").agg(F.max_by("text", "_n").alias("text"))
        kept = base.join(newest.select("path"), "path", "left_anti").select("path", "text")
        head = kept.unionByName(newest.where("text IS NOT NULL"))
        texts = base.select(F.lit("base").alias("rev"), "path", "text").unionByName(head.select(F.lit("head").alias("rev"), "path", "text"))
        then(plan.make(texts), number)

    return edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
