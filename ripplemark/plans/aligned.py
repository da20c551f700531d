"""One file's functions aligned, for people: what was added, removed, or calls other things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.operators import align
from ripplemark.plans import extraction


def rows(texts: DataFrame, path: str, symbol: str | None = None) -> DataFrame:
    """(kind, label, exported, base_start, base_end, head_start, head_end, tier, added_calls, removed_calls) by line.

    Here a function is changed when the calls it makes differ, not when its body does.
    """
    facts = extraction.facts(texts.where(F.col("path") == path))
    fn, calls = extraction.functions(facts), extraction.calls(facts).where("idx IS NOT NULL")
    base, head = (fn.where(F.col("rev") == r) for r in ("base", "head"))
    al = align.align(base, head)
    side = lambda df, s: df.select("path", F.col("idx").alias(f"{s}_idx"), F.struct("label", "exported", "start_line", "end_line").alias(s))
    both = al.join(side(base, "base"), ["path", "base_idx"], "left").join(side(head, "head"), ["path", "head_idx"], "left")
    pairs = al.where("base_idx IS NOT NULL AND head_idx IS NOT NULL").select("path", "base_idx", "head_idx")
    made = lambda r, s: calls.where(F.col("rev") == r).select("path", F.col("idx").alias(f"{s}_idx"), "call").join(pairs, ["path", f"{s}_idx"]).select("path", "head_idx", "call")
    diff = align.multiset_changes(made("base", "base"), made("head", "head"), ["path", "head_idx"], "call")
    listed = lambda c: F.array_sort(F.flatten(F.collect_list(F.when(F.col("change") == c, F.array_repeat("call", F.col("n").cast("int"))))))
    per = diff.groupBy("path", "head_idx").agg(listed("added").alias("added_calls"), listed("removed").alias("removed_calls"))
    own = F.coalesce("head", "base")
    kind = F.when(F.col("base").isNull(), "added").when(F.col("head").isNull(), "removed").when(F.col("added_calls").isNotNull(), "changed").otherwise("unchanged")
    out = both.join(per, ["path", "head_idx"], "left").select(
        kind.alias("kind"), own["label"].alias("label"), own["exported"].alias("exported"), F.col("base.start_line").alias("base_start"), F.col("base.end_line").alias("base_end"),
        F.col("head.start_line").alias("head_start"), F.col("head.end_line").alias("head_end"), "tier", "added_calls", "removed_calls",
    )
    if symbol:
        out = out.where(F.col("label") == symbol)
    return out.orderBy(F.coalesce("head_start", "base_start"), "label")
