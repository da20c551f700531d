"""Which unit of the head is which unit of the base.

``units`` has path, idx, parent (the idx of the enclosing unit, or null), name
(or null), body_hash. Within a path, tiers in turn: the kth unit of a name with
the kth of that name; equal bodies under corresponding parents, to a fixed
point; equal bodies anywhere, kth with kth; and by position among what is left
under corresponding parents, to a fixed point. Every tier is a window and an
equi-join keyed by path, so a pass is a shuffle by path and the rest stays in
place. Passes are bounded by the depth of nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.tables import cut

_TOP = -1


def _ranked(units: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("idx")
    return units.withColumn("k", F.row_number().over(order))


def _pair(base: DataFrame, head: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """kth of each key with the kth."""
    b = _ranked(base, keys).select(*keys, "k", F.col("idx").alias("base_idx"))
    h = _ranked(head, keys).select(*keys, "k", F.col("idx").alias("head_idx"))
    return b.join(h, [*keys, "k"]).select("path", "base_idx", "head_idx", F.lit(tier).alias("tier"))


def _left(units: DataFrame, matched: DataFrame, side: str) -> DataFrame:
    done = matched.select("path", F.col(f"{side}_idx").alias("idx"))
    return units.join(done, ["path", "idx"], "left_anti")


def _anchored(units: DataFrame, matched: DataFrame, side: str) -> DataFrame:
    """Units with ``anchor``: the head idx of their parent's match, ``_TOP`` for those without a
    parent; units whose parent is not matched yet are not among them."""
    pairs = matched.select("path", F.col(f"{side}_idx").alias("parent"), F.col("head_idx").alias("anchor"))
    top = units.where(F.col("parent").isNull()).withColumn("anchor", F.lit(_TOP))
    return top.unionByName(units.join(pairs, ["path", "parent"]).select(top.columns))


def _to_fixed_point(base: DataFrame, head: DataFrame, matched: DataFrame, keys: list[str], tier: str, nested: bool) -> DataFrame:
    """Passes until one finds nothing; one is enough where no unit stands in another, as no new match is a parent."""
    while True:
        new = _pair(
            _anchored(_left(base, matched, "base"), matched, "base"),
            _anchored(_left(head, matched, "head"), matched, "head"),
            ["path", "anchor", *keys],
            tier,
        )
        if not nested:
            return cut(matched.unionByName(new))
        new = cut(new)
        if new.isEmpty():
            return matched
        matched = cut(matched.unionByName(new))


def align(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, base_idx, head_idx, tier); one side is null for added and removed units, and so is the tier."""
    cols = ["path", "idx", "parent", "name", "body_hash"]
    base, head = base.select(*cols), head.select(*cols)
    named, inner = F.col("name").isNotNull(), F.col("parent").isNotNull()
    nested = not base.where(inner).isEmpty() and not head.where(inner).isEmpty()
    matched = cut(_pair(base.where(named), head.where(named), ["path", "name"], "exact"))
    matched = _to_fixed_point(base, head, matched, ["body_hash"], "body_hash", nested)
    loose = _pair(_left(base, matched, "base"), _left(head, matched, "head"), ["path", "body_hash"], "body_hash")
    matched = cut(matched.unionByName(loose))
    matched = _to_fixed_point(base, head, matched, [], "positional", nested)
    none = F.lit(None)
    removed = _left(base, matched, "base").select("path", F.col("idx").alias("base_idx"), none.cast("int").alias("head_idx"), none.cast("string").alias("tier"))
    added = _left(head, matched, "head").select("path", none.cast("int").alias("base_idx"), F.col("idx").alias("head_idx"), none.cast("string").alias("tier"))
    return matched.unionByName(removed).unionByName(added)


def unit_changes(base: DataFrame, head: DataFrame, alignment: DataFrame) -> DataFrame:
    """The alignment with both sides' hashes and ``change``: added, removed, changed or unchanged (by body)."""
    b = base.select("path", F.col("idx").alias("base_idx"), F.col("body_hash").alias("base_hash"))
    h = head.select("path", F.col("idx").alias("head_idx"), F.col("body_hash").alias("head_hash"))
    change = (
        F.when(F.col("base_idx").isNull(), "added")
        .when(F.col("head_idx").isNull(), "removed")
        .when(F.col("base_hash") != F.col("head_hash"), "changed")
        .otherwise("unchanged")
    )
    return alignment.join(b, ["path", "base_idx"], "left").join(h, ["path", "head_idx"], "left").withColumn("change", change)


def multiset_changes(base: DataFrame, head: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, n, change): how many more (added) or fewer (removed) of an item the head has."""
    both = base.select(*keys, item, F.lit(-1).alias("d")).unionByName(head.select(*keys, item, F.lit(1).alias("d")))
    return (
        both.groupBy(*keys, item)
        .agg(F.sum("d").alias("d"))
        .where("d <> 0")
        .select(*keys, item, F.abs("d").alias("n"), F.when(F.col("d") > 0, "added").otherwise("removed").alias("change"))
    )


def outermost(units: DataFrame, keep: Column) -> DataFrame:
    """Units that ``keep`` holds for and for no unit around them. Needs path, idx, parent; one join a level."""
    flagged = cut(units.withColumn("kept", keep))
    marked = flagged.where("kept").select("path", "idx", F.col("parent").alias("up"))
    inside = marked.select("path", "idx").limit(0)
    frontier = marked.where(F.col("up").isNotNull())
    above = flagged.select("path", F.col("idx").alias("up"), "kept", F.col("parent").alias("next"))
    while not frontier.isEmpty():
        step = cut(frontier.join(above, ["path", "up"]))
        inside = cut(inside.unionByName(step.where("kept").select("path", "idx")))
        frontier = step.where("NOT kept AND next IS NOT NULL").select("path", "idx", F.col("next").alias("up"))
    return flagged.where("kept").drop("kept").join(inside, ["path", "idx"], "left_anti")
