"""Route tables: routers mounted under prefixes, and calls matched to routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import paths
from ripplemark.tables import cut


def mounted(roots: DataFrame, mounts: DataFrame, most: int | None = None) -> DataFrame:
    """(router, route): the whole prefix of every router below ``roots`` (router, route); mounts are
    (parent, child, prefix). A router mounted twice has two routes; none is mounted below itself."""
    known = frontier = cut(roots.select("router", "route", F.array("router").alias("way")))
    level = 0
    while most is None or level < most:
        level += 1
        step = frontier.join(mounts, frontier["router"] == mounts["parent"]).where(~F.array_contains("way", F.col("child")))
        joined = F.concat(F.regexp_replace("route", "/+$", ""), F.lit("/"), F.regexp_replace("prefix", "^/+", ""))
        frontier = cut(step.select(F.col("child").alias("router"), joined.alias("route"), F.concat("way", F.array("child")).alias("way")))
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier))
    return known.select("router", "route")


def same_route(a: Column, b: Column) -> Column:
    """Segments that agree one by one, a ``:name`` with any."""
    fits = F.zip_with(a, b, lambda x, y: (x == y) | F.startswith(x, F.lit(":")) | F.startswith(y, F.lit(":")))
    return (F.size(a) == F.size(b)) & F.forall(fits, lambda f: F.coalesce(f, F.lit(False)))


def matched(sites: DataFrame, routes: DataFrame) -> DataFrame:
    """Call sites with the routes of their method that fit; both have method and path."""
    s = sites.withColumn("_a", paths.segments(F.col("path"))).withColumn("_n", F.size("_a"))
    r = routes.withColumnRenamed("path", "route_path").withColumn("_b", paths.segments(F.col("route_path"))).withColumn("_n", F.size("_b"))
    return s.join(r, ["method", "_n"]).where(same_route(F.col("_a"), F.col("_b"))).drop("_a", "_b", "_n")
