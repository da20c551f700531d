"""Call graphs: closures, nearest changes, chains, ranks.

Edges are (caller, callee); upstream is from a callee to its callers. Loops run
level by level: a level is one join of the frontier with the edges and an
anti-join with what is known, and its result is checkpointed. A level's work is
that of its frontier, and cycles end because nothing is visited twice.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.operators import blocks
from ripplemark.tables import Written, cut


#: Levels that stand side by side in a plan before they are written together.
_SIDE_BY_SIDE = 16


class _Levels:
    """What a walk has found, each level written once."""

    def __init__(self, first: DataFrame):
        self.parts = [cut(first)]

    def all(self) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), self.parts)

    def add(self, level: DataFrame) -> None:
        self.parts = [cut(self.all())] if len(self.parts) >= _SIDE_BY_SIDE else self.parts
        self.parts.append(level)


def _callers(edges: DataFrame) -> DataFrame:
    """(node, next) once for each pair, written once for all levels of a walk."""
    return cut(edges.select(F.col("callee").alias("node"), F.col("caller").alias("next")).distinct())


def upstream(edges: DataFrame, origins: DataFrame, levels: int | None = None) -> DataFrame:
    """(node, level) that reach any of ``origins`` (node), which are at level 0."""
    known = _Levels(origins.select("node").distinct().withColumn("level", F.lit(0)))
    frontier, level, callers = known.all(), 0, _callers(edges)
    while levels is None or level < levels:
        level += 1
        new = callers.join(frontier.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct()
        frontier = cut(new.join(known.all(), "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        known.add(frontier)
    return known.all()


def downstream(edges: DataFrame, origins: DataFrame, levels: int | None = None) -> DataFrame:
    return upstream(edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")), origins, levels)


#: Origins that share a word of marks, and about how many are numbered in one place.
_BITS, _NUMBERED = 62, 4096
#: Powers of two: nodes of a stretch of names that are walked from in one place, callers that make a row of a node's.
_STRETCH, _LISTED = 10, 14
#: Up to so many origins are numbered by name alone; rounds in which parts of the graph must be told from each other.
_FEW, _ROUNDS = 16 * _BITS, 12
#: Up to so many names, the parts are told in one task.
_PLACED = 1 << 22


class Walks(NamedTuple):
    """Walks of many origins: which bit of which word each is, and the words that have come to a node at a distance."""

    marks: DataFrame  # origin, w, nth, bit
    words: DataFrame  # node, w, bits, distance (walks without distances: 1 for any but 0)
    kept: Written  # the table of words, for those who drop it


def in_order(name: str) -> Column:
    """What names are ordered by, so that those of one place stand together: the digits in them count as numbers."""
    return F.regexp_replace(F.regexp_replace(name, "([0-9]+)", "0" * 19 + "$1"), "[0-9]*([0-9]{19})", "$1")


def _numbered(names: DataFrame, name: str, number: str, places: int) -> DataFrame:
    """Distinct ``names`` with a number of their own, ascending by part and in order, without gaps in each of ``places``."""
    placed = names.withColumn("_key", in_order(name)).repartitionByRange(places, "part", "_key").sortWithinPartitions("part", "_key", name)
    return placed.select(name, F.monotonically_increasing_id().alias(number))


def _parts(edges: DataFrame, named: DataFrame) -> Written:
    """(name, part) of all ends of edges and of ``named`` (origin): what no edge links is in different parts.

    Parts only order the numbers. Of a node's links two are kept, to the neighbours of the least and of the
    greatest hash: a part that falls apart so, or two that meet by a hash, cost room and change no result.
    If parts are not told from each other after some rounds, all is one.
    """
    end = lambda name, other: F.struct(F.col(name).alias("name"), F.col(other).alias("other"))
    ends = edges.select(F.inline(F.array(end("caller", "callee"), end("callee", "caller")))).union(named.select("origin", "origin"))
    other = F.xxhash64("other")
    near = Written(ends.groupBy("name").agg(F.min(other).alias("low"), F.max(other).alias("high")).withColumn("id", F.xxhash64("name")))
    if near.df.count() <= _PLACED:  # a few numbers for each
        of = Written(near.df.coalesce(1).mapInArrow(blocks.told_in_one_place(_ROUNDS), "name string, part long").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        near.drop()
        return of
    link = lambda to, of: F.struct(F.col(to).alias("to"), F.col(of).alias("id"))
    links = near.df.select(F.inline(F.array(link("id", "low"), link("low", "id"), link("id", "high"), link("high", "id")))).where("to <> id")
    parts, total, told = Written(near.df.select("id", F.least("id", "low").alias("part"))), None, False
    for _ in range(_ROUNDS):
        least = parts.df.join(parts.df.select(F.col("id").alias("part"), F.col("part").alias("least")), "part").select("id", F.col("least").alias("part"))
        come = links.join(least, "id").select(F.col("to").alias("id"), "part")
        now = Written(least.union(come).groupBy("id").agg(F.min("part").alias("part")))
        parts.drop()
        parts, before = now, total
        total = parts.df.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0]
        if told := total == before:  # they only fall
            break
    of = near.df.join(parts.df, "id").select("name", "part") if told else near.df.select("name", F.lit(0).cast("long").alias("part"))
    of = Written(of)
    near.drop()
    parts.drop()
    return of


@contextmanager
def _as_dealt(spark: SparkSession) -> Iterator[None]:
    """Joins take tables as they were dealt out by some of their keys; else Spark deals them anew, by all keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _step(frontier: DataFrame, calls: DataFrame, places: int) -> DataFrame:
    """(node, w, come): the words of the frontier at its callers, for each of its nodes that they call.

    Both sides are dealt by stretch alone: the callers of neighbours meet in one task, where they can be merged
    before they are shuffled. That holds where it is run under ``_as_dealt``.
    """
    dealt = frontier.select(F.shiftright("node", _STRETCH).alias("stretch"), "node", "w", "bits").repartition(places, "stretch")
    step = dealt.join(calls.repartition(places, "stretch"), ["stretch", "node"])
    return step.select(F.explode("nexts").alias("node"), "w", F.col("bits").alias("come"))


class Reached(NamedTuple):
    """Walks of many origins without distances, in blocks of nodes."""

    marks: DataFrame  # origin, b, c, nth
    found: list[DataFrame]  # s, b, at, bits, distance: 0 for the origins themselves, or 1
    names: DataFrame  # name, node
    kept: list[Written]  # the tables of these


class _Numbers(NamedTuple):
    """Origins with their words, names with their numbers, and whether the origins are so many that they walk in blocks."""

    marks: DataFrame  # origin, w, nth, bit
    names: Written  # name, node
    many: bool


def _numbers(edges: DataFrame, origins: DataFrame) -> _Numbers:
    places = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = origins.select(F.col("node").alias("origin")).distinct()
    many, parts = named.count(), None
    if many > _FEW:
        parts = _parts(edges, named)
        names, named = parts.df, named.join(parts.df.withColumnRenamed("name", "origin"), "origin")
    else:
        names = edges.select(F.explode(F.array("caller", "callee")).alias("name")).union(named).distinct().withColumn("part", F.lit(0))
        named = named.withColumn("part", F.lit(0))
    marks = _numbered(named, "origin", "n", 1 + many // _NUMBERED)
    place, nth = F.expr("n - pmod(n, 1L << 33)"), F.expr("pmod(n, 1L << 33)")
    word, bit = place + F.floor(nth / _BITS), F.expr(f"shiftleft(1L, cast(pmod(n, 1L << 33) % {_BITS} AS int))")
    marks = cut(marks.select("origin", word.alias("w"), (nth % _BITS).alias("nth"), bit.alias("bit")))
    names = Written(_numbered(names, "name", "node", places))
    if parts:
        parts.drop()
    return _Numbers(marks, names, many > _FEW)


def _ends(names: DataFrame, end: str, number: str) -> DataFrame:
    return names.select(F.col("name").alias(end), F.col("node").alias(number))


def _numbered_calls(edges: DataFrame, names: DataFrame) -> tuple[Written, DataFrame]:
    """A table, and by it (node, next): the numbers of the ends of each edge."""
    # a table for each end, so that the shuffles of one are gone before those of the other come
    known = Written(edges.join(_ends(names, "callee", "node"), "callee").select("caller", "node"))
    return known, known.df.join(_ends(names, "caller", "next"), "caller").select("node", "next")


def _in_blocks(edges: DataFrame, of: _Numbers, levels: int | None, distances: bool) -> list[tuple[Written, DataFrame]]:
    """Tables of what a walk of many origins finds, and the blocks in each."""
    known, calls = _numbered_calls(edges, of.names.df)
    marks = _of_blocks(of.marks).join(_ends(of.names.df, "origin", "node"), "origin").select("node", "b", "c", F.col("bit").alias("bits"))
    places = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.walk(marks, calls, levels, places, distances, known.drop)


def _of_blocks(marks: DataFrame) -> DataFrame:
    c = F.pmod("w", F.lit(blocks.WIDE)).cast("int")
    return marks.withColumns({"b": F.col("w") - c, "c": c})


def walks(edges: DataFrame, origins: DataFrame, levels: int | None = None, distances: bool = True) -> Walks:
    """Upstream of every origin on its own, itself at distance 0. ``edges`` are read more than once.

    The walks go together: an origin is a bit, and a node carries words of the bits that have come
    to it, so a level is one join with the edges for each word of origins and not for each origin.
    Nodes and origins are numbered part by part of the graph, in the order of their names. Neighbours
    reach much the same, so they fill the same words, and what they reach is merged where it arises,
    before it is shuffled. Many origins walk in blocks of nodes and words. Without ``distances`` a
    node has one row of a word for all that came.
    """
    of = _numbers(edges, origins)
    if not of.many:
        return _in_rows(edges, of, levels, distances)
    found = _in_blocks(edges, of, levels, distances)
    with blocks.small_batches(edges.sparkSession):
        words = Written(blocks.words([b for _, b in found], of.names.df))
    for done in (of.names, *(f for f, _ in found)):
        done.drop()
    return Walks(of.marks, words.df, words)


def _in_rows(edges: DataFrame, of: _Numbers, levels: int | None, distances: bool) -> Walks:
    known, calls = _numbered_calls(edges, of.names.df)
    calls = calls.groupBy("node", F.shiftright("next", _LISTED)).agg(F.collect_set("next").alias("nexts"))
    calls = Written(calls.select(F.shiftright("node", _STRETCH).alias("stretch"), "node", "nexts"))
    known.drop()
    first = of.marks.join(_ends(of.names.df, "origin", "node"), "origin").groupBy("node", "w").agg(F.bit_or("bit").alias("bits"))
    places = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (_by_distance if distances else _reached)(first, calls.df, levels, places)
    calls.drop()
    words = reduce(DataFrame.union, (f.df for f in found))
    if not distances:
        some = F.array(F.struct(F.col("own").alias("bits"), F.lit(0).alias("distance")), F.struct(_less("seen", "own").alias("bits"), F.lit(1).alias("distance")))
        words = words.select("node", "w", F.inline(some)).where("bits <> 0")
    words = Written(words.join(of.names.df, "node").select(F.col("name").alias("node"), "w", "bits", "distance"))
    for done in (of.names, *found):
        done.drop()
    return Walks(of.marks, words.df, words)


def reached(edges: DataFrame, origins: DataFrame, levels: int | None = None) -> Walks | Reached:
    """``walks`` without distances; those of many origins stay in blocks."""
    of = _numbers(edges, origins)
    if not of.many:
        return _in_rows(edges, of, levels, False)
    found = _in_blocks(edges, of, levels, False)
    return Reached(_of_blocks(of.marks), [b for _, b in found], of.names.df, [of.names, *(f for f, _ in found)])


def counted(each: Reached, groups: DataFrame) -> Written:
    """(origin, kind, n): see ``blocks.counts``; ``groups`` has (kind, name, next)."""
    places = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = blocks.counts(each.found, groups.join(each.names, "name").select("kind", "node", "next"), places)
    marks = each.marks.select("origin", "b", (F.col("c") * _BITS + F.col("nth")).cast("long").alias("nth"))
    found = Written(held.df.join(marks, ["b", "nth"]).select("origin", "kind", "n"))
    held.drop()
    return found


def _less(bits: str, known: str) -> Column:
    return F.col(bits).bitwiseAND(F.bitwise_not(known))


def _by_distance(first: DataFrame, calls: DataFrame, levels: int | None, places: int) -> list[Written]:
    """(node, w, bits, distance): what came to a node, level by level."""
    found = [Written(first.withColumn("distance", F.lit(0)))]
    level, none = 0, F.lit(0).cast("long")
    while levels is None or level < levels:
        level += 1
        come = _step(found[-1].df, calls, places).withColumn("here", none)
        here = reduce(DataFrame.union, (f.df.select("node", "w", none.alias("come"), F.col("bits").alias("here")) for f in found))
        both = come.union(here).groupBy("node", "w").agg(F.bit_or("come").alias("come"), F.bit_or("here").alias("here"))
        new = both.select("node", "w", _less("come", "here").alias("bits"), F.lit(level).alias("distance"))
        with _as_dealt(first.sparkSession):
            found.append(Written(new.where("bits <> 0")))
        if found[-1].df.isEmpty():
            break
        if len(found) > _SIDE_BY_SIDE:
            found = [*_merged(found[:-1]), found[-1]]
    return found


def _reached(first: DataFrame, calls: DataFrame, levels: int | None, places: int) -> list[Written]:
    """(node, w, own, seen, new): one row for all that came, which takes the place of the row of the level before."""
    now, level, none = Written(first.select("node", "w", *(F.col("bits").alias(c) for c in ("own", "seen", "new")))), 0, F.lit(0).cast("long")
    while levels is None or level < levels:
        level += 1
        come = _step(now.df.where("new <> 0").select("node", "w", F.col("new").alias("bits")), calls, places)
        both = come.select("node", "w", none.alias("own"), none.alias("seen"), "come").union(now.df.select("node", "w", "own", "seen", none.alias("come")))
        both = both.groupBy("node", "w").agg(*(F.bit_or(c).alias(c) for c in ("own", "seen", "come")))
        with _as_dealt(first.sparkSession):
            after = Written(both.select("node", "w", "own", F.col("seen").bitwiseOR(F.col("come")).alias("seen"), _less("come", "seen").alias("new")))
        now.drop()
        now = after
        if now.df.where("new <> 0").isEmpty():
            break
    return [now]


def _merged(found: list[Written]) -> list[Written]:
    one = Written(reduce(DataFrame.union, (f.df for f in found)))
    for f in found:
        f.drop()
    return [one]


def upstream_of_each(edges: DataFrame, origins: DataFrame, levels: int | None = None) -> DataFrame:
    """(origin, node, distance) of every origin on its own: the pairs of ``walks``, one row each."""
    known = Written(edges.select("caller", "callee"))
    of = _numbers(known.df, origins)
    if not of.many:
        found = pairs(_in_rows(known.df, of, levels, True))
    else:
        found = blocks.pairs([b for _, b in _in_blocks(known.df, of, levels, True)], of.names.df, _of_blocks(of.marks))
    known.drop()
    return found


def pairs(each: Walks) -> DataFrame:
    """(origin, node, distance), one row for each bit of the words."""
    marks = each.marks.groupBy("w").agg(F.collect_list(F.struct("bit", "origin")).alias("marks"))
    held = each.words.join(marks, "w").select("node", "distance", "bits", F.inline("marks"))
    return held.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("origin", "node", "distance")


def held_by_each(marks: DataFrame, words: DataFrame) -> DataFrame:
    """(origin, kind, n): how many rows of ``words`` (kind, w, bits) hold an origin's bit, where any does.

    A word's bits are summed side by side, so the pairs of origins and rows are counted without being made.
    """
    each = F.array(*(F.sum(F.shiftright("bits", i).bitwiseAND(F.lit(1))) for i in range(_BITS)))
    sums = words.groupBy("kind", "w").agg(each.alias("_each"))
    return sums.select("kind", "w", F.posexplode("_each").alias("nth", "n")).where("n > 0").join(marks, ["w", "nth"]).select("origin", "kind", "n")


def nearest_origin(edges: DataFrame, origins: DataFrame, levels: int | None = None) -> DataFrame:
    """(node, distance, chain) of each node that reaches an origin: a shortest chain, origin first.

    Of shortest chains it is the least, part by part from the origin, as a queue over sorted
    origins and sorted callers would find it.
    """
    known = _Levels(origins.select("node").distinct().withColumns({"distance": F.lit(0), "chain": F.array("node")}))
    frontier, level, callers = known.all(), 0, _callers(edges)
    while levels is None or level < levels:
        level += 1
        step = frontier.join(callers, "node").select(F.col("next").alias("node"), "chain")
        step = step.join(known.all().select("node"), "node", "left_anti").groupBy("node").agg(F.min("chain").alias("chain"))
        frontier = cut(step.select("node", F.lit(level).alias("distance"), F.concat("chain", F.array("node")).alias("chain")))
        if frontier.isEmpty():
            break
        known.add(frontier)
    return known.all()


def entry_points(nodes: DataFrame, edges: DataFrame, kind: Column) -> DataFrame:
    """Nodes that nothing calls, and routes, with ``kind``; ``nodes`` has node and route."""
    called = edges.select(F.col("callee").alias("node")).distinct().withColumn("_called", F.lit(True))
    found = nodes.join(called, "node", "left").where(F.col("_called").isNull() | F.col("route").isNotNull())
    return found.drop("_called").withColumn("kind", kind)


def entry_kind() -> Column:
    """Kind of an entry point: what it is first of the list. Needs route, label, path, explored, exported."""
    return (
        F.when(F.col("route").isNotNull(), "route")
        .when(F.startswith(F.col("label"), F.lit("module@")), "module")
        .when(F.endswith(F.col("path"), F.lit(".svelte")), "component")
        .when(~F.col("explored"), "unexplored")
        .when(F.col("exported"), "export")
        .otherwise("function")
    )


def _components_of_cycles(edges: DataFrame) -> DataFrame:
    """(node, scc) of the nodes that lie on a cycle; edges are without loops.

    Nodes that nothing enters or leaves go first, again and again. Of the rest each takes the greatest
    name that reaches it; what goes back to that name within its colour is a component, and goes.
    """
    found, left = None, cut(edges)
    while True:
        while not left.isEmpty():
            inner = left.join(left.select(F.col("callee").alias("caller")).distinct(), "caller", "left_semi")
            inner = cut(inner.join(left.select(F.col("caller").alias("callee")).distinct(), "callee", "left_semi").select("caller", "callee"))
            done, left = inner.count() == left.count(), inner
            if done:
                break
        if left.isEmpty():
            return edges.select(F.col("caller").alias("node"), F.col("caller").alias("scc")).limit(0) if found is None else found
        colour = cut(left.select(F.explode(F.array("caller", "callee")).alias("node")).distinct().withColumn("scc", F.col("node")))
        while True:
            come = left.join(colour, F.col("caller") == F.col("node")).select(F.col("callee").alias("node"), "scc")
            now = cut(colour.unionByName(come).groupBy("node").agg(F.max("scc").alias("scc")))
            if now.exceptAll(colour).isEmpty():
                break
            colour = now
        a, b = (colour.select(F.col("node").alias(end), F.col("scc").alias(c)) for end, c in (("caller", "a"), ("callee", "b")))
        same = left.join(a, "caller").join(b, "callee").where("a = b").select("caller", "callee")
        back = upstream(same, colour.where("node = scc").select("node")).select("node")
        one = cut(colour.join(back, "node", "left_semi"))
        found = one if found is None else cut(found.unionByName(one))
        gone = one.select("node")
        left = left.join(gone.withColumnRenamed("node", "caller"), "caller", "left_anti")
        left = cut(left.join(gone.withColumnRenamed("node", "callee"), "callee", "left_anti").select("caller", "callee"))


def _back_edges(table: pa.Table) -> pa.Table:
    """Of one component's edges those that end, depth first from the least node of least level, on the way that led to them."""
    out, level = defaultdict(list), {}
    for row in table.to_pylist():
        out[row["caller"]].append(row["callee"])
        level[row["caller"]] = row["level"]
    start = min(level, key=lambda n: (level[n], n))
    back, on_the_way, stack = [], {start: True}, [(start, iter(sorted(out[start])))]
    while stack:
        node, rest = stack[-1]
        for to in rest:
            if to not in on_the_way:
                on_the_way[to] = True
                stack.append((to, iter(sorted(out[to]))))
                break
            if on_the_way[to]:
                back.append((node, to))
        else:
            on_the_way[node] = False
            stack.pop()
    return pa.table({"caller": pa.array([a for a, _ in back], pa.string()), "callee": pa.array([b for _, b in back], pa.string())})


def ranks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, rank): the longest way down from a node that nothing calls, back edges aside.

    Only edges inside a strongly connected component can be back edges. A component is walked depth first
    in one place, from where it is first reached, and the edges that close a cycle go; all others count.
    """
    names = cut(nodes.select("node").distinct())
    known = edges.where("caller <> callee").select("caller", "callee").distinct()
    for end in ("caller", "callee"):
        known = known.join(names.withColumnRenamed("node", end), end, "left_semi")
    known = cut(known.select("caller", "callee"))
    forward, cycles = known, _components_of_cycles(known)
    if not cycles.isEmpty():
        tops = names.join(known.select(F.col("callee").alias("node")).distinct(), "node", "left_anti")
        level = names.join(downstream(known, tops), "node", "left").select(F.col("node").alias("caller"), F.coalesce("level", F.lit(0)).alias("level"))
        a, b = (cycles.select(F.col("node").alias(end), F.col("scc").alias(c)) for end, c in (("caller", "a"), ("callee", "b")))
        inside = known.join(a, "caller").join(b, "callee").where("a = b").join(level, "caller").select("a", "caller", "callee", "level")
        back = inside.groupBy("a").applyInArrow(_back_edges, "caller string, callee string")
        forward = cut(known.join(back, ["caller", "callee"], "left_anti"))
    ranked = cut(names.withColumn("rank", F.lit(0)))
    while True:
        up = forward.join(ranked, forward["caller"] == ranked["node"]).groupBy(F.col("callee").alias("node")).agg((F.max("rank") + 1).alias("r"))
        now = cut(ranked.join(up, "node", "left").select("node", F.greatest("rank", F.coalesce("r", F.lit(0))).alias("rank")))
        if now.exceptAll(ranked).isEmpty():
            return ranked
        ranked = now


def _revealed_one_way(callers: DataFrame, origins: DataFrame, direction: str, hops: int | None) -> DataFrame:
    known = _Levels(origins.select("node").distinct().select("node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("direction"), F.lit(0).alias("level")))
    frontier, level = known.all(), 0
    while hops is None or level < hops:
        level += 1
        step = frontier.join(callers, "node").groupBy(F.col("next").alias("node")).agg(F.min("node").alias("parent"))
        step = step.join(known.all().select("node"), "node", "left_anti")
        frontier = cut(step.withColumns({"direction": F.lit(direction), "level": F.lit(level)}))
        if frontier.isEmpty():
            break
        known.add(frontier)
    return known.all()


def revealed(edges: DataFrame, origins: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, parent, direction, level): what expanding the origins brings into view, and from which node it first came.

    Callers are expanded first, then callees; of several parents a hop away the least counts. Origins have none.
    """
    up = _revealed_one_way(_callers(edges), origins, "callers", hops)
    down = _revealed_one_way(_callers(edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))), origins, "callees", hops)
    return cut(up.unionByName(down.join(up.select("node"), "node", "left_anti")))


def visible_nodes(nodes: DataFrame, edges: DataFrame, shown: DataFrame) -> DataFrame:
    """(node) of ``shown`` (node, parent, direction) in view when unchanged callees are hidden.

    An unchanged callee stays only if a changed function newly calls it or no longer does; what came into view
    through a hidden node is hidden with it. ``nodes`` has node and status, ``edges`` caller, callee and status.
    """
    status = lambda s: nodes.where(F.col("status") == s).select("node")
    moved = edges.where("status <> 'unchanged'").join(status("changed").withColumnRenamed("node", "caller"), "caller", "left_semi")
    hidden = shown.where("direction = 'callees'").join(status("unchanged"), "node", "left_semi")
    hidden = hidden.join(moved.select(F.col("callee").alias("node")), "node", "left_anti").select("node")
    kept = shown.where("parent IS NOT NULL").join(hidden, "node", "left_anti")
    return downstream(kept.select(F.col("parent").alias("caller"), F.col("node").alias("callee")), shown.where("parent IS NULL").select("node")).select("node")


def visible_edges(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges that show a change: all into what changed, and of the others those that a changed caller newly makes
    or no longer makes. ``visible_nodes`` says what a view keeps."""
    moved = changed.select("node").distinct()
    to_changed = edges.join(moved.withColumnRenamed("node", "callee"), "callee", "left_semi").select(edges.columns)
    from_changed = edges.join(moved.withColumnRenamed("node", "caller"), "caller", "left_semi").where("status <> 'unchanged'").select(edges.columns)
    return to_changed.unionByName(from_changed).distinct()


def collapsed(edges: DataFrame, revealed: DataFrame, node: str) -> DataFrame:
    """Edges without what was revealed from a node; ``revealed`` has (node, parent)."""
    below = downstream(revealed.select(F.col("parent").alias("caller"), F.col("node").alias("callee")), revealed.sparkSession.createDataFrame([(node,)], "node string"))
    gone = below.where("level > 0").select("node")
    return edges.join(gone.withColumnRenamed("node", "caller"), "caller", "left_anti").join(gone.withColumnRenamed("node", "callee"), "callee", "left_anti").select(edges.columns)


def distances(edges: DataFrame, origins: DataFrame, levels: int | None = None) -> DataFrame:
    """(node, level): hops from the nearest origin, either way along the edges."""
    both = edges.select("caller", "callee").unionByName(edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")))
    return upstream(both, origins, levels)


def around(edges: DataFrame, origins: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within so many hops up or down, each way on its own: node, level, direction."""
    up = upstream(edges, origins, hops).withColumn("direction", F.when(F.col("level") == 0, "origin").otherwise("up"))
    down = downstream(edges, origins, hops).where("level > 0").withColumn("direction", F.lit("down"))
    nodes = cut(up.unionByName(down))
    seen = nodes.select("node").distinct()
    inside = edges.join(seen.withColumnRenamed("node", "caller"), "caller", "left_semi").join(seen.withColumnRenamed("node", "callee"), "callee", "left_semi")
    return nodes, inside.select(edges.columns)


def depths(units: DataFrame, most: int | None = None) -> DataFrame:
    """(path, idx, depth): how many units stand around each. Needs path, idx, parent; none stands in itself."""
    known = frontier = cut(units.where("parent IS NULL").select("path", "idx", F.lit(0).alias("depth"), F.array("idx").alias("way")))
    inner = units.where("parent IS NOT NULL").select("path", "idx", "parent")
    depth = 0
    while most is None or depth < most:
        depth += 1
        step = inner.join(frontier.select("path", F.col("idx").alias("parent"), "way"), ["path", "parent"]).where(~F.array_contains("way", F.col("idx")))
        frontier = cut(step.select("path", "idx", F.lit(depth).alias("depth"), F.concat("way", F.array("idx")).alias("way")))
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier))
    return known.select("path", "idx", "depth")


def folded(edges: DataFrame, into: DataFrame) -> DataFrame:
    """Edges between groups: each end becomes its ``group``, loops go, the strongest status of the
    bundle stays, and ``n`` counts the calls. ``into`` has node and group."""
    rank = F.when(F.col("status") == "unchanged", 0).when(F.col("status") == "removed", 1).when(F.col("status") == "added", 2).otherwise(3)
    a = into.select(F.col("node").alias("caller"), F.col("group").alias("from"))
    b = into.select(F.col("node").alias("callee"), F.col("group").alias("to"))
    return (
        edges.join(a, "caller").join(b, "callee").where(F.col("from") != F.col("to"))
        .groupBy(F.col("from").alias("caller"), F.col("to").alias("callee"))
        .agg(F.max_by("status", rank).alias("status"), F.count(F.lit(1)).alias("n"))
    )


def folded_nodes(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Status of each group of nodes: all added, all removed, any change, or unchanged; with counts."""
    every = lambda s: F.bool_and(F.col("status") == s)
    status = F.when(every("added"), "added").when(every("removed"), "removed").when(F.bool_or(F.col("status") != "unchanged"), "changed")
    return nodes.groupBy(*by).agg(
        status.otherwise("unchanged").alias("status"), F.count(F.lit(1)).alias("functions"), F.count_distinct("path").alias("files")
    )
