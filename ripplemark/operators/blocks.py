"""Walks of many origins in blocks: a stretch of nodes by some words of origins is one row.

A level's work is one operation for a call and a block of origins, on arrays, where rows of nodes and words
would be one for each call and word. A block keeps the nodes that hold any bit: ``at``, their offsets in the
stretch, and ``bits``, ``WIDE`` words for each. Rows come to the kernels in the order of their keys, so a
kernel holds one block at a time, whatever the size of the graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.tables import Written

#: Nodes of a stretch, as a power of two, and words of a block, each of so many bits.
SIDE, WIDE, BITS = 12, 4, 62
_NODES, _ROWS = 1 << SIDE, 1 << 16
_BLOCK = "s long, b long, at binary, bits binary"
_STATE = "s long, b long, seen_at binary, seen binary, new_at binary, new binary"
#: Rows are large here: few of them make a batch.
_SMALL = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    "spark.sql.parquet.columnarReaderBatchSize": "64",
}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in _SMALL}
    for k, v in _SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _put(block: np.ndarray, at: bytes, bits: bytes) -> None:
    block[np.frombuffer(at, "<u2")] |= np.frombuffer(bits, "<i8").reshape(-1, WIDE)


def _kept(block: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(block.any(axis=1))
    return at.astype("<u2").tobytes(), block[at].astype("<i8", copy=False).tobytes()


def _empty() -> np.ndarray:
    return np.zeros((_NODES, WIDE), np.int64)


def _rows(batches: Iterator[pa.RecordBatch], *lists: str) -> Iterator[dict]:
    """Rows of batches as dicts; the columns of ``lists`` as arrays without copies."""
    for batch in batches:
        plain = {n: batch.column(n).to_pylist() for n in batch.schema.names if n not in lists}
        values = {n: (batch.column(n).offsets.to_numpy(), batch.column(n).values) for n in lists}
        for i in range(batch.num_rows):
            yield {n: c[i] for n, c in plain.items()} | {n: v.slice(o[i], o[i + 1] - o[i]) for n, (o, v) in values.items()}


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 16) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _dealt(df: DataFrame, places: int, *keys: str) -> DataFrame:
    return df.repartition(places, *keys).sortWithinPartitions(*keys)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a word each: rows (s, b, at, c, bits)."""

    def blocks() -> Iterator[tuple]:
        for row in _rows(batches):
            bits = np.zeros(WIDE, "<i8")
            bits[row["c"]] = row["bits"]
            yield row["s"], row["b"], np.array([row["at"]], "<u2").tobytes(), bits.tobytes()

    yield from _batches(blocks(), ["s", "b", "at", "bits"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], 1024)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, to, calls) of rows (s, to, call) in the order of s and to: each call once, by caller."""

    def blocks() -> Iterator[tuple]:
        key, held = None, []
        for batch in batches:
            s, to, call = (batch.column(n).to_numpy() for n in ("s", "to", "call"))
            cuts = np.flatnonzero((np.diff(s) != 0) | (np.diff(to) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(s)], strict=True):
                if a == z:
                    continue
                if key != (k := (int(s[a]), int(to[a]))):
                    if key:
                        yield *key, np.unique(np.concatenate(held))
                    key, held = k, []
                held.append(call[a:z].copy())
                if len(held) > 256:
                    held = [np.unique(np.concatenate(held))]
        if key:
            yield *key, np.unique(np.concatenate(held))

    yield from _batches(blocks(), ["s", "to", "calls"], [pa.int64(), pa.int64(), pa.list_(pa.int32())])


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What comes to the callers of a block: rows (to, b, at, bits, calls) in the order of to and b."""

    def blocks() -> Iterator[tuple]:
        key, come = None, _empty()
        for row in _rows(batches, "calls"):
            if key != (k := (row["to"], row["b"])):
                if key and come.any():
                    yield *key, *_kept(come)
                key = k
                come[:] = 0
            here = _empty()
            _put(here, row["at"], row["bits"])
            call = row["calls"].to_numpy()
            call = call[here.any(axis=1)[call & (_NODES - 1)]]
            if len(call):
                to = call >> SIDE
                first = np.flatnonzero(np.diff(to, prepend=-1))
                come[to[first]] |= np.bitwise_or.reduceat(here[call & (_NODES - 1)], first, axis=0)
        if key and come.any():
            yield *key, *_kept(come)

    yield from _batches(blocks(), ["s", "b", "at", "bits"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block has seen and what of that is new: rows (s, b, old, at, bits) in the order of s and b."""

    def blocks() -> Iterator[tuple]:
        key, seen, come = None, _empty(), _empty()

        def done() -> tuple:
            new = come & ~seen
            return *key, *_kept(seen | come), *_kept(new)

        for row in _rows(batches):
            if key != (k := (row["s"], row["b"])):
                if key:
                    yield done()
                key = k
                seen[:], come[:] = 0, 0
            _put(seen if row["old"] else come, row["at"], row["bits"])
        if key:
            yield done()

    yield from _batches(blocks(), ["s", "b", "seen_at", "seen", "new_at", "new"], [pa.int64(), pa.int64(), *[pa.binary()] * 4])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, w, bits, distance), a row for each word of a node that holds a bit."""
    for row in _rows(batches, "names"):
        at, bits = np.frombuffer(row["at"], "<u2"), np.frombuffer(row["bits"], "<i8").reshape(-1, WIDE)
        nth, c = np.nonzero(bits)
        if len(nth):
            columns = [row["names"].take(pa.array(at[nth])), pa.array(row["b"] + c), pa.array(bits[nth, c]), pa.array(np.full(len(nth), row["distance"], np.int32))]
            yield pa.record_batch(columns, names=["node", "w", "bits", "distance"])


#: The origin of a block that a bit of its words is.
_ORIGIN = np.array([i // 64 * BITS + i % 64 for i in range(64 * WIDE)], np.int32)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(origin, node, distance), a row for each bit."""
    for row in _rows(batches, "names", "origins"):
        at, bits = np.frombuffer(row["at"], "<u2"), np.frombuffer(row["bits"], "u1").reshape(-1, 8 * WIDE)
        names, origins = row["names"], row["origins"]
        for a in range(0, len(at), _ROWS // 256):
            nth, bit = np.nonzero(np.unpackbits(bits[a : a + _ROWS // 256], axis=1, bitorder="little"))
            columns = [origins.take(pa.array(_ORIGIN[bit])), names.take(pa.array(at[a + nth])), pa.array(np.full(len(nth), row["distance"], np.int32))]
            yield pa.record_batch(columns, names=["origin", "node", "distance"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, b, nth, n): nodes of a block that hold a bit, of rows (s, b, at, bits) in the order of s and b."""
    key, block = None, _empty()

    def done() -> pa.RecordBatch:
        held = np.unpackbits(block.astype("<i8", copy=False).view("u1"), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bit = np.flatnonzero(held)
        columns = [np.full(len(bit), key[0]), np.full(len(bit), key[1]), _ORIGIN[bit].astype(np.int64), held[bit]]
        return pa.record_batch([pa.array(c) for c in columns], names=["s", "b", "nth", "n"])

    for row in _rows(batches):
        if key != (k := (row["s"], row["b"])):
            if key:
                yield done()
            key = k
            block[:] = 0
        _put(block, row["at"], row["bits"])
    if key:
        yield done()


def _packed(ends: DataFrame, places: int) -> Written:
    """(s, to, calls): (node, next) of ``ends`` by the stretches of both; if it has a kind, below 8, ``to`` holds it too."""
    to = F.shiftright("next", SIDE)
    ends = ends.select(
        F.shiftright("node", SIDE).alias("s"), (to * 8 + F.col("kind") if "kind" in ends.columns else to).alias("to"),
        F.shiftleft(_offset("next"), SIDE).bitwiseOR(_offset("node")).cast("int").alias("call"),
    )
    return Written(_dealt(ends, places, "s", "to").mapInArrow(_pack, "s long, to long, calls array<int>"))


def _offset(node: str) -> Column:
    return F.col(node).bitwiseAND(_NODES - 1)


def counts(found: list[DataFrame], groups: DataFrame, places: int) -> Written:
    """(kind, b, nth, n): to how many groups of a kind a bit has come, by any node of the group.

    ``groups`` has (kind, node, next): the number of a kind, below 8, and a number of the group of that kind.
    Kinds of an odd number leave out what is at distance 0.
    """
    spark = groups.sparkSession
    of = _packed(groups, places)
    with small_batches(spark):
        come = reduce(DataFrame.union, found).repartition(places, "s").join(of.df.repartition(places, "s"), "s").where("distance > 0 OR pmod(to, 2) = 0")
        come = come.select("to", "b", "at", "bits", "calls").sortWithinPartitions("to", "b").mapInArrow(_step, _BLOCK)
        held = Written(_dealt(come, places, "s", "b").mapInArrow(_counts, "s long, b long, nth long, n long").groupBy(F.pmod("s", F.lit(8)).alias("kind"), "b", "nth").agg(F.sum("n").alias("n")))
    of.drop()
    return held


def walk(first: DataFrame, calls: DataFrame, levels: int | None, places: int, distances: bool, read: Callable[[], None]) -> list[tuple[Written, DataFrame]]:
    """Tables, and of each what it has of the blocks (s, b, at, bits, distance); distance is 1 for any but 0 without ``distances``.

    ``first`` has (node, b, c, bits), the words of the origins themselves; ``calls`` (node, next) is read once, then ``read`` is called.
    """
    spark = first.sparkSession
    ends = _packed(calls, places)
    read()
    with small_batches(spark):
        own = first.select(F.shiftright("node", SIDE).alias("s"), "b", _offset("node").alias("at"), "c", "bits").mapInArrow(_single, _BLOCK)
        own = Written(own)
        now = Written(_dealt(own.df.withColumn("old", F.lit(False)), places, "s", "b").mapInArrow(_merge, _STATE))
        own.drop()
        new = lambda of: of.df.select("s", "b", F.col("new_at").alias("at"), F.col("new").alias("bits")).where("length(new_at) > 0")
        own = Written(new(now))
        found, level = [(own, own.df.withColumn("distance", F.lit(0)))], 0
        frontier = own
        while levels is None or level < levels:
            level += 1
            step = frontier.df if frontier else new(now)
            step = step.repartition(places, "s").join(ends.df.repartition(places, "s"), "s").select("to", "b", "at", "bits", "calls")
            come = step.sortWithinPartitions("to", "b").mapInArrow(_step, _BLOCK).withColumn("old", F.lit(False))
            seen = now.df.select("s", "b", F.col("seen_at").alias("at"), F.col("seen").alias("bits"), F.lit(True).alias("old"))
            after = Written(_dealt(come.union(seen), places, "s", "b").mapInArrow(_merge, _STATE))
            now.drop()
            now = after
            if new(now).isEmpty():
                break
            frontier = None
            if distances:
                frontier = Written(new(now))
                found.append((frontier, frontier.df.withColumn("distance", F.lit(level))))
        ends.drop()
        if not distances:
            seen = now.df.select("s", "b", F.col("seen_at").alias("at"), F.col("seen").alias("bits"), F.lit(False).alias("old"))
            rest = Written(_dealt(seen.union(own.df.withColumn("old", F.lit(True))), places, "s", "b").mapInArrow(_merge, _STATE))
            found.append((rest, new(rest).withColumn("distance", F.lit(1))))
        now.drop()
    return found


def _named(found: list[DataFrame], names: DataFrame) -> DataFrame:
    """Blocks with the names of their nodes, those of a stretch one after the other."""
    of = names.groupBy(F.shiftright("node", SIDE).alias("s")).agg(F.array_sort(F.collect_list(F.struct("node", "name"))).getField("name").alias("names"))
    return reduce(DataFrame.union, found).join(of, "s")


def words(found: list[DataFrame], names: DataFrame) -> DataFrame:
    """(node, w, bits, distance) of blocks; ``names`` has (name, node)."""
    return _named(found, names).select("b", "at", "bits", "distance", "names").mapInArrow(_words, "node string, w long, bits long, distance int")


def pairs(found: list[DataFrame], names: DataFrame, marks: DataFrame) -> DataFrame:
    """(origin, node, distance) of blocks; ``marks`` has (origin, b, c, nth)."""
    origins = marks.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("c", "nth", "origin"))).getField("origin").alias("origins"))
    held = _named(found, names).join(origins, "b").select("at", "bits", "distance", "names", "origins")
    return held.mapInArrow(_pairs, "origin string, node string, distance int")


def told_in_one_place(rounds: int):
    """A kernel of all rows (name, id, low, high): (name, part), the least id that is linked to a name's, or 0 for all after ``rounds``."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        of, low, high = (table.column(n).to_numpy() for n in ("id", "low", "high"))
        ids = np.unique(of)
        of, low, high = (np.searchsorted(ids, x) for x in (of, low, high))
        part, done = np.arange(len(ids)), False
        np.minimum.at(part, of, low)
        for _ in range(rounds):
            now = part[part]
            least = now.copy()
            for a, b in ((of, low), (low, of), (of, high), (high, of)):
                np.minimum.at(now, a, least[b])
            done, part = np.array_equal(now, part), now
            if done:
                break
        parts = ids[part[of]] if done else np.zeros(len(of), np.int64)
        for a in range(0, len(of), _ROWS):
            yield pa.record_batch([table.column("name").slice(a, _ROWS).combine_chunks(), pa.array(parts[a : a + _ROWS])], names=["name", "part"])

    return told
