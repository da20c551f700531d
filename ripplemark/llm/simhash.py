"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, components.

A fingerprint is computed in one pass over each text. Everything after works
on distinct fingerprints. They are cut into blocks; two that differ in at most
``bits`` bits agree in at least ``blocks - bits`` of them, so every choice of
that many blocks is a join key, and close pairs share one. Candidates of a key
are verified by distance and reduced to the links that connect them.

A key with many fingerprints is dealt into chunks of at most about ``_CHUNK`` by
a hash, and each pair of chunks is a row of its own: no row holds more than two
chunks, however popular the key, and no candidate is left out. A pair of chunks
yields only links that neither chunk has by itself.

Texts that share four fifths of their shingles differ in too many bits of any
fingerprint for blocks of it to be both shared and selective. For these
(:func:`similar_dedup`) the pigeonhole is taken over the shingles themselves,
the fingerprint's input: see there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frequent import least_count
from .scratch import saved

SHINGLE = 4
BITS = 4
SEED = 42
#: Blocks of a fingerprint, as few as leave a key with this many fingerprints on average.
BLOCKS, _PER_KEY = 6, 64
_CHUNK = 512
#: Similar texts: words of a shingle, least Jaccard similarity of the distinct shingles that links two texts.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of 64 bits that candidates are compared by, and the bits they may differ in altogether: at 0.8 two texts
#: differ in 29 on average, the shortest in 36, with a deviation of 5.
WIDE_LANES, WIDE_BITS = 3, 64
#: Texts that are compared at a time are two chunks of so many.
_TEXTS = 128
#: Shingles that are ordered by how many texts have them: at most so many, if they have the least count.
HOT_SHINGLES, _HOT_LEAST = 1 << 18, 16
#: Shingles of a text beyond its prefix that are counted too, as late ones leave room for them.
_BEYOND = 32
#: Groups up to this size are compared many at a time; shingles whose texts are counted at a time.
_SMALL, _COLUMNS = 16, 4096


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of every word shingle of a UTF-8 text; none for null and for texts without words.

    A to Z count as lower case. Words lie between runs of space and tab to
    carriage return. Fewer words than a shingle make one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return []
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return [digest(line, seed)]
    return [digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def _majority(hashes: np.ndarray) -> np.uint64:
    """Each bit that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):  # long texts a part at a time; 255 ones fit a byte
        bits = np.unpackbits(hashes[at : at + 255 * 256].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a UTF-8 text; 0 for null and for texts without words."""
    hashes = shingle_hashes(text, shingle, seed)
    return int(_majority(np.array(hashes, np.uint64))) if hashes else 0


def distinct_shingles(text: bytes | None, shingle: int, seed: int = SEED) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle, seed), np.uint64))


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs of arrays of distinct shingles have a Jaccard similarity of ``least`` or more; two empty ones have."""
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shares = held[column] > 1
    row, (_, column) = row[shares], np.unique(column[shares], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [start, start + _COLUMNS])
        part = np.zeros((len(sets), int(column[b - 1]) - start + 1), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        shared += part @ part.T
    np.fill_diagonal(shared, sizes)
    return shared >= least * (sizes[:, None] + sizes[None, :] - shared)


def lanes(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` fingerprints of independent remixes of the same distinct shingle hashes; all 0 without words."""
    if not len(hashes):
        return np.zeros(n, np.uint64)
    out = [_majority(hashes)]
    for i in range(1, n):
        z = hashes + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(z ^ (z >> np.uint64(31))))
    return np.array(out, np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(_id, _hash of the text, _fp as a signed long) for every row."""
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"),
        F.col(text_col).cast("binary").alias("_text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints.view(np.int64))], ["_id", "_hash", "_fp"])

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("_fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def _masks(blocks: int, bits: int) -> list[int]:
    """As signed longs, the bits of every choice of blocks that close fingerprints must share one of."""
    of = [sum(1 << int(i) for i in part) for part in np.array_split(np.arange(64), blocks)]
    chosen = [sum(c) for c in combinations(of, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds the lanes of a fingerprint."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def _near(a: np.ndarray, bits: int) -> np.ndarray:
    return sum(np.bitwise_count(x[:, None] ^ x[None, :]).astype(np.int16) for x in a.T) <= bits


def _labels(near: np.ndarray) -> np.ndarray:
    """Of each row, the least row that it is connected to."""
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _spanning(near: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``near`` connects: (row, least row). Of two chunks, of which the first has ``first``
    rows, only the links that connect what neither connects by itself."""
    label = _labels(near)
    moved = np.flatnonzero(label != np.arange(len(near)))
    if first < len(near):
        apart = near.copy()
        apart[:first, first:] = apart[first:, :first] = False
        moved = moved[_labels(apart)[moved] == moved]
    return moved, label[moved]


def _verify(bits: int, n_lanes: int):
    """Reads one or two chunks of rows: what names a fingerprint, then its lanes; a lone lane names itself."""
    width = n_lanes + (n_lanes > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = b.column(0).values
            values = chunks.values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)
            at, of = chunks.offsets.to_numpy() // width, b.column(0).offsets.to_numpy()
            start, middle, end = at[of[:-1]], at[of[:-1] + 1], at[of[1:]]
            sizes = end - start
            u, v = [], []
            for size in np.unique(sizes[(sizes > 1) & (sizes <= _SMALL)]):
                rows = values[start[sizes == size][:, None] + np.arange(size)[None, :]]
                for i, j in combinations(range(size), 2):
                    near = _distance(rows[:, i, -n_lanes:], rows[:, j, -n_lanes:]) <= bits
                    u.append(rows[near, i, 0])
                    v.append(rows[near, j, 0])
            for k in np.flatnonzero(sizes > _SMALL):
                # in order, so that the rows of a chunk have the same least one under every key
                parts = [x[np.argsort(x[:, 0])] for x in (values[start[k] : middle[k]], values[middle[k] : end[k]])]
                rows = np.concatenate(parts)
                x, y = _spanning(_near(rows[:, -n_lanes:], bits), len(parts[0]))
                u.append(rows[x, 0])
                v.append(rows[y, 0])
            if u:
                ends = np.stack([np.concatenate(u), np.concatenate(v)], axis=1)
                ends = np.unique(np.sort(ends, axis=1), axis=0)  # found under several keys
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, i].view(np.int64)) for i in (0, 1)], ["u", "v"])

    return run


def blocks_for(n: int, bits: int = BITS) -> int:
    """As few blocks as leave ``_PER_KEY`` of ``n`` fingerprints to a key on average, if they are even."""
    return next(b for b in range(bits + 2, 33) if b == 32 or n <= _PER_KEY << (64 * (b - bits) // b))


def links(prints: DataFrame, bits: int = BITS, blocks: int = BLOCKS, chunk: int = _CHUNK) -> DataFrame:
    """(u, v) that connect the distinct fingerprints ``_fp`` as all pairs up to ``bits`` apart do."""
    keys = prints.select(
        F.array("_fp").alias("_one"),
        F.posexplode(F.array(*[F.col("_fp").bitwiseAND(F.lit(m).cast("long")) for m in _masks(blocks, bits)])).alias("_c", "_key"),
    )
    by = ["_c", "_key"]
    return _pairs(_dealt(_shared(keys, by), by, chunk), by).mapInArrow(_verify(bits, 1), "u long, v long").distinct()


def _shared(keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose key ``by`` others have too, with their number ``_n``."""
    # a written table, as only a join of two shuffles can split the rows of a popular key
    return keys.join(saved(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared"), by)


def _dealt(rows: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """The lists ``_one`` of each key, one after the other, in ``_of`` chunks ``_part`` of a column ``_chunk``.

    The numbers of chunks are powers of two, so that chunks of different keys have the same rows in common.
    """
    of = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / chunk)))).cast("int")
    return (
        rows.withColumn("_of", of)
        .withColumn("_part", F.pmod(F.xxhash64("_one"), F.col("_of")).cast("int"))
        .groupBy(*by, "_of", "_part")
        .agg(F.flatten(F.collect_list("_one")).alias("_chunk"))
    )


def _pairs(dealt: DataFrame, by: list[str]) -> DataFrame:
    """Each chunk, and each two chunks of a key."""
    whole = dealt.where("_of = 1").select(F.array("_chunk"))
    other = F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_other")
    pairs = (
        dealt.where("_of > 1")
        .select(*by, "_part", "_chunk", other)
        .groupBy(*by, F.least("_part", "_other").alias("_lo"), F.greatest("_part", "_other").alias("_hi"))
        .agg(F.collect_list("_chunk").alias("_chunks"))
    )
    return whole.union(pairs.select("_chunks"))


def _groups(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, seed: int, blocks: int | None
) -> tuple[DataFrame, DataFrame]:
    """(_id, _hash, _fp) of every row, and (_fp, _least id, _root): the least fingerprint of its component."""
    rows = saved(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = saved(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct")
    return rows, _rooted(distinct, components(links(distinct, bits, blocks or blocks_for(distinct.count(), bits))))


def _rooted(distinct: DataFrame, found: DataFrame) -> DataFrame:
    roots = distinct.join(found, distinct["_fp"] == found["node"], "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
    )
    return saved(roots, "roots")


def _similar_links(shingle: int, seed: int):
    """Reads one or two chunks of (hash, text); names the hashes of links that connect what their similar texts connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for chunks in b.column(0):
                parts = [x.values for x in chunks]
                hashes = np.concatenate([x.field(0).to_numpy() for x in parts])
                sets = [distinct_shingles(t.as_py(), shingle, seed) for x in parts for t in x.field(1)]
                x, y = _spanning(similar(sets, SIMILARITY), len(parts[0]))
                u.append(hashes[x])
                v.append(hashes[y])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e)) for e in (u, v)], ["u", "v"])

    return run


def prefix(hashes: np.ndarray, least: float, late: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """So many of a text's distinct shingles that a text with ``least`` of all shingles in common has one of them in its own.

    Of n shingles a similar text lacks at most n - ceil(least n), so of one more it has one; taken in one order for all
    texts, each has its first shared one among these. The order is that of the hashes, but shingles that many texts have
    come last: ``late``, ascending, and the ``rank`` of each.
    """
    at = np.minimum(np.searchsorted(late, hashes), max(0, len(late) - 1))
    frequent = late[at] == hashes if len(late) else np.zeros(len(hashes), bool)
    order = np.concatenate([hashes[~frequent], hashes[frequent][np.argsort(rank[at[frequent]])]])
    return order[: _prefix_length(len(hashes), least)]


def _prefix_length(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1


def _late(texts: DataFrame, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and the rank of each; a bounded number, by counts over all texts.

    Counted are the hashes that a text's prefix takes if none is late, and some beyond. A bound on the hash instead would
    leave out most of a short text: what many have in common would stay a key, and link them into one component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                hashes = distinct_shingles(t.as_py(), shingle, seed)
                few = hashes[: _prefix_length(len(hashes), SIMILARITY) + _BEYOND].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(few)], ["h"])

    counts = saved(texts.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= _HOT_LEAST), "late")
    most = counts.where(F.col("c") >= least_count(counts, HOT_SHINGLES)).orderBy("c", "h").select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(most)
    return most[order], order


def _classes(texts: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(_hash, _key, _class) of ``texts``: the least hash that links lead to."""
    found = components(reduce(DataFrame.unionByName, links))
    return texts.select("_hash", "_key").join(found, F.col("_hash") == F.col("node"), "left").select(
        "_hash", "_key", F.coalesce("root", "_hash").alias("_class")
    )


def _counted(rows: DataFrame, least: int = 2) -> DataFrame:
    """Adds the number ``_n`` of rows of each _key, where that is at least ``least``."""
    return rows.join(saved(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least), "several"), "_key")


def _similar(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(node, root) of the texts (_hash, _key, _text, _n) that links of similar texts of the same _key connect.

    Every two texts of a key are compared, unless they are connected already. First those of each chunk; then one of each
    class that this leaves; then, where a key still has several classes, the texts of all but its largest with all others.
    """
    one, verify = F.array(F.struct("_hash", "_text")).alias("_one"), _similar_links(shingle, seed)
    compared = lambda chunks: saved(chunks.mapInArrow(verify, "u long, v long").distinct(), "links")
    listed = lambda rows: _dealt(rows.select("_key", "_n", one), ["_key"], _TEXTS)
    found = [compared(listed(texts).select(F.array("_chunk")))]
    large = texts.where(F.col("_n") > _TEXTS)
    if large.isEmpty():
        return components(found[0])
    classes = _classes(large, found)
    heads = _counted(classes.select("_key", F.col("_class").alias("_hash")).distinct())
    found.append(compared(_pairs(listed(heads.join(large.select("_hash", "_text"), "_hash")), ["_key"])))
    classes = saved(_classes(large, found), "classes")
    sizes = classes.groupBy("_key", "_class").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("_key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("_class", F.struct("n", "_class")).alias("_most"))
    several = saved(several.where("classes > 1").select("_key", "_most"), "several")
    if not several.isEmpty():
        rest = classes.join(several, "_key").where("_class <> _most").select("_hash", "_key")
        rest = listed(_counted(rest, 1).join(large.select("_hash", "_text"), "_hash")).select("_key", F.col("_chunk").alias("_mine"))
        whole = listed(large.join(several.select("_key"), "_key"))
        found.append(compared(rest.join(whole, "_key").select(F.array("_mine", "_chunk"))))
    return components(reduce(DataFrame.unionByName, found))


def _wide_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """As :func:`_groups`, for texts whose shingles are similar rather than nearly all the same; the _fp returned is the text's _hash."""
    given = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"),
    )
    late, rank = _late(given.select("_text"), shingle, seed)
    sent = docs.sparkSession.sparkContext.broadcast((late, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda found: pa.ListArray.from_arrays(
            np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
        )
        for b in batches:
            texts = [distinct_shingles(t.as_py(), shingle, seed) for t in b.column(2)]
            keys = [prefix(h, SIMILARITY, *sent.value) if len(h) else np.zeros(1, np.uint64) for h in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), lists([lanes(h, WIDE_LANES) for h in texts]), lists(keys)], ["_id", "_hash", "_lanes", "_keys"]
            )

    added = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("_lanes", "_keys")]
    rows = saved(given.mapInArrow(run, T.StructType([*given.schema.fields[:2], *added])), "wide")
    prints = saved(rows.groupBy("_hash").agg(F.first("_lanes").alias("_lanes"), F.first("_keys").alias("_keys")), "prints")
    shared = _shared(prints.select("_hash", F.explode("_keys").alias("_key")), ["_key"])
    shared = shared.join(prints.select("_hash", "_lanes"), "_hash").select("_key", "_n", F.concat(F.array("_hash"), "_lanes").alias("_one"))
    near = _pairs(_dealt(shared, ["_key"], _CHUNK), ["_key"]).mapInArrow(_verify(WIDE_BITS, WIDE_LANES), "u long, v long").distinct()

    # candidates are the texts of a component of near fingerprints
    near = components(near)
    texts = given.join(near, F.col("_hash") == F.col("node")).groupBy("_hash").agg(F.first("root").alias("_key"), F.first("_text").alias("_text"))
    found = _similar(saved(_counted(saved(texts, "texts")), "candidates"), shingle, seed)
    rows = rows.select("_id", "_hash", F.col("_hash").alias("_fp"))
    return rows, _rooted(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), found)


def hex_of(prints: Column) -> Column:
    """A signed long as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(prints)), 16, "0")


def near_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    bits: int = BITS,
    seed: int = SEED,
    blocks: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint as 16 hex digits, component_id.

    Fingerprints up to ``bits`` apart are linked; component_id is the smallest
    id reachable over links, itself included, and null where no id is known.
    Null and empty texts have fingerprint 0 and are linked like any other.
    Rows may repeat. Extra columns, whatever their names, play no part. An
    empty table gives no rows.
    """
    rows, roots = _groups(docs, id_col, text_col, shingle, bits, seed, blocks)
    least = roots.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of_print = roots.select("_fp", "_root").join(least, "_root").select("_fp", "component_id")
    return rows.join(of_print, "_fp").select(
        F.col("_id").alias(id_col), hex_of(F.col("_fp")).alias("fingerprint"), "component_id"
    )


def near_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    bits: int = BITS,
    seed: int = SEED,
    blocks: int | None = None,
) -> DataFrame:
    """``docs`` with the row of smallest id of each component, all columns kept.

    A null id is retained only where its component has no other. Of rows that
    repeat the id, the text's hash decides, then that of the other columns.
    """
    return _first_of_each(docs, *_groups(docs, id_col, text_col, shingle, bits, seed, blocks), id_col, text_col)


def similar_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, seed: int = SEED
) -> DataFrame:
    """``docs`` with the row of smallest id of each component of texts whose shingles are similar.

    Two texts are linked where the exact Jaccard similarity of their distinct
    shingles is ``SIMILARITY`` or more. The pigeonhole is over shingles: a
    text's :func:`prefix`, one shingle more than a similar text may lack, are
    its join keys of 64 bits, so every similar pair shares one. Candidates of
    a key are verified by the Hamming distance of ``WIDE_LANES`` fingerprints
    with a bound that is far beyond that of similar texts, and every two texts
    that such links connect by the exact similarity. Texts without words are
    similar to each other. Nulls and repeated rows as in :func:`near_dedup`.
    """
    return _first_of_each(docs, *_wide_groups(docs, id_col, text_col, shingle, seed), id_col, text_col)


def _first_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash")))
    kept = rows.join(roots.select("_fp", "_root"), "_fp").groupBy("_root").agg(first.alias("k")).select("k.id", "k.hash")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash")
    same = Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("_row"))
    return (
        docs.select(row, F.col(id_col).alias("_id"), text_hash)
        .join(kept, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")), "left_semi")
        .withColumn("_nth", F.row_number().over(same))
        .where("_nth = 1")
        .select("_row.*")
    )
