"""Benchmark decontamination. DataFrame functions only.

The hashes of all windows of the benchmark are broadcast as one set of longs
(its size is checked; beyond the bound they are joined by a shuffle). One scan
cuts every document into words and looks up every token window of every length
that the benchmark has. Only hits leave it, with their words, and a row for each
document with its number of words. Hits are then verified by comparing words
with those of the windows, and only then joined to the items that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved
from .words import ascii_lower, between

#: Fixed: what separates words, once A to Z are in lower case; words are digits, letters and everything beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Distinct windows of the benchmark whose hashes may be broadcast; a row of the joined table takes some 40 bytes.
MAX_BROADCAST_WINDOWS = 500_000
#: Texts with hits that may be broadcast, as id and hash.
MAX_BROADCAST_TEXTS = 200_000


def words_of(text: Column) -> Column:
    """The words of a text with A to Z in lower case; null and empty texts have none."""
    return between(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def _gram(words: str, start: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(F.col(words), start + i) for i in range(n)])


def _span(words: str, start: Column, n) -> Column:
    return F.array_join(F.slice(F.col(words), start + 1, n), " ")


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The distinct windows of each item: _n words, _window as text, _item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("_item"), words_of(F.col(text_col)).alias("_words"))
    n = F.least(F.size("_words"), F.lit(size))
    return (
        items.where(F.size("_words") > 0)
        .select("_item", "_words", n.alias("_n"), F.explode(F.sequence(F.lit(0), F.size("_words") - n)).alias("_at"))
        .select("_item", "_n", _span("_words", F.col("_at"), F.col("_n")).alias("_window"))
        .distinct()
    )


class Scan:
    """One scan of ``docs`` for the windows of ``benchmark``.

    ``texts`` is a row per row of ``docs``: _row, _id, _hash of the text, _n_words. ``hits`` are the verified occurrences:
    _row, _id, _hash, _at, _n, _gram, _window. ``items`` has the distinct (_gram, _window, _item).
    """

    def __init__(
        self, docs: DataFrame, benchmark: DataFrame, *, id_col: str, text_col: str, item_col: str, item_text_col: str,
        size: int, max_broadcast: int,
    ):
        windows = windows_of(benchmark, item_col, item_text_col, size)
        split = F.split("_window", " ", -1)
        of_length = [F.when(F.col("_n") == n, _gram("_split", F.lit(0), n)) for n in range(1, size + 1)]
        self.items = saved(windows.withColumn("_split", split).select("_n", F.coalesce(*of_length).alias("_gram"), "_window", "_item"), "windows")
        lengths = sorted(r["_n"] for r in self.items.select("_n").distinct().collect())  # at most `size`
        grams = self.items.select("_gram").distinct()
        small = grams.count() <= max_broadcast
        grams = grams.union(docs.sparkSession.range(1).select(F.xxhash64(F.lit(0))))  # what stands before a text is a hit too
        words = docs.select(
            F.col(id_col).alias("_id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"),
            words_of(F.col(text_col)).alias("_words"),
            F.monotonically_increasing_id().alias("_row"),
        )
        at = words.select("*", F.explode(F.sequence(F.lit(-1), F.size("_words") - 1)).alias("_at"))
        first = F.when(F.col("_at") < 0, F.xxhash64(F.lit(0)))
        inside = lambda n: (F.col("_at") >= 0) & (F.col("_at") + n <= F.size("_words"))
        if len(lengths) <= 1:
            n = (lengths or [size])[0]
            looked = at.withColumn("_n", F.lit(n)).withColumn("_gram", F.coalesce(first, F.when(inside(n), _gram("_words", F.col("_at"), n))))
        else:
            each = [F.struct(F.lit(n).alias("_n"), F.when(inside(n), _gram("_words", F.col("_at"), n)).alias("_gram")) for n in lengths]
            looked = at.select("*", F.inline(F.array(F.struct(F.lit(0).alias("_n"), first.alias("_gram")), *each)))
        here = F.when(F.col("_at") >= 0, _span("_words", F.col("_at"), F.col("_n"))).alias("_here")
        columns = ["_row", "_id", "_hash", F.size("_words").alias("_n_words"), "_at", "_n", "_gram", here]
        if small:
            found = looked.join(F.broadcast(grams), "_gram").select(*columns)
        else:  # the words of the window go along, not the whole text
            found = looked.where("_gram IS NOT NULL").select(*columns).join(grams, "_gram")
        found = saved(found, "hits")
        self.texts = found.where("_at < 0").select("_row", "_id", "_hash", "_n_words")
        texts = self.items.select("_gram", F.col("_window").alias("_here")).distinct()
        self.hits = found.where("_at >= 0").join(texts, ["_gram", "_here"]).select("_row", "_id", "_hash", "_at", "_n", "_gram", F.col("_here").alias("_window"))

    def bad(self) -> DataFrame:
        """(_i, _h): id and hash of the texts with hits; broadcast if they are few."""
        found = saved(self.hits.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).distinct(), "bad")
        return F.broadcast(found) if found.count() <= MAX_BROADCAST_TEXTS else found


def hit_counts(scan: Scan) -> DataFrame:
    """Per row with hits: _n_hit words inside any occurrence, and the sorted ids of the items _found."""
    earlier = Window.partitionBy("_row").orderBy("_at", "_n").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("_at") + F.col("_n")).over(earlier), F.lit(0))
    new = F.greatest(F.lit(0), F.col("_at") + F.col("_n") - F.greatest(F.col("_at"), reach))
    counted = scan.hits.select("_row", new.alias("_new")).groupBy("_row").agg(F.sum("_new").cast("long").alias("_n_hit"))
    of = scan.hits.select("_row", "_gram", "_window").distinct().join(scan.items.select("_gram", "_window", "_item"), ["_gram", "_window"])
    listed = of.groupBy("_row").agg(F.array_sort(F.collect_set("_item")).alias("_found"))
    return counted.join(listed, "_row")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    max_broadcast: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items, items_sha256, contaminated.

    An item of fewer than ``size`` words, but not none, is a single window.
    Null and empty texts have no words. Items are told apart by id; one whose
    id is null marks words but is not listed. Rows of ``docs`` may repeat, ids
    may be null. An empty table on either side gives no hits. Extra columns,
    whatever their names, play no part.
    """
    scan = Scan(
        docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col,
        size=size, max_broadcast=max_broadcast,
    )
    listed = F.coalesce("_found", F.array().cast("array<string>"))
    return scan.texts.join(hit_counts(scan), "_row", "left").select(
        F.col("_id").alias(id_col),
        F.col("_n_words").cast("long").alias("n_words"),
        F.coalesce("_n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        listed.alias("items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.col("_n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    max_broadcast: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark, all columns kept.

    Nulls, repeated rows and empty tables as in :func:`contamination`.
    """
    scan = Scan(
        docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col,
        size=size, max_broadcast=max_broadcast,
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash")
    kept = docs.select(row, F.col(id_col).alias("_id"), text_hash).join(
        scan.bad(), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left_anti"
    )
    return kept.select("_row.*")


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    max_broadcast: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """(id, clean): each text with its hit words cut out, and what joins them to the next word.

    The text is cut into pieces of one word with what follows it; the pieces of
    hit words go. Texts without hits are returned unchanged, null as null.
    Repeated rows, empty tables and extra columns as in :func:`contamination`.
    """
    scan = Scan(
        docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col,
        size=size, max_broadcast=max_broadcast,
    )
    spans = scan.hits.groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).agg(
        F.array_sort(F.collect_set(F.struct("_at", (F.col("_at") + F.col("_n")).alias("_to")))).alias("_spans")
    )
    text = F.col("_text")
    between = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    lead = F.regexp_extract(text, f"^({between})", 1)
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" + between), F.lit(0))
    outside = F.filter(
        F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda x: ~F.exists("_spans", lambda s: (s["_at"] <= x["i"]) & (x["i"] < s["_to"])),
    )
    clean = F.concat(lead, F.array_join(F.transform(outside, lambda x: x["p"]), ""))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"),
    )
    return rows.join(spans, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left").select(
        F.col("_id").alias(id_col), F.when(F.col("_spans").isNull(), text).otherwise(clean).alias("clean")
    )
