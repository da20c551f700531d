"""WARC records, and not-modified revisits resolved by an as-of join.

A revisit says that a page had not changed since an earlier capture. It is
joined by canonical address to the latest earlier full response. If their
validators agree, the response's headers are brought up to date with those of
the revisit that a not-modified answer may change.

An address with a third of all captures does not end in one task: time is cut
into slices with about as many captures each, the latest response is found
inside each (address, slice), and only one row per slice is carried over to
later ones. Bodies take no part in the join; it moves ids, times and headers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slices of time: so many, each of so many.
SLICES = 32
_CHUNK = 1 << 20
#: Headers that describe the stored body or the connection, which a not-modified answer leaves as they were.
KEPT_HEADERS = (
    "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate "
    "proxy-authorization te trailer transfer-encoding upgrade"
).split()
#: Query parameters that don't select content.
_TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without www. and the scheme's own port, no fragment, no tracking
    parameters, the others in order, no closing slash. Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^(?i){_TRACKING}(=|$)")))
    known = F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(scheme != "", known).otherwise(bare)


def _validator(headers: Column, name: str) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit(name)), r"^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """``stored`` with all of ``update`` but the kept ones; names are in lower case."""
    new = F.map_filter(update, lambda k, v: ~k.isin(KEPT_HEADERS) & v.isNotNull())
    old = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(old, new)


def _slice(records: DataFrame, slices: int) -> Column:
    """Which of ``slices`` times ``slices`` slices of time ``at`` is in, by approximate quantiles over all records."""
    n = slices * slices
    found = records.select(F.col("at").cast("double").alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    edges = found or [0.0] * (n - 1)
    at_least = lambda of: F.size(F.filter(of, lambda e: e <= F.col("at")))
    array = lambda of: F.array(*map(F.lit, of)).cast("array<double>")
    coarse = at_least(array(edges[slices - 1 :: slices]))
    fine = F.array(*[array(edges[i * slices : (i + 1) * slices - 1]) for i in range(slices)])
    return coarse * slices + at_least(F.get(fine, coarse))


def resolve_revisits(records: DataFrame, *, slices: int = SLICES) -> DataFrame:
    """One row per revisit: record_id, url, response_id, outcome, headers.

    ``records`` has record_id, kind (``response`` or ``revisit``; others play
    no part), url, at (a whole number, the time) and headers (a map, names in
    lower case). Where it has ``status`` and ``truncated``, a response is full
    if its status is 200 and it isn't truncated, and others play no part.
    Outcomes: ``resolved``; ``changed`` where the entity tags, or without both
    of those the last-modified dates, differ; ``unchecked`` where neither is on
    both sides; ``missing`` where no full response is earlier. Only
    ``resolved`` rows have headers. Of responses at the same time the largest
    record_id is the latest. A revisit without url or time is missing. Rows may
    repeat; other columns play no part. An empty table gives no rows.
    """
    full = F.lit(True)
    if {"status", "truncated"} <= set(records.columns):
        full = (F.col("status") == 200) & ~F.coalesce("truncated", F.lit(False))
    records = records.where((F.col("kind") == "revisit") | ((F.col("kind") == "response") & full))
    rows = records.select(
        F.col("record_id").alias("_id"),
        F.col("kind").alias("_kind"),
        canonical_url(F.col("url")).alias("_url"),
        F.col("at").cast("long").alias("_at"),
        _slice(records, slices).alias("_slice"),
        F.when(F.col("headers").isNotNull(), F.col("headers")).otherwise(F.create_map().cast("map<string,string>")).alias("_headers"),
    )
    is_response = F.col("_kind") == "response"
    whole = F.struct(F.col("_id").alias("id"), F.col("_headers").alias("headers"))
    # strictly earlier: at equal times revisits come first
    order = [F.col("_at"), F.when(is_response, 1).otherwise(0), F.col("_id")]
    before = Window.partitionBy("_url", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("_url").isNotNull() & F.col("_at").isNotNull()
    here = rows.where(known).withColumn("_here", F.last(F.when(is_response, whole), ignorenulls=True).over(before))
    last = F.max_by(whole, F.struct("_at", "_id"))
    ending = rows.where(known & is_response).groupBy("_url", "_slice").agg(last.alias("_last"))
    slots = rows.where(known).select("_url", "_slice").distinct().join(ending, ["_url", "_slice"], "left")
    earlier = Window.partitionBy("_url").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("_url", "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    found = here.where(~is_response).join(carried, ["_url", "_slice"]).withColumn("_of", F.coalesce("_here", "_carried"))
    lost = rows.where(~known & ~is_response).withColumn("_of", F.lit(None).cast(found.schema["_of"].dataType))
    found = found.select("_id", "_url", "_headers", "_of").unionByName(lost.select("_id", "_url", "_headers", "_of"))
    stored = F.col("_of.headers")
    pairs = [(_validator(stored, n), _validator(F.col("_headers"), n)) for n in ("etag", "last-modified")]
    agree = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in pairs])
    outcome = F.when(F.col("_of").isNull(), "missing").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("changed")
    return found.select(
        F.col("_id").alias("record_id"),
        F.col("_url").alias("url"),
        F.col("_of.id").alias("response_id"),
        outcome.alias("outcome"),
        F.when(outcome == "resolved", merged_headers(stored, F.col("_headers"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """``pages`` as a crawl: each a full response, and a revisit that asks for it again later.

    Times follow page_id. A revisit sends the tag of the page it came from, so
    it finds a changed one where the address was captured again meanwhile;
    every fifth asks before the page was there.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    at = F.col("page_id") * 10
    later = F.when(F.col("page_id") % 5 == 0, at - 5).otherwise(at + (F.col("page_id") % 97 + 1) * 10 + 5)
    text = lambda c: c.cast("string")
    response = F.create_map(
        F.lit("etag"), tag, F.lit("date"), text(at), F.lit("content-type"), F.lit("text/html"),
        F.lit("content-length"), text(F.length(F.coalesce("html", F.lit("")))), F.lit("cache-control"), F.lit("max-age=60"),
    )
    revisit = F.create_map(
        F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), text(later), F.lit("content-length"), F.lit("0"),
        F.lit("expires"), text(later + 600),
    )
    known = pages.where("page_id IS NOT NULL")
    return known.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("at"), response.alias("headers")
    ).unionByName(
        known.select(
            (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", later.alias("at"), revisit.alias("headers")
        )
    )


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a file in parts, decompressed if it is gzip; what is cut or broken ends it."""
    view, at = memoryview(data), 0
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i : i + _CHUNK]) for i in range(0, len(view), _CHUNK))
        return
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            part = view[at : at + _CHUNK // 8]
            try:
                yield member.decompress(part)
            except zlib.error:
                return
            at += len(part) - len(member.unused_data)


def parse_records(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with names in lower case, block) of each record, holding one record at a time.

    A cut last record ends the list. A record without a length that is a number is left out.
    """
    parts, buffer, at = iter(parts), bytearray(), 0

    def find(mark: bytes, start: int) -> int:
        """Where ``mark`` is, reading on if need be; -1 at the end."""
        while (found := buffer.find(mark, start)) < 0:
            start = max(start, len(buffer) - len(mark) + 1)
            more = next(parts, None)
            if more is None:
                return -1
            buffer.extend(more)
        return found

    while True:
        del buffer[:at]
        start = find(b"WARC/", 0)
        end = find(b"\r\n\r\n", start) if start >= 0 else -1
        if end < 0:
            return
        lines = buffer[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = headers.get("content-length", "")
        at = end + 4
        if not (length.isascii() and length.isdigit()):
            continue
        while len(buffer) < at + int(length):
            more = next(parts, None)
            if more is None:
                return
            buffer.extend(more)
        yield headers, bytes(buffer[at : at + int(length)])
        at += int(length)


def format_record(headers: dict[str, str], block: bytes) -> bytes:
    """One record, as :func:`parse_records` reads it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if k.lower() != "content-length")
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http_of(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """(status, headers with names in lower case, body) of an HTTP message; of headers that repeat, the last."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    said = first.split()
    status = int(said[1]) if len(said) > 1 and said[0].upper().startswith("HTTP/") and said[1].isascii() and said[1].isdigit() and len(said[1]) < 5 else None
    return status, list(dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines)).items()), body


_RECORD = "record_id string, kind string, url string, time string, status int, truncated boolean, http_headers map<string,string>, body binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, url, time, status, truncated, http_headers, body) of the response and revisit records of WARC files.

    Files are plain or compressed a record at a time, and the unit of work: a task holds one file as it is stored, which
    Spark limits to 2 GB, and the records of a batch. Broken and cut records are left out. What a record does not say is
    null; an empty file has no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for headers, block in parse_records(inflated(content.as_py())):
                    if headers.get("warc-type") not in ("response", "revisit"):
                        continue
                    status, http, body = http_of(block)
                    rows.append((headers.get("warc-record-id"), headers["warc-type"], headers.get("warc-target-uri"),
                                 headers.get("warc-date"), status, "warc-truncated" in headers, http, body))
                    size += len(block)
                    if len(rows) == 1000 or size > 16 * _CHUNK:
                        yield _records(rows)
                        rows, size = [], 0
                yield _records(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _RECORD)


def records_of(read: DataFrame) -> DataFrame:
    """What :func:`read_warc` gives, as :func:`resolve_revisits` takes it: times as microseconds, headers without bodies.

    A time that cannot be read is null, which makes a revisit missing.
    """
    at = F.unix_micros(F.try_to_timestamp("time"))
    return read.select("record_id", "kind", "url", at.alias("at"), F.col("http_headers").alias("headers"), "status", "truncated")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary()]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["record_id", "kind", "url", "time", "status", "truncated", "http_headers", "body"])
