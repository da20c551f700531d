"""Secret scans by corpus-wide ownership frequency.

One pass over each whole text finds credentials by pattern and, beside them,
bare tokens that look like keys. What leaves the pass is spans and digests,
never the values. The digests are counted over the whole corpus by distinct
repositories and owners: a value that many owners share is a copied example, a
live-looking value of few owners is theirs. Bare tokens are reported only when
they are owner-specific; pattern matches always are, with their verdict.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import saved

KINDS = ("assign", "access", "hex", "bare")
#: Fixed patterns and lengths of the base kinds.
_ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LEAST_ASSIGN, _LEAST_ACCESS = 8, 16
_BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits a character that a live-looking value has at least.
LIVE_BITS = 3.0
#: From so many distinct owners on a value counts as a copied example.
EXAMPLE_OWNERS = 3


def bits(value: str) -> float:
    """Entropy of a value's characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str) -> bool:
    return bits(value) >= LIVE_BITS and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in code points, by start and kind; bare ones don't overlap others."""
    if not text:
        return []
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    base = sorted((a, b) for a, _, b, _ in found)
    reach, at = 0, 0
    for m in _BARE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and looks_live(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found, key=lambda f: f[:3])


def _span(s) -> F.Column:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_cols: tuple[str, ...] = ("source", "lang"),
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per row of ``docs``: id, found (array of kind, start, end, digest, owners, repositories, verdict).

    ``verdict`` is ``live`` for a live-looking value of fewer than
    ``example_owners`` owners, ``example`` from that many on, ``weak``
    otherwise; bare tokens are listed only when live. Null and empty texts have
    no spans. A null owner is an owner of its own, so is a null in a
    repository's columns. Rows may repeat. Extra columns, whatever their names,
    play no part. An empty table gives no rows.
    """
    owner = F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit(""))
    repository = F.xxhash64(*[F.col(c) for c in repository_cols], *[F.col(c).isNull() for c in repository_cols])
    rows = docs.select(
        F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("_id"), owner.alias("_owner"),
        repository.alias("_repository"), F.monotonically_increasing_id().alias("_row"),
    )
    piece = T.StructType(
        [T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()),
         T.StructField("digest", T.BinaryType()), T.StructField("live", T.BooleanType())]
    )
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("digest", pa.binary()), ("live", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                [
                    {"start": a, "kind": k, "end": z, "digest": hashlib.sha256(v.encode()).digest(), "live": looks_live(v)}
                    for a, k, z, v in find(text.as_py())
                ]
                for text in b.column(0)
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, arrow)], ["_id", "_owner", "_repository", "_row", "_found"])

    schema = T.StructType([*rows.schema.fields[1:], T.StructField("_found", T.ArrayType(piece))])
    read = saved(rows.mapInArrow(run, schema), "secrets")
    each = read.select("_row", "_owner", "_repository", F.explode("_found").alias("s"))
    owned = each.select(F.col("s.digest").alias("_digest"), "_owner", "_repository").distinct()
    per_owner = owned.groupBy("_digest", "_owner").agg(F.count(F.lit(1)).alias("_n"))
    spread = per_owner.groupBy("_digest").agg(F.count(F.lit(1)).alias("_owners"), F.sum("_n").alias("_repositories"))
    # a written table, as only a join of two shuffles can split the rows of a value that many texts hold
    spread = saved(spread, "spread")
    verdict = F.when(F.col("_owners") >= example_owners, "example").when(F.col("s.live"), "live").otherwise("weak")
    judged = (
        each.select("_row", "s", F.col("s.digest").alias("_digest"))
        .join(spread, "_digest")
        .select("_row", "s", "_owners", "_repositories", verdict.alias("_verdict"))
        .where((F.col("s.kind") < KINDS.index("bare")) | (F.col("_verdict") == "live"))
        .groupBy("_row")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "s.start", "s.kind", "s.end", "s.digest", F.col("_owners").alias("owners"),
                        F.col("_repositories").alias("repositories"), F.col("_verdict").alias("verdict"),
                    )
                )
            ).alias("found")
        )
    )
    none = F.array().cast(judged.schema["found"].dataType)
    return read.select("_row", "_id").join(judged, "_row", "left").select(
        F.col("_id").alias(id_col), F.coalesce("found", none).alias("found")
    )


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def digest_of(found: DataFrame) -> DataFrame:
    """The result of :func:`scan` as counts, spans as text, and the hash of the base spans."""
    base = F.filter("found", lambda s: s["kind"] < KINDS.index("bare"))
    text = lambda spans: F.array_join(F.transform(spans, _span), ",")
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    rest = [c for c in found.columns if c != "found"]
    return found.select(
        *rest,
        *[count(_of_kind(k)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(text(base), 256).alias("base_sha256"),
        text("found").alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
    )
