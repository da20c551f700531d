"""Facts of all source files of both revisions, extracted once for each distinct content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ripplemark.functions import code, paths
from ripplemark.functions.extract import extract
from ripplemark.functions.extract.facts import Facts
from ripplemark.tables import cut

FACTS = (
    "path string, hash string, functions array<struct<idx: int, parent: int, owner: int, name: string, exported: boolean, method: boolean, "
    "start_line: int, end_line: int, body_hash: string, route: string, calls: array<struct<call: string, line: int>>>>, "
    "imports array<struct<local: string, specifier: string, kind: string, imported: string>>, specifiers array<string>, "
    "reexports array<string>, namespaces array<struct<name: string, specifier: string>>, module_calls array<struct<call: string, line: int>>, "
    "hits array<struct<query: string, line: int, loop: boolean, stops_early: boolean>>, "
    "interfaces array<struct<type: string, method: string>>, methods array<struct<type: string, method: string>>, "
    "rpc_calls array<struct<method: string, path: string, line: int>>, mounts array<struct<prefix: string, router: string>>"
)


def _row(path: str, hash_: str, facts: Facts) -> dict:
    functions = []
    for i, f in enumerate(facts.functions):
        owner = i  # calls of a nameless callback are made by the function it stands in
        while facts.functions[owner].name is None and facts.functions[owner].route is None and facts.functions[owner].parent is not None:
            owner = facts.functions[owner].parent
        functions.append(
            {
                "idx": i, "parent": f.parent, "owner": owner, "name": f.name, "exported": f.exported, "method": f.method,
                "start_line": f.start_line, "end_line": f.end_line, "body_hash": f.body_hash, "route": f.route,
                "calls": [{"call": c, "line": n} for c, n in f.calls],
            }
        )
    pairs = lambda rows, *names: [dict(zip(names, r, strict=True)) for r in rows]
    return {
        "path": path, "hash": hash_, "functions": functions, "imports": [vars(i) for i in facts.imports], "specifiers": facts.specifiers,
        "reexports": facts.reexports, "namespaces": pairs(facts.namespace_reexports, "name", "specifier"),
        "module_calls": pairs(facts.module_calls, "call", "line"), "hits": [vars(h) for h in facts.hits],
        "interfaces": pairs(facts.interfaces, "type", "method"), "methods": pairs(facts.methods, "type", "method"),
        "rpc_calls": pairs(facts.rpc_calls, "method", "path", "line"), "mounts": pairs(facts.mounts, "prefix", "router"),
    }


def facts(files: DataFrame) -> DataFrame:
    """(rev, path, hash, …facts) of source files that are neither tests nor in skipped directories."""
    keep = paths.is_source(F.col("path")) & ~paths.is_test(F.col("path")) & ~paths.is_skipped(F.col("path"))
    sources = files.where(keep).withColumn("hash", F.md5("text"))
    schema = to_arrow_schema(T._parse_datatype_string(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row(p, h, extract(p, t)) for p, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    once = sources.select("path", "hash", "text").dropDuplicates(["path", "hash"]).mapInArrow(run, FACTS)
    return cut(sources.select("rev", "path", "hash").join(once, ["path", "hash"]))


def functions(found: DataFrame) -> DataFrame:
    """(rev, path, idx, parent, owner, name, label, exported, method, start_line, end_line, body_hash, route)."""
    f = found.select("rev", "path", F.explode("functions").alias("f")).select("rev", "path", "f.*").drop("calls")
    return f.withColumn("label", code.label(F.col("name"), F.col("start_line")))


def calls(found: DataFrame) -> DataFrame:
    """(rev, path, idx of the caller or null at the top level, ord, call, line); callbacks count to their owner."""
    inner = found.select("rev", "path", F.explode("functions").alias("f")).select(
        "rev", "path", F.col("f.owner").alias("idx"), F.posexplode("f.calls").alias("ord", "c")
    )
    top = found.select("rev", "path", F.lit(None).cast("int").alias("idx"), F.posexplode("module_calls").alias("ord", "c"))
    return inner.unionByName(top).select("rev", "path", "idx", "ord", "c.call", "c.line")


def added_lines(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, line, text) of the head's lines that the change added; renames compare with the previous path."""
    from ripplemark.functions.extract import lines

    named = changes.where("change <> 'deleted'").select("path", F.coalesce("previous_path", "path").alias("before"))
    head = files.where("rev = 'head'").select("path", F.col("text").alias("head"))
    base = files.where("rev = 'base'").select(F.col("path").alias("before"), F.col("text").alias("base"))
    both = named.join(head, "path").join(base, "before", "left").select("path", "base", "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, old, new in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text, numbers = new.splitlines(), lines.added_lines(old, new)
                cols = [pa.array([p] * len(numbers), pa.string()), pa.array(numbers, pa.int32()), pa.array([text[n - 1] for n in numbers], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["path", "line", "text"])

    return both.mapInArrow(run, "path string, line int, text string")


def statements(files: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, line, statement, span, excerpt) of the forward half of changed SQL files of the head."""
    from ripplemark.functions.extract import sql

    texts = files.where("rev = 'head'").join(changed.select("path").distinct(), "path", "left_semi").where(F.col("path").rlike(r"\.sql$")).select("path", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head = sql.forward_half(t)
                raw, found = head.splitlines(), sql.statements(head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * len(found), pa.string()), pa.array([n for n, _ in found], pa.int32()), pa.array([s for _, s in found], pa.string()),
                     pa.array([max(1, len(s.splitlines())) for _, s in found], pa.int32()), pa.array([raw[n - 1].strip() for n, _ in found], pa.string())],
                    ["path", "line", "statement", "span", "excerpt"],
                )

    return texts.mapInArrow(run, "path string, line int, statement string, span int, excerpt string")


def without_sql_comments(files: DataFrame) -> DataFrame:
    """(path, text) of the head, SQL without its comments."""
    from ripplemark.functions.extract import sql

    rows = files.where("rev = 'head'").select("path", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([sql.without_comments(t) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], ["path", "text"])

    is_sql = F.col("path").rlike(r"\.sql$")
    return rows.where(~is_sql).unionByName(rows.where(is_sql).mapInArrow(run, "path string, text string"))
