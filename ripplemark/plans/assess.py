"""The rules in force, applied to a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import paths
from ripplemark.operators import findings, rules
from ripplemark.plans import extraction
from ripplemark.plans.plan import VERSION as PLAN_VERSION
from ripplemark.plans.plan import Plan
from ripplemark.sources import sarif
from ripplemark.tables import cut

VERSION = 1
_FUNCTION = "array<struct<id: string, name: string, path: string, range: struct<start: int, end: int>, side: string, change: string, package: string, exported: boolean, route: string, entry: string>>"
_SYMBOL = "array<struct<id: string, called_from_packages: array<string>, reach_functions: bigint, reach_files: bigint, reach_packages: bigint, reach_entries: bigint>>"
#: What of a plan's document the rules read.
SCHEMA = f"version int, base string, head string, files array<struct<path: string, change: string, previous_path: string, package: string>>, functions {_FUNCTION}, summary struct<symbols: {_SYMBOL}>"


def check_version(document: dict) -> None:
    """Refuses plans of another version, before anything else of them is read."""
    if document.get("version") != PLAN_VERSION:
        raise ValueError(f"plan version {document.get('version')}: this reads version {PLAN_VERSION}; make the plan again")


def of_plan(plan: Plan, rule_set: rules.RuleSet, sarif_results: DataFrame | None = None) -> DataFrame:
    """Findings of a plan at hand."""
    changed = plan.functions.withColumns({"id": F.col("node"), "name": F.coalesce("route", "name", "label")})
    symbols = plan.symbols.select("id", "called_from_packages", "reach_functions", "reach_files", "reach_packages", "reach_entries")
    return _assess(plan.files, changed, symbols, plan.texts, rule_set, sarif_results)


def of_document(spark, path: str, texts: DataFrame, rule_set: rules.RuleSet, sarif_results: DataFrame | None = None) -> DataFrame:
    """Findings of a plan's document; the call graph is not made again."""
    raw = spark.read.schema("version int").option("multiLine", True).json(path).first()
    check_version({"version": raw and raw["version"]})
    doc = cut(spark.read.schema(SCHEMA).option("multiLine", True).json(path))
    files = doc.select(F.explode("files").alias("f")).select("f.*")
    functions = doc.select(F.explode("functions").alias("f")).select("f.*")
    functions = functions.withColumns({"start_line": F.col("range.start"), "end_line": F.col("range.end")})
    symbols = doc.select(F.explode("summary.symbols").alias("s")).select("s.*")
    return _assess(files, functions, symbols, texts, rule_set, sarif_results)


def _assess(files: DataFrame, functions: DataFrame, symbols: DataFrame, texts: DataFrame, rule_set: rules.RuleSet, sarif_results: DataFrame | None) -> DataFrame:
    head = texts.where("rev = 'head'")
    judged = files.where((F.col("change") != "deleted") & ~paths.is_test_for_rules(F.col("path")))
    added = cut(extraction.added_lines(texts, judged))
    moved = functions.where("change <> 'unchanged'")
    owners = moved.where("side = 'head'").select("id", "name", "path", "start_line", "end_line")

    facts = moved.join(symbols, "id", "left")
    zero = {f"reach_{k}": F.coalesce(f"reach_{k}", F.lit(0)) for k in ("functions", "files", "packages")}
    none = F.array().cast("array<string>")
    facts = facts.withColumns(zero | {"entries": F.coalesce("reach_entries", F.lit(0)), "importing_packages": F.coalesce("called_from_packages", none), "line": F.col("start_line")})
    lines = head.join(functions.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("i", "text"))
    lines = cut(lines.select("path", (F.col("i") + 1).alias("line"), "text"))
    facts = facts.join(lines, ["path", "line"], "left").withColumn("excerpt", F.trim(F.coalesce("text", F.lit(""))))

    found = [rules.symbol_findings(facts, rule_set), rules.line_findings(added, owners, rule_set)]
    reach = functions.where("side = 'head'").select("id", "name", "path", "start_line", "end_line")
    found.append(rules.reach_findings(lines, reach, rule_set))
    if rule_set.of_kind("ast"):
        sources = head.join(judged.select("path"), "path", "left_semi")
        hits = extraction.facts(sources).select("path", F.explode("hits").alias("h")).select("path", "h.*")
        found.append(rules.ast_findings(hits.join(added, ["path", "line"]), owners, rule_set))
    if rule_set.of_kind("sql"):
        statements = extraction.statements(texts, judged)
        covered = statements.select("path", "line", F.explode(F.sequence("line", F.col("line") + F.col("span") - 1)).alias("at"))
        touched = covered.join(added.select("path", F.col("line").alias("at")), ["path", "at"], "left_semi").select("path", "line").distinct().withColumn("added", F.lit(True))
        marked = cut(statements.join(touched, ["path", "line"], "left").withColumn("added", F.coalesce("added", F.lit(False))))
        found.append(rules.sql_findings(marked, extraction.without_sql_comments(texts), rule_set))
    every = rules.finish(found, rule_set)
    if sarif_results is not None:
        every = every.unionByName(sarif.on_added_lines(sarif_results, added))
    return cut(every)


def report(found: DataFrame, base: str = "base", head: str | None = None) -> dict:
    rows = [r.asDict() for r in findings.ordered(found).select("rule", "severity", "title", "path", "line", "function", "excerpt").collect()]
    rows = [{k: v for k, v in r.items() if not (k == "function" and v is None)} for r in rows]
    return {"version": VERSION, "base": base, "head": head, "findings": rows, "counts": findings.counts(found).first().asDict()}


def to_text(document: dict) -> str:
    out = []
    for f in document["findings"]:
        mark = "·" if f["severity"] == "low" else "⚠"
        excerpt = f["excerpt"] if len(f["excerpt"]) <= 90 else f["excerpt"][:89] + "…"
        out += [f"{mark} {f['severity']:<6} {f['rule']:<34} {f['title']}", f"    {f['path']}:{f['line']}  {excerpt}"]
    c = document["counts"]
    return "\n".join([*out, f"Assessment: {c['high']} high, {c['medium']} medium, {c['low']} low."])


def gate(document: dict, level: str | None) -> bool:
    """Whether a check should fail: any finding at least this severe."""
    if level is None:
        return False
    return any(findings.SEVERITIES.index(f["severity"]) <= findings.SEVERITIES.index(level) for f in document["findings"])
