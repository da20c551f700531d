"""Declarative rules, compiled to Columns.

A rule set is read from TOML on the driver and becomes, for each kind of rule,
one expression over the rows it looks at: all line rules are one array per line,
all symbol rules one array per changed function. So a table is scanned once
however many rules there are, and tiers and variants are CASE expressions, not
windows.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import code, paths
from ripplemark.operators import findings as _findings
from ripplemark.operators.joins import first_of, innermost

PRESETS = ("graph", "typescript", "go", "python", "postgres")
#: Fixed: what conditions may ask of a changed function.
SYMBOL_FIELDS = (
    "change", "exported", "route", "public", "importing_packages", "reach_functions", "reach_files", "reach_packages", "entries",
)
#: Syntax queries by node, and the languages that have them.
QUERIES = {"await_expression": "typescript", "defer_statement": "go", "await": "python"}
_RULE_KEYS = {
    "name", "kind", "severity", "title", "fold", "paths", "pattern", "unless", "scope", "where", "language", "query",
    "filters", "variant", "in_set", "skip_new_tables",
}
_VARIANT_KEYS, _IN_SET_KEYS = {"pattern", "when", "severity", "title"}, {"capture", "set"}
KINDS = ("line", "symbol", "sql", "ast")


class RuleError(ValueError):
    """A rule set that can't be used, with the reason."""


@dataclass
class Pattern:
    """A regular expression in the dialect without look-around, for the JVM."""

    text: str

    def __post_init__(self):
        if re.search(r"\(\?(<?[=!]|>)|\\[1-9]|\(\?P[=>]", self.text):
            raise RuleError(f"look-around and back references are not supported: {self.text}")
        try:
            compiled = re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", self.text).replace(r"\z", r"\Z"))
        except re.error as e:
            raise RuleError(f"{e}: {self.text}") from e
        self.groups, self.names = compiled.groups, dict(compiled.groupindex)
        flags = re.match(r"\(\?([a-zA-Z]+)\)", self.text)
        body = self.text[flags.end() :] if flags else self.text
        self.java = f"(?{flags[1] if flags else ''}U)" + body.replace("(?P<", "(?<")

    def on(self, text: Column) -> Column:
        return text.rlike(self.java)

    def group(self, text: Column, key: str) -> Column:
        """A group of the first match, trimmed; empty if it took no part or doesn't exist."""
        n = self.names.get(key, int(key) if key.isdigit() else None)
        return F.lit("") if n is None or n > self.groups else F.trim(F.regexp_extract(text, self.java, n))


@dataclass
class Variant:
    severity: str
    title: str
    pattern: Pattern | None = None
    when: str | None = None


@dataclass
class Rule:
    name: str
    kind: str
    severity: str
    title: str
    source: str
    fold: bool = False
    paths: Pattern | None = None
    pattern: Pattern | None = None
    unless: Pattern | None = None
    scope: str = "added"
    where: list[str] = field(default_factory=list)
    language: str = "typescript"
    query: str | None = None
    filters: list[str] = field(default_factory=list)
    variants: list[Variant] = field(default_factory=list)
    in_set: dict | None = None
    skip_new_tables: bool = False

    def applies(self, path: Column) -> Column:
        if self.paths:
            return self.paths.on(path)
        return paths.is_migration(path) if self.kind == "sql" else F.lit(True)


@dataclass
class ValueSet:
    name: str
    paths: Pattern
    patterns: list[Pattern]


@dataclass
class RuleSet:
    rules: list[Rule]
    sets: list[ValueSet]

    def of_kind(self, kind: str) -> list[Rule]:
        return [r for r in self.rules if r.kind == kind]

    @property
    def folding(self) -> list[str]:
        return sorted({r.name for r in self.rules if r.fold})


def _rule(table: dict, source: str) -> Rule:
    name = table.get("name", "?")

    def fail(why: str):
        raise RuleError(f"rule {name}: {why}")

    for missing in [k for k in ("name", "kind", "severity", "title") if k not in table]:
        fail(f"missing {missing}")
    if unknown := set(table) - _RULE_KEYS:
        fail(f"unknown field {sorted(unknown)[0]!r}")
    if table["kind"] not in KINDS:
        fail(f"unknown kind {table['kind']!r}")
    if table["severity"] not in _findings.SEVERITIES:
        fail(f"unknown severity {table['severity']!r}")
    kind = table["kind"]
    if kind in ("line", "sql") and "pattern" not in table:
        fail(f"a {kind} rule needs a pattern")
    if kind == "ast" and "query" not in table:
        fail("an ast rule needs a query")
    if kind == "symbol" and not table.get("where"):
        fail("a symbol rule needs `where`")
    for f in table.get("filters", []):
        if f != "per-loop-iteration":
            fail(f"unknown filter {f!r} (known: per-loop-iteration)")
    language = table.get("language", "typescript")
    if language not in paths.LANGUAGES:
        fail(f"unknown language {language!r} (known: {', '.join(paths.LANGUAGES)})")
    query = None
    if kind == "ast":
        found = re.fullmatch(r"\s*\((\w+)\)\s*(@hit)?\s*", table["query"])
        query = found[1] if found else None
        if QUERIES.get(query) != language:
            known = ", ".join(f"({q}) @hit" for q, of in QUERIES.items() if of == language)
            fail(f"query: {table['query']!r} is not one of those of {language}: {known}")

    def pattern(key: str, of: dict = table) -> Pattern | None:
        try:
            return Pattern(of[key]) if key in of else None
        except RuleError as e:
            fail(f"{key}: {e}")

    for c in table.get("where", []):
        try:
            condition(c)
        except RuleError as e:
            fail(f"where {c!r}: {e}")
    variants = []
    for v in table.get("variant", []):
        if unknown := set(v) - _VARIANT_KEYS:
            fail(f"variant: unknown field {sorted(unknown)[0]!r}")
        if v.get("when") not in (None, "loop-stops-early"):
            fail(f"variant: unknown `when` {v['when']!r} (known: loop-stops-early)")
        variants.append(Variant(v["severity"], v["title"], pattern("pattern", v), v.get("when")))
    if unknown := set(table.get("in_set", {})) - _IN_SET_KEYS:
        fail(f"in_set: unknown field {sorted(unknown)[0]!r}")
    return Rule(
        name, kind, table["severity"], table["title"], source, table.get("fold", False), pattern("paths"), pattern("pattern"),
        pattern("unless"), table.get("scope", "added"), table.get("where", []), language, query, table.get("filters", []),
        variants, table.get("in_set"), table.get("skip_new_tables", kind == "sql"),
    )


def _set(table: dict) -> ValueSet:
    try:
        return ValueSet(table["name"], Pattern(table["paths"]), [Pattern(p) for p in table["patterns"]])
    except (KeyError, RuleError) as e:
        raise RuleError(f"set {table.get('name', '?')}: {e}") from e


def load(text: str | None = None, source: str = "config") -> RuleSet:
    """The presets that the config names, all if it names none, with its own rules and sets over them.

    A rule of the config replaces all preset rules of its name, a set the one of its name;
    ``disable`` drops rules by name, the config's own too.
    """
    config = tomllib.loads(text) if text else {}
    rules, sets = [], []
    for name in config.get("presets", PRESETS):
        if name not in PRESETS:
            raise RuleError(f"{source}: unknown preset {name!r} (known: {', '.join(PRESETS)})")
        preset = tomllib.loads(resources.files("ripplemark").joinpath(f"presets/{name}.toml").read_text("utf-8"))
        sets += [_set(s) for s in preset.get("set", [])]
        rules += [_rule(r, f"preset:{name}") for r in preset.get("risk", [])]
    own = {r.get("name") for r in config.get("risk", [])}
    rules = [r for r in rules if r.name not in own]
    for s in config.get("set", []):
        sets = [x for x in sets if x.name != s.get("name")] + [_set(s)]
    rules += [_rule(r, source) for r in config.get("risk", [])]
    rules = [r for r in rules if r.name not in config.get("disable", [])]
    for r in rules:
        if r.in_set and r.in_set["set"] not in [s.name for s in sets]:
            raise RuleError(f"rule {r.name}: in_set names an unknown set {r.in_set['set']!r}")
    return RuleSet(rules, sets)


def _field(name: str) -> tuple[str, Column]:
    public = F.col("route").isNotNull() | (F.col("exported") & (F.size("importing_packages") > 0))
    if name == "change":
        return "text", F.col("change")
    if name in ("exported", "route", "public"):
        return "bool", {"exported": F.col("exported"), "route": F.col("route").isNotNull(), "public": public}[name]
    return "number", (F.size("importing_packages") if name == "importing_packages" else F.col(name)).cast("double")


def condition(text: str) -> Column:
    """``field``, ``!field`` or ``field op value`` over a changed function's facts."""
    text = text.strip()
    found = next(((op, *text.split(op, 1)) for op in ("==", "!=", ">=", "<=", ">", "<") if op in text), None)
    negated = found is None and text.startswith("!")
    name = (found[1] if found else text.removeprefix("!")).strip()
    if name not in SYMBOL_FIELDS:
        raise RuleError(f"unknown field {name!r} (known: {', '.join(SYMBOL_FIELDS)})")
    kind, actual = _field(name)
    if found is None:
        holds = {"bool": actual, "number": actual != 0, "text": actual != ""}[kind]
        return ~holds if negated else holds
    op, want = found[0], found[2].strip().strip('"')
    if kind == "text":
        equal = F.lower(actual) == want.lower()
        return {"==": equal, "!=": ~equal}.get(op, F.lit(False))
    if kind == "bool":
        return {"==": actual == (want == "true"), "!=": actual != (want == "true")}.get(op, F.lit(False))
    try:
        n = float(want)
    except ValueError:
        return F.lit(False)
    return {"==": actual == n, "!=": actual != n, ">=": actual >= n, "<=": actual <= n, ">": actual > n, "<": actual < n}[op]


def rendered(template: str, value) -> Column:
    """A title with ``{key}`` replaced by ``value(key)``, a Column; null reads as empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(value(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _verdict(rule: Rule, line: Column, stops_early: Column | None, value) -> Column:
    """Severity and title: those of the first variant that fits, else the rule's."""
    out = None
    for v in rule.variants:
        tests = [t for t in (v.pattern and v.pattern.on(line), stops_early if v.when else None) if t is not None]
        fits = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
        then = F.struct(F.lit(v.severity).alias("severity"), rendered(v.title, value).alias("title"))
        out = F.when(fits, then) if out is None else out.when(fits, then)
    own = F.struct(F.lit(rule.severity).alias("severity"), rendered(rule.title, value).alias("title"))
    return own if out is None else out.otherwise(own)


def _hit(rule: Rule, holds: Column, verdict: Column) -> Column:
    return F.when(holds, F.struct(F.lit(rule.name).alias("rule"), verdict.alias("v")))


def _exploded(df: DataFrame, hits: list[Column], cols: list[Column]) -> DataFrame:
    """A row for each hit that is not null."""
    some = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return df.select(*cols, F.explode(some).alias("_h")).select(
        "_h.rule", "_h.v.severity", "_h.v.title", *[c for c in ("path", "line", "function", "excerpt")]
    )


_EMPTY = "rule string, severity string, title string, path string, line int, function string, excerpt string"


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], _EMPTY)


def symbol_findings(symbols: DataFrame, rules: RuleSet) -> DataFrame:
    """Symbol rules: of each name the first whose conditions all hold.

    ``symbols`` has id, name, path, line, change, exported, route, importing_packages,
    reach_functions, reach_files, reach_packages, entries, excerpt.
    """
    listed = F.array_join("importing_packages", ", ")
    values = {
        "importing_packages": F.size("importing_packages"),
        "importing_packages_list": listed,
        "called_from": F.when(listed != "", F.concat(F.lit("; called from "), listed)),
    }
    value = lambda key: values.get(key, F.col(key) if key in _PLAIN else F.lit(""))
    tiers: dict[str, Column] = {}
    for r in rules.of_kind("symbol"):
        holds = reduce(lambda a, b: a & b, [F.coalesce(condition(c), F.lit(False)) for c in r.where])
        then = F.struct(F.lit(r.name).alias("rule"), _verdict(Rule(r.name, r.kind, r.severity, r.title, r.source), F.lit(""), None, value).alias("v"))
        tiers[r.name] = F.when(holds, then) if r.name not in tiers else tiers[r.name].when(holds, then)
    if not tiers:
        return _none(symbols)
    cols = [F.col("path"), F.col("line"), F.col("id").alias("function"), F.col("excerpt")]
    return _exploded(symbols, list(tiers.values()), cols)


_PLAIN = {"name", "route", "change", "reach_functions", "reach_files", "reach_packages", "entries"}


def with_owner(hits: DataFrame, functions: DataFrame) -> DataFrame:
    """``hits`` (path, line) with function and function_name: the smallest changed function of the head around the line."""
    spans = functions.select("path", F.col("id").alias("function"), F.col("name").alias("function_name"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    return innermost(hits, spans, ["path"], "line", "_s", "_e").drop("_s", "_e")


def _in_function() -> Column:
    return F.when(F.col("function").isNotNull(), F.concat(F.lit(" in "), F.col("function_name")))


def line_findings(lines: DataFrame, functions: DataFrame, rules: RuleSet) -> DataFrame:
    """Line rules on added lines. ``lines`` has path, line, text: those that the change added."""
    wanted = [r for r in rules.of_kind("line") if r.scope == "added"]
    if not wanted:
        return _none(lines)
    text = F.col("text")
    any_rule = reduce(lambda a, b: a | b, [r.pattern.on(text) for r in wanted])
    owned = with_owner(lines.where(any_rule), functions)
    return _exploded(owned, [_line_hit(r, text) for r in wanted], [F.col("path"), F.col("line"), F.col("function"), F.trim(text).alias("excerpt")])


def _line_hit(r: Rule, text: Column) -> Column:
    value = lambda key: _in_function() if key == "in_function" else r.pattern.group(text, key)
    holds = r.applies(F.col("path")) & r.pattern.on(text)
    if r.unless:
        holds = holds & ~r.unless.on(F.regexp_extract(text, r.pattern.java, 0))
    return _hit(r, holds, _verdict(r, text, None, value))


def reach_findings(lines: DataFrame, functions: DataFrame, rules: RuleSet, bucket: int = 64) -> DataFrame:
    """Line rules of scope ``reach``: the first hit in each function that the change reaches.

    ``lines`` has all lines of the functions' files; ``functions`` id, name, path, start_line, end_line.
    """
    wanted = [r for r in rules.of_kind("line") if r.scope == "reach"]
    if not wanted:
        return _none(lines)
    text = F.col("text")
    any_rule = reduce(lambda a, b: a | b, [r.pattern.on(text) for r in wanted])
    spans = functions.select(
        "path", F.col("id").alias("function"), F.col("name").alias("function_name"), "start_line", "end_line",
        F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("_b"),
    )
    held = lines.where(any_rule).withColumn("_b", F.floor(F.col("line") / bucket)).join(spans, ["path", "_b"])
    held = held.where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    hits = _exploded(held, [_line_hit(r, text) for r in wanted], [F.col("path"), F.col("line"), F.col("function"), F.trim(text).alias("excerpt")])
    return first_of(hits, ["rule", "function"], F.col("line"))


def ast_findings(hits: DataFrame, functions: DataFrame, rules: RuleSet) -> DataFrame:
    """Syntax rules. ``hits`` has path, line, text, query, loop, stops_early: nodes on added lines."""
    wanted = rules.of_kind("ast")
    if not wanted:
        return _none(hits)
    text = F.trim(F.col("text"))
    out = []
    for r in wanted:
        holds = (F.col("query") == r.query) & (paths.language(F.col("path")) == r.language) & r.applies(F.col("path"))
        if r.filters:
            holds = holds & F.col("loop")
        if r.pattern:
            holds = holds & r.pattern.on(text)
        out.append(_hit(r, holds, _verdict(r, text, F.col("stops_early"), lambda k: _in_function() if k == "in_function" else F.lit(""))))
    owned = with_owner(hits, functions)
    found = _exploded(owned, out, [F.col("path"), F.col("line"), F.col("function"), text.alias("excerpt")])
    return first_of(found, ["rule", "path", "line"], _findings.severity_rank(F.col("severity")), F.col("title"))


def set_values(files: DataFrame, value_set: ValueSet) -> DataFrame:
    """(value): what a set's patterns capture in the files it names, in lower case. ``files`` has path and
    text, SQL without its comments."""
    found = None
    for p in value_set.patterns:
        n = p.names.get("name", 1 if p.groups else None)
        if n is None:
            continue
        here = files.where(value_set.paths.on(F.col("path"))).select(F.explode(F.regexp_extract_all("text", F.lit(p.java), F.lit(n))).alias("value"))
        found = here if found is None else found.unionByName(here)
    if found is None:
        return files.select(F.lit("").alias("value")).limit(0)
    return found.select(F.lower("value").alias("value")).where("value <> ''").distinct()


def sql_findings(statements: DataFrame, files: DataFrame, rules: RuleSet) -> DataFrame:
    """SQL rules on statements that the change added to.

    ``statements`` has path, line, statement, excerpt, added, of the forward half; ``files`` (path, text) is
    where sets are collected, and only if a rule uses one.
    """
    wanted = rules.of_kind("sql")
    text, found = F.col("statement"), None
    created = (
        statements.where(F.lower(F.ltrim(text)).startswith("create table"))
        .select("path", code.target_table(text).alias("table"))
        .where("table IS NOT NULL")
        .distinct()
    )
    for r in wanted:
        p = r.pattern
        groups = [F.regexp_extract_all(text, F.lit(p.java), F.lit(i)).alias(f"g{i}") for i in range(p.groups + 1)]
        hits = statements.where(F.col("added") & r.applies(F.col("path")) & p.on(text)).withColumn("_g", F.explode(F.arrays_zip(*groups)))
        if r.unless:
            hits = hits.where(~r.unless.on(F.col("_g.g0")))
        group = lambda key, p=p: F.col(f"_g.g{p.names.get(key, key if key.isdigit() else '')}")
        if r.in_set:
            chosen = next(s for s in rules.sets if s.name == r.in_set["set"])
            hits = hits.withColumn("value", F.lower(group(r.in_set["capture"]))).join(set_values(files, chosen), "value", "left_semi")
        if r.skip_new_tables:
            named = F.lower(F.regexp_replace(group("table"), r'^"+|"+$', "")) if "table" in p.names else F.lit(None)
            table = F.coalesce(F.when(named != "", named), code.target_table(text))
            hits = hits.withColumn("table", table).join(created, ["path", "table"], "left_anti")
        value = lambda key, p=p, group=group: F.trim(group(key)) if key in p.names or key.isdigit() and int(key) <= p.groups else F.lit("")
        verdict = _verdict(r, text, None, value)
        one = hits.withColumn("_v", verdict).select(
            F.lit(r.name).alias("rule"), "_v.severity", "_v.title", "path", "line", F.lit(None).cast("string").alias("function"), "excerpt"
        )
        found = one if found is None else found.unionByName(one)
    return _none(statements) if found is None else found


def finish(found: list[DataFrame], rules: RuleSet) -> DataFrame:
    """All findings without repeats and folded; in order only where :func:`findings.ordered` asks for it."""
    every = reduce(lambda a, b: a.unionByName(b), found)
    return _findings.fold(_findings.without_repeats(every), rules.folding)


def as_table(spark, rules: RuleSet) -> DataFrame:
    """The rules in force, in order."""
    rows = [(i, r.name, r.kind, r.severity, r.title, r.source, r.fold) for i, r in enumerate(rules.rules)]
    return spark.createDataFrame(rows, "ord int, name string, kind string, severity string, title string, source string, fold boolean")
