"""Calls resolved to functions: the call graph of both revisions.

Every way to resolve a call is a join that proposes targets with a rank; the
least rank that finds one wins. So the whole graph is a union of equi-joins
keyed by revision and path or name, instead of a search for each call.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions import code, paths
from ripplemark.operators import joins, routes
from ripplemark.plans import extraction
from ripplemark.tables import cut

#: Fixed: extensions tried for an import that names none, in order.
RESOLVABLE = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "svelte")
#: Types that a call through an interface may land on at most, and levels of barrels followed.
MOST_IMPLEMENTATIONS, BARREL_LEVELS = 8, 4
_KIND = {"typescript": "js", "go": "go", "python": "python"}


@dataclass
class Graph:
    functions: DataFrame  # rev, path, idx, …, label, package, mounted route
    edges: DataFrame  # rev, caller, callee, line, inferred, external
    imports: DataFrame  # rev, path, specifier, to_path


def _kind(path):
    lang = paths.language(path)
    out = F.lit(None).cast("string")
    for language, kind in _KIND.items():
        out = F.when(lang == language, kind).otherwise(out)
    return out


def _ts_files(specs: DataFrame, files: DataFrame, packages: DataFrame, manifests: DataFrame) -> DataFrame:
    """(rev, path, specifier, to_path): relative paths, $lib, aliases, workspace packages, in that order."""
    spec, dir_ = F.col("specifier"), paths.directory(F.col("path"))
    js = packages.where("kind = 'js'")
    relative = specs.where(F.startswith("specifier", F.lit("."))).select(
        "rev", "path", "specifier", F.lit(0).alias("r"), paths.normalised(F.concat(dir_, F.lit("/"), spec)).alias("b")
    )
    owned = joins.owning_package(specs.where(F.startswith("specifier", F.lit("$lib/"))).withColumn("kind", F.lit("js")), js.withColumn("name", F.col("dir")), ("rev",))
    lib = owned.where("package IS NOT NULL").select(
        "rev", "path", "specifier", F.lit(1).alias("r"), paths.normalised(F.concat("package", F.lit("/src/lib/"), F.substring(spec, F.lit(6), F.length(spec)))).alias("b")
    )
    bare = specs.where(~F.startswith("specifier", F.lit(".")))
    aliases = manifests.where("kind = 'aliases' AND rev = 'head'").select(F.col("dir").alias("up"), "aliases")
    near = bare.select(dir_.alias("d")).distinct().select("d", F.explode(paths.ancestors(F.col("d"))).alias("up")).join(aliases, "up")
    near = near.groupBy("d").agg(F.max_by(F.struct("up", "aliases"), F.length("up")).alias("n")).select("d", "n.up", F.posexplode("n.aliases").alias("i", "a"))
    fits = F.when(F.col("a.exact"), spec == F.col("a.prefix")).otherwise(F.startswith("specifier", F.col("a.prefix")))
    aliased = bare.withColumn("d", dir_).join(near, "d").where(fits).select(
        "rev", "path", "specifier", (F.col("i") + 10).alias("r"),
        # a target with a leading slash is written from the root
        paths.normalised(F.concat(F.when(F.startswith("a.target", F.lit("/")), "").otherwise(F.col("up")), F.lit("/"), "a.target", F.when(F.col("a.exact"), "").otherwise(F.expr("substring(specifier, length(a.prefix) + 1)")))).alias("b"),
    )
    named = bare.withColumn("name", code.js_package(spec)).join(js.select("rev", "name", "dir", "entries"), ["rev", "name"])
    sub = F.expr("substring(specifier, length(name) + 2)")
    inner = named.select(
        "rev", "path", "specifier",
        F.posexplode(F.when(sub != "", F.array(paths.normalised(F.concat("dir", F.lit("/"), sub)))).otherwise(F.transform("entries", paths.normalised))).alias("i", "b"),
    ).select("rev", "path", "specifier", (F.col("i") + 1000).alias("r"), "b")
    base = relative.unionByName(lib).unionByName(aliased).unionByName(inner)
    b = F.col("b")
    plain = [b, *[F.concat(b, F.lit(f".{e}")) for e in RESOLVABLE], *[F.concat(b, F.lit(f"/index.{e}")) for e in RESOLVABLE]]
    tries = F.when(paths.extension(b) != "", F.array(b, F.concat(b, F.lit(".ts")), F.concat(b, F.lit(".js")))).otherwise(F.array(*plain))
    each = base.select("rev", "path", "specifier", "r", F.posexplode(tries).alias("i", "to_path"))
    there = each.join(files.select("rev", F.col("path").alias("to_path")), ["rev", "to_path"])
    return there.groupBy("rev", "path", "specifier").agg(F.min_by("to_path", F.struct("r", "i")).alias("to_path"))


def _python_files(specs: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(rev, path, specifier, to_path) of module paths. Every Python file is listed under its name below
    each root above it, so a module meets its file by equality."""
    sources = files.where(paths.language(F.col("path")) == "python").select("rev", F.col("path").alias("to_path"))
    projects = packages.where("kind = 'python'").select("rev", "dir", "ord")
    fixed = files.select("rev").distinct().select("rev", F.explode(F.array(F.struct(F.lit("").alias("root"), F.lit(-2).alias("ord")), F.struct(F.lit("src").alias("root"), F.lit(-1).alias("ord")))).alias("x")).select("rev", "x.*")
    below = projects.select("rev", F.explode(F.array(F.struct(F.col("dir").alias("root"), (F.col("ord") * 2).alias("ord")), F.struct(paths.normalised(F.concat("dir", F.lit("/src"))).alias("root"), (F.col("ord") * 2 + 1).alias("ord")))).alias("x")).select("rev", "x.*")
    roots = fixed.unionByName(below).groupBy("rev", "root").agg(F.min("ord").alias("ord"))
    listed = sources.withColumn("root", F.explode(paths.ancestors(paths.directory(F.col("to_path"))))).join(roots, ["rev", "root"])
    inside = F.regexp_replace(paths.relative_to(F.col("to_path"), F.col("root")), r"\.py$", "")
    is_init = F.endswith(F.col("to_path"), F.lit("__init__.py"))
    module = F.replace(F.regexp_replace(inside, r"/?__init__$", ""), F.lit("/"), F.lit("."))
    index = listed.select("rev", module.alias("specifier"), "root", "ord", is_init.alias("init"), "to_path").where("specifier <> ''")
    absolute = specs.where(~F.startswith("specifier", F.lit(".")))
    own = joins.owning_package(absolute.withColumn("kind", F.lit("python")), packages.where("kind = 'python'").withColumn("name", F.col("dir")), ("rev",))
    met = own.join(index, ["rev", "specifier"])
    mine = F.when(F.col("root") == F.col("package"), -4).when(F.col("root") == paths.normalised(F.concat("package", F.lit("/src"))), -3).otherwise(F.col("ord"))
    found = met.groupBy("rev", "path", "specifier").agg(F.min_by("to_path", F.struct(mine.alias("o"), "init")).alias("to_path"))
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("specifier", r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.filter(F.split(paths.directory(F.col("path")), "/"), lambda p: p != "")
    base = F.array_join(F.slice(up, F.lit(1), F.greatest(F.size(up) - dots + 1, F.lit(0))), "/")
    at = paths.normalised(F.concat(base, F.lit("/"), rest))
    inner = F.when(rest != "", F.array(F.concat(at, F.lit(".py")), F.concat(at, F.lit("/__init__.py")))).otherwise(F.array(F.lit(None).cast("string"), paths.normalised(F.concat(at, F.lit("/__init__.py")))))
    near = specs.where(F.startswith("specifier", F.lit("."))).where(dots - 1 <= F.size(up)).select("rev", "path", "specifier", F.posexplode(inner).alias("i", "to_path"))
    relative = near.join(sources, ["rev", "to_path"]).groupBy("rev", "path", "specifier").agg(F.min_by("to_path", "i").alias("to_path"))
    return found.unionByName(relative)


def _closure(base: DataFrame, barrels: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` (rev, path, keys, …) seen also through files that re-export ``path``, nearest definition first."""
    cols = base.columns
    known = cut(base.withColumn("_d", F.lit(0)))
    frontier = known
    for depth in range(1, BARREL_LEVELS + 1):
        step = frontier.withColumnRenamed("path", "to_path").join(barrels, ["rev", "to_path"]).select(*cols).withColumn("_d", F.lit(depth))
        frontier = cut(step.join(known.select("rev", "path", *keys), ["rev", "path", *keys], "left_anti").dropDuplicates(["rev", "path", *keys]))
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier))
    return known.drop("_d")


def resolve(facts: DataFrame, files: DataFrame, packages: DataFrame, manifests: DataFrame, reported: DataFrame | None = None, sites: DataFrame | None = None) -> Graph:
    """The graph. ``reported`` has an external resolver's (rev, from_path, from_line, to_path, to_line) and
    goes before own resolution; ``sites`` has seams' (rev, seam, side, key, path, line)."""
    fn = extraction.functions(facts)
    kinds = facts.select("rev", "path", _kind(F.col("path")).alias("kind"))
    owner = joins.owning_package(kinds, packages.withColumn("name", F.coalesce("name", "dir")), ("rev",)).select("rev", "path", "package")
    fn = cut(fn.join(owner, ["rev", "path"], "left").withColumn("lang", paths.language(F.col("path"))))
    there = files.select("rev", "path").distinct()
    lang = paths.language(F.col("path"))

    imports = facts.select("rev", "path", F.explode("imports").alias("i")).select("rev", "path", "i.*").withColumn("lang", lang)
    calls = extraction.calls(facts).withColumn("lang", lang)
    head = F.split("call", r"\(")[0]
    calls = calls.withColumn("head", head).withColumn("plain", head == F.col("call")).withColumn("segs", F.split(head, r"\."))
    calls = calls.withColumns({"root": F.col("segs")[0], "last": F.element_at("segs", -1), "n": F.size("segs")})
    calls = cut(calls.withColumn("site", F.monotonically_increasing_id()))

    bound = calls.join(imports.select("rev", "path", F.col("local").alias("root"), "specifier", F.col("kind").alias("binding"), "imported"), ["rev", "path", "root"])
    join_module = F.when(F.endswith(F.col("specifier"), F.lit(".")), F.concat("specifier", "imported")).otherwise(F.concat_ws(".", "specifier", "imported"))
    start = F.when(F.col("binding") == "named", join_module).otherwise(F.col("specifier"))
    middle = lambda n: F.array_join(F.slice("segs", 2, F.greatest(F.size("segs") - n, F.lit(0))), ".")
    dotted = lambda a, b: F.when(b == "", a).when(F.endswith(a, F.lit(".")), F.concat(a, b)).otherwise(F.concat(a, F.lit("."), b))
    chains = bound.where("lang = 'python' AND plain AND n >= 2").withColumn("module", dotted(start, middle(2)))

    spec_rows = facts.select("rev", "path", F.explode(F.array_distinct(F.concat("specifiers", "reexports", F.transform("namespaces", lambda x: x["specifier"])))).alias("specifier"))
    ts = _ts_files(spec_rows.where(lang == "typescript"), there, packages, manifests)
    # for `repo.save` after `from shop import Repo`, the module that holds the class
    owners = chains.select("rev", "path", F.when(F.col("n") > 2, dotted(start, middle(3))).otherwise(F.col("specifier")).alias("specifier"))
    py_specs = spec_rows.where(lang == "python").unionByName(chains.select("rev", "path", F.col("module").alias("specifier"))).unionByName(owners).distinct()
    py = _python_files(py_specs, there, packages)
    to_file = cut(ts.unionByName(py))
    go_dirs = packages.where("kind = 'go'").select("rev", F.col("name").alias("specifier"), F.col("dir").alias("to_dir"))

    top = fn.where("parent IS NULL AND name IS NOT NULL")
    importable = top.where("(lang = 'typescript' AND exported AND NOT method) OR (lang = 'python' AND NOT method)")
    barrel_specs = facts.where(lang == "typescript").select("rev", "path", F.explode("reexports").alias("specifier")).unionByName(
        facts.where(F.endswith("path", F.lit("__init__.py"))).select("rev", "path", F.explode("specifiers").alias("specifier"))
    )
    barrels = cut(barrel_specs.join(to_file, ["rev", "path", "specifier"]).select("rev", "path", "to_path").distinct().where("path <> to_path"))
    exports = _closure(importable.select("rev", "path", "name", F.col("path").alias("def_path"), "label"), barrels, ["name"])
    methods = fn.where("method AND parent IS NULL AND lang = 'python'").withColumn("class", F.expr("substring_index(name, '.', 1)"))
    classes = _closure(methods.select("rev", "path", "class", F.col("path").alias("def_path")).distinct(), barrels, ["class"])

    def proposed(df: DataFrame, rank: int, to_path="def_path", to_label="label", inferred=False) -> DataFrame:
        return df.select("rev", "site", F.lit(rank).alias("rank"), F.col(to_path).alias("to_path"), F.col(to_label).alias("to_label"), F.lit(inferred).alias("inferred"))

    one = lambda df, *order: joins.first_of(df, ["site"], *order)
    local = fn.select("rev", "path", F.col("label").alias("l"), F.col("idx").alias("i"), "method", F.col("path").alias("def_path"), "label", "name")
    script = calls.where("lang <> 'go'")
    found = []
    same = script.where("n = 1 AND plain").join(local.where("name IS NOT NULL").withColumnRenamed("l", "call"), ["rev", "path", "call"])
    found.append(proposed(one(same, F.col("i")), 0))
    made = script.where("lang = 'python' AND plain AND n = 1").withColumn("l", F.concat("call", F.lit(".__init__"))).join(local, ["rev", "path", "l"])
    found.append(proposed(one(made, F.col("i")), 1))
    exact = script.where("n >= 2").withColumnRenamed("head", "l").join(local.where("method"), ["rev", "path", "l"])
    found.append(proposed(one(exact, F.col("i")), 2))
    by_name = local.where("method").withColumn("last", code.short_name(F.col("label"))).drop("l")
    found.append(proposed(one(script.where("n >= 2").join(by_name, ["rev", "path", "last"]), F.col("i")), 3))
    into = bound.where("lang <> 'go' AND plain").join(to_file.withColumnRenamed("to_path", "f"), ["rev", "path", "specifier"])
    ex = exports.select("rev", F.col("path").alias("f"), "name", "def_path", "label")
    found.append(proposed(into.where("binding = 'named' AND n = 1").withColumn("name", F.col("imported")).join(ex, ["rev", "f", "name"]), 5))
    spaces = into.where("lang = 'typescript' AND binding = 'namespace' AND n >= 2")
    found.append(proposed(spaces.where("n = 2").withColumn("name", F.col("last")).join(ex, ["rev", "f", "name"]), 5))
    through = facts.select("rev", F.col("path").alias("f"), F.explode("namespaces").alias("x")).select("rev", "f", F.col("x.name").alias("seg"), F.col("x.specifier").alias("s"))
    through = through.join(to_file.select("rev", F.col("path").alias("f"), F.col("specifier").alias("s"), F.col("to_path").alias("g")), ["rev", "f", "s"])
    walked = spaces.where("n > 2").select("rev", "site", "segs", "last", "f", F.lit(1).alias("at"))
    for _ in range(BARREL_LEVELS):
        walked = walked.withColumn("seg", F.get("segs", F.col("at"))).join(through, ["rev", "f", "seg"]).select("rev", "site", "segs", "last", F.col("g").alias("f"), (F.col("at") + 1).alias("at"))
        found.append(proposed(walked.where("at = size(segs) - 1").withColumn("name", F.col("last")).join(ex, ["rev", "f", "name"]), 5))
    modules = chains.join(to_file.select("rev", "path", F.col("specifier").alias("module"), F.col("to_path").alias("f")), ["rev", "path", "module"])
    found.append(proposed(modules.withColumn("name", F.col("last")).join(ex, ["rev", "f", "name"]), 5))
    class_of = chains.withColumn("class", F.when(F.col("n") > 2, F.element_at("segs", -2)).otherwise(F.when(F.col("binding") == "named", F.col("imported"))))
    class_of = class_of.withColumn("holder", F.when(F.col("n") > 2, dotted(start, middle(3))).otherwise(F.col("specifier"))).where("class IS NOT NULL")
    cls = classes.select("rev", F.col("path").alias("f"), "class", "def_path")
    held = class_of.join(to_file.select("rev", "path", F.col("specifier").alias("holder"), F.col("to_path").alias("f")), ["rev", "path", "holder"]).join(cls, ["rev", "f", "class"])
    defined = fn.select("rev", F.col("path").alias("def_path"), "label").distinct()
    found.append(proposed(held.withColumn("label", F.concat("class", F.lit("."), "last")).join(defined, ["rev", "def_path", "label"]), 6))
    built = into.where("lang = 'python' AND binding = 'named' AND n = 1").withColumn("class", F.col("imported")).join(cls, ["rev", "f", "class"])
    found.append(proposed(built.withColumn("label", F.concat("class", F.lit(".__init__"))).join(defined, ["rev", "def_path", "label"]), 4))
    by_module = bound.where("lang = 'python' AND plain AND n = 2").withColumn("class", F.col("last"))
    by_module = by_module.join(to_file.select("rev", "path", "specifier", F.col("to_path").alias("f")), ["rev", "path", "specifier"]).join(cls, ["rev", "f", "class"])
    found.append(proposed(by_module.withColumn("label", F.concat("class", F.lit(".__init__"))).join(defined, ["rev", "def_path", "label"]), 4))

    gofn = top.where("lang = 'go'").select("rev", paths.directory(F.col("path")).alias("to_dir"), code.short_name(F.col("label")).alias("last"), "method", F.col("path").alias("def_path"), "label", "idx")
    golang = calls.where("lang = 'go'").withColumn("own_dir", paths.directory(F.col("path")))
    first = [F.col("def_path"), F.col("g.idx")]
    g_bound = bound.where("lang = 'go' AND n >= 2")
    g = gofn.alias("g")
    by_import = g_bound.where("plain AND n = 2").join(go_dirs, ["rev", "specifier"]).join(g.where("NOT method"), ["rev", "to_dir", "last"])
    found.append(proposed(one(by_import, *first), 1))
    free = golang.join(g_bound.select("site").distinct(), "site", "left_anti").where("plain").withColumnRenamed("own_dir", "to_dir")
    own = free.join(g, ["rev", "to_dir", "last"]).where((F.col("n") >= 2) == F.col("g.method"))
    found.append(proposed(one(own, *first), 1))
    imported_dirs = imports.where("lang = 'go'").select("rev", "path", "specifier").distinct().join(go_dirs, ["rev", "specifier"])
    away = free.where("n >= 2").drop("to_dir").join(imported_dirs.select("rev", "path", "to_dir"), ["rev", "path"]).join(g.where("method"), ["rev", "to_dir", "last"])
    away = away.withColumn("_dirs", F.size(F.collect_set("to_dir").over(Window.partitionBy("site")))).where("_dirs = 1")
    found.append(proposed(one(away, *first), 2))
    found.append(_through_interfaces(facts, free, imported_dirs))

    rest = F.when(F.col("binding") == "namespace", F.expr("if(startswith(call, concat(root, '.')), substring(call, length(root) + 2), call)")).otherwise(F.col("call"))
    outer = F.when(F.col("lang") == "go", F.col("specifier")).when(F.col("lang") == "python", code.python_package(F.col("specifier"))).otherwise(code.js_package(F.col("specifier")))
    outside = bound.where("idx IS NOT NULL AND (lang <> 'go' OR n >= 2)").select("rev", "site", F.lit(9).alias("rank"), F.lit(None).cast("string").alias("to_path"), code.external_id(outer, rest).alias("to_label"), F.lit(False).alias("inferred"))
    outside = outside.where("to_label IS NOT NULL")
    every = outside
    for f in found:
        every = every.unionByName(f)
    least = F.min("rank").over(Window.partitionBy("site"))
    chosen = every.withColumn("_least", least).where("rank = _least").select("site", "to_path", "to_label", "inferred").distinct()

    labels = fn.select("rev", "path", "idx", F.col("label").alias("caller_label"))
    from_label = F.coalesce("caller_label", code.module_label(F.col("line")))
    resolved = calls.join(chosen, "site").join(labels, ["rev", "path", "idx"], "left").select(
        "rev", "path", "line", "call", code.node_id(F.col("path"), from_label).alias("caller"),
        F.coalesce(code.node_id(F.col("to_path"), F.col("to_label")), F.col("to_label")).alias("callee"), "inferred", F.col("to_path").isNull().alias("external"),
    )
    resolved = cut(resolved)
    if reported is not None:
        resolved = _with_reported(resolved, reported, fn)
    mounted = _mounted(facts, imports, to_file, fn)
    edges = resolved.unionByName(_rpc(facts, fn, mounted)).unionByName(_nested(fn))
    if sites is not None:
        edges = edges.unionByName(_seams(sites, fn))
    edges = edges.where("caller <> callee").groupBy("rev", "caller", "callee").agg(F.min("line").alias("line"), F.bool_and("inferred").alias("inferred"), F.bool_or("external").alias("external"))
    fn = fn.join(mounted.select("rev", "path", "prefix"), ["rev", "path"], "left")
    return Graph(cut(fn.withColumn("id", code.node_id(F.col("path"), F.col("label")))), cut(edges), to_file)


def _through_interfaces(facts: DataFrame, free: DataFrame, imported_dirs: DataFrame) -> DataFrame:
    """Targets that a Go method call may land on: methods of types that have all an interface in view asks for."""
    go = facts.where(paths.language(F.col("path")) == "go").withColumn("dir", paths.directory(F.col("path")))
    asked = go.select("rev", "dir", F.explode("interfaces").alias("x")).select("rev", "dir", F.col("x.type").alias("iface"), F.col("x.method").alias("method")).distinct()
    had = go.select("rev", "dir", "path", F.explode("methods").alias("x")).select("rev", F.col("dir").alias("type_dir"), F.col("x.type").alias("type"), F.col("x.method").alias("method"), "path")
    # names of methods meet within a revision
    tag = F.concat_ws("\u0001", "rev", "method")
    full = joins.divides(had.withColumn("method", tag), asked.withColumn("method", tag), ["type_dir", "type"], ["rev", "dir", "iface"], "method")
    targets = full.join(asked, ["rev", "dir", "iface"]).join(had, ["rev", "type_dir", "type", "method"])
    targets = targets.select("rev", "dir", F.col("method").alias("last"), F.col("path").alias("def_path"), F.concat("type", F.lit("."), "method").alias("label")).distinct()
    methods = free.where("n >= 2")
    seen = methods.select("rev", "site", "last", F.col("to_dir").alias("dir")).unionByName(
        methods.drop("to_dir").join(imported_dirs.select("rev", "path", F.col("to_dir").alias("dir")), ["rev", "path"]).select("rev", "site", "last", "dir")
    )
    hits = seen.distinct().join(targets, ["rev", "dir", "last"]).select("rev", "site", "def_path", "label").distinct()
    few = F.count(F.lit(1)).over(Window.partitionBy("site"))
    hits = hits.withColumn("_n", few).where(F.col("_n") <= MOST_IMPLEMENTATIONS)
    return hits.select("rev", "site", F.lit(3).alias("rank"), F.col("def_path").alias("to_path"), F.col("label").alias("to_label"), F.lit(True).alias("inferred"))


def _owner_at(points: DataFrame, fn: DataFrame) -> DataFrame:
    """``points`` (rev, path, line) with ``at``: the label of the function around the line, callbacks counting
    to the one they stand in; null outside any."""
    spans = fn.select("rev", "path", F.col("owner").alias("_owner"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    held = joins.innermost(points, spans, ["rev", "path"], "line", "_s", "_e").drop("_s", "_e")
    return held.join(fn.select("rev", "path", F.col("idx").alias("_owner"), F.col("label").alias("at")), ["rev", "path", "_owner"], "left").drop("_owner")


def _with_reported(own: DataFrame, reported: DataFrame, fn: DataFrame) -> DataFrame:
    """The resolver's targets in place of the own ones on the lines it speaks of."""
    to = _owner_at(reported.select("rev", F.col("to_path").alias("path"), F.col("to_line").alias("line")).distinct(), fn).where("at IS NOT NULL")
    told = reported.join(to.select("rev", F.col("path").alias("to_path"), F.col("line").alias("to_line"), F.col("at").alias("to_label")), ["rev", "to_path", "to_line"])
    told = told.select("rev", F.col("from_path").alias("path"), F.col("from_line").alias("line"), "to_path", "to_label").distinct()
    callers = _owner_at(told.select("rev", "path", "line").distinct(), fn)
    named = own.join(told, ["rev", "path", "line"]).where(code.short_name(F.split("call", r"\(")[0]) == code.short_name(F.col("to_label")))
    any_named = named.select("rev", "path", "line").distinct().withColumn("_any", F.lit(True))
    kept = told.join(any_named, ["rev", "path", "line"], "left").join(named.select("rev", "path", "line", "to_label").distinct().withColumn("_named", F.lit(True)), ["rev", "path", "line", "to_label"], "left")
    kept = kept.where("_any IS NULL OR _named").join(callers, ["rev", "path", "line"])
    rows = kept.select(
        "rev", "path", "line", F.col("to_label").alias("call"), code.node_id(F.col("path"), F.coalesce("at", code.module_label(F.col("line")))).alias("caller"),
        code.node_id(F.col("to_path"), F.col("to_label")).alias("callee"), F.lit(False).alias("inferred"), F.lit(False).alias("external"),
    )
    return own.join(told.select("rev", "path", "line").distinct(), ["rev", "path", "line"], "left_anti").unionByName(rows)


def _mounted(facts: DataFrame, imports: DataFrame, to_file: DataFrame, fn: DataFrame) -> DataFrame:
    """(rev, path, prefix) of the files that routers are mounted from or in."""
    raw = facts.select("rev", "path", F.explode("mounts").alias("m")).select("rev", "path", "m.prefix", F.col("m.router").alias("local"))
    into = raw.join(imports.select("rev", "path", "local", "specifier"), ["rev", "path", "local"]).join(to_file, ["rev", "path", "specifier"])
    # one table of routers for both revisions: a router is a file of a revision
    router = lambda p: F.concat("rev", F.lit("\u0001"), p)
    mounts = into.select(router("path").alias("parent"), router("to_path").alias("child"), "prefix").distinct()
    roots = mounts.select(F.col("parent").alias("router")).join(mounts.select(F.col("child").alias("router")), "router", "left_anti").distinct()
    table = routes.mounted(roots.withColumn("route", F.lit("")), mounts)
    return table.groupBy("router").agg(F.min("route").alias("prefix")).select(
        F.substring_index("router", "\u0001", 1).alias("rev"), F.substring_index("router", "\u0001", -1).alias("path"), "prefix"
    )


def _nested(fn: DataFrame) -> DataFrame:
    """A function stands before the named and routed ones inside it."""
    around = fn.select("rev", "path", F.col("idx").alias("parent"), F.col("owner").alias("o"))
    label = fn.select("rev", "path", F.col("idx").alias("o"), F.col("label").alias("outer"))
    inner = fn.where("owner = idx AND parent IS NOT NULL").join(around, ["rev", "path", "parent"]).join(label, ["rev", "path", "o"])
    return inner.select(
        "rev", "path", F.col("start_line").alias("line"), F.col("label").alias("call"), code.node_id(F.col("path"), F.col("outer")).alias("caller"),
        code.node_id(F.col("path"), F.col("label")).alias("callee"), F.lit(False).alias("inferred"), F.lit(False).alias("external"),
    )


def _rpc(facts: DataFrame, fn: DataFrame, mounted: DataFrame) -> DataFrame:
    """Calls of typed clients, joined to the handlers of their routes."""
    calls = facts.select("rev", "path", F.explode("rpc_calls").alias("c")).select("rev", "path", "c.line", F.col("c.method").alias("method"), F.col("c.path").alias("call_path"))
    held = _owner_at(calls, fn).select("rev", F.col("path").alias("from_path"), "line", "at", "method", F.col("call_path").alias("path"))
    handlers = fn.where("route IS NOT NULL").join(mounted, ["rev", "path"], "left")
    full = F.concat(F.coalesce("prefix", F.lit("")), F.substring_index("route", " ", -1))
    table = handlers.select("rev", F.substring_index("route", " ", 1).alias("method"), full.alias("path"), code.node_id(F.col("path"), F.col("label")).alias("callee"))
    # methods of a revision meet those of the same one
    tagged = lambda df: df.withColumn("method", F.concat_ws("\u0001", "rev", "method"))
    hits = routes.matched(tagged(held), tagged(table).drop("rev"))
    caller = code.node_id(F.col("from_path"), F.coalesce("at", code.module_label(F.col("line"))))
    return hits.select(
        "rev", F.col("from_path").alias("path"), "line", F.lit("$").alias("call"), caller.alias("caller"), "callee", F.lit(False).alias("inferred"), F.lit(False).alias("external")
    )


def seam_sites(files: DataFrame, seam: str, definition: str, call: str) -> DataFrame:
    """(rev, seam, side, key, path, line) of a seam's two patterns, line by line; the key is the groups that
    matched, or all of the match."""
    lines = files.select("rev", "path", F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    out = None
    from ripplemark.operators.rules import Pattern

    for side, text in (("definition", definition), ("call", call)):
        p = Pattern(text)
        groups = [F.nullif(F.regexp_extract("t", p.java, i), F.lit("")) for i in range(1, p.groups + 1)]
        key = F.coalesce(F.nullif(F.concat_ws(" ", *groups), F.lit("")), F.regexp_extract("t", p.java, 0)) if groups else F.regexp_extract("t", p.java, 0)
        rows = lines.where(F.col("t").rlike(p.java)).select("rev", F.lit(seam).alias("seam"), F.lit(side).alias("side"), key.alias("key"), "path", (F.col("i") + 1).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _seams(sites: DataFrame, fn: DataFrame) -> DataFrame:
    held = _owner_at(sites, fn).withColumn("node", code.node_id(F.col("path"), F.coalesce("at", code.module_label(F.col("line")))))
    calls = held.where("side = 'call'").select("rev", "seam", "key", "path", "line", F.col("node").alias("caller"))
    definitions = held.where("side = 'definition'").select("rev", "seam", "key", F.col("node").alias("callee"))
    met = joins.key_join(calls, definitions, ["rev", "seam"])
    return met.select("rev", "path", "line", F.col("key").alias("call"), "caller", "callee", F.lit(False).alias("inferred"), F.lit(False).alias("external"))
