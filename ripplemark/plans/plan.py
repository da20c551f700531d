"""The plan of a change: what it touches, how far that reaches, and the facts both rest on."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import code, paths
from ripplemark.operators import aggregates, align, graph, joins
from ripplemark.plans import extraction, resolve, workspace
from ripplemark.tables import cut

VERSION = 3
HOPS = 12


@dataclass
class Plan:
    files: DataFrame  # path, change, previous_path, package
    functions: DataFrame  # id, name, path, start_line, end_line, side, change, package, exported, route, entry
    calls: DataFrame  # caller, callee, line, change, inferred
    symbols: DataFrame  # id, public, reach_*, reach_entries, called_from_packages
    reach: DataFrame  # functions that run the change: node, path, package
    entries: DataFrame  # node, kind
    chains: DataFrame  # node, distance, chain
    reaches: DataFrame  # node, reaches: of each entry point the changes it reaches, nearest first
    texts: DataFrame  # rev, path, text
    facts: DataFrame


def changed_files(texts: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, change, previous_path, package) of every file that differs."""
    hashed = texts.select("rev", "path", F.md5("text").alias("hash"))
    st = cut(joins.renames(hashed.where("rev = 'base'"), hashed.where("rev = 'head'")))
    lone = lambda rev, letter: texts.where(F.col("rev") == rev).join(st.where(F.col("status") == letter), "path", "left_semi").select("path", "text")
    st = joins.with_similar(st, joins.similar_renames(lone("base", "D"), lone("head", "A")))
    kind = paths.language(F.col("path"))
    rows = st.select("path", joins.change_kind(F.col("status")).alias("change"), F.col("from").alias("previous_path"), F.when(kind == "typescript", "js").otherwise(kind).alias("kind"))
    head = packages.where("rev = 'head'").withColumn("name", F.coalesce("name", "dir"))
    return joins.owning_package(rows, head.select("dir", "kind", "name", "ord")).drop("kind")


def make(texts: DataFrame, reported: DataFrame | None = None, sites: DataFrame | None = None, hops: int = HOPS) -> Plan:
    """The plan of ``texts`` (rev, path, text)."""
    texts = cut(texts)
    facts, manifests = extraction.facts(texts), workspace.manifests(texts)
    packages = workspace.packages(manifests, facts)
    found = resolve.resolve(facts, texts, packages, manifests, reported, sites)
    fn = found.functions
    files = cut(changed_files(texts, packages))
    touched = files.where("change IN ('modified', 'added', 'renamed')").select("path")
    base, head = (fn.where(F.col("rev") == r).join(touched, "path", "left_semi") for r in ("base", "head"))
    units = cut(align.unit_changes(base, head, align.align(base, head)))
    facts_of = lambda side: fn.where(F.col("rev") == side).select("path", F.col("idx").alias(f"{side}_idx"), F.struct("id", "label", "parent", "name", "exported", "route", "prefix", "package", "start_line", "end_line").alias(side))
    both = cut(units.join(facts_of("base"), ["path", "base_idx"], "left").join(facts_of("head"), ["path", "head_idx"], "left"))
    # a base function goes by its counterpart's label
    renamed = both.where("base IS NOT NULL AND head IS NOT NULL").select(F.col("base.id").alias("old"), F.col("head.id").alias("new")).where("old <> new")

    def under_head_names(edges: DataFrame) -> DataFrame:
        for end in ("caller", "callee"):
            edges = edges.join(renamed.withColumnRenamed("old", end), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
        return edges

    old = under_head_names(found.edges.where("rev = 'base'"))
    new = found.edges.where("rev = 'head'")
    status = joins.status_of_sets(old, new, ["caller", "callee"])
    details = new.select("caller", "callee", "line", "inferred", "external")
    gone = old.select("caller", "callee", F.col("inferred").alias("was"), F.col("external").alias("ext"))
    edges = status.join(details, ["caller", "callee"], "left").join(gone, ["caller", "callee"], "left")
    edges = cut(edges.select("caller", "callee", "status", "line", F.coalesce("inferred", "was").alias("inferred"), F.coalesce("external", "ext").alias("external")))

    own = F.coalesce("head", "base")
    moved = both.where("change <> 'unchanged'")
    roots = align.outermost(
        both.select(
            "path", "change", F.coalesce("head_idx", F.col("base_idx") + 1_000_000).alias("idx"),
            F.when(F.col("head").isNotNull(), F.col("head.parent")).otherwise(F.col("base.parent") + 1_000_000).alias("parent"), own["id"].alias("id"),
        ),
        F.col("change") != "unchanged",
    )
    origins = cut(roots.select(F.col("id").alias("node")))
    live = cut(edges.where("status <> 'removed' AND NOT external").select("caller", "callee"))

    head_fn = fn.where("rev = 'head'").select(F.col("id").alias("node"), "label", "name", "path", "package", "exported", "route", "prefix", "start_line", "end_line", F.lit("head").alias("side"))
    lost = both.where("head IS NULL").select(F.col("base.id").alias("node"), "base.label", "base.name", "path", "base.package", "base.exported", "base.route", "base.prefix", "base.start_line", "base.end_line", F.lit("base").alias("side"))
    change = moved.select(own["id"].alias("node"), "change")
    places = head_fn.select("path", "package").distinct()
    module = edges.select(F.col("caller").alias("node")).where(F.col("caller").rlike("::module@\\d+$")).distinct()
    module = module.select("node", F.regexp_extract("node", "^(.*)::", 1).alias("path"), F.regexp_extract("node", "::(module@\\d+)$", 1).alias("label")).join(places, "path", "left")
    at = F.regexp_extract("label", r"(\d+)$", 1).cast("int")
    module = module.select("node", "label", F.concat(paths.basename(F.col("path")), F.lit(" · module level")).alias("name"), "path", "package", F.lit(False).alias("exported"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("string").alias("prefix"), at.alias("start_line"), at.alias("end_line"), F.lit("head").alias("side"))
    nodes = head_fn.unionByName(lost).unionByName(module).join(change, "node", "left").withColumn("change", F.coalesce("change", F.lit("unchanged")))
    nodes = nodes.withColumn("explored", F.lit(True)).withColumn(
        "route", F.when(F.col("route").isNotNull(), F.concat(F.substring_index("route", " ", 1), F.lit(" "), F.regexp_replace(F.concat(F.coalesce("prefix", F.lit("")), F.substring_index("route", " ", -1)), r"(?<=.)/$", "")))
    ).drop("prefix")
    nodes = cut(nodes.dropDuplicates(["node"]))

    each = graph.walks(live, origins, hops)
    each = each._replace(words=cut(each.words.join(nodes.select("node"), "node", "left_semi")))
    upstream = each.words.select("node").distinct()
    within = cut(nodes.join(upstream, "node", "left_semi"))
    entries = cut(graph.entry_points(within.where("change <> 'removed'"), live, graph.entry_kind()).select("node", "kind"))
    # a nested function that changed stands inside one that did; it is reported with the one around it
    is_origin = origins.withColumn("_o", F.lit(True))
    functions = within.join(is_origin, "node", "left").withColumn("change", F.when(F.col("_o"), F.col("change")).otherwise("unchanged")).drop("_o")
    functions = cut(functions.join(entries, "node", "left").withColumnRenamed("kind", "entry"))
    symbols = aggregates.symbol_summary(each, functions, live, entries)
    about = functions.select(F.col("node").alias("id"), "exported", "route", "label", "path", "start_line", "change")
    symbols = symbols.join(about, "id").withColumn("public", F.col("route").isNotNull() | (F.col("exported") & (F.size("called_from_packages") > 0)))
    kept = functions.select("node")
    calls = edges.join(kept.select(F.col("node").alias("caller")), "caller", "left_semi").join(kept.select(F.col("node").alias("callee")), "callee", "left_semi")
    reach = functions.where("change = 'unchanged'")
    at_entries = graph.pairs(each._replace(words=each.words.join(entries.select("node"), "node", "left_semi")))
    nearest_first = F.array_sort(F.collect_list(F.struct("distance", "origin")))
    reaches = at_entries.groupBy("node").agg(F.transform(nearest_first, lambda x: x["origin"]).alias("reaches"))
    return Plan(files, functions, cut(calls), cut(symbols), reach, entries, graph.nearest_origin(live, origins, hops), reaches, texts, facts)


def report(plan: Plan, base: str = "base", head: str | None = None, hops: int = HOPS) -> dict:
    """The plan as one document. What it lists is what the change touches and reaches."""
    rows = lambda df, *order: [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
    files = []
    for f in rows(plan.files, "path"):
        files.append({k: v for k, v in f.items() if not (k == "previous_path" and v is None)})
    functions = []
    moved_first = F.when(F.col("change") == "unchanged", 1).otherwise(0)
    placed = F.when(F.col("change") != "unchanged", F.col("start_line")).otherwise(0)
    for f in rows(plan.functions, moved_first, F.when(F.col("change") != "unchanged", F.col("path")).otherwise(""), placed, "node"):
        item = {"id": f["node"], "name": f["route"] or f["name"] or f["label"], "path": f["path"], "range": {"start": f["start_line"], "end": f["end_line"]}, "side": f["side"], "change": f["change"], "package": f["package"], "exported": f["exported"]}
        functions.append(item | {k: f[k] for k in ("route", "entry") if f[k] is not None})
    calls = []
    for c in rows(plan.calls, "caller", "callee"):
        line = None if c["status"] == "removed" else c["line"]
        calls.append({"caller": c["caller"], "callee": c["callee"], "line": line, "change": c["status"]} | ({"inferred": True} if c["inferred"] else {}))
    counts = plan.functions.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "removed")]).first().asDict()
    without = plan.files.join(plan.functions.where("change <> 'unchanged'").select("path").distinct(), "path", "left_anti").count()
    totals = aggregates.reach_totals(plan.reach.withColumn("package", F.coalesce("package", F.lit(aggregates.OUTSIDE)))).first()
    packages = rows(aggregates.reach_by_package(plan.reach), F.desc("functions"), "package")
    symbols = rows(plan.symbols.select("id", "public", "called_from_packages", "reach_functions", "reach_files", "reach_packages", "reach_entries"), F.desc("reach_functions"), "id")
    entries = {r["kind"]: r["n"] for r in rows(aggregates.entries_by_kind(plan.entries), "kind")}
    return {
        "version": VERSION, "base": base, "head": head, "files": files, "functions": functions, "calls": calls,
        "summary": {
            "changed": counts | {"files_without_function_changes": without},
            "reach": {"functions": totals["functions"], "files": totals["files"], "packages": packages, "entries": entries},
            "symbols": symbols,
        },
        "truncated": False, "limits": {"hops": hops},
    }


def to_json(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False)


_MARK = {"added": "+", "removed": "-", "changed": "~", "modified": "~", "deleted": "-", "renamed": ">"}


def to_text(document: dict) -> str:
    """The plan for people: 15 symbols, 20 other files and 8 packages at most."""
    s, by_id = document["summary"], {f["id"]: f for f in document["functions"]}
    c, out = s["changed"], []
    out.append(f"Changed symbols: {len(s['symbols'])}  (~{c['changed']} changed, +{c['added']} added, -{c['removed']} removed)")
    for x in s["symbols"][:15]:
        f = by_id[x["id"]]
        reach = f"  ← {x['reach_functions']} fn / {x['reach_packages']} pkg" if x["reach_functions"] else ""
        out.append(f"  {_MARK[f['change']]} {f['name']}  {f['path']}:{f['range']['start']}{reach}{' · public' if x['public'] else ''}")
    if len(s["symbols"]) > 15:
        out.append(f"  … {len(s['symbols']) - 15} more")
    own = {f["path"] for f in document["functions"] if f["change"] != "unchanged"}
    others = [f for f in document["files"] if f["path"] not in own]
    if others:
        out += ["", f"Other changed files: {len(others)}", *[f"  {_MARK[f['change']]} {f['path']}" for f in others[:20]]]
        if len(others) > 20:
            out.append(f"  … {len(others) - 20} more")
    r = s["reach"]
    kinds = ", ".join(f"{n} {k}" for k, n in sorted(r["entries"].items()))
    out += ["", f"Reach: {r['functions']} functions in {r['files']} files / {len(r['packages'])} packages, entry points: {kinds or 'none'}"]
    out.append("  " + "   ".join(f"{p['package']} ← {p['functions']}" for p in r["packages"][:8]))
    return "\n".join(out)


def impact(plan: Plan, base: str = "base", head: str | None = None) -> dict:
    """The older report: for each entry point a shortest chain down to a change, and all changes it reaches."""
    entries = plan.entries.join(plan.chains, "node").join(plan.reaches, "node", "left")
    chains = []
    for r in entries.orderBy("kind", "node").collect():
        hops = list(reversed(r["chain"]))
        chains.append({"entry": r["node"], "kind": r["kind"], "changed": hops[-1], "reaches": r["reaches"] or [], "hops": hops})
    packages = {}
    for r in plan.functions.groupBy(F.coalesce("package", F.lit(aggregates.OUTSIDE)).alias("p")).agg(
        F.count_if(F.col("change") != "unchanged").alias("changed"), F.count_if(F.col("change") == "unchanged").alias("affected")
    ).orderBy("p").collect():
        packages[r["p"]] = {"changed": r["changed"], "affected": r["affected"]}
    nodes = plan.functions.select("node", "package", "route")
    crossings = [r.asDict() for r in aggregates.package_crossings(plan.calls, nodes).orderBy("from_package", "to_package").collect()]
    return {"version": 1, "base": base, "head": head, "chains": chains, "packages": packages, "crossings": crossings}


def model(plan: Plan, document: dict) -> str:
    """Nodes, edges and whole-file differences as JSON that may stand inside a page's script."""
    from ripplemark.functions.extract import lines

    shown = sorted({f["path"] for f in document["functions"]})
    texts = {(r["rev"], r["path"]): r["text"] for r in plan.texts.where(F.col("path").isin(shown)).collect()}
    diffs = {p: lines.rows(texts.get(("base", p)), texts.get(("head", p))) for p in shown}
    return json.dumps({"nodes": document["functions"], "edges": document["calls"], "diffs": diffs}, ensure_ascii=False).replace("<", "\\u003c")


def to_html(plan: Plan, document: dict) -> str:
    """A page with the model and a plain listing of it."""
    return (
        '<!DOCTYPE html><meta charset="utf-8"><title>change impact</title><pre id="out"></pre>\n'
        f'<script type="application/json" id="model">{model(plan, document)}</script>\n'
        "<script>const m=JSON.parse(document.getElementById('model').textContent);"
        "document.getElementById('out').textContent=m.nodes.map(n=>n.change+' '+n.id).join('\\n');</script>\n"
    )
