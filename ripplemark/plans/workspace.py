"""Packages of a revision, from its manifests."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions import paths
from ripplemark.functions.extract.go import module_path
from ripplemark.tables import cut

_MANIFEST = r"(^|/)(package\.json|pnpm-workspace\.yaml|go\.mod|pyproject\.toml|setup\.py|setup\.cfg|tsconfig[^/]*\.json|jsconfig\.json)$"
#: Fixed: entries that are tried where a package names none.
_GUESSES = ("src/index.ts", "src/index.tsx", "index.ts", "index.js")
_SCHEMA = "rev string, dir string, kind string, name string, deps array<string>, entries array<string>, globs array<string>, aliases array<struct<prefix: string, exact: boolean, target: string>>, path string, extends string"
#: Configurations that one may extend in turn.
_EXTENDS = 4


def _exports(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for k in ("import", "require", "default", "types") if k in value for s in _exports(value[k])]
    return []


def _package_json(text: str) -> dict | None:
    try:
        p = json.loads(text)
    except ValueError:
        return None
    if not isinstance(p, dict):
        return None
    exports = p.get("exports")
    entries = _exports(exports) if isinstance(exports, str) else _exports(exports.get(".")) if isinstance(exports, dict) else []
    entries += [p[k] for k in ("main", "module", "types") if isinstance(p.get(k), str)]
    deps = sorted({d for k in ("dependencies", "devDependencies", "peerDependencies") for d in (p.get(k) or {})})
    globs = p.get("workspaces")
    globs = globs.get("packages", []) if isinstance(globs, dict) else globs or []
    entries = [e.removeprefix("./") for e in entries] or list(_GUESSES)
    return {"kind": "js", "name": p.get("name"), "deps": deps, "entries": entries, "globs": [g for g in globs if isinstance(g, str)]}


def _pnpm(text: str) -> dict:
    globs, inside = [], False
    for line in text.splitlines():
        if re.match(r"packages\s*:", line):
            inside = True
        elif inside and (m := re.match(r"""\s*-\s*['"]?([^'"#\s]+)""", line)):
            globs.append(m[1])
        elif inside and line.strip() and not line.lstrip().startswith("#"):
            inside = False
    return {"kind": "pnpm", "globs": globs}


def normalised_name(name: str) -> str:
    """A distribution's name as packages are compared by."""
    return re.sub(r"[-_.]+", "-", name).lower()


def _requirement(text: str) -> str:
    return normalised_name(re.split(r"[^A-Za-z0-9._-]", text.strip(), maxsplit=1)[0])


def _python(base: str, text: str) -> dict | None:
    if base == "pyproject.toml":
        try:
            t = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return None
        project, poetry = t.get("project", {}), t.get("tool", {}).get("poetry", {})
        deps = [*project.get("dependencies", []), *(d for group in project.get("optional-dependencies", {}).values() for d in group), *poetry.get("dependencies", {})]
        name = project.get("name") or poetry.get("name")
        if name is None and not deps:
            return None
    else:
        m = re.search(r"""(?m)^\s*name\s*=\s*["']?([\w.-]+)""", text)
        name, deps = m and m[1], []
    return {"kind": "python", "name": name and normalised_name(name), "deps": sorted({_requirement(d) for d in deps} - {"python"})}


def _aliases(text: str) -> dict | None:
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    try:
        config = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))
        options, extends = config.get("compilerOptions") or {}, config.get("extends")
    except (ValueError, AttributeError):
        return None
    base = (options.get("baseUrl") or ".").removeprefix("./")
    out = []
    for pattern, targets in (options.get("paths") or {}).items():
        for t in targets:
            target = f"{base}/{t}" if base not in ("", ".") else t
            out.append({"prefix": pattern.removesuffix("*"), "exact": not pattern.endswith("*"), "target": target.removesuffix("*")})
    return {"kind": "aliases", "aliases": out, "extends": extends if isinstance(extends, str) and extends.startswith(".") else None}


def _manifest(path: str, text: str) -> dict | None:
    base = path.rsplit("/", 1)[-1]
    if base == "package.json":
        return _package_json(text)
    if base == "pnpm-workspace.yaml":
        return _pnpm(text)
    if base == "go.mod":
        return {"kind": "gomod", "name": module_path(text)}
    if re.fullmatch(r"(tsconfig.*|jsconfig)\.json", base):
        return _aliases(text)
    return _python(base, text)


def manifests(files: DataFrame) -> DataFrame:
    """One row per manifest that can be read."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(_SCHEMA)
    arrow = to_arrow_schema(schema)
    rows = files.where(F.col("path").rlike(_MANIFEST) & ~paths.is_skipped(F.col("path"))).select("rev", "path", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rev, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (found := _manifest(path, text)) is not None:
                    out.append({"rev": rev, "dir": path.rpartition("/")[0], "path": path, **found})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found = cut(rows.mapInArrow(run, schema))
    return cut(_extended(found))


def _extended(found: DataFrame) -> DataFrame:
    """Configurations without aliases of their own take those of the one they extend, whose directory counts.
    What is only extended and is not a directory's own configuration goes."""
    config = found.where("kind = 'aliases'")
    for _ in range(_EXTENDS):
        target = paths.normalised(F.concat("dir", F.lit("/"), "extends"))
        json_name = F.when(F.endswith(target, F.lit(".json")), target).otherwise(F.concat(target, F.lit(".json")))
        above = config.select("rev", F.col("path").alias("_path"), F.col("dir").alias("_dir"), F.col("aliases").alias("_aliases"), F.col("extends").alias("_extends"))
        step = config.withColumn("_path", F.when(F.size("aliases") == 0, json_name)).join(above, ["rev", "_path"], "left")
        inherits = F.col("_dir").isNotNull()
        # a target that is taken is written from the root, marked by a leading slash; one that goes on keeps its last
        rooted = lambda t: F.concat(F.lit("/"), paths.normalised(F.concat("_dir", F.lit("/"), t)), F.when(F.endswith(t, F.lit("/")), "/").otherwise(""))
        there = lambda t: F.when(F.startswith(t, F.lit("/")), t).otherwise(rooted(t))
        taken = F.transform("_aliases", lambda a: F.struct(a["prefix"].alias("prefix"), a["exact"].alias("exact"), there(a["target"]).alias("target")))
        config = step.withColumn("aliases", F.when(inherits, taken).otherwise(F.col("aliases"))).withColumn("extends", F.when(inherits, F.col("_extends"))).select(found.columns)
    kept = config.where(paths.basename(F.col("path")).isin("tsconfig.json", "jsconfig.json"))
    return found.where("kind <> 'aliases'").unionByName(kept)


def glob_pattern(glob):
    """A workspace glob as a pattern over whole directories."""
    quoted = F.regexp_replace(F.regexp_replace(glob, r"^\./|/+$", ""), r"([.+()\[\]{}^$|])", r"\\$1")
    many = F.replace(quoted, F.lit("**"), F.lit("\u0001"))
    return F.concat(F.lit("^"), F.replace(F.replace(many, F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def packages(found: DataFrame, facts: DataFrame) -> DataFrame:
    """(rev, ord, kind, name, dir, deps, entries): workspace packages, Go packages and Python projects.

    A Go package is a directory with Go files below a go.mod, named by its import path, the deepest module's.
    """
    js = found.where("kind = 'js'")
    globs = found.where("kind IN ('pnpm', 'js') AND dir = ''")
    only_pnpm = globs.where("kind = 'pnpm'").select("rev").distinct().withColumn("_pnpm", F.lit(True))
    chosen = globs.join(only_pnpm, "rev", "left").where("kind = 'pnpm' OR _pnpm IS NULL").select("rev", F.explode("globs").alias("glob"))
    members = js.join(F.broadcast(chosen.withColumn("re", glob_pattern(F.col("glob")))), "rev").where(F.expr("dir rlike re") & ~F.startswith("glob", F.lit("!")))
    root = js.where("dir = ''")
    entry = F.expr("transform(entries, e -> if(dir = '', e, concat(dir, '/', e)))")
    cols = ["rev", "kind", "name", "dir", "deps", "entries"]
    none = F.array().cast("array<string>")
    js_rows = root.unionByName(members.select(root.columns)).dropDuplicates(["rev", "dir"]).withColumn("entries", entry).select(cols)
    modules = found.where("kind = 'gomod' AND name IS NOT NULL").select("rev", F.col("dir").alias("up"), F.col("name").alias("module"))
    go = facts.where(paths.language(F.col("path")) == "go").withColumn("dir", paths.directory(F.col("path")))
    dirs = go.groupBy("rev", "dir").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("specifiers")))).alias("deps"))
    owned = dirs.withColumn("up", F.explode(paths.ancestors(F.col("dir")))).join(modules, ["rev", "up"])
    below = F.when(F.col("m.up") == "", F.col("dir")).otherwise(F.expr("substring(dir, length(m.up) + 2)"))
    import_path = F.when((F.col("dir") == F.col("m.up")), F.col("m.module")).otherwise(F.concat("m.module", F.lit("/"), below))
    deepest = F.max_by(F.struct("up", "module"), F.length("up")).alias("m")
    go_rows = owned.groupBy("rev", "dir", "deps").agg(deepest).select("rev", F.lit("go").alias("kind"), import_path.alias("name"), "dir", "deps", none.alias("entries"))
    python = found.where("kind = 'python'").groupBy("rev", "kind", "dir").agg(F.max("name").alias("name"), F.flatten(F.collect_list("deps")).alias("deps"))
    python = python.withColumn("name", F.coalesce("name", paths.basename(F.col("dir")))).withColumn("entries", none).select(cols)
    order = F.row_number().over(Window.partitionBy("rev").orderBy(F.when(F.col("kind") == "js", 0).when(F.col("kind") == "go", 1).otherwise(2), "dir"))
    return cut(js_rows.unionByName(go_rows).unionByName(python).withColumn("ord", order))
