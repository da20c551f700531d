"""Commands: plan, assess, rules, align, cache, schema.

    python -m ripplemark.cli plan [--root DIR] [--base REF] [--head REF] [--hops N] [--json]
    python -m ripplemark.cli assess PLAN|- [--sarif LOG]... [--json] [--fail-on LEVEL]
    python -m ripplemark.cli rules [--json]
    python -m ripplemark.cli align FILE[:SYMBOL] [--base REF]
    python -m ripplemark.cli cache [clean]
    python -m ripplemark.cli schema
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import subprocess
import sys
import tempfile
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.operators import rules
from ripplemark.plans import aligned, assess, plan, resolve, schema
from ripplemark.sources import repository, resolver, sarif

CONFIG_ENV, CONFIG_NAME, CACHE_ENV = "RIPPLEMARK_CONFIG", "ripplemark.toml", "RIPPLEMARK_CACHE"


def _config(root: str) -> tuple[str | None, str]:
    path = os.environ.get(CONFIG_ENV) or os.path.join(root, CONFIG_NAME)
    if not os.path.exists(path):
        return None, path
    with open(path, encoding="utf-8") as f:
        return f.read(), path


def _cache() -> str:
    return os.environ.get(CACHE_ENV) or os.path.join(os.path.expanduser("~"), ".cache", "ripplemark")


def _texts(spark: SparkSession, root: str, base: str, head: str | None) -> DataFrame:
    old = repository.commit_files(spark, root, base, _cache())
    new = repository.commit_files(spark, root, head, _cache()) if head else repository.working_files(spark, root)
    return repository.versions(old, new)


def _sites(texts: DataFrame, config: str | None) -> DataFrame | None:
    found = None
    for s in tomllib.loads(config or "").get("seam", []):
        rows = resolve.seam_sites(texts, s["name"], s["definition"], s["call"])
        found = rows if found is None else found.unionByName(rows)
    return found


def _reported(spark: SparkSession, root: str, config: str | None) -> DataFrame | None:
    """What the resolvers of the config say of the head: each is a command that prints ``site target`` lines, or
    names a file of them. One that fails says nothing, but why."""
    found = None
    for r in tomllib.loads(config or "").get("resolver", []):
        if "output" in r:
            rows = resolver.read(spark, os.path.join(root, r["output"]), root)
        else:
            done = subprocess.run(r["command"], cwd=root, capture_output=True, text=True)
            if done.returncode:
                print(f"resolver {r['command'][0]}: {done.stderr.strip()}", file=sys.stderr)
                continue
            rows = resolver.parse(spark.createDataFrame([(x,) for x in done.stdout.splitlines()], "value string"), root)
        rows = rows.withColumn("rev", F.lit("head"))
        found = rows if found is None else found.unionByName(rows)
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ripplemark")
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("plan")
    p.add_argument("--base")
    p.add_argument("--head")
    p.add_argument("--hops", type=int, default=plan.HOPS)
    p.add_argument("--json", action="store_true")
    p.add_argument("--impact", action="store_true", help="the older report: chains from entry points to changes, as JSON")
    p.add_argument("--html", metavar="FILE", help="write the page as well")
    a = commands.add_parser("assess")
    a.add_argument("plan", nargs="?", default="-")
    a.add_argument("--sarif", action="append", default=[])
    a.add_argument("--json", action="store_true")
    a.add_argument("--fail-on", choices=("high", "medium", "low"))
    r = commands.add_parser("rules")
    r.add_argument("--json", action="store_true")
    al = commands.add_parser("align")
    al.add_argument("file")
    al.add_argument("--base")
    c = commands.add_parser("cache")
    c.add_argument("what", nargs="?", choices=("clean",))
    commands.add_parser("schema")
    args = parser.parse_args(argv)

    if args.command == "schema":
        spark = spark or SparkSession.builder.appName("ripplemark").getOrCreate()
        print(json.dumps(schema.documents(spark), indent=2))
        return 0
    if args.command == "cache":
        trees = repository.cached_trees(_cache())
        if args.what == "clean":
            shutil.rmtree(os.path.join(_cache(), "trees"), ignore_errors=True)
        print(f"{len(trees)} trees, {sum(n for _, n in trees)} bytes" + (" removed" if args.what else ""))
        return 0
    root = repository.root_of(args.root)
    config, source = _config(root)
    if args.command == "rules":
        found = rules.load(config, source)
        rows = [{"name": x.name, "kind": x.kind, "severity": x.severity, "title": x.title, "source": x.source} for x in found.rules]
        print(json.dumps(rows, indent=2) if args.json else "\n".join(f"{x['severity']:<7}{x['kind']:<7}{x['name']:<36}{x['source']}" for x in rows))
        return 0
    spark = spark or SparkSession.builder.appName("ripplemark").getOrCreate()
    if args.command == "assess":
        text = sys.stdin.read() if args.plan == "-" else open(args.plan, encoding="utf-8").read()
        document = json.loads(text)
        assess.check_version(document)
        with tempfile.TemporaryDirectory() as tmp:
            path = os.path.join(tmp, "plan.json")
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            logs = sarif.read(spark, args.sarif, root) if args.sarif else None
            texts = _texts(spark, root, document["base"], document.get("head"))
            out = assess.report(assess.of_document(spark, path, texts, rules.load(config, source), logs), document["base"], document.get("head"))
        print(json.dumps(out, indent=2, ensure_ascii=False) if args.json else assess.to_text(out))
        return int(assess.gate(out, args.fail_on))
    head = repository.commit_of(root, args.head) if getattr(args, "head", None) else None
    base = repository.merge_base(root, args.base or repository.default_branch(root), head or "HEAD")
    texts = _texts(spark, root, base, head)
    if args.command == "align":
        path, _, symbol = args.file.partition(":")
        for x in aligned.rows(texts, path, symbol or None).collect():
            print(f"{x['kind']:<10}{x['label']}  {x['base_start'] or '-'} → {x['head_start'] or '-'}" + "".join(f"\n    + {c}" for c in x["added_calls"] or []) + "".join(f"\n    - {c}" for c in x["removed_calls"] or []))
        return 0
    made = plan.make(texts, _reported(spark, root, config), _sites(texts, config), args.hops)
    if args.impact:
        print(json.dumps(plan.impact(made, base, head), indent=2, ensure_ascii=False))
        return 0
    document = plan.report(made, base, head, args.hops)
    if args.html:
        with open(args.html, "w", encoding="utf-8") as f:
            f.write(plan.to_html(made, document))
    print(plan.to_json(document) if args.json else plan.to_text(document))
    return 0


if __name__ == "__main__":
    sys.exit(main())
