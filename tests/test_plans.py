"""End to end: two revisions in, plan and findings out."""

import json
import subprocess

import pytest
import repos
from pyspark.sql import functions as F

from ripplemark import cli
from ripplemark.operators import rules
from ripplemark.plans import assess, plan
from ripplemark.sources import repository, resolver, sarif


def texts_of(spark, base, head):
    rows = [("base", p, t) for p, t in base.items()] + [("head", p, t) for p, t in head.items()]
    return spark.createDataFrame(rows, "rev string, path string, text string")


def named(document, change, top=""):
    return sorted(f"{f['path']}:{f['name']}" for f in document["functions"] if f["change"] == change and f["path"].startswith(top))


@pytest.fixture(scope="module")
def orchard(spark):
    made = plan.make(texts_of(spark, repos.ORCHARD_BASE, repos.ORCHARD_HEAD))
    return made, plan.report(made)


@pytest.fixture(scope="module")
def many(spark):
    reported = resolver.parse(spark.createDataFrame([(x,) for x in repos.REPORTED.split("\n")], "value string")).withColumn("rev", F.lit("head"))
    made = plan.make(texts_of(spark, repos.MANY_BASE, repos.MANY_HEAD), reported)
    return made, plan.report(made)


def test_a_library_change_reaches_every_entry_point(orchard):
    _, doc = orchard
    s = doc["summary"]
    assert s["changed"] == {"added": 1, "changed": 3, "removed": 0, "files_without_function_changes": 1}
    assert (s["reach"]["functions"], s["reach"]["files"], len(s["reach"]["packages"])) == (6, 5, 5)
    assert s["reach"]["entries"] == {"export": 2, "function": 1, "module": 1, "route": 1}
    by = {x["id"].split("::")[1]: x for x in s["symbols"]}
    assert (by["moisture"]["reach_functions"], by["moisture"]["public"], by["moisture"]["called_from_packages"]) == (6, True, ["@orchard/beds", "@orchard/log"])
    assert [(by[n]["reach_functions"], by[n]["reach_packages"], by[n]["public"]) for n in ("clamp", "floor")] == [(6, 5, False)] * 2
    assert by["flush"]["reach_functions"] == 0 and by["flush"]["reach_entries"] == 1
    assert [(c["caller"].split("::")[1], c["change"]) for c in doc["calls"] if c["callee"].endswith("::floor")] == [("clamp", "added")]
    assert {f["route"] for f in doc["functions"] if "route" in f} == {"GET /garden/dry"}
    text = plan.to_text(doc)
    assert "Changed symbols: 4  (~3 changed, +1 added, -0 removed)" in text and "Other changed files: 1" in text


def test_the_rules_judge_it(orchard, spark, tmp_path):
    made, doc = orchard
    out = assess.report(assess.of_plan(made, rules.load()))
    got = {(f["rule"], f["severity"], f["path"].split("/")[-1], f["line"]) for f in out["findings"]}
    assert got == {
        ("migration-domain-rewrite", "high", "0002.sql", 1), ("migration-not-null-without-default", "high", "0002.sql", 3),
        ("public-api-change", "medium", "convert.ts", 6), ("await-in-loop", "medium", "log.ts", 7), ("wide-reach", "low", "convert.ts", 3),
    }
    assert out["counts"] == {"high": 2, "medium": 2, "low": 1}
    assert assess.gate(out, "high") and not assess.gate(out, None)
    log = {"runs": [{"tool": {"driver": {"name": "Lint"}}, "results": [
        {"ruleId": "r1", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "./kit/units/lib/convert.ts"}, "region": {"startLine": 1}}}]},
        {"ruleId": "r2", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "kit/units/lib/convert.ts"}, "region": {"startLine": 12}}}]},
        {"ruleId": "r3"}]}]}
    (tmp_path / "log.sarif").write_text(json.dumps(log))
    (tmp_path / "plan.json").write_text(plan.to_json(doc))
    texts = texts_of(spark, repos.ORCHARD_BASE, repos.ORCHARD_HEAD)
    again = assess.report(assess.of_document(spark, str(tmp_path / "plan.json"), texts, rules.load(), sarif.read(spark, str(tmp_path / "log.sarif"))))
    assert [f["title"] for f in again["findings"] if f["rule"] == "lint/r1"] == ["m"]
    assert sorted((f["rule"], f["line"], f["title"]) for f in again["findings"] if "lint" not in f["rule"]) == sorted((f["rule"], f["line"], f["title"]) for f in out["findings"])
    with pytest.raises(ValueError, match="version 2"):
        assess.check_version({"version": 2})


def test_go_reaches_through_methods_packages_and_routes(many):
    made, doc = many
    assert named(doc, "changed", "ferry/") == ["ferry/tide/table.go:Table.At"]
    assert named(doc, "added", "ferry/") == ["ferry/tide/table.go:Table.note"]
    assert named(doc, "unchanged", "ferry/") == [
        "ferry/main.go:main", "ferry/sailing/captain.go:Captain.MaySail", "ferry/web/board.go:ANY /departures", "ferry/web/board.go:Mount",
    ]
    assert next(s for s in doc["summary"]["symbols"] if s["id"].endswith("Table.At"))["called_from_packages"] == ["example.org/ferry/sailing"]
    found = {(f["rule"], f["line"]) for f in assess.report(assess.of_plan(made, rules.load()))["findings"] if f["severity"] == "medium"}
    assert found == {("defer-in-loop", 7), ("python-await-in-loop", 7)}


def test_go_interface_calls_are_inferred_and_a_resolver_is_believed(many):
    _, doc = many
    of = {c["callee"]: c for c in doc["calls"] if c["callee"].startswith("alarm/")}
    horn = of["alarm/roof/siren.go::Siren.Blow"]
    assert (horn["caller"], horn["line"], horn["inferred"]) == ("alarm/watch/guard.go::Guard.Intruder", 12, True)
    latch = of["alarm/gate/latch.go::Latched"]
    assert (latch["caller"], latch["line"], "inferred" in latch) == ("alarm/watch/patrol.go::Patrol", 5, False)


def test_python_reaches_through_relative_imports_and_reexports(many):
    _, doc = many
    assert named(doc, "changed", "one/") == ["one/src/museum/labels.py:captions"]
    assert named(doc, "unchanged", "one/") == ["one/src/museum/web/views.py:GET /rooms"]
    assert named(doc, "unchanged", "two/") == [
        "two/src/museum/labels.py:captions", "two/src/museum/web/views.py:GET /rooms", "two/src/museum/web/views.py:PUT /cards",
    ]
    assert not [f for f in doc["functions"] if "/tests/" in f["path"]]


def test_python_typed_instances_and_constructors_reach_their_own_methods(many):
    _, doc = many
    assert named(doc, "changed", "pots/") == ["pots/kiln/burner.py:Burner.heat", "pots/kiln/glaze.py:Celadon.__init__"]
    assert named(doc, "unchanged", "pots/") == [
        "pots/kiln/bench.py:bench.py · module level", "pots/kiln/bench.py:green", "pots/kiln/firing.py:Potter.bisque", "pots/kiln/firing.py:candle",
    ]


def test_commands_on_a_git_repository(spark, tmp_path, capsys, monkeypatch):
    root = tmp_path / "repo"
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    root.mkdir()
    monkeypatch.setenv("RIPPLEMARK_CACHE", str(tmp_path / "cache"))
    run("init", "-q", "-b", "main")
    run("config", "user.name", "t")
    run("config", "user.email", "t@example.invalid")
    (root / "a.py").write_text("def f():\n    return g()\n\n\ndef g():\n    return 1\n")
    run("add", "-A")
    run("commit", "-qm", "base")
    run("switch", "-qc", "work")
    (root / "a.py").write_text("def f():\n    return g()\n\n\ndef g():\n    # only said more\n    return 1\n\n\ndef h():\n    return g()\n")
    (root / "b.sql").write_text("SELECT 1;\n")
    args = ["--root", str(root)]
    assert cli.main([*args, "plan", "--json"], spark) == 0
    doc = json.loads(capsys.readouterr().out)
    assert named(doc, "added") == ["a.py:h"] and named(doc, "changed") == []
    assert cli.main([*args, "align", "a.py"], spark) == 0
    assert "added     h" in capsys.readouterr().out
    (tmp_path / "p.json").write_text(json.dumps(doc))
    assert cli.main([*args, "assess", str(tmp_path / "p.json"), "--fail-on", "high"], spark) == 0
    assert "Assessment: 0 high" in capsys.readouterr().out
    assert cli.main([*args, "rules"]) == 0 and "await-in-loop" in capsys.readouterr().out
    assert cli.main(["cache"]) == 0 and cli.main(["schema"], spark) == 0
    assert '"const": 3' in capsys.readouterr().out
    assert [r["path"] for r in repository.directory_files(spark, str(root)).where("path LIKE '%.sql'").collect()] == ["b.sql"]


def test_seams_aliases_components_and_namespaces_join_the_graph(spark):
    from ripplemark.plans import resolve

    base = {
        "package.json": '{ "name": "app" }',
        "tsconfig.json": '{ // one that extends\n "extends": "./config/tsconfig.base.json", }',
        "config/tsconfig.base.json": '{ "compilerOptions": { "baseUrl": "..", "paths": { "@core/*": ["src/core/*"] } } }',
        "src/core/bus.ts": "export const deliver = (x: number) => x;\nbus.on('order.paid', (e) => { deliver(e); });\n",
        "src/core/index.ts": "export * as money from './money';\n",
        "src/core/money.ts": "export function round(x: number) { return x; }\n",
        "src/pay.ts": "import { round } from '@core/money';\nimport * as core from '@core/index';\n\nexport const pay = () => {\n  bus.emit('order.paid', round(1));\n  return core.money.round(2);\n};\n",
        "src/lib/fmt.ts": "export const fmt = (x: string) => x;\n",
        "src/Cart.svelte": "<script>\n  import { fmt } from '$lib/fmt';\n  const show = () => fmt('x');\n</script>\n<p>don't</p>\n",
    }
    head = base | {
        "src/core/money.ts": "export function round(x: number) { return x + 1; }\n",
        "src/lib/fmt.ts": "export const fmt = (x: string) => x + '!';\n",
        "src/core/bus.ts": "export const deliver = (x: number) => x + 1;\nbus.on('order.paid', (e) => { deliver(e); });\n",
    }
    texts = texts_of(spark, base, head)
    sites = resolve.seam_sites(texts, "bus", r"\.on\('([\w.]+)'", r"\.emit\('([\w.]+)'")
    assert {(r["side"], r["key"], r["line"]) for r in sites.where("rev = 'head'").collect()} == {("definition", "order.paid", 2), ("call", "order.paid", 5)}
    doc = plan.report(plan.make(texts, sites=sites))
    calls = {(c["caller"], c["callee"]) for c in doc["calls"]}
    assert ("src/pay.ts::pay", "src/core/money.ts::round") in calls
    assert ("src/Cart.svelte::show", "src/lib/fmt.ts::fmt") in calls and ("src/Cart.svelte::Cart", "src/Cart.svelte::show") in calls
    assert ("src/pay.ts::pay", "src/core/bus.ts::anon@2") in calls and ("src/core/bus.ts::anon@2", "src/core/bus.ts::deliver") in calls
    assert {f["entry"] for f in doc["functions"] if f["path"].endswith(".svelte") and "entry" in f} == {"component"}
    changed = {s["id"]: s["reach_functions"] for s in doc["summary"]["symbols"]}
    assert changed["src/core/bus.ts::deliver"] == 2 and changed["src/core/money.ts::round"] == 1


def test_the_page_and_the_older_report(orchard):
    made, doc = orchard
    page = plan.to_html(made, doc)
    assert "moisture" in page and "</script><" not in page.split('id="model">')[1].split("\n")[0].removesuffix("</script>")
    old = plan.impact(made)
    far = next(c for c in old["chains"] if c["entry"].endswith("::refresh"))
    assert [h.split("::")[1] for h in far["hops"]] == ["refresh", "anon@5", "dryBeds", "isDry", "moisture"]
    assert far["reaches"][0] == far["changed"] and len(far["reaches"]) == len(set(far["reaches"]))
    assert {"from_package": "@orchard/phone", "to_package": "@orchard/panel", "calls": 1, "changed_calls": 0, "routes": 1} in old["crossings"]


def test_one_files_alignment_for_people(spark):
    from ripplemark.plans import aligned

    texts = texts_of(spark, {"a.ts": "const f = () => { x(); };\nconst g = () => 1;\n"}, {"a.ts": "\nconst f = () => { x(); y(); };\nconst h = () => z();\n"})
    rows = {r["label"]: r for r in aligned.rows(texts, "a.ts").collect()}
    assert rows["f"]["kind"] == "changed" and rows["f"]["added_calls"] == ["y"] and (rows["f"]["base_start"], rows["f"]["head_start"]) == (1, 2)
    assert rows["h"]["tier"] == "positional" and rows["h"]["kind"] == "changed"


def test_a_file_that_moves_and_changes_is_one_file(spark):
    old = "".join(f"const step{i} = () => {{ return {i}; }};\n" for i in range(8))
    texts = texts_of(spark, {"a/old.ts": old, "a/gone.ts": "let x = 1;\n"}, {"a/new.ts": old.replace("return 3", "return 33"), "a/fresh.ts": "call(me);\n"})
    made = plan.make(texts)
    assert {(r["path"], r["change"], r["previous_path"]) for r in made.files.collect()} == {
        ("a/new.ts", "renamed", "a/old.ts"), ("a/gone.ts", "deleted", None), ("a/fresh.ts", "added", None)
    }
