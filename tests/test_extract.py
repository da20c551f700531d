import difflib
import random

import pytest

from ripplemark.functions.extract import extract, go, lines, python, sql, typescript


def by_name(facts):
    return {f.name: f for f in facts.functions}


PY = """import sys
import harbour.pilots.roster
import decimal as dec
from . import berths
from ..weather.wind import gusts as blow, calm

@api.put("/berths")
async def assign(ship):
    async with gate(ship) as lane:
        await harbour.pilots.roster.book(lane)
    tug = lambda size: call_tug(size)
    return {n: fee(n) for n in berths.Berth.free()}

class Quay(Stone):
    def moor(self, ship):
        self.fits(ship)  # or else not
        return blow().over(ship)

    @classmethod
    def _code(cls, ship):
        return ship.code

@area.route("/q", methods=["DELETE"])
def clear(): ...
"""


def test_python_functions_calls_and_imports():
    facts = extract("a.py", PY)
    f = by_name(facts)
    assert f["assign"].route == "PUT /berths" and f["assign"].exported and f["assign"].start_line == 7
    assert [c for c, _ in f["assign"].calls] == ["gate", "harbour.pilots.roster.book", "fee", "berths.Berth.free"]
    assert f["tug"].parent == 0 and f["clear"].route == "DELETE /q"
    assert f["Quay.moor"].method and [c for c, _ in f["Quay.moor"].calls] == ["Quay.fits", "blow(...).over", "blow"]
    assert (f["Quay._code"].start_line, f["Quay._code"].exported) == (19, False)
    assert {(i.local, i.specifier, i.kind, i.imported) for i in facts.imports} == {
        ("sys", "sys", "namespace", None), ("harbour", "harbour", "namespace", None), ("dec", "decimal", "namespace", None),
        ("berths", ".", "named", "berths"), ("blow", "..weather.wind", "named", "gusts"), ("calm", "..weather.wind", "named", "calm"),
    }
    assert ".berths" in facts.specifiers and "..weather.wind.calm" in facts.specifiers


def test_comments_and_blanks_change_no_body():
    same = by_name(python.extract(PY.replace("  # or else not", "   # as it must")))["Quay.moor"].body_hash
    assert same == by_name(python.extract(PY))["Quay.moor"].body_hash
    a, b = ("func f() {\n\tg() // x\n}\n", "func f() {  g()\n/* y */ }\n")
    assert go.extract(a).functions[0].body_hash == go.extract(b).functions[0].body_hash
    assert go.extract(a).functions[0].body_hash != go.extract(a.replace("g()", "h()")).functions[0].body_hash


def test_python_types_lead_calls_to_classes():
    text = "class A:\n    r: Repo\n    def __init__(self, q: 'db.Queue', o: Optional[Old], n: list[No]):\n        self.q = q\n        self.m = Make()\n    def go(self, x: int | None, y: Y | None):\n        self.r.a(); self.q.b(); self.m.c(); x.d(); y.e(); self.z.f(); Repo(1).g()\n"
    assert [c for c, _ in by_name(python.extract(text))["A.go"].calls] == ["Repo.a", "db.Queue.b", "Make.c", "x.d", "Y.e", "self.z.f", "Repo.g", "Repo"]


def test_broken_python_gives_what_can_be_read():
    assert set(by_name(python.extract("def a():\n    f()\n\ndef b(:\n    pass\n\ndef c():\n    g()\n"))) >= {"a", "c"}
    assert python.extract("\x00((((").functions == [] and extract("x.unknown", "a").functions == []


def loops(facts):
    return [(h.line, h.stops_early if h.loop else None) for h in facts.hits]


def test_what_runs_once_per_turn_of_a_loop():
    src = "package mill\n\nfunc grind(sacks []string) {\n\tdefer sweep()\n\tfor len(sacks) > 0 {\n\t\tsacks = sacks[1:]\n\t\tdefer tie(sacks)\n\t\tgo func() { defer rest() }()\n\t}\n\tfor {\n\t\tdefer lock()\n\t\treturn\n\t}\n}\n"
    assert loops(go.extract(src)) == [(4, None), (7, False), (8, None), (11, None)]
    src = "async def bake(loaves):\n    await heat()\n    while loaves:\n        await turn(loaves.pop())\n    async for crumb in table():\n        await wipe(crumb)\n    for loaf in loaves:\n        if await done(loaf):\n            break\n"
    assert loops(python.extract(src)) == [(2, None), (4, False), (6, None), (8, True)]
    src = "async function row(boats) {\n  do {\n    await stroke();\n  } while (tired());\n  for (const b in await harbour()) { b; }\n  for await (const wave of sea) {\n    await wave.pass();\n  }\n  for (;;) {\n    boats.forEach(async (b) => { await b.turn(); });\n    await sleep(1); break;\n  }\n}\n"
    assert loops(typescript.extract(src)) == [(3, False), (5, None), (7, None), (10, None), (11, None)]


GO = """package press

import (
	"bufio"
	ink "example.net/print/internal/ink"
	"example.net/type/v2"
	"gopkg.in/paper.v1"
	_ "image/png"
)

func Begin(in *bufio.Reader) *Sheet {
	defer func() { in.close() }()
	site.Post("/proofs", func(out http.ResponseWriter, ask *http.Request) { proof(out) })
	sheet := &Sheet{}
	return ink.Roll(sheet)
}

func (t *Tray[S]) Take(n int) (S, error) { first := pair.Of[string](n); return []rune(first), cut(n)(t) }

type Plate interface {
	Etch(line string) error
	Depth() (float64, bool)
}
"""


def test_go_functions_types_and_imports():
    facts = go.extract(GO)
    f = by_name(facts)
    assert [c for c, _ in f["Begin"].calls] == ["site.Post", "ink.Roll"] and f["Begin"].exported
    assert [c for c, _ in f["Tray.Take"].calls] == ["pair.Of", "cut(...)", "cut"] and f["Tray.Take"].method
    assert [x.route for x in facts.functions if x.route] == ["POST /proofs"]
    assert {(i.local, i.specifier) for i in facts.imports} == {
        ("bufio", "bufio"), ("ink", "example.net/print/internal/ink"), ("type", "example.net/type/v2"),
        ("paper", "gopkg.in/paper.v1"), (None, "image/png"),
    }
    assert facts.interfaces == [("Plate", "Etch"), ("Plate", "Depth")] and facts.methods == [("Tray", "Take")]


TS = """import { reel as spool, type Film } from './film';
import lamp, { lens } from "cine/optics";
import * as sound from '@cine/sound/track';
export * from './screen';
export * as seats from './hall';
export const show = async (title: string): Promise<Frame[]> => {
  const frames = await vault.fetch<Frame>(`film ${slug(title)}`);
  return frames.map((f) => tint(f)).filter(Boolean);
};
function splice<A>(a: A): { end: number } { return glue(a)({ cut: f => snip(f) }); }
class Booth { private async open(key: () => void): Promise<void> { this.door.turn(key); } dim = () => { lights(); } }
const desk = { sell() { print(); }, refund: async () => pay() };
cinema.start = function () { run(/reel(s)/.test(name)); };
type Usher = (seat: number) => void;
interface Guest { sit(seat: () => void): void }
site.put('/shows/:day', guard, async (ctx) => { ctx.json(await plan(ctx)); });
new Ticket(price());
const way = late ? (g) => back(g) : (g) => front(g);
remote.api.shows['today'].$put({});
site.route('/old', archive);
"""


def test_typescript_functions_calls_and_modules():
    facts = typescript.extract(TS)
    f = by_name(facts)
    assert f["show"].exported and [c for c, _ in f["show"].calls] == ["vault.fetch", "slug", "frames.map(...).filter", "frames.map"]
    assert [c for c, _ in f["splice"].calls] == ["glue(...)", "glue"] and not f["splice"].exported
    assert f["open"].method and f["sell"].method and f["refund"].method and f["start"].method
    assert [c for c, _ in f["start"].calls] == ["run", "/reel(s)/.test"]
    routed = [x for x in facts.functions if x.route]
    assert [x.route for x in routed] == ["PUT /shows/:day"] and [c for c, _ in routed[0].calls] == ["ctx.json", "plan"]
    nameless = [[c for c, _ in x.calls] for x in facts.functions if x.name is None]
    assert [c for c, _ in f["cut"].calls] == ["snip"] and ["back"] in nameless and ["front"] in nameless and ["tint"] in nameless
    assert "price" in [c for c, _ in facts.module_calls]
    assert {(i.local, i.kind, i.imported) for i in facts.imports} == {
        ("spool", "named", "reel"), ("Film", "named", "Film"), ("lamp", "default", None), ("lens", "named", "lens"), ("sound", "namespace", None),
    }
    assert facts.reexports == ["./screen"] and facts.namespace_reexports == [("seats", "./hall")]
    assert facts.rpc_calls[-1][:2] == ("PUT", "/api/shows/today") and facts.mounts == [("/old", "archive")]


def test_a_component_is_one_function_with_its_callbacks_inside():
    src = "<h1>Tides</h1>\n\n<script>\n  import {\n    moon,\n  } from '../sky';\n  import sea from './sea.js';\n  const ebb = () => sea(moon);\n  onMount(() => {\n    ebb();\n  });\n</script>\n<b>it's low</b>\n"
    facts = extract("pages/+layout.svelte", src)
    assert [(f.name, f.parent, f.start_line, f.end_line) for f in facts.functions] == [("Layout", None, 3, 12), ("ebb", 0, 8, 8), (None, 0, 9, 11)]
    assert facts.functions[0].exported and sorted(facts.specifiers) == ["../sky", "./sea.js"]


def test_sql_statements_and_the_forward_half():
    text = "/* first */ INSERT INTO a VALUES ('x;y');\n\nDO $fix$ BEGIN\n  PERFORM 1; END $fix$;\n-- then\nDROP VIEW v"
    found = sql.statements(text)
    assert [n for n, _ in found] == [1, 3, 6] and "PERFORM 1; END $fix$" in found[1][1] and found[2][1].strip() == "DROP VIEW v"
    assert sql.forward_half("-- Up Migration\nA;\n-- Down Migration\nB;\n") == "-- Up Migration\nA;\n"
    assert sql.without_comments("a -- b\n'--c' /* d\n e */f") == "a     \n'--c'     \n     f"


def test_line_differences_are_shortest():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        m = lines.matches(a, b)
        best = max([len(m), sum(n for _, _, n in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks())])
        assert len(m) == best and all(a[i] == b[j] for i, j in m) and all(p < q for p, q in zip(m, m[1:], strict=False))
    assert lines.added_lines("a\nb\n", "a\nx\nb\ny\n") == [2, 4] and lines.added_lines(None, "a\n") == [1]
    assert [r[0] for r in lines.rows("a\nb\nc\n", "a\nx\nc\n")] == [" ", "-", "+", " "]


def test_hunks_have_keys_that_tell_repetitions_apart():
    diff = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n@@ -5 +5 @@\n-c\n+d\n@@ -9,2 +9 @@ x\n-c\n+d\n"
    found = lines.unified(diff)
    assert [(h["path"], h["start"], h["changed"]) for h in found] == [("f", 1, 2), ("f", 5, 2), ("f", 9, 2)]
    assert found[2]["key"] == found[1]["key"] + "#1" and found[0]["key"] != found[1]["key"]


@pytest.mark.parametrize("seed", range(5))
def test_scanners_survive_any_text(seed):
    rng = random.Random(seed)
    for _ in range(40):
        text = "".join(rng.choices(["(", ")", "{", "}", "=>", "func ", "f", ".", "`", "${", "'", '"', "/", "\n", " ", "await ", "for ", "class ", ":", "?", "é"], k=rng.randint(0, 60)))
        for path in ("a.ts", "a.go", "a.py", "a.svelte"):
            extract(path, text)
