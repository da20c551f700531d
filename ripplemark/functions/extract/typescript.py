"""TypeScript, JavaScript and the scripts of Svelte components, by a tolerant scan."""

from __future__ import annotations

import re

from ripplemark.functions.extract.facts import Facts, Function, Hit, Import, fingerprint
from ripplemark.functions.extract.tokens import CLOSE, OPEN, Loop, Scan, standing

#: Fixed: methods of routers and of typed clients.
HTTP = ("get", "post", "put", "patch", "delete")
_NO_CALL = {
    "if", "for", "while", "switch", "catch", "function", "return", "typeof", "void", "delete", "await", "yield", "throw", "case",
    "in", "of", "new", "else", "do", "instanceof", "with", "async",
}
_MODIFIERS = {"async", "static", "public", "private", "protected", "readonly", "override", "get", "set", "abstract", "declare"}
_CONTINUES_AFTER = {"(", "[", "{", "${", ",", ".", "?.", "=", "=>", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", "!", "&", "|", "^", "<", ">", "=="}
_CONTINUES_BEFORE = {".", "?.", ",", ")", "]", "}", "}$", "=", "=>", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", "==", "===", "!=", "!==", "&", "|", "^", "(", "["}


_SCRIPT = re.compile(r"^[ \t]*<script\b(?![^\n]*</script>)([^>]*)>[^\n]*\n(.*?)^[ \t]*</script>[^\n]*", re.M | re.S)
_IMPORT = re.compile(r"""^[ \t]*import\b\s*(?:[\w$*{}\s,]*?\bfrom\s*)?['"][^'"\n]*['"][^\n]*""", re.M)


def script_of(text: str, name: str) -> str:
    """A component's scripts, each as one exported function on its own lines; all else is blank lines.

    Imports and ``export`` can't stand in a function: the first go, the word is blanked.
    """
    lines = lambda part: "\n" * part.count("\n")
    out, at = [], 0
    for m in _SCRIPT.finditer(text):
        body = _IMPORT.sub(lambda i: lines(i[0]), m[2])
        body = re.sub(r"(?m)^([ \t]*)export ", r"\1       ", body)
        suffix = "_module" if re.search(r"""\smodule\b|context=["']module""", m[1]) else ""
        out += [lines(text[at : m.start()]), f"export const {name}{suffix} = async () => {{\n", body, "};"]
        at = m.end()
    return "".join(out) + lines(text[at:])


def component_name(path: str) -> str:
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].split("@")[0]
    if stem.startswith("+"):
        stem = stem[1:2].upper() + stem[2:]
    return re.sub(r"[^\w]", "_", stem) or "Component"


def _ends(scan: Scan):
    def ends(a: int, b: int) -> bool:
        x, y = scan.tokens[a], scan.tokens[b]
        if x.kind == "op" and x.text in _CONTINUES_AFTER or y.kind == "op" and y.text in _CONTINUES_BEFORE:
            return False
        return not (y.kind == "id" and y.text in ("else", "catch", "finally", "instanceof", "in", "as", "satisfies", "extends", "implements"))

    return ends


def _is_object(scan: Scan, i: int) -> bool:
    """Whether a brace opens an object rather than a block."""
    p = i - 1
    if p < 0:
        return False
    t = scan.tokens[p]
    if t.kind == "op":
        return t.text in ("(", "[", ",", "=", ":", "?", "&&", "||", "??", "${", "...")
    return t.kind == "id" and t.text in ("return", "default", "yield", "await", "throw", "in", "of")


def _class_bodies(scan: Scan) -> set[int]:
    out = set()
    for i, t in enumerate(scan.tokens):
        if t.kind == "id" and t.text == "class" and not scan.is_op(i - 1, ".", "?."):
            k = i + 1
            while k < len(scan.tokens) and not scan.is_op(k, "{", ";"):
                k = scan.end(k) + 1 if scan.is_op(k, "(", "[") else k + 1
            if scan.is_op(k, "{"):
                out.add(k)
    return out


def _type_spans(scan: Scan) -> list[tuple[int, int]]:
    """Interfaces and type declarations, where arrows are types."""
    out = []
    for i, t in enumerate(scan.tokens):
        if t.kind != "id" or scan.is_op(i - 1, ".", "?.") or not scan.is_word(i + 1):
            continue
        if t.text == "interface":
            body = next((k for k in range(i + 1, min(i + 60, len(scan.tokens))) if scan.is_op(k, "{")), None)
            if body is not None:
                out.append((i, scan.end(body)))
        elif t.text == "type" and (scan.is_op(i + 2, "=", "<")):
            k, ends = i + 2, _ends(scan)
            while k + 1 < len(scan.tokens):
                if scan.tokens[k].kind == "op" and scan.tokens[k].text in OPEN:
                    k = scan.end(k)
                if k + 1 >= len(scan.tokens) or scan.is_op(k + 1, ";") or not scan.same_line(k, k + 1) and ends(k, k + 1) and not scan.is_op(k, "=", "|", "&", ">", "=>"):
                    break
                k += 1
            out.append((i, k))
    return out


def _after_params(scan: Scan, close: int) -> int:
    """The token after parameters and a return type: where a body or an arrow would be."""
    k = close + 1
    if not scan.is_op(k, ":"):
        return k
    k, first = k + 1, True
    while k < len(scan.tokens):
        if scan.is_op(k, "=>", ";", ",", ")", "}") or scan.is_op(k, "{") and not first and not scan.is_op(k - 1, "|", "&", ":", "<", "=>", "is"):
            return k
        first = False
        k = scan.end(k) + 1 if scan.is_op(k, "(", "[", "{") else k + 1
    return k


def _expression_end(scan: Scan, i: int) -> int:
    """Last token of the expression that begins at i."""
    k, ends, choices = i, _ends(scan), 0
    while k < len(scan.tokens):
        if scan.tokens[k].kind == "op":
            choices += scan.is_op(k, "?")
            if scan.tokens[k].text in CLOSE or scan.tokens[k].text in (",", ";") or scan.is_op(k, ":") and not choices:
                return max(i, k - 1)
            choices -= scan.is_op(k, ":")
            if scan.tokens[k].text in OPEN:
                k = scan.end(k)
        if k + 1 < len(scan.tokens) and not scan.same_line(k, k + 1) and ends(k, k + 1):
            return k
        k += 1
    return len(scan.tokens) - 1


class _Found:
    """Functions of a scan: (start token, end token, name, exported, method, tokens of parameters)."""

    def __init__(self, scan: Scan):
        self.scan, self.classes, types = scan, _class_bodies(scan), _type_spans(scan)
        self.types = types
        self.items: list[tuple[int, int, str | None, bool, bool]] = []
        self.heads: set[int] = set()  # parentheses of parameters
        for i, t in enumerate(scan.tokens):
            if any(a <= i <= z for a, z in types):
                continue
            if t.kind == "op" and t.text == "=>":
                self._arrow(i)
            elif t.kind == "id" and t.text == "function" and not scan.is_op(i - 1, ".", "?."):
                self._function(i)
            elif t.kind == "op" and t.text == "(":
                self._method(i)
        self.items.sort(key=lambda f: (f[0], -f[1]))

    def _arrow(self, i: int) -> None:
        scan, p = self.scan, i - 1
        if scan.is_op(p, ")") and p in scan.pair:
            start = scan.pair[p]
        elif scan.is_word(p) and not (scan.is_op(p - 1, ":") and scan.is_op(p - 2, ")") or scan.is_op(p - 1, ".", "]", "|", "&", ">")):
            start = p
        else:  # a return type lies between: back to the parameters' colon
            k = p
            while k > 0 and not scan.is_op(k, ";", ",", "{", "=", "("):
                if scan.is_op(k, ")", "]", "}", ">") and k in scan.pair:
                    k = scan.pair[k]
                if scan.is_op(k, ":") and scan.is_op(k - 1, ")"):
                    break
                k -= 1
            if not (scan.is_op(k, ":") and scan.is_op(k - 1, ")") and k - 1 in scan.pair):
                return
            start = scan.pair[k - 1]
        if scan.is_op(start, "("):
            self.heads.add(start)
        if scan.is_op(start - 1, ">") and not scan.is_op(start - 1, "=>"):
            k = start - 1
            while k > 0 and not scan.is_op(k, "<"):
                k -= 1
            start = k
        if scan.is_word(start - 1, "async"):
            start -= 1
        if scan.is_op(start - 1, ":") and not self._is_pair(start - 1) and not self._is_ternary(start - 1):
            return  # a type after a colon
        end = scan.end(i + 1) if scan.is_op(i + 1, "{") else _expression_end(scan, i + 1)
        self.items.append((start, end, *self._named(start)))

    def _is_pair(self, colon: int) -> bool:
        a = self.scan.around[colon]
        return a >= 0 and self.scan.is_op(a, "{") and a not in self.classes and _is_object(self.scan, a) and self.scan.is_op(colon - 2, "{", ",")

    def _is_ternary(self, colon: int) -> bool:
        scan, k = self.scan, colon - 1
        while k >= 0 and not scan.is_op(k, ";", ",", "{", "(", "="):
            if scan.is_op(k, ")", "]", "}") and k in scan.pair:
                k = scan.pair[k]
            elif scan.is_op(k, "?"):
                return not scan.is_op(k + 1, ":")
            k -= 1
        return False

    def _named(self, start: int) -> tuple[str | None, bool, bool]:
        """Name, exported, method of a function expression, by what it is given to."""
        scan = self.scan
        if scan.is_op(start - 1, ":") and self._is_pair(start - 1):
            return scan.tokens[start - 2].text, False, True
        if not scan.is_op(start - 1, "="):
            return None, False, False
        k = start - 2
        if scan.is_word(k) and scan.is_op(k - 1, ".", "?."):
            return scan.tokens[k].text, False, True
        if scan.around[start] in self.classes:
            return None, False, False
        first = self._declared(start - 1)
        if first is not None:
            return scan.tokens[first + 1].text, scan.is_word(first - 1, "export"), False
        return (scan.tokens[k].text, False, False) if scan.is_word(k) else (None, False, False)

    def _declared(self, equals: int) -> int | None:
        """The const, let or var before ``name[: type] =``."""
        scan, k = self.scan, equals - 1
        while k > 0:
            if scan.is_op(k, ")", "]", "}") and k in scan.pair:
                k = scan.pair[k] - 1
                continue
            if scan.is_word(k - 1, "const", "let", "var") and scan.is_word(k) and (k + 1 == equals or scan.is_op(k + 1, ":")):
                return k - 1
            if scan.is_op(k, ";", "{", "(", "="):
                return None
            k -= 1
        return None

    def _function(self, i: int) -> None:
        scan, k, name = self.scan, i + 1, None
        if scan.is_op(k, "*"):
            k += 1
        if scan.is_word(k):
            name, k = scan.tokens[k].text, k + 1
        if scan.is_op(k, "<"):
            while k < len(scan.tokens) and not scan.is_op(k, "("):
                k += 1
        if not scan.is_op(k, "("):
            return
        self.heads.add(k)
        body = _after_params(scan, scan.end(k))
        if not scan.is_op(body, "{"):
            return
        start = i - 1 if scan.is_word(i - 1, "async") else i
        before = start - 1
        value = scan.is_op(before, "=", "(", ",", ":", "=>", "&&", "||", "??", "?", "[", "!") or scan.is_word(before, "return", "new", "await", "typeof", "void")
        if name is not None and not value:
            exported = scan.is_word(before, "export") or scan.is_word(before, "default") and scan.is_word(before - 1, "export")
            self.items.append((start, scan.end(body), name, exported, False))
        else:
            self.items.append((start, scan.end(body), *self._named(start)))

    def _method(self, i: int) -> None:
        scan, around = self.scan, self.scan.around[i]
        if around < 0 or not scan.is_op(around, "{") or not (around in self.classes or _is_object(scan, around)):
            return
        k = i - 1
        if scan.is_op(k, ">"):
            while k > around and not scan.is_op(k, "<"):
                k -= 1
            k -= 1
        if scan.is_op(k, "]") and k in scan.pair:
            name_at, k = scan.pair[k], scan.pair[k]
        elif k > around and scan.tokens[k].kind in ("id", "str", "num"):
            name_at = k
        else:
            return
        name = scan.text[scan.tokens[name_at].start : scan.tokens[i - 1].end] if scan.is_op(name_at, "[") else scan.tokens[name_at].text
        start = name_at
        while scan.is_op(start - 1, "*") or scan.is_word(start - 1) and scan.tokens[start - 1].text in _MODIFIERS:
            start -= 1
        fresh = scan.is_op(start - 1, "{", "}", ";", ",") or not scan.same_line(start - 1, start)
        body = _after_params(scan, scan.end(i))
        if not fresh or scan.is_op(start - 1, ".", "?.", "=", ":", "(") or not scan.is_op(body, "{") or scan.is_word(name_at, *_NO_CALL - {"of", "in", "async", "delete", "with"}):
            return
        self.heads.add(i)
        self.items.append((start, scan.end(body), name, False, True))


def _callee(scan: Scan, i: int) -> tuple[str | None, int]:
    """Text of the expression that ends at i as a callee, and where it starts."""
    t = scan.tokens[i]
    if t.kind == "id":
        if scan.is_op(i - 1, ".", "?.") and i >= 2:
            owner, at = _callee(scan, i - 2 - (scan.is_op(i - 2, "!") and i > 2))
            return f"{owner}.{t.text}" if owner else t.text, at
        return t.text, i
    if scan.is_op(i, ")") and i in scan.pair:
        a = scan.pair[i]
        if a and (scan.tokens[a - 1].kind == "id" and scan.tokens[a - 1].text not in _NO_CALL or scan.is_op(a - 1, ")", "]")):
            inner, at = _callee(scan, a - 1)
            return f"{inner or ''}(...)", at
        return scan.text[scan.tokens[a].start : t.end], a
    if scan.is_op(i, "]") and i in scan.pair and scan.pair[i] > 0:
        at = _callee(scan, scan.pair[i] - 1)[1]
        return scan.text[scan.tokens[at].start : t.end], at
    if t.kind == "str":
        return t.text, i
    return None, i


def extract(text: str, path: str = "") -> Facts:
    """Facts of a file; a component reads as one function with its callbacks inside."""
    source = script_of(text, component_name(path)) if path.endswith(".svelte") else text
    scan, facts = Scan(source, script=True), Facts()
    found = _Found(scan)
    spans = [(f[0], f[1]) for f in found.items]
    for n, (start, end, name, exported, method) in enumerate(found.items):
        parent = next((m for m in range(n - 1, -1, -1) if spans[m][0] <= start and end <= spans[m][1]), None)
        facts.functions.append(
            Function(parent, name, exported, method, scan.line_of(start), scan.line(scan.tokens[end].end - 1), fingerprint(scan.code(start, end)), _route(scan, start))
        )
    calls = []
    for i in range(1, len(scan.tokens)):
        if not scan.is_op(i, "(") or i in found.heads or any(a <= i <= z for a, z in found.types):
            continue
        k = i - 1
        if scan.is_op(k, ">"):  # type arguments, written close
            depth = 0
            while k > 0 and not scan.is_op(k, ";", "{", "}", "(", ")"):
                depth += scan.is_op(k, ">") - scan.is_op(k, "<")
                if depth == 0:
                    break
                k -= 1
            if not scan.is_op(k, "<") or scan.tokens[k - 1].end != scan.tokens[k].start:
                continue
            k -= 1
        elif scan.is_op(k, "?."):
            k -= 1
        t = scan.tokens[k]
        if not (t.kind == "id" or scan.is_op(k, ")", "]")) or t.kind == "id" and t.text in _NO_CALL and not scan.is_op(k - 1, ".", "?."):
            continue
        if scan.is_op(k, ")") and (k not in scan.pair or scan.is_word(scan.pair[k] - 1, "if", "for", "while", "switch", "catch", "with") or scan.pair[k] in found.heads):
            continue
        call, at = _callee(scan, k)
        if call is None or scan.is_word(at - 1, "new", "function"):
            continue
        calls.append((at, -i, call))
    for at, _, call in sorted(calls):
        owner = next((n for n in range(len(spans) - 1, -1, -1) if spans[n][0] <= at <= spans[n][1]), None)
        if owner is None:
            facts.module_calls.append((call, scan.line_of(at)))
        else:
            facts.functions[owner].calls.append((call, scan.line_of(at)))
    facts.hits = _hits(scan, spans)
    _modules(text, facts)
    _rpc(text, facts)
    return facts


def _route(scan: Scan, start: int) -> str | None:
    """``METHOD /path`` of a function passed straight to a router's method."""
    open_ = scan.around[start]
    if open_ < 2 or not scan.is_op(open_, "(") or not scan.is_op(start - 1, "(", ","):
        return None
    method, first = scan.tokens[open_ - 1], scan.tokens[open_ + 1]
    path = first.text.strip("'\"")
    if method.kind == "id" and method.text.lower() in HTTP and scan.is_op(open_ - 2, ".", "?.") and first.kind == "str" and first.text[0] in "'\"" and path.startswith("/"):
        return f"{method.text.upper()} {path}"
    return None


def _hits(scan: Scan, functions: list[tuple[int, int]]) -> list[Hit]:
    loops, switches, out = [], [], []
    for i, t in enumerate(scan.tokens):
        if t.kind != "id" or scan.is_op(i - 1, ".", "?."):
            continue
        if t.text in ("for", "while"):
            waits = scan.is_word(i + 1, "await")
            head = i + 1 + waits
            if not scan.is_op(head, "("):
                continue
            body = scan.end(head) + 1
            if body < len(scan.tokens) and not scan.is_op(body, ";"):
                loops.append(Loop(i, (body, scan.end(body) if scan.is_op(body, "{") else _expression_end(scan, body)), waits))
        elif t.text == "do" and scan.is_op(i + 1, "{"):
            loops.append(Loop(i, (i + 1, scan.end(i + 1)), False))
        elif t.text == "switch" and scan.is_op(i + 1, "(") and scan.is_op(scan.end(i + 1) + 1, "{"):
            body = scan.end(i + 1) + 1
            switches.append((body, scan.end(body)))
    for i, t in enumerate(scan.tokens):
        if t.kind == "id" and t.text == "await" and not scan.is_op(i - 1, ".", "?.") and not scan.is_word(i - 1, "for"):
            loop, stops = standing(scan, i, loops, functions, _ends(scan), {"return", "break", "throw"}, {"return", "throw"}, switches)
            out.append(Hit("await_expression", scan.line_of(i), loop, stops))
    return out


_FROM = r"""\s*from\s*['"]([^'"\n]+)['"]"""
_SPECIFIER = re.compile(r"""\bfrom\s*['"]([^'"\n]+)['"]|\b(?:require|import)\s*\(\s*['"]([^'"\n]+)['"]|\bimport\s*['"]([^'"\n]+)['"]""")
_NAMESPACE = re.compile(r"\bimport\s+(?:type\s+)?\*\s*as\s+([\w$]+)" + _FROM)
_NAMED = re.compile(r"\bimport\s+(?:type\s+)?(?:([\w$]+)\s*,\s*)?\{([^}]*)\}" + _FROM)
_DEFAULT = re.compile(r"\bimport\s+(?:type\s+)?([\w$]+)(?:\s*,\s*\*\s*as\s+[\w$]+)?" + _FROM)
_REEXPORT = re.compile(r"\bexport\s+(?:type\s+)?(?:\*|\{[^}]*\})" + _FROM)
_REEXPORT_AS = re.compile(r"\bexport\s+\*\s*as\s+([\w$]+)" + _FROM)
_PART = re.compile(r"^\s*(?:type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*$")


def _modules(text: str, facts: Facts) -> None:
    facts.specifiers = [m[1] or m[2] or m[3] for m in _SPECIFIER.finditer(text)]
    out: dict[str, Import] = {m[1]: Import(m[1], m[2], "namespace") for m in _NAMESPACE.finditer(text)}
    for m in _NAMED.finditer(text):
        if m[1]:
            out[m[1]] = Import(m[1], m[3], "default")
        for part in m[2].split(","):
            if p := _PART.match(part):
                out[p[2] or p[1]] = Import(p[2] or p[1], m[3], "named", p[1])
    for m in _DEFAULT.finditer(text):
        out.setdefault(m[1], Import(m[1], m[2], "default"))
    facts.imports = list(out.values())
    facts.reexports = [m[1] for m in _REEXPORT.finditer(text)]
    facts.namespace_reexports = [(m[1], m[2]) for m in _REEXPORT_AS.finditer(text)]


_CLIENT = re.compile(r"""((?:\s*\??\.\s*[A-Za-z_$][\w$]*|\s*\[\s*(?:'[^'\n]*'|"[^"\n]*")\s*\])+?)\s*\??\.\s*\$(get|post|put|patch|delete)\s*\(""")
_PIECE = re.compile(r"""\.\s*([A-Za-z_$][\w$]*)|\[\s*['"]([^'"\n]*)['"]\s*\]""")
_MOUNT = re.compile(r"""\.route\(\s*['"]([^'"\n]*)['"]\s*,\s*([A-Za-z_$][\w$]*)""")


def _rpc(text: str, facts: Facts) -> None:
    """Calls of typed clients, ``client.a['b'].$get(``, and routers mounted with ``.route('/p', X)``."""
    for m in _CLIENT.finditer(text):
        parts = [p[1] or p[2] for p in _PIECE.finditer(m[1])]
        facts.rpc_calls.append((m[2].upper(), "/" + "/".join(s for p in parts for s in p.split("/") if s), text.count("\n", 0, m.end(2)) + 1))
    facts.mounts = [(m[1], m[2]) for m in _MOUNT.finditer(text)]
