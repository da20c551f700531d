"""Go files, by a tolerant scan."""

from __future__ import annotations

import re

from ripplemark.functions.extract.facts import Facts, Function, Hit, Import, fingerprint
from ripplemark.functions.extract.tokens import Loop, Scan, standing

#: Fixed: functions of routers, in lower case, and the method they stand for.
ROUTES = {
    "get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "head": "HEAD",
    "options": "OPTIONS", "handlefunc": "ANY", "handle": "ANY",
}
_KEYWORDS = {
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if",
    "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var",
}


def _ends(scan: Scan):
    """Whether a line break after a token ends the statement."""

    def ends(a: int, _: int) -> bool:
        t = scan.tokens[a]
        if t.kind in ("num", "str"):
            return True
        if t.kind == "id":
            return t.text not in _KEYWORDS or t.text in ("break", "continue", "fallthrough", "return")
        return t.text in (")", "]", "}", "++", "--")

    return ends


def _signature(scan: Scan, i: int) -> int | None:
    """Body's opening brace of the function whose parameters open at i; None for a type."""
    if not scan.is_op(i, "("):
        return None
    i = scan.end(i) + 1
    if scan.is_op(i, "("):  # results
        i = scan.end(i) + 1
        return i if scan.is_op(i, "{") else None
    while i < len(scan.tokens):
        t = scan.tokens[i]
        if t.kind == "op" and t.text == "{":
            return i
        if t.kind == "id" and t.text in ("interface", "struct") and scan.is_op(i + 1, "{"):
            i = scan.end(i + 1) + 1
        elif t.kind == "id" and t.text == "func":
            i = scan.end(i + 1) + 1 if scan.is_op(i + 1, "(") else i + 1
        elif t.kind == "op" and t.text in ("[", "("):
            i = scan.end(i) + 1
        elif t.kind == "id" and t.text not in _KEYWORDS | {"map"} or t.text in ("*", ".", "<-", "chan", "map"):
            if not scan.same_line(i - 1, i):
                return None
            i += 1
        else:
            return None
    return None


def _receiver(scan: Scan, i: int) -> str | None:
    """Type of a receiver whose parenthesis opens at i."""
    end, last = scan.end(i), None
    for k in range(i + 1, end):
        if scan.is_op(k, "["):
            break
        if scan.is_word(k):
            last = scan.tokens[k].text
    return last


def _before(scan: Scan, i: int) -> tuple[str | None, int]:
    """Text of the expression that ends at i, and where it starts; null for what has no name."""
    t = scan.tokens[i]
    if t.kind == "id" and t.text not in _KEYWORDS:
        if scan.is_op(i - 1, ".") and i >= 2:
            owner, at = _before(scan, i - 2)
            return (owner and f"{owner}.{t.text}"), at
        return t.text, i
    if scan.is_op(i, ")") and i in scan.pair:
        a = scan.pair[i]
        if a and (scan.is_word(a - 1) and scan.tokens[a - 1].text not in _KEYWORDS or scan.is_op(a - 1, ")", "]", "}")):
            f, at = _before(scan, a - 1)
            return (f and f"{f}(...)"), at
        inner, at = _before(scan, i - 1) if i - 1 > a else (None, a)
        return (inner if at == a + 1 else None), a
    if scan.is_op(i, "]") and i in scan.pair and scan.pair[i] > 0:
        return _before(scan, scan.pair[i] - 1)
    return None, i


def extract(text: str) -> Facts:
    scan, facts = Scan(text, script=False), Facts()
    tokens = scan.tokens
    spans: list[tuple[int, int]] = []
    for i, t in enumerate(tokens):
        if not (t.kind == "id" and t.text == "func"):
            continue
        k, receiver, name, top = i + 1, None, None, scan.around[i] < 0
        if top and scan.is_op(k, "(") and scan.is_word(scan.end(k) + 1) and scan.is_op(scan.end(k) + 2, "(", "["):
            receiver, k = _receiver(scan, k), scan.end(k) + 1
        if top and scan.is_word(k):
            name, k = tokens[k].text, k + 1
            if scan.is_op(k, "["):
                k = scan.end(k) + 1
        elif scan.is_op(i - 1, "]"):
            continue  # an element's type
        body = _signature(scan, k)
        if body is None:
            continue
        end = scan.end(body)
        if receiver and name:
            facts.methods.append((receiver, name))
        label = f"{receiver}.{name}" if receiver and name else name
        route = _route(scan, i) if name is None else None
        parent = next((n for n in range(len(spans) - 1, -1, -1) if spans[n][0] < i <= spans[n][1]), None)
        facts.functions.append(
            Function(parent, label, bool(name) and name[:1].isupper(), receiver is not None, scan.line_of(i), scan.line_of(end), fingerprint(scan.code(i, end)), route)
        )
        spans.append((i, end))
    found = []
    for i in range(1, len(tokens)):
        if not scan.is_op(i, "(") or not (scan.is_word(i - 1) or scan.is_op(i - 1, ")", "]")):
            continue
        owner = next((n for n in range(len(spans) - 1, -1, -1) if spans[n][0] < i <= spans[n][1]), None)
        call, at = _before(scan, i - 1)
        if owner is None or call is None or scan.is_word(at - 1, "func") or scan.is_op(at - 1, "]") and not scan.is_op(i - 1, "]"):
            continue
        if at <= spans[owner][0] + 1 or scan.is_op(at - 1, ")") and scan.is_word(scan.pair.get(at - 1, 0) - 1, "func"):
            continue
        found.append((at, -i, owner, call))
    for at, _, owner, call in sorted(found):
        facts.functions[owner].calls.append((call, scan.line_of(at)))
    loops = []
    for i, t in enumerate(tokens):
        if t.kind == "id" and t.text == "for":
            body = next((k for k in range(i + 1, len(tokens)) if scan.is_op(k, "{") and scan.around[k] == scan.around[i] and not scan.is_word(k - 1, "struct", "interface") and not scan.is_op(k - 1, "]")), None)
            if body is not None:
                loops.append(Loop(i, (body, scan.end(body)), False))
    switches = []
    for i, t in enumerate(tokens):
        if t.kind == "id" and t.text in ("switch", "select"):
            body = next((k for k in range(i + 1, len(tokens)) if scan.is_op(k, "{") and scan.around[k] == scan.around[i]), None)
            if body is not None:
                switches.append((body, scan.end(body)))
    for i, t in enumerate(tokens):
        if t.kind == "id" and t.text == "defer":
            loop, stops = standing(scan, i, loops, spans, _ends(scan), {"return", "break"}, {"return"}, switches)
            facts.hits.append(Hit("defer_statement", scan.line_of(i), loop, stops))
        if t.kind == "id" and t.text == "interface" and scan.is_op(i + 1, "{") and scan.is_word(i - 1) and (scan.is_word(i - 2, "type") or scan.is_op(i - 2, "(")):
            for k in range(i + 2, scan.end(i + 1)):
                if scan.is_word(k) and scan.is_op(k + 1, "(") and scan.around[k] == i + 1:
                    facts.interfaces.append((tokens[i - 1].text, tokens[k].text))
    facts.imports = _imports(text)
    facts.specifiers = [x.specifier for x in facts.imports]
    return facts


def _route(scan: Scan, i: int) -> str | None:
    """``METHOD /path`` of a literal handed straight to a router."""
    open_ = scan.around[i]
    if open_ < 1 or not scan.is_op(open_, "(") or not scan.is_op(i - 1, "(", ","):
        return None
    method, first = scan.tokens[open_ - 1], scan.tokens[open_ + 1]
    verb = ROUTES.get(method.text.lower()) if method.kind == "id" else None
    path = first.text.strip('"`')
    return f"{verb} {path}" if verb and first.kind == "str" and path.startswith("/") else None


def default_name(path: str) -> str:
    """What an import goes by: its last part, versions and a leading ``go-`` aside."""
    parts = path.split("/")
    last = parts[-2] if len(parts) > 1 and re.fullmatch(r"v\d+", parts[-1]) else parts[-1]
    return re.sub(r"^(go-)+", "", re.sub(r"\.v\d+$", "", last)).replace("-", "_")


def _imports(text: str) -> list[Import]:
    """Import lines, single or in a block, up to the first declaration."""
    out = []
    head = re.split(r"(?m)^\s*(?:func|type|var)\s", text, maxsplit=1)[0]
    head = re.sub(r"//[^\n]*", "", head)
    for block in re.finditer(r'(?m)^\s*import\s*(?:\(([^)]*)\)|((?:[\w.]+\s+)?["`][^"`\n]*["`]))', head):
        for m in re.finditer(r'(?:^|[\n;]|(?<=\())\s*(?:([\w.]+)\s+)?["`]([^"`\n]*)["`]', "\n" + (block[1] if block[1] is not None else block[2])):
            local = m[1] or default_name(m[2])
            out.append(Import(None if local in ("_", ".") else local, m[2], "namespace"))
    return out


def module_path(go_mod: str) -> str | None:
    m = re.search(r'(?m)^\s*module\s+"?([^\s"]+)', go_mod)
    return m and m[1]
