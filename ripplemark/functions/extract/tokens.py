"""Tokens, brackets and statements of brace languages; a scan that any text survives."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}$"}, {")", "]", "}", "}$"}
_WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|#[^\W\d][\w$]*|@(?=\w)")
_NUMBER = re.compile(r"\.?\d[\w.]*")
_OPS = re.compile(r"=>|\?\.|\.\.\.|:=|<-|\*\*=?|&&=?|\|\|=?|\?\?=?|[=!]==?|<<=?|>>>?=?|[+\-*/%&|^<>]=|\+\+|--|.", re.S)
#: Fixed: words after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


@dataclass
class Token:
    kind: str  # id, num, str, op
    text: str
    start: int
    end: int


class Scan:
    """Tokens of a source, the bracket that matches each bracket, and where comments are."""

    def __init__(self, text: str, script: bool):
        self.text, self.script = text, script
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int]] = []
        self._breaks = [m.start() for m in re.finditer("\n", text)]
        self._read()
        self.pair: dict[int, int] = {}
        self.around: list[int] = []  # of each token, the innermost open bracket before it, or -1
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in CLOSE:
                at = next((k for k in range(len(stack) - 1, -1, -1) if OPEN[self.tokens[stack[k]].text] == t.text), None)
                if at is not None:
                    self.pair[stack[at]], self.pair[i] = i, stack[at]
                    del stack[at:]
            self.around.append(stack[-1] if stack else -1)
            if t.kind == "op" and t.text in OPEN:
                stack.append(i)

    def line(self, offset: int) -> int:
        return bisect_right(self._breaks, offset - 1) + 1

    def line_of(self, i: int) -> int:
        return self.line(self.tokens[i].start)

    def is_op(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "op" and self.tokens[i].text in texts

    def is_word(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "id" and (not texts or self.tokens[i].text in texts)

    def same_line(self, i: int, j: int) -> bool:
        return "\n" not in self.text[self.tokens[i].end : self.tokens[j].start]

    def end(self, i: int) -> int:
        """Closing bracket of an opening one; the last token where it is missing."""
        return self.pair.get(i, len(self.tokens) - 1)

    def code(self, a: int, z: int) -> str:
        """Source of tokens a to z without comments."""
        start, stop, out = self.tokens[a].start, self.tokens[z].end, []
        for x, y in self.comments:
            if x >= start and y <= stop:
                out.append(self.text[start:x])
                start = y
        return "".join([*out, self.text[start:stop]])

    def _read(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        templates: list[int] = []  # depth of braces at which a template goes on
        depth = 0
        while at < n:
            c = text[at]
            if c.isspace():
                at += 1
                continue
            if text.startswith("//", at) or text.startswith("/*", at):
                end = text.find("\n" if text[at + 1] == "/" else "*/", at + 2)
                end = n if end < 0 else end if text[at + 1] == "/" else end + 2
                self.comments.append((at, end))
                at = end
                continue
            if c == "`" and not self.script:
                end = text.find("`", at + 1)
                end = n if end < 0 else end + 1
                self.tokens.append(Token("str", text[at:end], at, end))
                at = end
                continue
            if c == "`":
                at = self._template(at, at + 1)
                if self.tokens[-1].text == "${":
                    templates.append(depth)
                continue
            if c in "'\"":
                end = at + 1
                while end < n and text[end] != c and text[end] != "\n":
                    end += 2 if text[end] == "\\" else 1
                if end < n and text[end] == c:
                    self.tokens.append(Token("str", text[at : end + 1], at, end + 1))
                    at = end + 1
                else:  # an apostrophe in markup or the like
                    self.tokens.append(Token("op", c, at, at + 1))
                    at += 1
                continue
            if self.script and c == "/" and self._regex_may_start():
                if m := re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(text, at):
                    self.tokens.append(Token("str", m[0], at, m.end()))
                    at = m.end()
                    continue
            if m := _WORD.match(text, at):
                self.tokens.append(Token("op" if m[0] == "@" else "id", m[0], at, m.end()))
                at = m.end()
                continue
            if m := _NUMBER.match(text, at):
                self.tokens.append(Token("num", m[0], at, m.end()))
                at = m.end()
                continue
            if c == "}" and templates and templates[-1] == depth:
                templates.pop()
                self.tokens.append(Token("op", "}$", at, at + 1))
                at = self._template(at + 1, at + 1)
                if self.tokens[-1].text == "${":
                    templates.append(depth)
                continue
            depth += (c == "{") - (c == "}")
            op = _OPS.match(text, at)[0]
            self.tokens.append(Token("op", op, at, at + len(op)))
            at += len(op)

    def _template(self, start: int, at: int) -> int:
        """Reads template text up to its end or to an expression in it."""
        text, n = self.text, len(self.text)
        while at < n:
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                self.tokens.append(Token("str", text[start : at + 1], start, at + 1))
                return at + 1
            elif text.startswith("${", at):
                self.tokens.append(Token("str", text[start:at], start, at))
                self.tokens.append(Token("op", "${", at, at + 2))
                return at + 2
            else:
                at += 1
        self.tokens.append(Token("str", text[start:n], start, n))
        return n

    def _regex_may_start(self) -> bool:
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.kind == "id":
            return last.text in _BEFORE_REGEX
        return last.kind == "op" and last.text not in (")", "]", "}", "}$", "<")


@dataclass
class Loop:
    start: int  # first token of the loop
    body: tuple[int, int]  # first and last token of its body, brackets included
    waits: bool  # each turn waits by itself


def statement_starts(scan: Scan, lo: int, hi: int, ends) -> list[int]:
    """First tokens of the statements between two tokens, both excluded; ``ends(a, b)`` says whether a line
    break between two tokens ends a statement."""
    out, i, fresh = [], lo + 1, True
    while i < hi:
        if scan.is_op(i, ";"):
            fresh, i = True, i + 1
            continue
        if fresh:
            out.append(i)
            fresh = False
        last = i
        if scan.tokens[i].kind == "op" and scan.tokens[i].text in OPEN:
            last = min(scan.end(i), hi)
        nxt = last + 1
        if nxt < hi and not scan.same_line(last, nxt) and ends(last, nxt):
            fresh = True
        i = nxt
    return out


def standing(scan: Scan, at: int, loops: list[Loop], functions: list[tuple[int, int]], ends, exits: set[str], returns: set[str], switches: list[tuple[int, int]]) -> tuple[bool, bool]:
    """Whether what is at a token runs once per turn of a loop, and whether that loop can stop early.

    ``functions`` and ``switches`` are token spans, ``exits`` words that leave a block, ``returns`` those of
    them that leave the function.
    """
    inside = [f for f in functions if f[0] < at <= f[1]]
    own = max(inside, default=(-1, len(scan.tokens)))
    held = [x for x in loops if own[0] < x.start and x.body[0] <= at <= x.body[1]]
    if not held:
        return False, False
    loop = max(held, key=lambda x: x.start)
    if loop.waits or _on_the_way_out(scan, at, loop, ends, exits, returns):
        return False, False
    nested = [f for f in functions if loop.body[0] <= f[0] and f[1] <= loop.body[1] and f != own]
    inner = [x.body for x in loops if loop.body[0] <= x.start and x.body[1] <= loop.body[1] and x is not loop] + [s for s in switches if loop.body[0] <= s[0] and s[1] <= loop.body[1]]
    within = lambda i, spans: any(a <= i <= z for a, z in spans)
    for i in range(loop.body[0], loop.body[1] + 1):
        if not scan.is_word(i) or scan.is_op(i - 1, ".", "?.") or within(i, nested):
            continue
        if scan.tokens[i].text in returns or scan.tokens[i].text == "break" and not within(i, inner):
            return True, True
    return True, False


def _on_the_way_out(scan: Scan, at: int, loop: Loop, ends, exits: set[str], returns: set[str]) -> bool:
    """In a statement that leaves, or right before one in the same block, up to the loop's body."""
    block = scan.around[at]
    while block >= 0:
        if scan.is_op(block, "{"):
            starts = statement_starts(scan, block, scan.end(block), ends)
            k = bisect_right(starts, at) - 1
            # ``if (x) return await y`` leaves too, without a block of its own
            if k >= 0 and any(scan.is_word(i, *returns) and scan.around[i] == block for i in range(starts[k], at)):
                return True
            if 0 <= k + 1 < len(starts) and scan.is_word(starts[k + 1], *exits):
                return True
        if block <= loop.body[0]:
            return False
        at, block = block, scan.around[block]
    return False
