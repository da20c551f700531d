"""SQL texts: comments, statements, the forward half of a migration."""

from __future__ import annotations

import re

_PIECE = re.compile(r"'[^']*(?:'|\Z)|--[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_DOLLAR = re.compile(r"\$\w*\$")
_DOWN = re.compile(r"(?im)^\s*--\s*(?:migrate:down|\+migrate\s+down|\+goose\s+down|down\s+migration)\b")


def without_comments(text: str) -> str:
    """Comments as blanks, line breaks kept; quoted text is left alone."""
    blank = lambda m: m[0] if m[0][0] == "'" else re.sub(r"[^\n]", " ", m[0])
    return _PIECE.sub(blank, text)


def forward_half(text: str) -> str:
    """Everything before the line that marks the way down."""
    kept = []
    for line in text.splitlines():
        if _DOWN.match(line):
            break
        kept.append(line)
    return "".join(f"{x}\n" for x in kept)


def statements(text: str) -> list[tuple[int, str]]:
    """(first line, statement) each; semicolons in quotes and in ``$tag$`` bodies end nothing."""
    text = without_comments(text)
    out, begin, at = [], 0, 0

    def close(end: int) -> None:
        part = text[begin:end]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((text.count("\n", 0, begin + lead) + 1, part.strip()))

    while at < len(text):
        c = text[at]
        if c == "'":
            end = text.find("'", at + 1)
            at = len(text) if end < 0 else end + 1
        elif c == "$" and (m := _DOLLAR.match(text, at)):
            end = text.find(m[0], m.end())
            at = len(text) if end < 0 else end + len(m[0])
        elif c == ";":
            close(at)
            at += 1
            begin = at
        else:
            at += 1
    close(len(text))
    return out
