"""Line differences by the greedy shortest-edit algorithm, and unified diffs."""

from __future__ import annotations

import hashlib
import re


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines of a longest common subsequence, in order. Linear space: it is found around the
    middle of a shortest edit path, for the parts before and after in turn."""
    ids: dict[str, int] = {}
    x = [ids.setdefault(s, len(ids)) for s in a]
    y = [ids.setdefault(s, len(ids)) for s in b]
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1 and (cut := _middle(x, y, a0, a1, b0, b1)):
            todo += [(a0, cut[0], b0, cut[1]), (cut[0], a1, cut[1], b1)]
    return sorted(out)


def _middle(x, y, a0, a1, b0, b1) -> tuple[int, int] | None:
    """A point that a shortest edit path passes, searched from both ends; None where nothing is equal."""
    n, m = a1 - a0, b1 - b0
    delta, most = n - m, (n + m + 1) // 2
    fore, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            i = fore[k + 1] if k == -d or k != d and fore[k - 1] < fore[k + 1] else fore[k - 1] + 1
            j = i - k
            while i < n and j < m and x[a0 + i] == y[b0 + j]:
                i, j = i + 1, j + 1
            fore[k] = i
            if delta % 2 and -(d - 1) <= k - delta <= d - 1 and i + back[delta - k] >= n:
                return _inside(a0 + i, b0 + j, a0, a1, b0, b1)
        for k in range(-d, d + 1, 2):
            i = back[k + 1] if k == -d or k != d and back[k - 1] < back[k + 1] else back[k - 1] + 1
            j = i - k
            while i < n and j < m and x[a1 - 1 - i] == y[b1 - 1 - j]:
                i, j = i + 1, j + 1
            back[k] = i
            if delta % 2 == 0 and -d <= delta - k <= d and i + fore[delta - k] >= n:
                return _inside(a1 - i, b1 - j, a0, a1, b0, b1)
    return None


def _inside(i, j, a0, a1, b0, b1) -> tuple[int, int] | None:
    """The point, if cutting there leaves two smaller parts."""
    return None if (i, j) in ((a0, b0), (a1, b1)) or not (a0 <= i <= a1 and b0 <= j <= b1) else (i, j)


def added_lines(base: str | None, head: str) -> list[int]:
    """Numbers of the head's lines that no line of the base stands for."""
    a, b = (base or "").splitlines(), head.splitlines()
    kept = {j for _, j in matches(a, b)}
    return [j + 1 for j in range(len(b)) if j not in kept]


def rows(base: str | None, head: str | None) -> list[tuple[str, int | None, int | None, str]]:
    """Both texts in one: (mark, line in base, line in head, text), removed lines before added ones."""
    a, b = (base or "").splitlines(), (head or "").splitlines()
    out, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        out += [("-", n + 1, None, a[n]) for n in range(i, x)]
        out += [("+", None, n + 1, b[n]) for n in range(j, y)]
        if x < len(a):
            out.append((" ", x + 1, y + 1, a[x]))
        i, j = x + 1, y + 1
    return out


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def unified(diff: str) -> list[dict]:
    """Hunks of a unified diff of many files: path, ord, start, changed, content, key.

    The key is the hash of the changed lines, and from the second time on a file has the same, which time.
    """
    out: list[dict] = []
    path, times = None, {}
    for line in diff.split("\n"):
        if line.startswith("diff --git "):
            path, times = None, {}
        elif line.startswith("+++ "):
            path = path if line[4:] == "/dev/null" else re.sub(r"^b/", "", line[4:].rstrip("\t"))
        elif line.startswith("--- "):
            path = None if line[4:] == "/dev/null" else re.sub(r"^a/", "", line[4:].rstrip("\t"))
        elif m := _HUNK.match(line):
            out.append({"path": path, "ord": len(out), "start": int(m[3]), "changed": 0, "content": ""})
        elif out and out[-1]["path"] == path and line[:1] in ("+", "-"):
            out[-1]["changed"] += 1
            out[-1]["content"] += line + "\n"
    seen: dict[tuple, int] = {}
    for h in out:
        digest = hashlib.md5(h["content"].encode()).hexdigest()
        n = seen.get((h["path"], digest), 0)
        seen[h["path"], digest] = n + 1
        h["key"] = digest + (f"#{n}" if n else "")
    return out
