"""What a source file says: functions, calls, imports, and the syntax that rules ask for.

Scanners run in Python workers, a file at a time; they tolerate broken code.
"""

from __future__ import annotations

from ripplemark.functions.extract.facts import Facts


def extract(path: str, text: str) -> Facts:
    """Facts of a file by its extension; none for other files."""
    from ripplemark.functions.extract import go, python, typescript

    ext = path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    if ext == "py":
        return python.extract(text)
    if ext == "go":
        return go.extract(text)
    if ext in ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "svelte"):
        return typescript.extract(text, path)
    return Facts()
