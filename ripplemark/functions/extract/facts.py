"""Rows that scanners produce."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field


@dataclass
class Function:
    parent: int | None
    name: str | None
    exported: bool
    method: bool
    start_line: int
    end_line: int
    body_hash: str
    route: str | None = None
    calls: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class Import:
    """A local name and what it stands for: a whole module (``namespace``), its ``default``, or a ``named`` part."""

    local: str | None
    specifier: str
    kind: str
    imported: str | None = None


@dataclass
class Hit:
    """A syntax node that rules may ask for, and how it stands to a loop."""

    query: str
    line: int
    loop: bool
    stops_early: bool


@dataclass
class Facts:
    functions: list[Function] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    specifiers: list[str] = field(default_factory=list)
    reexports: list[str] = field(default_factory=list)
    namespace_reexports: list[tuple[str, str]] = field(default_factory=list)
    module_calls: list[tuple[str, int]] = field(default_factory=list)
    hits: list[Hit] = field(default_factory=list)
    interfaces: list[tuple[str, str]] = field(default_factory=list)
    methods: list[tuple[str, str]] = field(default_factory=list)
    rpc_calls: list[tuple[str, str, int]] = field(default_factory=list)
    mounts: list[tuple[str, str]] = field(default_factory=list)


def fingerprint(code: str) -> str:
    """Hash of code without comments, blanks aside (vertical tab is not one)."""
    return hashlib.md5(code.translate(_NO_BLANKS).encode()).hexdigest()


_NO_BLANKS = dict.fromkeys(map(ord, " \t\n\f\r"))
