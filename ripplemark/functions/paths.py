"""Paths as Columns: parts, normal form, languages, and the predicates on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: extensions of each language.
LANGUAGES = {
    "typescript": ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "svelte"),
    "go": ("go",),
    "python": ("py",),
}


def extension(path: Column) -> Column:
    """After the last dot of the last part; empty without one."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """Language of a source path, null for others."""
    ext, out = extension(path), None
    for name, known in LANGUAGES.items():
        out = F.when(ext.isin(*known), name) if out is None else out.when(ext.isin(*known), name)
    return out


def directory(path: Column) -> Column:
    """All before the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Last part without its extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def ancestors(dir_: Column) -> Column:
    """The directory itself and all above it, the root (empty) first."""
    parts = F.filter(F.split(dir_, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def normalised(path: Column) -> Column:
    """Without ``.`` and empty parts; ``..`` takes back the part before it, if there is one."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "") | (p == "."), done)
        .when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(p))),
    )
    return F.array_join(kept, "/")


def under(path: Column, dir_: Column) -> Column:
    """Whether a path lies below a directory, by whole parts; everything lies below the root."""
    return (dir_ == "") | F.startswith(path, F.concat(dir_, F.lit("/")))


def relative_to(path: Column, dir_: Column) -> Column:
    """A path below a directory without it; others unchanged."""
    return F.when((dir_ != "") & under(path, dir_), F.substring(path, F.length(dir_) + 2, F.length(path))).otherwise(path)


def is_test(path: Column) -> Column:
    """Test files as the call graph leaves them out: by directory, infix or a language's naming."""
    return path.rlike(r"\.(spec|test)\.|(^|/)(tests?|__tests__)/|_test\.go$|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$")


def is_test_for_rules(path: Column) -> Column:
    """Test files as the rules leave them out, which is narrower: only directories below the root count."""
    return path.rlike(r"\.(spec|test)\.|/(tests?|__tests__)/")


def is_source(path: Column) -> Column:
    return language(path).isNotNull()


def is_skipped(path: Column) -> Column:
    """Below a directory that listings leave out."""
    return path.rlike(r"(^|/)(vendor|testdata|node_modules|__pycache__|site-packages|\.[^/]+)/")


def is_migration(path: Column) -> Column:
    """SQL that goes forward, in a directory whose name begins with migration (or is such a file's own name)."""
    return path.rlike(r"\.sql$") & ~path.rlike(r"\.down\.sql$") & path.rlike(r"(?i)(^|/)migration")


def segments(url_path: Column) -> Column:
    """Parts of a route without empty ones."""
    return F.filter(F.split(url_path, "/"), lambda p: p != "")
