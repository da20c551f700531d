"""Names and texts of code as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that a body's fingerprint ignores; vertical tab is not among them.
BLANKS = r"[ \t\n\f\r]"


def body_hash(code: Column) -> Column:
    """Fingerprint of code whose comments are gone already."""
    return F.md5(F.regexp_replace(code, BLANKS, ""))


def label(name: Column, start_line: Column) -> Column:
    """What a function is called: its name, or its line where it has none."""
    return F.coalesce(name, F.concat(F.lit("anon@"), start_line.cast("string")))


def node_id(path: Column, label_: Column) -> Column:
    return F.concat(path, F.lit("::"), label_)


def external_id(package: Column, call: Column) -> Column:
    return F.concat(F.lit("pkg::"), package, F.lit("::"), call)


def module_label(line: Column) -> Column:
    """A reference outside any function."""
    return F.concat(F.lit("module@"), line.cast("string"))


def short_name(label_: Column) -> Column:
    """Last dotted part."""
    return F.substring_index(label_, ".", -1)


def call_matches(call: Column, label_: Column) -> Column:
    """A call text that names a label: the label, or anything dot the label."""
    return (call == label_) | F.endswith(call, F.concat(F.lit("."), label_))


def js_package(specifier: Column) -> Column:
    """External package of an import: two parts if scoped, else one; null for relative ones."""
    parts = F.split(specifier, "/")
    n = F.when(F.startswith(specifier, F.lit("@")), 2).otherwise(1)
    return F.when(~F.startswith(specifier, F.lit(".")), F.array_join(F.slice(parts, 1, n), "/"))


def python_package(module: Column) -> Column:
    return F.when(~F.startswith(module, F.lit(".")), F.substring_index(module, ".", 1))


def forward_half(sql: Column) -> Column:
    """A migration up to the line that marks the way down."""
    down = r"(?im)^\s*--\s*(?:migrate:down|\+migrate\s+down|\+goose\s+down|down\s+migration)\b"
    at = F.regexp_instr(sql, F.lit(down))
    return F.when(at > 0, F.substring(sql, F.lit(1), at - 1)).otherwise(sql)


def target_table(statement: Column) -> Column:
    """Lower-case table that a definition is about: the word after TABLE and what may stand between."""
    word = F.regexp_extract(statement, r"(?is)(?:^|\s)table\s+(?:(?:if|not|exists|only)\s+)*(\S+)", 1)
    return F.when(word != "", F.lower(F.regexp_replace(word, r'^["(]+|["(]+$', "")))


def excerpt(line: Column, most: int = 90) -> Column:
    """A trimmed line, cut with an ellipsis."""
    text = F.trim(line)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def human_size(n: Column) -> Column:
    """Bytes for people."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.concat(F.format_number(n / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return out
