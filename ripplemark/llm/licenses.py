"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory. DataFrame functions only.

Units of comparison are the lines and the paragraphs of every text, and the
whole text of a licence file. A paragraph ends at a line without letters and
digits, so the wrapped header of a comment is one. A term's document frequency
is counted over all documents. The templates are few and fixed, so their vectors
sit in the plan. Units that lack the rarest term that a template needs (or, of a
template that needs none, all terms that carry its weight) cannot match and are
left out before they are cut into terms, which loses none. A unit is compared in its
own row: only its best template goes on.

The cosine cannot tell versions and relatives of a licence apart. So a template
names terms that a unit must have beside it, as the number of the version, and
terms that it must not have.

A file takes the licence it states itself. Others take the one of the licence
file in the nearest directory above them: every directory is resolved once
against its ancestors, and files join the directory they are in.
"""

from __future__ import annotations

import json
import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import saved
from .words import ascii_lower, between

class Template(NamedTuple):
    """A notice: terms that a unit needs and refuses, and what outranks others of the same text, whatever their cosines."""

    license: str
    text: str
    needs: tuple[str, ...] = ()
    refuses: tuple[str, ...] = ()
    rank: int = 0


def _gnu(name: str, title: str, version: str, date: str, subject: str, needs: tuple[str, ...], refuses: tuple[str, ...]) -> list[Template]:
    """The notices of a GNU licence: a short one, that of a file, and the licence's title."""
    texts = (
        f"This work is licensed under the {title}, version {version}.",
        f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"{title} Version {version}, {date} Copyright Free Software Foundation, Inc. Everyone is permitted to copy and distribute "
        "verbatim copies of this license document, but changing it is not allowed.",
        f"{title} Version {version}, {date}",
    )
    return [Template(name, t, ("gnu", *needs), refuses) for t in texts]


_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: Fixed texts of notices, as their owners word them.
_NOTICES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2")),
    Template(
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache", "2"),
    ),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", ("apache", "2")),
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("MIT", "The MIT License (MIT)", ("mit",)),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
        ("free", "charge"),
    ),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
        ("free", "charge"),
    ),
    *_gnu("GPL-2.0", "GNU General Public License", "2", "June 1991", "program", ("2",), ("lesser", "library", "affero")),
    *_gnu("GPL-3.0", "GNU General Public License", "3", "29 June 2007", "program", ("3",), ("lesser", "library", "affero")),
    *_gnu("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999", "library", ("lesser", "2", "1"), ("affero",)),
    *_gnu("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007", "library", ("lesser", "3"), ("affero",)),
    *_gnu("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007", "program", ("affero", "3"), ("lesser",)),
    Template("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3.", ("lesser", "3")),
    Template("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3.", ("affero", "3")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2")),
    Template("MPL-2.0", "Mozilla Public License Version 2.0", ("mozilla", "2")),
    Template("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ("bsd",)),
    Template("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution", "binary")),
    Template(
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        ("redistribution", "binary"),
    ),
    Template(
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
        ("endorse", "neither"),
        rank=1,  # what makes three clauses of two
    ),
    Template("ISC", f"{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies.", ("fee", "provided")),
    Template("0BSD", f"{_PERMISSION}.", ("fee",), ("provided",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "nc", "4")),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("attribution", "4"), ("noncommercial", "sharealike", "noderivatives")),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("sharealike", "4"), ("noncommercial",)),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("noncommercial", "4"), ("sharealike", "noderivatives")),
    Template("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal.", ("cc0",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered",)),
    Template("LicenseRef-proprietary", "All rights reserved.", ("all", "rights", "reserved")),
)


def _identifiers(names: list[str]) -> list[Template]:
    """The one-line notice that names a licence by its identifier."""
    return [Template(n, f"SPDX-License-Identifier: {n}", ("spdx", *re.findall(r"[a-z0-9]+", n.lower()))) for n in names if "Ref" not in n]


TEMPLATES = (*_NOTICES, *_identifiers(sorted({t.license for t in _NOTICES})))
LEAST = 0.7
_TERM, _NO_TERM = r"[a-z0-9]+", r"[^a-z0-9]+"
#: Name of a licence file.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
#: What ends a paragraph: a line without letters and digits.
_GAP = r"\n[^A-Za-z0-9\n]*\n"


def _terms(text: Column) -> Column:
    return between(ascii_lower(text), _NO_TERM)


class Vectors:
    """Unit vectors of the templates under an inverse document frequency."""

    def __init__(self, templates: tuple[Template, ...], seen: dict[str, int], n_docs: int, least: float):
        counts = [_count(t.text) for t in templates]
        terms = sorted({t for c in counts for t in c} | {t for x in templates for t in (*x.needs, *x.refuses)})
        self.idf = {t: math.log((1 + n_docs) / (1 + seen.get(t, 0))) + 1 for t in terms}
        #: of a term that no template has; as that of a term no document has
        self.unknown = math.log(1 + n_docs) + 1
        self.templates, self.strong = [], set()
        for template, c in zip(templates, counts, strict=True):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            weights = {t: n * self.idf[t] / norm for t, n in c.items()}
            self.templates.append(
                {
                    "license": template.license,
                    "rank": template.rank,
                    "needs": template.needs,
                    "refuses": template.refuses,
                    "weights": [{"term": t, "w": w * self.idf[t]} for t, w in weights.items()],  # for a term's bare count
                }
            )
            if template.needs:  # a unit has all of them, so it has the rarest
                self.strong.add(min(template.needs, key=lambda t: (seen.get(t, 0), t)))
                continue
            # with only the lightest terms the cosine stays below `least`
            spent = 0.0
            for t, w in sorted(weights.items(), key=lambda x: x[1]):
                spent += w * w
                if spent >= least * least * (1 - 1e-9):
                    self.strong.add(t)


def _count(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for t in re.findall(_TERM, text.lower()):
        found[t] = found.get(t, 0) + 1
    return found


def vectors(docs: DataFrame, text_col: str, templates: tuple[Template, ...], least: float) -> Vectors:
    """Document frequencies of the templates' terms over all of ``docs``: one pass, a row per term back."""
    vocabulary = sorted({t for x in templates for t in (*_count(x.text), *x.needs, *x.refuses)})
    held = F.array_intersect(F.array_distinct(_terms(F.coalesce(F.col(text_col), F.lit("")))), F.array(*map(F.lit, vocabulary)))
    marked = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("term"))  # the empty term counts documents
    seen = {r["term"]: r["n"] for r in marked.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Vectors(templates, seen, seen.pop("", 0), least)


_TEMPLATES = "array<struct<license:string,rank:int,needs:array<string>,refuses:array<string>,weights:array<struct<term:string,w:double>>>>"


def matches(units: DataFrame, found: Vectors, least: float) -> DataFrame:
    """``units`` with ``_best`` (rank, c, license, cosine) instead of ``_line``: its best template by rank, cosine, then name, or null.

    A unit's vector is made and compared in its own row, so no term is shuffled. Squares over all its terms
    come from one walk over them in order; terms of no template count in the norm alone.
    """
    every = F.from_json(F.lit(json.dumps(found.templates)), _TEMPLATES)  # folded into a literal, as are the others
    idf = F.from_json(F.lit(json.dumps(found.idf)), "map<string,double>")
    known = F.array(*map(F.lit, found.idf))
    held = F.array_intersect("_terms", known)

    def fits(t: Column) -> Column:
        return (F.size(F.array_except(t["needs"], "_held")) == 0) & ~F.arrays_overlap(t["refuses"], "_held")

    def step(acc: Column, term: Column) -> Column:
        run = F.when(term == acc["last"], acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        # the squares of 1, 2, 3, ... are sums of the first odd numbers
        return F.struct(term.alias("last"), run.alias("run"), (acc["squares"] + 2 * run - 1).alias("squares"))

    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("squares"))
    squares = F.aggregate(F.array_sort("_terms"), start, step, lambda acc: acc["squares"])
    mine = F.filter("_terms", lambda t: F.array_contains("_held", t))
    counts = F.transform("_held", lambda t: F.struct(t.alias("term"), F.size(F.filter("_mine", lambda m: m == t)).cast("double").alias("tf")))
    zero = F.lit(0.0)
    others = F.aggregate("_tf", F.col("_squares").cast("double"), lambda a, x: a - x["tf"] * x["tf"])
    norm = F.sqrt(
        F.lit(found.unknown * found.unknown) * others
        + F.aggregate("_tf", zero, lambda a, x: a + F.pow(x["tf"] * F.element_at(idf, x["term"]), F.lit(2.0)))
    )
    tf = F.map_from_entries("_tf")

    def compared(t: Column) -> Column:
        dot = F.aggregate(t["weights"], zero, lambda a, w: a + w["w"] * F.coalesce(F.element_at(tf, w["term"]), zero))
        cosine = dot / norm
        return F.struct(t["rank"].alias("rank"), F.round(cosine, 9).alias("c"), t["license"].alias("license"), cosine.alias("cosine"))

    # a column exploded from an array of one stays a column of its own: plain ones would be computed again where they are used
    kept = units.columns[:-1]
    rows = units.select(*kept, F.explode(F.array(_terms(F.col("_line")))).alias("_terms"))
    rows = rows.select("*", F.explode(F.array(held)).alias("_held"))
    rows = rows.select("*", F.explode(F.array(F.filter(every, fits))).alias("_fit"))
    some = F.size("_fit") > 0
    rows = rows.select(*kept, "_held", "_fit", F.explode(F.array(F.struct(F.when(some, mine).alias("m"), F.when(some, squares).alias("s")))).alias("_v"))
    rows = rows.select(*kept, "_held", "_fit", F.col("_v.m").alias("_mine"), F.col("_v.s").alias("_squares"))
    rows = rows.select(*kept, "_fit", "_squares", F.explode(F.array(F.when(some, counts))).alias("_tf"))
    best = F.array_max(F.filter(F.transform("_fit", compared), lambda b: b["cosine"] >= least))
    return rows.select(*kept, F.when(some, best).alias("_best"))


def _directory(path: Column) -> Column:
    """All before the last slash; the root is the empty text."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(
    docs: DataFrame,
    *,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    least: float = LEAST,
) -> DataFrame:
    """One row per row of ``docs``: id, path, license, cosine, origin, from_directory.

    ``origin`` is ``own``, ``inherited`` or ``none``; cosine is that of the
    notice itself, of the licence file for inherited ones. Where a directory
    has several licence files the highest cosine counts, then the last name.
    Null and empty texts state nothing. A null path has no directory and
    inherits nothing. Rows may repeat, ids may be null. Extra columns, whatever
    their names, play no part. An empty table gives no rows.
    """
    found = vectors(docs, text_col, templates, least)
    text = F.coalesce(F.col(text_col), F.lit(""))
    is_license = F.coalesce(F.regexp_extract(path, r"([^/]*)$", 1).rlike(LICENSE_FILE), F.lit(False))
    strong = r"(?i)(?<![a-z0-9])(" + "|".join(sorted(found.strong) or ["(?!)"]) + r")(?![a-z0-9])"
    units = F.concat(F.split(text, "\n", -1), F.filter(F.split(text, _GAP, -1), lambda part: F.contains(part, F.lit("\n"))))
    lines = F.filter(units, lambda line: line.rlike(strong))
    lines = F.when(is_license & text.rlike(strong), F.concat(F.array(text), lines)).otherwise(lines)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),  # before the explosion, as its rows share one
        F.col(id_col).alias("_id"),
        path.alias("_path"),
        is_license.alias("_is_license"),
        F.concat(F.array(F.lit("")), lines).alias("_lines"),  # the empty one stands for the row
    ).select("_row", "_id", "_path", "_is_license", F.posexplode("_lines").alias("_unit", "_line"))
    own = matches(rows, found, least).where("_unit = 0 OR _best IS NOT NULL").groupBy("_row")
    own = own.agg(*(F.first(c).alias(c) for c in ("_id", "_path", "_is_license")), F.max("_best").alias("b"))
    stated = saved(
        own.select("_id", "_path", "_is_license", _directory(F.col("_path")).alias("_dir"), "b.license", "b.cosine"), "notices"
    )
    declared = (
        stated.where(F.col("_is_license") & F.col("license").isNotNull())
        .groupBy("_dir")
        .agg(F.max(F.struct(F.round("cosine", 9).alias("c"), F.col("license").alias("license"))).alias("d"))
        .select(F.col("_dir").alias("_up"), F.col("d.license").alias("_license"), F.col("d.c").alias("_cosine"))
    )
    parts = F.split("_dir", "/", -1)
    above = F.concat(  # the directory itself and all above it, down from the root
        F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    )
    nearest = F.max(F.struct(F.length("_up").alias("n"), F.col("_up").alias("up"), F.col("_license").alias("l"), F.col("_cosine").alias("c")))
    inherited = (
        stated.where("_dir IS NOT NULL").select("_dir").distinct()
        .select("_dir", F.explode(F.array_distinct(above)).alias("_up"))
        .join(declared, "_up")
        .groupBy("_dir").agg(nearest.alias("i"))
    )
    # a written table, as only a join of two shuffles can split the files of a large directory
    inherited = saved(inherited, "inherited")
    mine = F.col("license").isNotNull()
    return stated.join(inherited, "_dir", "left").select(
        F.col("_id").alias(id_col),
        F.col("_path").alias("path"),
        F.coalesce("license", "i.l").alias("license"),
        F.round(F.coalesce("cosine", "i.c"), 6).alias("cosine"),
        F.when(mine, "own").when(F.col("i").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("i.up")).alias("from_directory"),
    )


def document_path() -> Column:
    """Where ``documents`` stand in for files: source / language / hundred / file; every tenth is a licence file,
    and that of a hundred's first document is one directory up."""
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(
        F.concat(F.lit("d"), F.col("doc_id"), F.lit(".txt"))
    )
    hundred = F.when(F.col("doc_id") % 100 != 0, F.concat(F.lit("h"), F.floor(F.col("doc_id") / 100).cast("string")))
    return F.concat_ws("/", "source", "lang", hundred, name)
