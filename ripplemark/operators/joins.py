"""Joins that SQL has no word for, as equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions import paths
from ripplemark.tables import cut


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``; the columns stay."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def owning_package(files: DataFrame, packages: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``files`` with package: the one in the deepest directory above the path, those of the file's
    own kind before others, the first discovered of several. Null where none is above.

    files: path, kind and ``keys``; packages: dir, kind, name, ord and ``keys``. Directories are
    resolved, not files: each directory is expanded into the ones above it and meets the packages
    by equality.
    """
    by_dir = files.withColumn("dir", paths.directory(F.col("path")))
    above = by_dir.select(*keys, "dir", "kind").distinct().withColumn("up", F.explode(paths.ancestors(F.col("dir"))))
    found = packages.select(*keys, F.col("dir").alias("up"), F.col("kind").alias("of_kind"), "name", "ord")
    best = F.max(
        F.struct((F.col("kind").eqNullSafe(F.col("of_kind"))).alias("same"), F.length("up").alias("depth"), (-F.col("ord")).alias("o"), F.col("name").alias("name"))
    )
    chosen = above.join(found, [*keys, "up"]).groupBy(*keys, "dir", "kind").agg(best.alias("b"))
    chosen = chosen.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "dir", "kind")], F.col("b.name").alias("package"))
    on = [F.col(c) == F.col(f"_{c}") for c in (*keys, "dir")] + [F.col("kind").eqNullSafe(F.col("_kind"))]
    return by_dir.join(chosen, on, "left").select(*files.columns, "package")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: int = 64) -> DataFrame:
    """``points`` with the columns of the smallest span that holds them, null where none does.

    The range join is an equi-join: spans are listed under every bucket of ``bucket`` lines that
    they touch, and a point looks in its own.
    """
    extra = [c for c in spans.columns if c not in keys]
    listed = spans.select(*keys, *extra, F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("_b"))
    marked = points.withColumn("_p", F.monotonically_increasing_id()).withColumn("_b", F.floor(F.col(at) / bucket))
    held = marked.join(listed, [*keys, "_b"], "left").withColumn("_in", F.col(at).between(F.col(start), F.col(end)))
    size = F.col(end) - F.col(start)
    best = first_of(held, ["_p"], F.col("_in").desc_nulls_last(), size.asc_nulls_last(), F.col(start).desc_nulls_last())
    return best.select(*points.columns, *[F.when(F.col("_in"), F.col(c)).alias(c) for c in extra])


def first_candidate(candidates: DataFrame, existing: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Per key the existing path of least ``rank``: candidates in order, the first that is there."""
    found = candidates.join(existing.select(path).distinct(), path)
    return found.groupBy(*keys).agg(F.min_by(path, "rank").alias(path), F.min("rank").alias("rank"))


def divides(members: DataFrame, required: DataFrame, owner: list[str], group: list[str], item: str, most: int | None = None) -> DataFrame:
    """(group, owner): owners that have every item their group requires; groups with more than
    ``most`` such owners give none."""
    sizes = required.groupBy(*group).agg(F.count_distinct(item).alias("_need"))
    have = required.select(*group, item).distinct().join(members.select(*owner, item).distinct(), item)
    full = have.groupBy(*group, *owner).agg(F.count(F.lit(1)).alias("_have")).join(sizes, group).where("_have = _need")
    full = full.select(*group, *owner)
    if most is None:
        return full
    few = full.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).select(*group)
    return full.join(few, group, "left_semi")


def only_one(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) for keys with exactly one distinct value."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")


def _parameter(segment: Column) -> Column:
    return segment.rlike(r"^(:.*|\{.*\}|\[.*\])$")


def same_key(a: Column, b: Column) -> Column:
    """Keys that are equal, or paths of as many parts that agree part by part: equal, both
    parameters, or either a ``*``."""
    x, y = paths.segments(a), paths.segments(b)
    fits = F.zip_with(x, y, lambda p, q: (p == q) | (_parameter(p) & _parameter(q)) | (p == "*") | (q == "*"))
    parts = F.contains(a, F.lit("/")) & F.contains(b, F.lit("/")) & (F.size(x) == F.size(y))
    return (a == b) | (parts & F.forall(fits, lambda f: F.coalesce(f, F.lit(False))))


def key_join(calls: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """Calls with the definitions whose key matches by :func:`same_key`; both have ``keys`` and ``key``.

    Keys without a ``*`` meet by their form, in which every parameter reads the same; only the keys with
    one are compared by number of parts.
    """
    form = lambda k: F.when(
        F.contains(k, F.lit("/")),
        F.concat(F.lit("/"), F.array_join(F.transform(paths.segments(k), lambda s: F.when(_parameter(s), ":").otherwise(s)), "/")),
    ).otherwise(k)
    c = calls.withColumn("_form", form(F.col("key"))).withColumn("_n", F.size(paths.segments(F.col("key"))))
    d = definitions.withColumnRenamed("key", "def_key")
    d = d.withColumn("_form", form(F.col("def_key"))).withColumn("_n", F.size(paths.segments(F.col("def_key"))))
    star = lambda k: F.array_contains(paths.segments(F.col(k)), "*")
    plain = c.where(~star("key")).join(d.where(~star("def_key")).drop("_n"), [*keys, "_form"])
    wild_definitions = c.join(d.where(star("def_key")).drop("_form"), [*keys, "_n"])
    wild_calls = c.where(star("key")).join(d.where(~star("def_key")).drop("_form"), [*keys, "_n"])
    cols = [*calls.columns, *[x if x != "key" else "def_key" for x in definitions.columns if x not in keys]]
    every = plain.select(cols).unionByName(wild_definitions.select(cols)).unionByName(wild_calls.select(cols))
    return every.where(same_key(F.col("key"), F.col("def_key")))


def overridden(own: DataFrame, reported: DataFrame, keys: list[str], target: str, name: Column) -> DataFrame:
    """Targets of sites: the reported ones where there are any, else the own ones.

    Of several reported at a site, those stay that are called ``name`` (a Column over ``target``
    and the site's ``call``), if any are.
    """
    told = reported.join(own.select(*keys, "call").distinct(), keys).withColumn("_named", name)
    any_named = F.max(F.col("_named").cast("int")).over(Window.partitionBy(*keys, "call"))
    told = told.withColumn("_any", any_named).where("_named OR _any = 0").select(*keys, "call", target).distinct()
    rest = own.join(reported.select(*keys).distinct(), keys, "left_anti").select(*keys, "call", target)
    return told.withColumn("by", F.lit("resolver")).unionByName(rest.withColumn("by", F.lit("own")))


def status_of_sets(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): added, removed or unchanged by where a row is."""
    b = base.select(*keys).distinct().withColumn("_b", F.lit(True))
    h = head.select(*keys).distinct().withColumn("_h", F.lit(True))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").otherwise("unchanged")
    return b.join(h, keys, "full_outer").select(*keys, status.alias("status"))


def renames(base: DataFrame, head: DataFrame) -> DataFrame:
    """(status, path, from) of files that differ; both sides have path and hash.

    A path only in the base and one only in the head with equal content are a rename, kth with kth.
    """
    b = base.select("path", F.col("hash").alias("base_hash"))
    h = head.select("path", F.col("hash").alias("head_hash"))
    both = b.join(h, "path", "full_outer").where(~F.col("base_hash").eqNullSafe(F.col("head_hash")))
    edited = both.where("base_hash IS NOT NULL AND head_hash IS NOT NULL").select(F.lit("M").alias("status"), "path")
    gone, new = both.where("head_hash IS NULL"), both.where("base_hash IS NULL")
    k = lambda h: F.row_number().over(Window.partitionBy(h).orderBy("path"))
    g = gone.select(F.col("base_hash").alias("hash"), F.col("path").alias("from"), k("base_hash").alias("k"))
    n = new.select(F.col("head_hash").alias("hash"), "path", k("head_hash").alias("k"))
    each = g.join(n, ["hash", "k"], "full_outer")
    moved = each.select(
        F.when(F.col("from").isNull(), "A").when(F.col("path").isNull(), "D").otherwise("R").alias("status"),
        F.coalesce("path", "from").alias("path"),
        F.when(F.col("path").isNotNull(), F.col("from")).alias("from"),
    )
    return edited.withColumn("from", F.lit(None).cast("string")).unionByName(moved)


#: Pieces that contents are compared by: lines, long ones in parts.
_PIECE = r"[^\n]{0,63}\n|[^\n]{1,64}"


def similar_renames(gone: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """(path, from, score): which new file (path, text) is which gone one, edited.

    The score is the bytes of the pieces that both have, repeats counted, of those of the larger file. Pairs at
    ``least`` or more are taken from the highest on, each file once; of equal ones that of the same file name, then
    the first names. Candidates share one of the rare pieces that make up all but ``least`` of each, so none is lost
    and frequent lines pair nothing. Texts without pieces and null ones have no pair.
    """

    def pieces(df: DataFrame, side: str) -> DataFrame:
        each = df.select(F.lit(side).alias("side"), F.col("path").alias("file"), F.explode(F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))).alias("piece"))
        return each.groupBy("side", "file", "piece").agg(F.sum(F.octet_length("piece")).alias("bytes"))

    held = cut(pieces(gone, "gone").unionByName(pieces(new, "new")))
    rarest = Window.partitionBy("side", "file").orderBy(F.desc("files"), F.desc("piece")).rowsBetween(Window.unboundedPreceding, 0)
    files = held.groupBy("piece").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("side").alias("sides"))
    known = held.join(files, "piece").withColumns({"rest": F.sum("bytes").over(rarest), "size": F.sum("bytes").over(Window.partitionBy("side", "file"))})
    known = cut(known)
    of = lambda side, name: known.where(F.col("side") == side).select(F.col("file").alias(name), "piece", F.col("bytes").alias(f"{side}_bytes"), F.col("size").alias(f"{side}_size"), "rest", "sides")
    g, n = of("gone", "from"), of("new", "path")
    key = lambda df, size: df.where((F.col("sides") == 2) & (F.col("rest") >= least * F.col(size))).drop("rest", "sides")
    pairs = key(g, "gone_size").join(key(n, "new_size"), "piece")
    pairs = pairs.where(F.least("gone_size", "new_size") >= least * F.greatest("gone_size", "new_size")).select("from", "path").distinct()
    shared = pairs.join(g.drop("rest", "sides"), "from").join(n.drop("rest", "sides"), ["path", "piece"])
    scored = shared.groupBy("path", "from").agg((F.sum(F.least("gone_bytes", "new_bytes")) / F.max(F.greatest("gone_size", "new_size"))).alias("score"))
    name = lambda c: F.substring_index(c, "/", -1)
    left = cut(scored.where(F.col("score") >= least).withColumn("order", F.struct((-F.col("score")).alias("s"), (name("path") != name("from")).alias("n"), "path", "from")))
    taken = left.limit(0)
    while not left.isEmpty():  # what is best on both sides would be taken before all others of these files
        best = lambda c: F.min("order").over(Window.partitionBy(c))
        mutual = cut(left.withColumns({"a": best("from"), "b": best("path")}).where("order = a AND order = b").drop("a", "b"))
        taken = cut(taken.unionByName(mutual))
        left = cut(left.join(mutual.select("from"), "from", "left_anti").join(mutual.select("path"), "path", "left_anti").select(left.columns))
    return taken.select("path", "from", "score")


def with_similar(status: DataFrame, similar: DataFrame) -> DataFrame:
    """The rows of ``renames`` with added and removed files that are the same one, edited, as a rename."""
    pair = similar.select("path", "from")
    rest = status.join(pair.select("path").withColumn("status", F.lit("A")), ["status", "path"], "left_anti")
    rest = rest.join(pair.select(F.col("from").alias("path")).withColumn("status", F.lit("D")), ["status", "path"], "left_anti")
    return rest.select("status", "path", "from").unionByName(pair.select(F.lit("R").alias("status"), "path", "from"))


def change_kind(status: Column) -> Column:
    """Change of a status letter."""
    return F.when(status.isin("A", "C"), "added").when(status == "D", "deleted").when(status == "R", "renamed").otherwise("modified")


def text_references(lines: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that mention a name as ``alias.label(``: ``names`` has ``keys``, alias and label; ``lines`` keys, line, text.

    Every dotted pair of words of a line is listed once, so mentions meet names by equality.
    """
    pair = r"(?<![\w$.])([A-Za-z_$][\w$]*\.[A-Za-z_$][\w$]*)"
    said = lines.select(*lines.columns, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pair), F.lit(1)))).alias("_said"))
    wanted = names.withColumn("_said", F.concat("alias", F.lit("."), "label"))
    return said.join(wanted, [*keys, "_said"]).drop("_said")
