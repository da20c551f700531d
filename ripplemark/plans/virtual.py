"""Virtual repositories: the benchmark's tables read as versioned code.

``documents`` are files whose lines are units; the head revision drops and edits
lines by position. Parts and suppliers are functions in packages, line items
their calls. ``pages`` are modules that import what they link to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions import code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units of the base and the head: path, doc_id, idx, line, parent, name, body_hash."""
    docs = table(spark, sf_dir, "documents")
    base = docs.select(
        F.concat("source", F.lit("/d"), F.col("doc_id").cast("string")).alias("path"), "doc_id",
        F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"),
    )
    n = F.col("doc_id") + F.col("idx")
    head = base.where(n % 11 != 0).withColumn("line", F.when(n % 7 == 0, F.concat("line", F.lit(" x"))).otherwise(F.col("line")))

    def units(df: DataFrame) -> DataFrame:
        name = F.regexp_extract("line", "^([A-Za-z]+)", 1)
        return df.select(
            "path", "doc_id", "idx", "line", F.lit(None).cast("int").alias("parent"),
            F.when(name != "", name).alias("name"), code.body_hash(F.col("line")).alias("body_hash"),
        )

    return units(base), units(head)


LINES_SQL = r"""
base0 AS (
  SELECT source || '/d' || doc_id AS path, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
head0 AS (
  SELECT path, doc_id, CASE WHEN (doc_id + idx) % 7 = 0 THEN line || ' x' ELSE line END AS line, idx
  FROM base0 WHERE (doc_id + idx) % 11 <> 0),
base AS (SELECT path, doc_id, idx::INT AS idx, line, nullif(regexp_extract(line, '^([A-Za-z]+)', 1), '') AS name,
                md5(regexp_replace(line, '[ \t\n\f\r]', '', 'g')) AS body_hash FROM base0),
head AS (SELECT path, doc_id, idx::INT AS idx, line, nullif(regexp_extract(line, '^([A-Za-z]+)', 1), '') AS name,
                md5(regexp_replace(line, '[ \t\n\f\r]', '', 'g')) AS body_hash FROM head0)
"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (caller, callee, status): parts call suppliers, and each supplier one part, so there are cycles."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    per_pair = items.groupBy("l_partkey", "l_suppkey").agg(
        F.bool_or(F.col("l_returnflag") != "R").alias("b"), F.bool_or(F.col("l_returnflag") != "A").alias("h")
    )
    status = F.when(~F.col("b"), "added").when(~F.col("h"), "removed").otherwise("unchanged")
    down = per_pair.select(_part("l_partkey").alias("caller"), _supplier("l_suppkey").alias("callee"), status.alias("status"))
    back = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("p_partkey"), "s_suppkey")
    back = back.join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return down.unionByName(
        back.select(_supplier("s_suppkey").alias("caller"), _part("p_partkey").alias("callee"), F.lit("unchanged").alias("status"))
    )


def _part(key: str):
    return F.concat(F.lit("p:"), F.col(key).cast("string"))


def _supplier(key: str):
    return F.concat(F.lit("s:"), F.col(key).cast("string"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes: node, label, path, package, exported, route, explored, change. Suppliers of low balance have changed."""
    part = table(spark, sf_dir, "part").select(
        _part("p_partkey").alias("node"), F.col("p_name").alias("label"), F.concat("p_brand", F.lit("/"), "p_type").alias("path"),
        F.col("p_brand").alias("package"), (F.col("p_size") % 2 == 0).alias("exported"),
        F.when(F.col("p_size") == 1, F.concat(F.lit("GET /"), "p_type")).alias("route"), F.lit("unchanged").alias("change"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        _supplier("s_suppkey").alias("node"), F.col("s_name").alias("label"),
        F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("/suppliers")).alias("path"),
        F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("package"), (F.col("s_suppkey") % 3 != 0).alias("exported"),
        F.lit(None).cast("string").alias("route"), F.when(F.col("s_acctbal") < 1000, "changed").otherwise("unchanged").alias("change"),
    )
    return part.unionByName(supplier).withColumn("explored", F.lit(True))


GRAPH_SQL = r"""
pairs AS (SELECT l_partkey, l_suppkey, bool_or(l_returnflag <> 'R') AS b, bool_or(l_returnflag <> 'A') AS h
          FROM lineitem GROUP BY ALL),
calls AS (
  SELECT 'p:' || l_partkey AS caller, 's:' || l_suppkey AS callee,
         CASE WHEN NOT b THEN 'added' WHEN NOT h THEN 'removed' ELSE 'unchanged' END AS status FROM pairs
  UNION ALL
  SELECT 's:' || s_suppkey, 'p:' || p_partkey, 'unchanged' FROM supplier JOIN part ON p_partkey = s_suppkey * 7),
functions AS (
  SELECT 'p:' || p_partkey AS node, p_name AS label, p_brand || '/' || p_type AS path, p_brand AS package,
         p_size % 2 = 0 AS exported, CASE WHEN p_size = 1 THEN 'GET /' || p_type END AS route, 'unchanged' AS change FROM part
  UNION ALL
  SELECT 's:' || s_suppkey, s_name, 'nation' || s_nationkey || '/suppliers', 'nation' || s_nationkey, s_suppkey % 3 <> 0, NULL,
         CASE WHEN s_acctbal < 1000 THEN 'changed' ELSE 'unchanged' END FROM supplier),
live AS (SELECT caller, callee FROM calls WHERE status <> 'removed'),
origins AS (SELECT node FROM functions WHERE change = 'changed')
"""

HOPS = 12
#: (origin, node, distance) over the calls that are not removed, and the nearest of each node.
EACH_SQL = rf"""
walk(origin, node, distance) AS (
  SELECT node, node, 0 FROM origins
  UNION
  SELECT w.origin, l.caller, w.distance + 1 FROM walk w JOIN live l ON l.callee = w.node WHERE w.distance < {HOPS}),
each AS (SELECT origin, node, min(distance)::INT AS distance FROM walk GROUP BY origin, node),
reached AS (SELECT DISTINCT f.* FROM each e JOIN functions f ON f.node = e.node),
called AS (SELECT DISTINCT callee AS node FROM live),
entries AS (
  SELECT r.node, CASE WHEN route IS NOT NULL THEN 'route' WHEN starts_with(label, 'module@') THEN 'module'
         WHEN ends_with(path, '.svelte') THEN 'component' WHEN exported THEN 'export' ELSE 'function' END AS kind
  FROM reached r LEFT JOIN called c ON c.node = r.node WHERE c.node IS NULL OR route IS NOT NULL),
own AS (
  SELECT e.origin,
         count(*) FILTER (e.distance > 0 AND f.change = 'unchanged') AS reach_functions,
         count(DISTINCT f.path) FILTER (e.distance > 0) AS reach_files,
         count(DISTINCT f.package) FILTER (e.distance > 0) AS reach_packages
  FROM each e JOIN functions f ON f.node = e.node GROUP BY e.origin),
ent AS (SELECT e.origin, count(*) AS n FROM each e JOIN entries x ON x.node = e.node GROUP BY e.origin),
imp AS (
  SELECT l.callee AS origin, list_sort(list(DISTINCT f.package)) AS packages
  FROM live l JOIN origins o ON o.node = l.callee JOIN functions f ON f.node = l.caller JOIN functions g ON g.node = l.callee
  WHERE f.package <> g.package GROUP BY l.callee),
symbols AS (
  SELECT own.origin AS id, reach_functions, reach_files, reach_packages, coalesce(ent.n, 0) AS reach_entries,
         coalesce(imp.packages, []) AS called_from_packages
  FROM own LEFT JOIN ent ON ent.origin = own.origin LEFT JOIN imp ON imp.origin = own.origin)
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, ord, specifier) of every link of a page."""
    pages = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("ord", "specifier"))
