"""The registered queries of the operators, over virtual repositories, and their SQL.

Each takes (spark, sf_dir) and covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.functions import code, paths
from ripplemark.operators import aggregates, align, findings, graph, joins, rules
from ripplemark.plans import virtual
from ripplemark.plans.virtual import EACH_SQL, GRAPH_SQL, HOPS, LINES_SQL, table
from ripplemark.tables import Written, cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# files and changes


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit("/d"), F.col("doc_id").cast("string")).alias("path"))
    n = F.col("doc_id") % 10
    base = docs.where(n != 3).select("path", F.md5("text").alias("hash"))
    text = F.when(n == 6, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    moved = F.when(n == 5, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    return base, docs.where(n != 4).select(moved.alias("path"), F.md5(text).alias("hash"))


_VERSIONS_SQL = """
d AS (SELECT doc_id, text, source || '/d' || doc_id AS path FROM documents),
b AS (SELECT path, md5(text) AS h FROM d WHERE doc_id % 10 <> 3),
v AS (SELECT CASE WHEN doc_id % 10 = 5 THEN 'moved/' || path ELSE path END AS path,
             md5(CASE WHEN doc_id % 10 = 6 THEN text || '!' ELSE text END) AS h FROM d WHERE doc_id % 10 <> 4),
both_ AS (SELECT coalesce(b.path, v.path) AS path, b.h AS bh, v.h AS vh FROM b FULL JOIN v ON b.path = v.path WHERE b.h IS DISTINCT FROM v.h),
g AS (SELECT path, bh AS h, row_number() OVER (PARTITION BY bh ORDER BY path) AS k FROM both_ WHERE vh IS NULL),
n AS (SELECT path, vh AS h, row_number() OVER (PARTITION BY vh ORDER BY path) AS k FROM both_ WHERE bh IS NULL),
st AS (
  SELECT 'M' AS status, path, NULL AS "from" FROM both_ WHERE bh IS NOT NULL AND vh IS NOT NULL
  UNION ALL
  SELECT CASE WHEN g.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' ELSE 'R' END, coalesce(n.path, g.path),
         CASE WHEN n.path IS NOT NULL THEN g.path END
  FROM g FULL JOIN n ON g.h = n.h AND g.k = n.k)
"""


@query(f"WITH {_VERSIONS_SQL} SELECT * FROM st")
def file_status(spark, sf_dir):
    return joins.renames(*_versions(spark, sf_dir))


@query(None)
def edited_renames(spark, sf_dir):
    """Documents that move and lose or gain a line on the way; greedy pairs are beyond SQL, tests hold them against brute force."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    path, n = F.concat("source", F.lit("/d"), F.col("doc_id").cast("string")), F.col("doc_id") % 10
    edited = F.when(n == 5, F.concat("text", F.lit("\nadded"))).otherwise(F.regexp_replace("text", r"^[^\n]*\n", ""))
    gone = docs.where(n.isin(3, 5, 6)).select(path.alias("path"), "text")
    return joins.similar_renames(gone, docs.where(n.isin(4, 5, 6)).select(F.concat(F.lit("moved/"), path).alias("path"), F.when(n == 4, F.col("text")).otherwise(edited).alias("text")))


@query(f"""WITH {_VERSIONS_SQL} SELECT CASE status WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' ELSE 'modified' END AS change,
       split_part(regexp_replace(path, '^moved/', ''), '/', 1) AS package, count(*) AS files FROM st GROUP BY ALL""")
def file_changes(spark, sf_dir):
    st = joins.renames(*_versions(spark, sf_dir))
    package = F.split_part(F.regexp_replace("path", "^moved/", ""), F.lit("/"), F.lit(1))
    return st.groupBy(joins.change_kind(F.col("status")).alias("change"), package.alias("package")).agg(F.count(F.lit(1)).alias("files"))


# alignment

_ALIGN_SQL = f"""{LINES_SQL},
e AS (SELECT b.path, b.idx AS bi, h.idx AS hi FROM
        (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY idx) AS k FROM base WHERE name IS NOT NULL) b
   JOIN (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY idx) AS k FROM head WHERE name IS NOT NULL) h
     ON b.path = h.path AND b.name = h.name AND b.k = h.k),
b2 AS (SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.path = b.path AND e.bi = b.idx)),
h2 AS (SELECT * FROM head h WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.path = h.path AND e.hi = h.idx)),
x AS (SELECT b.path, b.idx AS bi, h.idx AS hi FROM
        (SELECT *, row_number() OVER (PARTITION BY path, body_hash ORDER BY idx) AS k FROM b2) b
   JOIN (SELECT *, row_number() OVER (PARTITION BY path, body_hash ORDER BY idx) AS k FROM h2) h
     ON b.path = h.path AND b.body_hash = h.body_hash AND b.k = h.k),
b3 AS (SELECT * FROM b2 b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.path = b.path AND x.bi = b.idx)),
h3 AS (SELECT * FROM h2 h WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.path = h.path AND x.hi = h.idx)),
p AS (SELECT coalesce(b.path, h.path) AS path, b.idx AS bi, h.idx AS hi FROM
        (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx) AS k FROM b3) b
   FULL JOIN (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx) AS k FROM h3) h ON b.path = h.path AND b.k = h.k),
al AS (SELECT path, bi AS base_idx, hi AS head_idx, 'exact' AS tier FROM e
       UNION ALL SELECT path, bi, hi, 'body_hash' FROM x
       UNION ALL SELECT path, bi, hi, CASE WHEN bi IS NOT NULL AND hi IS NOT NULL THEN 'positional' END FROM p),
ch AS (SELECT al.*, CASE WHEN base_idx IS NULL THEN 'added' WHEN head_idx IS NULL THEN 'removed'
              WHEN b.body_hash <> h.body_hash THEN 'changed' ELSE 'unchanged' END AS change,
              coalesce(h.doc_id, b.doc_id) AS doc_id
       FROM al LEFT JOIN base b ON b.path = al.path AND b.idx = al.base_idx
               LEFT JOIN head h ON h.path = al.path AND h.idx = al.head_idx)"""


def _changes(spark, sf_dir) -> DataFrame:
    base, head = virtual.lines(spark, sf_dir)
    return align.unit_changes(base, head, align.align(base, head))


@query(f"WITH {_ALIGN_SQL} SELECT * FROM al")
def align_units(spark, sf_dir):
    return align.align(*virtual.lines(spark, sf_dir))


@query(f"WITH {_ALIGN_SQL} SELECT tier, change, count(*) AS n FROM ch GROUP BY ALL")
def align_counts(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("tier", "change").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ALIGN_SQL} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed,
           count(*) FILTER (change = 'removed') AS removed FROM ch""")
def change_counts(spark, sf_dir):
    return aggregates.change_counts(_changes(spark, sf_dir))


@query(f"""WITH {_ALIGN_SQL} SELECT DISTINCT path FROM base ANTI JOIN (SELECT path FROM ch WHERE change <> 'unchanged') USING (path)""")
def files_without_changes(spark, sf_dir):
    base, _ = virtual.lines(spark, sf_dir)
    return aggregates.files_without_changes(base.select("path").distinct(), _changes(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, bu AS (
  SELECT path, idx // 4 AS block, min(idx) AS i, bool_or((doc_id + idx) % 7 = 0 AND idx % 4 = 0) AS moved FROM base GROUP BY ALL)
SELECT path, 1000000 + block::INT AS idx, 'block' AS kind FROM bu WHERE moved
UNION ALL
SELECT b.path, b.idx, 'line' FROM base b JOIN bu ON bu.path = b.path AND bu.block = b.idx // 4
WHERE (doc_id + b.idx) % 7 = 0 AND NOT moved""")
def changed_roots(spark, sf_dir):
    base, _ = virtual.lines(spark, sf_dir)
    block = F.floor(F.col("idx") / 4).cast("int")
    edited = (F.col("doc_id") + F.col("idx")) % 7 == 0
    line = base.select("path", "idx", (block + 1000000).alias("parent"), edited.alias("edited"), F.lit("line").alias("kind"))
    blocks = base.groupBy("path", (block + 1000000).alias("idx")).agg(F.bool_or(edited & (F.col("idx") % 4 == 0)).alias("edited"))
    blocks = blocks.select("path", "idx", F.lit(None).cast("int").alias("parent"), "edited", F.lit("block").alias("kind"))
    return align.outermost(line.unionByName(blocks), F.col("edited")).select("path", "idx", "kind")


_WORDS_SQL = """w AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word FROM conversations)"""


@query(f"""WITH {_WORDS_SQL}, c AS (
  SELECT conv_id, turn, word, 1 AS d FROM w WHERE turn > 0
  UNION ALL SELECT conv_id, turn + 1, word, -1 FROM w),
t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn > 0)
SELECT c.conv_id, c.turn, word, abs(sum(d))::BIGINT AS n, CASE WHEN sum(d) > 0 THEN 'added' ELSE 'removed' END AS change
FROM c JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn GROUP BY c.conv_id, c.turn, word HAVING sum(d) <> 0""")
def call_multiset_diff(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    words = turns.select("conv_id", "turn", F.explode(F.split(F.lower("text"), " ", -1)).alias("word"))
    after = words.where("turn > 0")
    before = words.withColumn("turn", F.col("turn") + 1).join(after.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi")
    return align.multiset_changes(before, after, ["conv_id", "turn"], "word")


# packages, spans, resolution


@query("""WITH f AS (SELECT doc_id, source || '/' || lang AS dir, lang AS kind FROM documents),
p AS (SELECT source AS dir, 'en' AS kind, source AS name, 10 AS ord FROM (SELECT DISTINCT source FROM documents)
      UNION ALL SELECT DISTINCT source || '/' || lang, 'fr', source || '-' || lang, 20 FROM documents WHERE lang IN ('fr', 'de')
      UNION ALL SELECT '', 'es', 'root', 0),
c AS (SELECT f.doc_id, p.name, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.kind = p.kind DESC, length(p.dir) DESC, p.ord) AS r
      FROM f JOIN p ON p.dir = '' OR p.dir = f.dir OR starts_with(f.dir, p.dir || '/'))
SELECT doc_id, name AS package FROM c WHERE r = 1""")
def owning_package(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("path"), F.col("lang").alias("kind"))
    of_source = docs.select(F.col("source").alias("dir"), F.lit("en").alias("kind"), F.col("source").alias("name"), F.lit(10).alias("ord")).distinct()
    two = docs.where(F.col("lang").isin("fr", "de"))
    of_lang = two.select(F.concat_ws("/", "source", "lang").alias("dir"), F.lit("fr").alias("kind"), F.concat_ws("-", "source", "lang").alias("name"), F.lit(20).alias("ord")).distinct()
    root = spark.createDataFrame([("", "es", "root", 0)], "dir string, kind string, name string, ord int")
    return joins.owning_package(files, of_source.unionByName(of_lang).unionByName(root)).select("doc_id", "package")


@query(f"""WITH {LINES_SQL},
s AS (SELECT path, 'b' || s AS id, idx - idx % s AS a, min(idx - idx % s) + s - 1 AS z FROM base, (VALUES (4), (16), (64)) AS v(s) GROUP BY path, s, idx - idx % s),
c AS (SELECT h.path, h.idx, s.id, s.a, row_number() OVER (PARTITION BY h.path, h.idx ORDER BY s.z - s.a, s.a DESC) AS r
      FROM head h JOIN s ON s.path = h.path AND h.idx BETWEEN s.a AND s.z)
SELECT path, idx, id, a::INT AS start FROM c WHERE r = 1""")
def owner_innermost(spark, sf_dir):
    base, head = virtual.lines(spark, sf_dir)
    sized = base.select("path", "idx", F.explode(F.array(F.lit(4), F.lit(16), F.lit(64))).alias("s"))
    spans = sized.select("path", F.concat(F.lit("b"), F.col("s").cast("string")).alias("id"), (F.col("idx") - F.col("idx") % F.col("s")).alias("start"), "s")
    spans = spans.distinct().select("path", "id", "start", (F.col("start") + F.col("s") - 1).alias("end"))
    return joins.innermost(head.select("path", "idx"), spans, ["path"], "idx", "start", "end").select("path", "idx", "id", "start")


_PAGE_SQL = r"""pg AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)"""


@query(f"""WITH {_PAGE_SQL}, ex AS (SELECT DISTINCT host || p AS path FROM pg),
c AS (SELECT page_id, host || p || '.html' AS path, 0 AS r FROM pg UNION ALL SELECT page_id, host || p, 1 FROM pg
      UNION ALL SELECT page_id, host || '/' || split_part(p, '/', 2), 2 FROM pg)
SELECT c.page_id, arg_min(c.path, c.r) AS path, min(c.r)::INT AS rank FROM c JOIN ex ON ex.path = c.path GROUP BY c.page_id""")
def specifier_resolution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host, path = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    tries = F.array(F.concat(host, path, F.lit(".html")), F.concat(host, path), F.concat(host, F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2))))
    candidates = pages.select("page_id", F.posexplode(tries).alias("rank", "path"))
    return joins.first_candidate(candidates, pages.select(F.concat(host, path).alias("path")), ["page_id"])


@query("""SELECT page_id, unnest(range(len(l))) ::INT AS ord, unnest(l) AS specifier
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""")
def import_scan(spark, sf_dir):
    return virtual.links(spark, sf_dir).select("page_id", "ord", "specifier")


_LINKS_SQL = """l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS specifier FROM pages)"""


@query(f"WITH {_LINKS_SQL} SELECT specifier, count(DISTINCT page_id) AS importers, min(page_id) AS first_importer FROM l GROUP BY specifier")
def importers(spark, sf_dir):
    edges = virtual.links(spark, sf_dir)
    return edges.groupBy("specifier").agg(F.count_distinct("page_id").alias("importers"), F.min("page_id").alias("first_importer"))


@query(f"WITH {_LINKS_SQL} SELECT DISTINCT page_id, specifier FROM l")
def dependencies(spark, sf_dir):
    return virtual.links(spark, sf_dir).select("page_id", "specifier").distinct()


@query(r"""WITH s AS (SELECT DISTINCT trim(leading '/' from specifier) AS specifier FROM (
  SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS specifier FROM pages) UNION SELECT '@' || p_type FROM part UNION SELECT p_brand || '/x/' || p_size FROM part)
SELECT specifier, CASE WHEN starts_with(specifier, '.') THEN NULL WHEN starts_with(specifier, '@') THEN array_to_string(string_split(specifier, '/')[1:2], '/')
  ELSE split_part(specifier, '/', 1) END AS js, CASE WHEN NOT starts_with(specifier, '.') THEN split_part(specifier, '.', 1) END AS python FROM s""")
def package_names(spark, sf_dir):
    links = virtual.links(spark, sf_dir).select(F.expr("trim(leading '/' from specifier)").alias("specifier"))
    part = table(spark, sf_dir, "part")
    more = part.select(F.concat(F.lit("@"), "p_type").alias("specifier")).unionByName(part.select(F.concat("p_brand", F.lit("/x/"), F.col("p_size").cast("string")).alias("specifier")))
    s = links.unionByName(more).distinct()
    return s.select("specifier", code.js_package(F.col("specifier")).alias("js"), code.python_package(F.col("specifier")).alias("python"))


@query(r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
SELECT p, 'a/../b/.' || p AS raw, 'b' || regexp_replace(p, '/+$', '') AS path, regexp_extract('b' || p, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(p, '([^/]*)$', 1) AS base FROM p""")
def path_functions(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("p")).distinct()
    raw = F.concat(F.lit("a/../b/."), F.col("p"))
    return p.select("p", raw.alias("raw"), paths.normalised(raw).alias("path"), paths.directory(F.concat(F.lit("b"), F.col("p"))).alias("dir"), paths.basename(F.col("p")).alias("base"))


# calls

_EDGE_SETS_SQL = """eb AS (SELECT DISTINCT 'p:' || l_partkey AS caller, 's:' || l_suppkey AS callee FROM lineitem WHERE l_returnflag <> 'R'),
eh AS (SELECT DISTINCT 'p:' || l_partkey AS caller, 's:' || l_suppkey AS callee FROM lineitem WHERE l_returnflag <> 'A')"""


def _edge_sets(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    pair = [F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("caller"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("callee")]
    return items.where("l_returnflag <> 'R'").select(*pair), items.where("l_returnflag <> 'A'").select(*pair)


@query(f"""WITH {_EDGE_SETS_SQL} SELECT coalesce(eb.caller, eh.caller) AS caller, coalesce(eb.callee, eh.callee) AS callee,
CASE WHEN eb.caller IS NULL THEN 'added' WHEN eh.caller IS NULL THEN 'removed' ELSE 'unchanged' END AS status
FROM eb FULL JOIN eh ON eb.caller = eh.caller AND eb.callee = eh.callee""")
def hub_callers(spark, sf_dir):
    return joins.status_of_sets(*_edge_sets(spark, sf_dir), ["caller", "callee"])


@query(f"""WITH {_EDGE_SETS_SQL}, e AS (SELECT coalesce(eb.caller, eh.caller) AS caller,
CASE WHEN eb.caller IS NULL THEN 'added' WHEN eh.caller IS NULL THEN 'removed' ELSE 'unchanged' END AS status
FROM eb FULL JOIN eh ON eb.caller = eh.caller AND eb.callee = eh.callee)
SELECT caller, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'unchanged') AS unchanged FROM e GROUP BY caller""")
def hub_callees(spark, sf_dir):
    e = joins.status_of_sets(*_edge_sets(spark, sf_dir), ["caller", "callee"])
    return e.groupBy("caller").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "unchanged")])


@query("""WITH i AS (SELECT l_returnflag AS f, p_type AS a, l_suppkey AS b FROM lineitem JOIN part ON p_partkey = l_partkey),
x AS (SELECT DISTINCT a, b FROM i WHERE f <> 'R'), y AS (SELECT DISTINCT a, b FROM i WHERE f <> 'A')
SELECT coalesce(x.a, y.a) AS from_package, coalesce(x.b, y.b) AS to_package,
CASE WHEN x.a IS NULL THEN 'added' WHEN y.a IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM x FULL JOIN y ON x.a = y.a AND x.b = y.b""")
def package_hub(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    e = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    e = e.select(F.col("p_type").alias("from_package"), F.col("l_suppkey").alias("to_package"), "l_returnflag")
    return joins.status_of_sets(e.where("l_returnflag <> 'R'"), e.where("l_returnflag <> 'A'"), ["from_package", "to_package"])


@query("""WITH own AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS ln, l_partkey % 7 AS call, l_partkey AS t FROM lineitem),
rep AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_suppkey AS t FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey + 1 FROM lineitem WHERE l_returnflag = 'R'),
j AS (SELECT DISTINCT own.o, own.ln, own.call, rep.t, rep.t % 7 = own.call AS nm FROM own JOIN rep ON rep.o = own.o AND rep.ln = own.ln),
k AS (SELECT *, bool_or(nm) OVER (PARTITION BY o, ln, call) AS any_nm FROM j)
SELECT o, ln, call, t, 'resolver' AS by FROM k WHERE nm OR NOT any_nm
UNION ALL SELECT o, ln, call, t, 'own' FROM own WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.o = own.o AND rep.ln = own.ln)""")
def resolver_override(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    site = [F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln")]
    own = items.select(*site, (F.col("l_partkey") % 7).alias("call"), F.col("l_partkey").alias("t")).distinct()
    told = items.where("l_returnflag = 'R'").select(*site, F.explode(F.array(F.col("l_suppkey"), F.col("l_suppkey") + 1)).alias("t"))
    return joins.overridden(own, told, ["o", "ln"], "t", F.col("t") % 7 == F.col("call"))


@query("SELECT l_orderkey, l_returnflag, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) = 1")
def unique_import_method(spark, sf_dir):
    return joins.only_one(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_suppkey")


@query("""WITH req AS (SELECT DISTINCT p_type || p_size AS iface, p_partkey AS method FROM part),
mem AS (SELECT DISTINCT l_suppkey AS type, l_partkey AS method FROM lineitem),
need AS (SELECT iface, count(*) AS n FROM req GROUP BY iface),
have AS (SELECT r.iface, m.type, count(*) AS n FROM req r JOIN mem m ON m.method = r.method GROUP BY ALL),
f AS (SELECT h.iface, h.type FROM have h JOIN need ON need.iface = h.iface AND need.n = h.n)
SELECT iface, type FROM f WHERE iface IN (SELECT iface FROM f GROUP BY iface HAVING count(*) <= 8)""")
def interface_division(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    required = part.select(F.concat("p_type", F.col("p_size").cast("string")).alias("iface"), F.col("p_partkey").alias("method"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("type"), F.col("l_partkey").alias("method"))
    return joins.divides(members, required, ["type"], ["iface"], "method", most=8)


@query(r"""WITH pg AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages),
c AS (SELECT page_id, p AS key FROM pg WHERE p <> ''),
d AS (SELECT min(page_id) AS def, regexp_replace(p, '/[0-9]+', '/' || CASE page_id % 3 WHEN 0 THEN '*' WHEN 1 THEN ':id' ELSE '7' || page_id END) AS def_key FROM pg WHERE p <> '' GROUP BY ALL),
x AS (SELECT c.page_id, d.def, c.key, d.def_key, list_filter(string_split(c.key, '/'), lambda s: s <> '') AS a, list_filter(string_split(d.def_key, '/'), lambda s: s <> '') AS b FROM c, d)
SELECT page_id, def, key, def_key FROM x WHERE key = def_key OR (len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: a[i] = b[i] OR a[i] = '*' OR b[i] = '*'
  OR (starts_with(a[i], ':') AND starts_with(b[i], ':')))) = len(a))""")
def seam_join(spark, sf_dir):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("p"), F.lit(1).alias("seam")).where("p <> ''")
    key = F.when(F.col("page_id") % 3 == 0, "*").when(F.col("page_id") % 3 == 1, ":id").otherwise(F.concat(F.lit("7"), F.col("page_id").cast("string")))
    first = F.concat(F.regexp_extract("p", "^(.*?)/[0-9]+", 1), F.lit("/"), key, F.regexp_extract("p", "^.*?/[0-9]+(.*)$", 1))
    edited = F.when(F.col("p").rlike("/[0-9]+"), first).otherwise(F.col("p"))
    definitions = pages.groupBy("seam", edited.alias("key")).agg(F.min("page_id").alias("def"))
    calls = pages.select("seam", "page_id", F.col("p").alias("key"))
    return joins.key_join(calls, definitions, ["seam"]).select("page_id", "def", "key", "def_key")


@query("""WITH RECURSIVE m AS (SELECT 'r' || r_regionkey AS router, ['', lower(r_name)] AS prefix FROM region
  UNION ALL SELECT x.child, list_concat(m.prefix, [x.seg]) FROM m JOIN (
    SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, lower(n_name) AS seg FROM nation
    UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 's' || s_suppkey FROM supplier) x ON x.parent = m.router)
SELECT router, array_to_string(prefix, '/') AS route FROM m""")
def route_table(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    mounts = nation.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"), F.lower("n_name").alias("prefix")).unionByName(
        supplier.select(key("n", "s_nationkey").alias("parent"), key("s", "s_suppkey").alias("child"), key("s", "s_suppkey").alias("prefix"))
    )
    roots = region.select(key("r", "r_regionkey").alias("router"), F.concat(F.lit("/"), F.lower("r_name")).alias("route"))
    from ripplemark.operators.routes import mounted

    return mounted(roots, mounts)


# reach


def _live(spark, sf_dir):
    return virtual.calls(spark, sf_dir).where("status <> 'removed'").select("caller", "callee")


def _origins(spark, sf_dir):
    return virtual.functions(spark, sf_dir).where("change = 'changed'").select("node")


def _each(spark, sf_dir):
    return graph.upstream_of_each(_live(spark, sf_dir), _origins(spark, sf_dir), HOPS)


def _entries(spark, sf_dir, each):
    nodes = virtual.functions(spark, sf_dir).join(each.select("node").distinct(), "node", "left_semi")
    return graph.entry_points(nodes, _live(spark, sf_dir), graph.entry_kind())


@query(f"WITH RECURSIVE {GRAPH_SQL}, {EACH_SQL} SELECT node, min(distance)::INT AS level FROM each WHERE distance <= 3 GROUP BY node")
def reach_bounded(spark, sf_dir):
    return graph.upstream(_live(spark, sf_dir), _origins(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, r(node) AS (SELECT node FROM origins UNION SELECT c.caller FROM r JOIN calls c ON c.callee = r.node) SELECT node FROM r""")
def reach_cyclic(spark, sf_dir):
    return graph.upstream(virtual.calls(spark, sf_dir), _origins(spark, sf_dir)).select("node")


@query(f"WITH RECURSIVE {GRAPH_SQL}, {EACH_SQL} SELECT * FROM each")
def reach_of_each(spark, sf_dir):
    return _each(spark, sf_dir)


@query(f"WITH RECURSIVE {GRAPH_SQL}, {EACH_SQL} SELECT origin, node FROM each WHERE distance > 0")
def upstream_sets(spark, sf_dir):
    return _each(spark, sf_dir).where("distance > 0").select("origin", "node")


_CHAIN_SQL = f"""{GRAPH_SQL}, ch(node, distance, chain) AS (
  SELECT node, 0, [node] FROM origins
  UNION ALL
  SELECT * FROM (SELECT l.caller, c.distance + 1, min(list_append(c.chain, l.caller)) FROM ch c JOIN live l ON l.callee = c.node
    WHERE c.distance < 6 GROUP BY l.caller, c.distance + 1)),
best AS (SELECT node, min(distance) AS d FROM ch GROUP BY node)"""


@query(f"WITH RECURSIVE {_CHAIN_SQL} SELECT ch.node, ch.distance::INT AS distance, min(ch.chain) AS chain FROM ch JOIN best ON best.node = ch.node AND best.d = ch.distance GROUP BY ch.node, ch.distance")
def nearest_change(spark, sf_dir):
    return graph.nearest_origin(_live(spark, sf_dir), _origins(spark, sf_dir), 6)


@query(f"WITH RECURSIVE {GRAPH_SQL}, {EACH_SQL} SELECT node, kind FROM entries")
def entry_points(spark, sf_dir):
    return _entries(spark, sf_dir, _reached(spark, sf_dir)).select("node", "kind")


@query("""WITH a AS (SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_partkey = s_suppkey * 7)
SELECT 'o:' || o_orderkey AS node, 0 AS rank FROM orders UNION ALL SELECT 'c:' || c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 ELSE 0 END FROM customer
UNION ALL SELECT 'n:' || n_nationkey, coalesce((SELECT max(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 2 ELSE 1 END) FROM customer WHERE c_nationkey = n_nationkey), 0) FROM nation
UNION ALL SELECT 'r:' || r_regionkey, coalesce((SELECT max(1 + coalesce((SELECT max(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 2 ELSE 1 END) FROM customer WHERE c_nationkey = n_nationkey), 0)) FROM nation WHERE n_regionkey = r_regionkey), 0) FROM region""")
def longest_rank(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    edges = (
        orders.select(key("o:", "o_orderkey").alias("caller"), key("c:", "o_custkey").alias("callee"))
        .unionByName(customer.select(key("c:", "c_custkey").alias("caller"), key("n:", "c_nationkey").alias("callee")))
        .unionByName(nation.select(key("n:", "n_nationkey").alias("caller"), key("r:", "n_regionkey").alias("callee")))
    )
    nodes = (
        orders.select(key("o:", "o_orderkey").alias("node"))
        .unionByName(customer.select(key("c:", "c_custkey").alias("node")))
        .unionByName(nation.select(key("n:", "n_nationkey").alias("node")))
        .unionByName(region.select(key("r:", "r_regionkey").alias("node")))
    )
    return graph.ranks(edges, nodes)


def _reached(spark, sf_dir):
    reach = graph.upstream(_live(spark, sf_dir), _origins(spark, sf_dir), HOPS)
    return virtual.functions(spark, sf_dir).join(reach.select("node"), "node", "left_semi")


@query(f"WITH RECURSIVE {GRAPH_SQL}, {EACH_SQL} SELECT count(DISTINCT node) AS functions, count(DISTINCT path) AS files, count(DISTINCT package) AS packages FROM reached")
def reach_totals(spark, sf_dir):
    return aggregates.reach_totals(_reached(spark, sf_dir))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {EACH_SQL} SELECT package, count(DISTINCT node) AS functions, count(DISTINCT path) AS files FROM reached GROUP BY package")
def reach_by_package(spark, sf_dir):
    return aggregates.reach_by_package(_reached(spark, sf_dir))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {EACH_SQL} SELECT kind, count(*) AS n FROM entries GROUP BY kind")
def entries_by_kind(spark, sf_dir):
    return aggregates.entries_by_kind(_entries(spark, sf_dir, _reached(spark, sf_dir)))


def _symbols(spark, sf_dir):
    live = Written(_live(spark, sf_dir))
    each = graph.reached(live.df, _origins(spark, sf_dir), HOPS)
    functions = virtual.functions(spark, sf_dir)  # entries that no function reaches are not counted
    found = aggregates.symbol_summary(each, functions, live.df, graph.entry_points(functions, live.df, graph.entry_kind()))
    live.drop()
    for done in each.kept if isinstance(each, graph.Reached) else [each.kept]:
        done.drop()
    return found


_SYMBOLS_SQL = f"WITH RECURSIVE {GRAPH_SQL}, {EACH_SQL}"


@query(f"{_SYMBOLS_SQL} SELECT id, reach_functions, reach_files, reach_packages, reach_entries, array_to_string(called_from_packages, ',') AS called_from FROM symbols")
def symbol_summary(spark, sf_dir):
    return _symbols(spark, sf_dir).withColumn("called_from", F.array_join("called_from_packages", ",")).drop("called_from_packages")


@query(f"{_SYMBOLS_SQL} SELECT id, reach_functions FROM symbols ORDER BY reach_functions DESC, id LIMIT 15")
def topk_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir).select("id", "reach_functions").orderBy(F.desc("reach_functions"), "id").limit(15)


@query(f"""WITH {GRAPH_SQL} SELECT a.package AS from_package, b.package AS to_package, count(*) AS calls, count(*) FILTER (status <> 'unchanged') AS changed_calls, count(b.route) AS routes
FROM calls JOIN functions a ON a.node = caller JOIN functions b ON b.node = callee WHERE a.package <> b.package GROUP BY ALL""")
def package_crossings(spark, sf_dir):
    return aggregates.package_crossings(virtual.calls(spark, sf_dir), virtual.functions(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, e AS (SELECT a.package AS caller, b.package AS callee, status,
  CASE status WHEN 'unchanged' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END AS r FROM calls JOIN functions a ON a.node = caller JOIN functions b ON b.node = callee WHERE a.package <> b.package)
SELECT caller, callee, arg_max(status, r) AS status, count(*) AS n FROM e GROUP BY ALL""")
def lod_edges(spark, sf_dir):
    into = virtual.functions(spark, sf_dir).select("node", F.col("package").alias("group"))
    return graph.folded(virtual.calls(spark, sf_dir), into)


@query(f"""WITH {GRAPH_SQL} SELECT package, CASE WHEN bool_and(change = 'added') THEN 'added' WHEN bool_and(change = 'removed') THEN 'removed'
  WHEN bool_or(change <> 'unchanged') THEN 'changed' ELSE 'unchanged' END AS status, count(*) AS functions, count(DISTINCT path) AS files FROM functions GROUP BY package""")
def lod_nodes(spark, sf_dir):
    return graph.folded_nodes(virtual.functions(spark, sf_dir).withColumn("status", F.col("change")), ["package"])


@query(f"""WITH {GRAPH_SQL}, l AS (SELECT change, list_sort(list(label)) AS a FROM functions GROUP BY change)
SELECT change, array_to_string(a[1:4], ', ') || CASE WHEN len(a) > 4 THEN ' (+' || (len(a) - 4) || ' more)' ELSE '' END AS line FROM l""")
def impact_line(spark, sf_dir):
    return aggregates.names_line(virtual.functions(spark, sf_dir), "change", "label")


# rules


def _facts(spark, sf_dir):
    fn = virtual.functions(spark, sf_dir).select(F.col("node").alias("id"), F.col("label").alias("name"), "path", "change", "exported", "route")
    s = _symbols(spark, sf_dir).withColumnsRenamed({"called_from_packages": "importing_packages", "reach_entries": "entries"})
    return fn.join(s, "id").withColumns({"line": F.lit(1), "excerpt": F.lit("")})


_TIERS = """
presets = []
[[risk]]
name = "wide"
kind = "symbol"
severity = "high"
where = ["change != added", "public", "importing_packages >= 24"]
title = "{name} from {importing_packages}"
[[risk]]
name = "wide"
kind = "symbol"
severity = "low"
where = ["change == changed", "reach_packages >= 3"]
title = "{name} in {reach_packages}"
[[risk]]
name = "hidden"
kind = "symbol"
severity = "medium"
where = ["!exported"]
title = "{name}{called_from}"
"""


@query(f"""{_SYMBOLS_SQL}, f AS (SELECT s.*, f.label, f.path, f.exported, f.route, len(called_from_packages) AS n FROM symbols s JOIN functions f ON f.node = s.id)
SELECT 'wide' AS rule, CASE WHEN (route IS NOT NULL OR exported AND n > 0) AND n >= 24 THEN 'high' ELSE 'low' END AS severity,
  label || CASE WHEN (route IS NOT NULL OR exported AND n > 0) AND n >= 24 THEN ' from ' || n ELSE ' in ' || reach_packages END AS title, path, 1 AS line, id AS function, '' AS excerpt
FROM f WHERE (route IS NOT NULL OR exported AND n > 0) AND n >= 24 OR reach_packages >= 3
UNION ALL SELECT 'hidden', 'medium', label || CASE WHEN n > 0 THEN '; called from ' || array_to_string(called_from_packages, ', ') ELSE '' END, path, 1, id, '' FROM f WHERE NOT exported""")
def symbol_tiers(spark, sf_dir):
    return rules.symbol_findings(_facts(spark, sf_dir), rules.load(_TIERS))


_LINE_RULES = """
presets = []
[[risk]]
name = "long-word"
kind = "line"
severity = "medium"
pattern = '''(?P<w>[A-Za-z]{14,})'''
unless = '''^(?:The|An)'''
title = "word {w}"
[[risk.variant]]
pattern = '''Licensed|License'''
severity = "low"
title = "licence"
[[risk]]
name = "key"
kind = "line"
severity = "high"
fold = true
pattern = '''AKIA[0-9A-Z]{16}|token = '''
title = "secret in a line"
"""
_LINE_SQL = f"""{LINES_SQL}, added AS (SELECT path, idx + 1 AS line, line AS text FROM head WHERE (doc_id + idx) % 7 = 0),
hit AS (SELECT 'long-word' AS rule, CASE WHEN regexp_matches(text, 'Licensed|License') THEN 'low' ELSE 'medium' END AS severity,
  CASE WHEN regexp_matches(text, 'Licensed|License') THEN 'licence' ELSE 'word ' || regexp_extract(text, '[A-Za-z]{{14,}}') END AS title, path, line, trim(text) AS excerpt
  FROM added WHERE regexp_matches(text, '[A-Za-z]{{14,}}') AND NOT regexp_matches(regexp_extract(text, '[A-Za-z]{{14,}}'), '^(?:The|An)')
  UNION ALL SELECT 'key', 'high', 'secret in a line', path, line, trim(text) FROM added WHERE regexp_matches(text, 'AKIA[0-9A-Z]{{16}}|token = '))"""


def _line_hits(spark, sf_dir):
    _, head = virtual.lines(spark, sf_dir)
    added = head.where((F.col("doc_id") + F.col("idx")) % 7 == 0).select("path", (F.col("idx") + 1).alias("line"), F.col("line").alias("text"))
    nothing = spark.createDataFrame([], "id string, name string, path string, start_line int, end_line int")
    return rules.line_findings(added, nothing, rules.load(_LINE_RULES)), rules.load(_LINE_RULES)


@query(f"WITH {_LINE_SQL} SELECT rule, severity, title, path, line::INT AS line, md5(excerpt) AS excerpt FROM hit")
def line_rule_added(spark, sf_dir):
    return _line_hits(spark, sf_dir)[0].drop("function").withColumn("excerpt", F.md5("excerpt"))


@query(f"WITH {_LINE_SQL} SELECT rule, severity, count(*) AS n FROM hit GROUP BY ALL")
def variants(spark, sf_dir):
    return _line_hits(spark, sf_dir)[0].groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


_FOLDED_SQL = """w AS (SELECT *, row_number() OVER (PARTITION BY rule, path, severity ORDER BY line, title) AS k, count(*) OVER (PARTITION BY rule, path, severity) AS n FROM hit),
fo AS (SELECT rule, severity, CASE WHEN rule = 'key' AND n > 1 THEN title || ' (+' || (n - 1) || ' more like it in this file)' ELSE title END AS title, path, line FROM w WHERE rule <> 'key' OR k = 1)"""


@query(f"WITH {_LINE_SQL}, {_FOLDED_SQL} SELECT rule, severity, title, path, line::INT AS line FROM fo")
def fold_findings(spark, sf_dir):
    found, with_rules = _line_hits(spark, sf_dir)
    return rules.finish([found], with_rules).drop("function", "excerpt")


@query(f"WITH {_LINE_SQL}, {_FOLDED_SQL} SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM fo")
def severity_counts(spark, sf_dir):
    found, with_rules = _line_hits(spark, sf_dir)
    return findings.counts(rules.finish([found], with_rules))


@query(f"WITH {_LINE_SQL} SELECT coalesce(bool_or(severity IN ('high', 'medium')), false) AS fails FROM hit")
def fail_gate(spark, sf_dir):
    return findings.fails(_line_hits(spark, sf_dir)[0], "medium")


@query(f"""WITH {_LINE_SQL}, d AS (SELECT * FROM hit UNION ALL SELECT rule, 'low', 'again ' || title, path, line, excerpt FROM hit),
k AS (SELECT *, row_number() OVER (PARTITION BY rule, path, line ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, title) AS r FROM d)
SELECT rule, severity, title, path, line::INT AS line FROM k WHERE r = 1""")
def dedup_findings(spark, sf_dir):
    found, _ = _line_hits(spark, sf_dir)
    again = found.withColumns({"severity": F.lit("low"), "title": F.concat(F.lit("again "), F.col("title"))})
    return findings.without_repeats(found.unionByName(again)).drop("function", "excerpt")


_REACH_RULE = """
presets = []
[[risk]]
name = "currency"
kind = "line"
scope = "reach"
severity = "low"
pattern = '''(?:^|[^A-Za-z0-9_])[a-z]{12,}(?:$|[^A-Za-z0-9_])'''
title = "long word{in_function}"
"""


@query(f"""WITH {LINES_SQL}, l AS (SELECT path, idx + 1 AS line, line AS text, idx // 5 AS f FROM head),
h AS (SELECT path, f, min(line) AS line FROM l WHERE regexp_matches(text, '(?:^|[^A-Za-z0-9_])[a-z]{{12,}}(?:$|[^A-Za-z0-9_])') GROUP BY ALL)
SELECT 'currency' AS rule, 'low' AS severity, 'long word in f' || f AS title, path, line::INT AS line, path || '::' || f AS function FROM h""")
def line_rule_reach(spark, sf_dir):
    _, head = virtual.lines(spark, sf_dir)
    # classes of ASCII in place of word boundaries, which dialects read differently beyond ASCII
    text = head.select("path", (F.col("idx") + 1).alias("line"), F.col("line").alias("text"))
    f = F.floor(F.col("idx") / 5).cast("int")
    functions = head.select("path", f.alias("f")).distinct().select(
        F.concat("path", F.lit("::"), F.col("f").cast("string")).alias("id"), F.concat(F.lit("f"), F.col("f").cast("string")).alias("name"), "path",
        (F.col("f") * 5 + 1).alias("start_line"), (F.col("f") * 5 + 5).alias("end_line"),
    )
    return rules.reach_findings(text, functions, rules.load(_REACH_RULE)).drop("excerpt")


_SET_RULE = """
presets = []
[[set]]
name = "starts"
paths = '''^benchmark/'''
patterns = ['''(?m)^([A-Z][a-z]+)''']
[[risk]]
name = "starts-alike"
kind = "sql"
paths = '''.'''
severity = "medium"
pattern = '''^(?P<w>[A-Z][a-z]+)'''
in_set = { capture = "w", set = "starts" }
skip_new_tables = false
title = "begins with {w}"
"""


@query(r"""WITH s AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '(?m)^([A-Z][a-z]+)', 1))) AS v FROM benchmark)
SELECT 'begins with ' || regexp_extract(text, '^[A-Z][a-z]+') AS title, doc_id::VARCHAR AS path FROM documents
WHERE lower(regexp_extract(text, '^[A-Z][a-z]+')) IN (SELECT v FROM s)""")
def set_membership(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    statements = docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("line"), F.col("text").alias("statement"), F.lit("").alias("excerpt"), F.lit(True).alias("added"))
    files = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), "text")
    # in these texts a word is ASCII; the shared dialect makes classes like [a-z] ASCII anyway
    return rules.sql_findings(statements, files, rules.load(_SET_RULE)).select("title", "path")


_NEW_TABLE_RULE = """
presets = []
[[risk]]
name = "index"
kind = "sql"
paths = '''.'''
severity = "medium"
pattern = '''(?is)^\\s*create\\s+index\\s+on\\s+(?P<table>\\w+)'''
title = "index on {table}"
"""


@query("""SELECT 'index on c' || o_custkey AS title, 'seg' || (o_custkey % 100) AS path, o_orderkey::INT AS line FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')""")
def new_table_antijoin(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    row = lambda key, line, text: [
        F.concat(F.lit("seg"), (F.col(key) % 100).cast("string")).alias("path"), F.col(line).cast("int").alias("line"),
        F.concat(F.lit(text), F.col(key).cast("string")).alias("statement"), F.lit("").alias("excerpt"), F.lit(True).alias("added"),
    ]
    indexes = orders.select(*row("o_custkey", "o_orderkey", "CREATE INDEX ON c"))
    created = customer.where("c_mktsegment = 'BUILDING'").select(*row("c_custkey", "c_custkey", "CREATE TABLE c"))
    nothing = spark.createDataFrame([], "path string, text string")
    return rules.sql_findings(indexes.unionByName(created), nothing, rules.load(_NEW_TABLE_RULE)).select("title", "path", "line")


@query("""WITH r AS (SELECT event_id, lower(event_type) AS tool, 'k' || (props::JSON ->> '$.k') AS rule_id, 'f' || (user_id % 50) AS path, (event_id % 20)::INT AS line, value FROM events),
a AS (SELECT DISTINCT 'f' || (user_id % 50) AS path, (event_id % 20)::INT AS line FROM events WHERE value > 50)
SELECT tool || '/' || rule_id AS rule, CASE WHEN value > 90 THEN 'medium' ELSE 'low' END AS severity, path, line, count(*) AS n
FROM r SEMI JOIN a USING (path, line) GROUP BY ALL""")
def external_results(spark, sf_dir):
    from ripplemark.sources.sarif import on_added_lines

    events = table(spark, sf_dir, "events")
    path, line = F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("path"), (F.col("event_id") % 20).cast("int").alias("line")
    results = events.select(
        F.col("event_type").alias("tool"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("rule_id"),
        F.when(F.col("value") > 90, "error").otherwise("note").alias("level"), F.lit("").alias("message"), path, line,
    )
    added = events.where("value > 50").select(path, line, F.lit("").alias("text"))
    return on_added_lines(results, added).groupBy("rule", "severity", "path", "line").agg(F.count(F.lit(1)).alias("n"))


# seen marks

_HUNKS_SQL = f"""{LINES_SQL}, hk AS (SELECT path, idx, doc_id, md5(line) || CASE WHEN row_number() OVER (PARTITION BY path, md5(line) ORDER BY idx) > 1
  THEN '#' || (row_number() OVER (PARTITION BY path, md5(line) ORDER BY idx) - 1) ELSE '' END AS key, 1 + idx % 3 AS changed FROM head)"""


def _hunks(spark, sf_dir):
    _, head = virtual.lines(spark, sf_dir)
    return aggregates.hunk_keys(head.withColumn("changed", (1 + F.col("idx") % 3).cast("long")), "line", "idx")


@query(f"WITH {_HUNKS_SQL} SELECT path, idx, key FROM hk")
def hunk_keys(spark, sf_dir):
    return _hunks(spark, sf_dir).select("path", "idx", "key")


_PROGRESS_SQL = f"""{_HUNKS_SQL}, sn AS (SELECT path, key, unnest(range(changed + 1)) AS line FROM hk WHERE (doc_id + idx) % 2 = 0 OR doc_id % 5 = 0),
mk AS (SELECT path, key, count(DISTINCT line) AS n FROM sn GROUP BY ALL),
pr AS (SELECT hk.path, sum(least(coalesce(n, 0), changed))::BIGINT AS seen, sum(changed)::BIGINT AS total FROM hk LEFT JOIN mk ON mk.path = hk.path AND mk.key = hk.key GROUP BY hk.path)"""


def _progress(spark, sf_dir):
    hunks = _hunks(spark, sf_dir)
    marked = hunks.where(((F.col("doc_id") + F.col("idx")) % 2 == 0) | (F.col("doc_id") % 5 == 0))
    seen = marked.select("path", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("changed"))).alias("line"))
    return aggregates.progress(hunks.select("path", "key", "changed"), seen)


@query(f"WITH {_PROGRESS_SQL} SELECT path, seen, total, seen >= total AS done FROM pr")
def seen_progress(spark, sf_dir):
    return _progress(spark, sf_dir)


@query(f"WITH {_PROGRESS_SQL} SELECT path FROM pr WHERE seen >= total")
def done_files(spark, sf_dir):
    return _progress(spark, sf_dir).where("done").select("path")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, b AS (SELECT caller AS x, callee AS y FROM live UNION SELECT callee, caller FROM live),
r(node, level) AS (SELECT node, 0 FROM origins UNION SELECT b.y, r.level + 1 FROM r JOIN b ON b.x = r.node WHERE r.level < 2)
SELECT node, min(level)::INT AS level FROM r GROUP BY node""")
def undirected_distance(spark, sf_dir):
    return graph.distances(_live(spark, sf_dir), _origins(spark, sf_dir), 2)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, u(node, level) AS (SELECT node, 0 FROM origins UNION SELECT l.caller, u.level + 1 FROM u JOIN live l ON l.callee = u.node WHERE u.level < 2),
d(node, level) AS (SELECT node, 0 FROM origins UNION SELECT l.callee, d.level + 1 FROM d JOIN live l ON l.caller = d.node WHERE d.level < 2)
SELECT node, min(level)::INT AS level, CASE WHEN min(level) = 0 THEN 'origin' ELSE 'up' END AS direction FROM u GROUP BY node
UNION ALL SELECT node, min(level)::INT, 'down' FROM d GROUP BY node HAVING min(level) > 0""")
def file_graph(spark, sf_dir):
    return graph.around(_live(spark, sf_dir), _origins(spark, sf_dir), 2)[0]


@query(f"""WITH {GRAPH_SQL} SELECT DISTINCT caller, callee, status FROM calls WHERE callee IN (SELECT node FROM origins)
UNION SELECT DISTINCT caller, callee, status FROM calls WHERE caller IN (SELECT node FROM origins) AND status <> 'unchanged'""")
def visible_edges(spark, sf_dir):
    return graph.visible_edges(virtual.calls(spark, sf_dir), _origins(spark, sf_dir))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, c AS (SELECT DISTINCT caller, callee FROM calls),
u0(node, level) AS (SELECT node, 0 FROM origins UNION SELECT c.caller, u0.level + 1 FROM u0 JOIN c ON c.callee = u0.node WHERE u0.level < 3),
d0(node, level) AS (SELECT node, 0 FROM origins UNION SELECT c.callee, d0.level + 1 FROM d0 JOIN c ON c.caller = d0.node WHERE d0.level < 3),
u AS (SELECT node, min(level) AS level FROM u0 GROUP BY node), d AS (SELECT node, min(level) AS level FROM d0 GROUP BY node),
up AS (SELECT u.node, min(p.node) AS parent FROM u JOIN c ON c.caller = u.node JOIN u AS p ON p.node = c.callee AND p.level = u.level - 1 GROUP BY u.node),
dn AS (SELECT d.node, min(p.node) AS parent FROM d JOIN c ON c.callee = d.node JOIN d AS p ON p.node = c.caller AND p.level = d.level - 1
       WHERE d.node NOT IN (SELECT node FROM u) GROUP BY d.node),
newly AS (SELECT callee FROM calls JOIN functions f ON f.node = caller AND f.change = 'changed' WHERE status <> 'unchanged'),
kept AS (SELECT * FROM up UNION ALL SELECT dn.* FROM dn JOIN functions f ON f.node = dn.node WHERE f.change <> 'unchanged' OR dn.node IN (SELECT callee FROM newly)),
v(node) AS (SELECT node FROM origins UNION SELECT kept.node FROM v JOIN kept ON kept.parent = v.node)
SELECT node FROM v""")
def visible_nodes(spark, sf_dir):
    edges = cut(virtual.calls(spark, sf_dir))
    nodes = virtual.functions(spark, sf_dir).select("node", F.col("change").alias("status"))
    return graph.visible_nodes(nodes, edges, graph.revealed(edges, _origins(spark, sf_dir), 3))


@query("""SELECT 'o' || o_orderkey AS idx, 'x' AS path, 2 AS depth FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'c' || c_custkey, 'x', 1 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'x', 0 FROM nation""")
def nesting_depth(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    units = (
        orders.select(key("o", "o_orderkey").alias("idx"), key("c", "o_custkey").alias("parent"))
        .unionByName(customer.select(key("c", "c_custkey").alias("idx"), key("n", "c_nationkey").alias("parent")))
        .unionByName(nation.select(key("n", "n_nationkey").alias("idx"), F.lit(None).cast("string").alias("parent")))
    )
    return graph.depths(units.withColumn("path", F.lit("x")))


@query(r"""WITH w AS (SELECT source, min(regexp_extract(lower(text), '^([a-z]+) ', 1)) AS alias FROM documents WHERE regexp_matches(lower(text), '^[a-z]+ ') GROUP BY source),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, alias, count(DISTINCT line) AS n FROM l JOIN w USING (source) GROUP BY ALL""")
def reference_callers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = F.regexp_extract(F.lower("text"), "^([a-z]+) ", 1)
    names = docs.where(first != "").groupBy("source").agg(F.min(first).alias("alias"))
    lines = docs.select("doc_id", "source", F.explode(F.split("text", "\n", -1)).alias("line"))
    said = lines.join(names, "source").select(
        "doc_id", "source", "line", F.concat("line", F.lit(" see "), "alias", F.lit(".run( and "), "alias", F.lit(".stop, not x."), "alias", F.lit(".run")).alias("text")
    )
    found = joins.text_references(said, names.withColumn("label", F.lit("run")), ["source"])
    return found.groupBy("doc_id", "alias").agg(F.count_distinct("line").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which changed functions reach furthest."""
    return _symbols(spark, sf_dir).orderBy(F.desc("reach_functions"), "id")
