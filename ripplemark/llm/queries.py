"""The registered queries of this subpackage, and their SQL where SQL can express them.

Each takes (spark, sf_dir) and covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as _decontaminate
from . import exact_dedup as _exact
from . import hmm as _hmm
from . import html_text as _html
from . import licenses as _licenses
from . import mixing as _mixing
from . import quality as _quality
from . import secrets as _secrets
from . import simhash as _simhash
from . import warc as _warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.rate(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _quality.label_grade(), _quality.N_GRADES
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    ).drop("items")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licenses.scan(_table(spark, sf_dir, "documents"), path=_licenses.document_path())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.digest_of(_secrets.scan(_table(spark, sf_dir, "documents")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.extract(_table(spark, sf_dir, "pages"))


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _warc.resolve_revisits(_warc.captures(_table(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "url", "response_id", "outcome", F.array_join(pairs, ";").alias("headers"))


def op9_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hmm.score(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.near_components(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bp AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM bp),
ns AS (SELECT DISTINCT n FROM bg),
dp AS (SELECT doc_id, r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, ns WHERE len(w) >= n),
h AS (SELECT dp.r, dp.p, dp.n, bg.item FROM dp JOIN bg ON bg.n = dp.n AND bg.g = array_to_string(dp.w[dp.p : dp.p + dp.n - 1], ' ')),
hw AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS i FROM h) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(hw.n_hit, 0)::BIGINT AS n_hit,
       coalesce(hi.n_items, 0)::BIGINT AS n_items, sha256(coalesce(hi.items, '')) AS items_sha256,
       hw.r IS NOT NULL AS contaminated
FROM dw LEFT JOIN hw ON dw.r = hw.r LEFT JOIN hi ON dw.r = hi.r
"""

def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]::VARCHAR[]"


_TEMPLATE_ROWS = ", ".join(
    "({}, '{}', '{}', {}, {}, {})".format(i, t.license, t.text.replace("'", "''"), _sql_list(t.needs), _sql_list(t.refuses), t.rank)
    for i, t in enumerate(_licenses.TEMPLATES)
)
OP3_SQL = rf"""
WITH tpl(nth, license, body, needs, refuses, rank) AS (VALUES {_TEMPLATE_ROWS}),
tc AS (SELECT nth, license, term, count(*) AS n
       FROM (SELECT nth, license, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM tpl) GROUP BY ALL),
ref AS (SELECT nth, license, unnest(refuses) AS term FROM tpl),
voc AS (SELECT term FROM tc UNION SELECT term FROM ref UNION SELECT unnest(needs) FROM tpl),
d AS (SELECT doc_id, row_number() OVER () AS r,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
             concat_ws('/', source, lang, CASE WHEN doc_id % 100 <> 0 THEN 'h' || (doc_id // 100) END,
                       CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' || doc_id ELSE 'd' || doc_id || '.txt' END) AS path
      FROM documents),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS c FROM (SELECT DISTINCT r, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS term FROM d)
       WHERE term IN (SELECT term FROM voc) GROUP BY term),
idf AS (SELECT voc.term, ln((1 + n.n) / (1 + coalesce(df.c, 0))) + 1 AS idf FROM n, voc LEFT JOIN df ON df.term = voc.term),
w AS (SELECT nth, license, tc.term, tc.n * idf AS x, sqrt(sum((tc.n * idf) ** 2) OVER (PARTITION BY nth)) AS norm
      FROM tc JOIN idf ON idf.term = tc.term),
wr AS (SELECT w.*, tpl.rank, len(tpl.needs) AS needs, list_contains(tpl.needs, term)::INT AS need, 0 AS refuse FROM w JOIN tpl ON tpl.nth = w.nth
       UNION ALL SELECT ref.nth, ref.license, ref.term, 0, 1, tpl.rank, len(tpl.needs), 0, 1 FROM ref JOIN tpl ON tpl.nth = ref.nth),
u AS (SELECT r, unnest(string_split(t, chr(10))) AS body, generate_subscripts(string_split(t, chr(10)), 1) AS unit FROM d
      UNION ALL SELECT r, body, -unit FROM (
        SELECT r, unnest(string_split_regex(t, '\n[^A-Za-z0-9\n]*\n')) AS body, generate_subscripts(string_split_regex(t, '\n[^A-Za-z0-9\n]*\n'), 1) AS unit FROM d)
      WHERE contains(body, chr(10))
      UNION ALL SELECT r, t, 0 FROM d WHERE regexp_matches(path, '(^|/)(?i:licen[cs]e|copying|notice)([._-][^/]*)?$')),
ut AS (SELECT r, unit, term, count(*) AS tf
       FROM (SELECT r, unit, unnest(regexp_extract_all(body, '[a-z0-9]+')) AS term FROM u) GROUP BY ALL),
ux AS (SELECT r, unit, ut.term, tf * coalesce(idf, ln(1 + n.n) + 1) AS x FROM n, ut LEFT JOIN idf ON idf.term = ut.term),
un AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY r, unit)) AS norm FROM ux),
co AS (SELECT r, unit, nth, license, rank, sum(un.x * w.x / w.norm) / any_value(un.norm) AS cosine
       FROM un JOIN wr AS w ON w.term = un.term GROUP BY r, unit, nth, license, rank
       HAVING cosine >= 0.7 AND sum(need) = any_value(needs) AND sum(refuse) = 0),
own AS (SELECT r, arg_max(license, (rank, round(cosine, 9), license)) AS license, arg_max(round(cosine, 9), (rank, round(cosine, 9), license)) AS cosine FROM co GROUP BY r),
f AS (SELECT d.r, d.doc_id, d.path, regexp_extract(d.path, '^(.*)/[^/]*$', 1) AS dir, own.license, own.cosine,
             regexp_matches(path, '(^|/)(?i:licen[cs]e|copying|notice)([._-][^/]*)?$') AS is_license FROM d LEFT JOIN own ON own.r = d.r),
de AS (SELECT dir AS up, arg_max(license, (cosine, license)) AS license, max(cosine) AS cosine FROM f
       WHERE is_license AND license IS NOT NULL GROUP BY dir),
inh AS (SELECT x.dir, arg_max(de.up, length(de.up)) AS up, arg_max(de.license, length(de.up)) AS license, arg_max(de.cosine, length(de.up)) AS cosine
        FROM (SELECT DISTINCT dir FROM f) x JOIN de ON de.up = x.dir OR starts_with(x.dir, de.up || '/') OR de.up = '' GROUP BY x.dir)
SELECT f.doc_id, f.path, coalesce(f.license, inh.license) AS license, round(coalesce(f.cosine, inh.cosine), 6) AS cosine,
       CASE WHEN f.license IS NOT NULL THEN 'own' WHEN inh.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN f.license IS NULL THEN inh.up END AS from_directory
FROM f LEFT JOIN inh ON inh.dir = f.dir
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t),
n AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t, doc_id) AS nth FROM d)
SELECT n.doc_id, g.keep_id, g.group_size,
       (n.doc_id IS NOT DISTINCT FROM g.keep_id) AND n.nth = 1 AS kept,
       sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, row_number() OVER () AS row_id,
         CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS skey,
         md5(coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (SELECT skey, source_size, 3 * source_size AS cap,
             (1 + (row_number() OVER (ORDER BY skey) - 1) % 3)::BIGINT AS w FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS total_w,
             coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws
      FROM w
      WINDOW o AS (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (total_w - ws) <= w * (total - caps) AS capped FROM c),
t AS (SELECT skey, source_size,
             CASE WHEN capped THEN cap::DOUBLE ELSE
               (w * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)))::DOUBLE
               / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target
      FROM f),
q AS (SELECT d.*, t.source_size, t.target,
             sum(size) OVER (PARTITION BY d.skey ORDER BY k, doc_id, row_id
                             ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d JOIN t ON d.skey = t.skey),
i AS (SELECT row_id, skey, k, size, (turn * source_size + upto)::DOUBLE / target AS finish
      FROM q, (VALUES (0), (1), (2)) AS e(turn) WHERE size > 0),
l AS (SELECT row_id, size, sum(size) OVER (ORDER BY finish, skey, k, row_id ROWS UNBOUNDED PRECEDING) AS spent FROM i),
b AS (SELECT floor(sum(target)) AS budget FROM t),
x AS (SELECT row_id, sum(size)::BIGINT AS taken FROM l, b WHERE spent <= budget GROUP BY row_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(x.taken, 0)::BIGINT AS taken, q.source
FROM q LEFT JOIN x ON q.row_id = x.row_id
"""

OP8_SQL = r"""
WITH u AS (
  SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(trim(url), '#.*$', '') AS b FROM pages WHERE page_id IS NOT NULL),
p AS (
  SELECT page_id, html,
         lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
         regexp_replace(regexp_replace(lower(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), '^www\.', ''),
                        CASE lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '') ||
         regexp_replace(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS head,
         list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) AS q
  FROM u),
c AS (
  SELECT page_id, head || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url,
         md5(html) AS tag, length(html) AS n, page_id * 10 AS at,
         CASE WHEN page_id % 5 = 0 THEN page_id * 10 - 5 ELSE page_id * 10 + (page_id % 97 + 1) * 10 + 5 END AS later
  FROM p),
j AS (
  SELECT v.page_id, v.url, v.tag, v.later, r.page_id AS rid, r.tag AS rtag, r.n AS rn, r.at AS rat
  FROM c v ASOF LEFT JOIN c r ON v.url = r.url AND v.later > r.at)
SELECT page_id * 2 + 1 AS record_id, url, rid * 2 AS response_id,
       CASE WHEN rid IS NULL THEN 'missing' WHEN tag = rtag THEN 'resolved' ELSE 'changed' END AS outcome,
       CASE WHEN tag = rtag THEN 'cache-control=max-age=60;content-length=' || rn || ';content-type=text/html;date=' || later
         || ';etag=W/"' || tag || '";expires=' || (later + 600) END AS headers
FROM j
"""


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_decontamination": op2_decontamination,
        "op3_licenses": op3_licenses,
        "op4_secrets": op4_secrets,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_html_text": op6_html_text,
        "op7_weighted_mix": op7_weighted_mix,
        "op8_warc_revisits": op8_warc_revisits,
        "op9_hmm_score": op9_hmm_score,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": OP2_SQL,
        "op3_licenses": OP3_SQL,
        "op5_exact_dedup": OP5_SQL,
        "op7_weighted_mix": OP7_SQL,
        "op8_warc_revisits": OP8_SQL,
    }
