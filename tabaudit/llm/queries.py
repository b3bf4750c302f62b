"""The queries of the numbered operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm import (
    collocations,
    decontamination,
    divergence,
    exact_dedup,
    fingerprints,
    language_id,
    license_scan,
    merge_dropout,
    near_dedup,
    packing,
    quality,
    secret_scan,
    warc,
)
from tabaudit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge_dropout.decoded(merge_dropout.encoded(table(spark, sf_dir, "documents")))
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return rows.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_ids"),
        decoded.alias("decoded_sha256"),
        (decoded == F.col("text_sha256")).alias("lossless"),
    )


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op4_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS body FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256
FROM d
WINDOW same AS (PARTITION BY body)
"""


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


# Kind, role, pattern of a run, group to measure, least length.
_SECRET_KINDS = (
    ("assign", "secret", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", r"[0-9a-f]+", 0, 24),
    ("login", "access", r"""((?i:client_?id|user_?name|user|login|account))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9_.@-]+)""", 2, 3),
    ("endpoint", "endpoint", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9.:@/?&=_%#~-]+", 0, 8),
    ("blob", "secret", r"[A-Za-z0-9+/_=-]+", 0, 32),
)
_SECRET_HITS = " UNION ALL ".join(
    f"""SELECT doc_id, {number} AS kind, '{name}' AS name, '{role}' AS role, {least} AS least,
    regexp_extract_all(body, '{pattern}') AS m, regexp_extract_all(body, '{pattern}', {part}) AS v,
    string_split_regex(body, '{pattern}') AS g FROM d"""
    for number, (name, role, pattern, part, least) in enumerate(_SECRET_KINDS)
)

SQL["op6_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
hits AS ({_SECRET_HITS}),
each AS (SELECT doc_id, kind, name, role, least, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM hits),
placed AS (
  SELECT doc_id, kind, name, role, least, length(m[i]) AS size, length(v[i]) AS part,
         sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM each),
found AS (SELECT doc_id, kind, name, role, stop - size AS start, stop FROM placed WHERE part >= least),
base AS (SELECT * FROM found WHERE kind < 3),
weak AS (
  SELECT w.* FROM found w WHERE kind >= 3
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start < w.stop AND w.start < b.stop)
  AND EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.role <> w.role
              AND b.start - w.stop <= 300 AND w.start - b.stop <= 300)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
lists AS (
  SELECT doc_id,
         count(*) FILTER (WHERE kind = 0) AS n_assign,
         count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(concat(name, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3) AS base_spans,
         string_agg(concat(name, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, kind, stop) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id,
       coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id
"""


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


# SHA-1 in base 32: each letter stands for five of the 160 bits, four hexadecimal digits hold 16 of them.
SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (
  SELECT page_id, payload,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           ((CAST(concat('0x', substr(concat(hex, '00'), 1 + (5 * i) // 4, 2)) AS INTEGER) >> (3 - (5 * i) % 4)) & 31)
           AS INTEGER), 1)), '') AS payload_digest
  FROM p)
SELECT page_id,
       CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       payload_digest,
       CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM q
WINDOW same AS (PARTITION BY payload)
"""


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# Every window is compared at every place of every document whose word there is the window's first.
SQL["op11_decontamination"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
b AS (
  SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + least(len(w), 10)) AS win FROM s),
p AS (SELECT r, w, unnest(range(0, len(w))) AS pos FROM d),
m AS (
  SELECT p.r, p.pos, len(win.win) AS size, win.item_id
  FROM p JOIN win ON p.w[p.pos + 1] = win.win[1]
  WHERE p.pos + len(win.win) <= len(p.w) AND list_slice(p.w, p.pos + 1, p.pos + len(win.win)) = win.win),
hit AS (SELECT DISTINCT r, unnest(range(pos, pos + size)) AS at FROM m),
nh AS (SELECT r, count(*) AS n_hit FROM hit GROUP BY r),
it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r)
SELECT d.doc_id,
       CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(coalesce(nh.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(nh.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh ON d.r = nh.r LEFT JOIN it ON d.r = it.r
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


# Every phrase of 1 to 4 words at every place of every piece is counted; then the same rules in SQL.
SQL["op12_collocations"] = f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents),
pc AS (SELECT lang, unnest(ps) AS piece FROM d),
pw AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pc),
ps AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pw),
ng AS (
  SELECT lang, m AS nw, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM ps, (VALUES (1), (2), (3), (4)) t(m) WHERE i + m - 1 <= len(w)),
freq AS (SELECT lang, nw, phrase, count(*) AS f FROM ng GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, count(*) AS n FROM ps GROUP BY lang),
cand AS (SELECT lang, phrase, nw, f AS a, string_split(phrase, ' ') AS ws FROM freq WHERE nw >= 2),
ck AS (SELECT *, unnest(range(1, nw)) AS k FROM cand),
cuts AS (
  SELECT c.lang, c.phrase, c.nw, c.a, c.k, l.f AS l, r.f AS r,
         CAST(2000000 AS HUGEINT) * c.a // (l.f + r.f) AS score
  FROM ck c
  JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.ws, 1, c.k), ' ')
  JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.ws, c.k + 1, c.nw), ' ')),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
sub AS (
  SELECT c.lang, array_to_string(list_slice(c.ws, i + 1, i + m), ' ') AS phrase, c.a AS wrap
  FROM cand c, range(0, 3) t1(i), range(2, 4) t2(m) WHERE c.nw >= 3 AND i + m <= c.nw AND m < c.nw),
cov AS (SELECT lang, phrase, max(wrap) AS wrap FROM sub GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN cov ON b.lang = cov.lang AND b.phrase = cov.phrase
  WHERE cov.wrap IS NULL OR CAST(cov.wrap AS HUGEINT) * 100 < CAST(b.a AS HUGEINT) * 80),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN total t ON r.lang = t.lang
WHERE rank <= 2000
"""


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


# Dense: every group gets every kept term of its language, and every pair of sources compares all of them.
SQL["op13_divergence"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents),
occ AS (SELECT r, lang, source, unnest(t) AS term FROM d),
vocab AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
vs AS (SELECT lang, count(*) AS v FROM vocab GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM occ o JOIN vocab v ON o.lang = v.lang AND o.term = v.term GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c
  FROM grp g JOIN vocab v ON g.lang = v.lang
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
gt AS (SELECT lang, source, sum(c) AS n FROM dense GROUP BY ALL),
pg AS (
  SELECT x.lang, x.source, x.term, x.c, 1 + (CAST(1000000000 AS HUGEINT) * (x.c + 2)) // (gt.n + 2 * vs.v) AS p
  FROM dense x JOIN gt ON x.lang = gt.lang AND x.source = gt.source JOIN vs ON x.lang = vs.lang),
lt AS (SELECT lang, term, sum(c) AS c FROM dense GROUP BY ALL),
ln AS (SELECT lang, sum(c) AS n FROM lt GROUP BY lang),
pl AS (
  SELECT lt.lang, lt.term, 1 + (CAST(1000000000 AS HUGEINT) * (lt.c + 2)) // (ln.n + 2 * vs.v) AS q
  FROM lt JOIN ln ON lt.lang = ln.lang JOIN vs ON lt.lang = vs.lang),
ps AS (
  SELECT a.lang, a.source AS g, b.source AS h, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS s
  FROM pg a JOIN pg b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(ps.s, 0) AS BIGINT) AS value
  FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN ps ON ps.lang = x.lang AND ps.g = x.source AND ps.h = y.source),
term AS (
  SELECT pg.lang, pg.source, 'term' AS part, pg.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM pg JOIN pl ON pg.lang = pl.lang AND pg.term = pl.term WHERE pg.c > 0 AND p > q),
every AS (SELECT * FROM pair UNION ALL SELECT * FROM term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
