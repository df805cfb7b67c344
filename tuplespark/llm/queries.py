"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator with production parameters to its whole
table. SQL is given where it can express the operator; the others (op5, op6,
op9, op10 and the pipeline) are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tuplespark.llm import (audit, credentials, decontam, lines, minhash, mixing, passages, quality, runs, suffix,
                            toxicity, urls, webpage)
from tuplespark.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(table(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webpage.extract(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_minhash, op3_decontamination, op4_mixing, op5_compact_windows,
                            op6_suffix_array, op7_url_filters, op8_line_dedup, op9_toxicity, op10_html_extraction,
                            op11_periodic_runs, op12_secret_scan, op13_filter_audit)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {}

ORACLE["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM d),
tri AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
key AS (SELECT rid, i, w[i:i + 2] AS k FROM tri),
dup AS (SELECT rid, i FROM key QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
nl AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN nl USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN n_words > 100000 THEN 4 ELSE 0 END)
        + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 8 ELSE 0 END)
        + (CASE WHEN n_words > 0 AND 2 * n_symbols > n_words THEN 16 ELSE 0 END)
        + (CASE WHEN n_lines > 0 AND 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept,
  bits::BIGINT AS fail_bits FROM b"""

ORACLE["op2_minhash"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
sized AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s),
cls AS (SELECT k, min(doc_id) AS class_id, any_value(s) AS s, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY k),
e AS (SELECT class_id, n, unnest(s) AS g FROM cls),
p AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
      FROM e a JOIN e b ON a.g = b.g AND a.class_id < b.class_id GROUP BY 1, 2),
lnk AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM lnk UNION ALL SELECT b, a FROM lnk),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
root AS (SELECT class_id, least(class_id, coalesce(min(b), class_id)) AS r FROM cls LEFT JOIN reach ON a = class_id GROUP BY class_id)
SELECT doc_id, sized.n::BIGINT AS n_shingles, coalesce(r, doc_id) AS component_id, doc_id = coalesce(r, doc_id) AS kept,
  coalesce(cls.class_id, doc_id) AS class_id
FROM sized LEFT JOIN cls USING (k) LEFT JOIN root ON root.class_id = cls.class_id"""

ORACLE["op3_decontamination"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 12] AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
        FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(p) AS n FROM win),
place AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
g AS (SELECT rid, i, n, w[i:i + n - 1] AS p FROM place),
hit AS (SELECT rid, i, n, item_id FROM g JOIN win USING (p)),
cover AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS k FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)"""

ORACLE["op4_mixing"] = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens,
             coalesce(doc_id::VARCHAR, text, '') AS row_key FROM documents),
t AS (SELECT source, sum(n_tokens) AS tokens FROM d GROUP BY source),
top AS (SELECT max(tokens) AS hi, min(tokens) AS lo FROM t WHERE tokens > 0),
-- Covering budget: a source of tokens t is taken (hi / t) ** (1 - alpha) times; the smallest source exactly twice, at most.
q AS (SELECT source, tokens, CASE WHEN hi <= 2 * lo THEN round(hi)
        ELSE round(tokens * pow(hi / tokens, ln(2.0) / ln(hi::DOUBLE / lo))) END::BIGINT AS quota FROM t, top WHERE tokens > 0),
plan AS (SELECT source, (quota // tokens)::INT AS epochs, (quota % tokens)::BIGINT AS rest FROM q
         UNION ALL SELECT source, 1, 0 FROM t WHERE tokens = 0),
c AS (SELECT doc_id, source, n_tokens, epochs, rest, copy, md5('17|' || source || '|' || copy || '|' || row_key) AS order_key
      FROM (SELECT *, unnest(range(0, epochs + 1))::INT AS copy FROM d JOIN plan USING (source))),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, copy ORDER BY order_key RANGE UNBOUNDED PRECEDING) AS upto FROM c)
SELECT doc_id, source, copy, n_tokens, order_key[1:3] AS block, order_key FROM r
WHERE copy < epochs OR (rest > 0 AND upto <= rest)"""

ORACLE["op7_url_filters"] = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (SELECT page_id, host, path, rh || rp AS rule, v FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(v, length(rule)), 'allow') AS verdict
FROM hit GROUP BY page_id, host, path"""

ORACLE["op8_line_dedup"] = rf"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i
           FROM documents),
k AS (SELECT doc_id, i, line, {_LOWER.format(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS k FROM d),
many AS (SELECT k, max(doc_id) AS top FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT doc_id, i, line, top IS NULL OR top = doc_id AS stay FROM k LEFT JOIN many USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stay)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stay), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

# CRC-32 of a list of byte values {0}; t is the table of the reflected polynomial, from ``_CRC_TABLE``.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"""
_CRC = "xor(list_reduce({0}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
_BYTES = "list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT)"

ORACLE["op11_periodic_runs"] = rf"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w0,
        coalesce({_CRC.format(_BYTES.format("doc_id::VARCHAR"))}, 1) AS h FROM documents, crc),
g AS (SELECT *, len(w0) AS n, h // 10 AS g, (h // 10) % greatest(len(w0), 1) AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN w0[a + (i - a) % p + 1] ELSE w0[i + 1] END) ELSE w0 END AS w FROM p),
x AS (SELECT rid, n, unnest(w) AS x, unnest(range(0, n)) AS i FROM w),
-- Places where a word recurs q words on, for every q of which four fit into the text; neighbours form islands.
eq AS (SELECT rid, b.i - a.i AS q, a.i FROM x a JOIN x b USING (rid, x) WHERE b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isl AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM eq)
        GROUP BY rid, q, k),
run AS (SELECT rid, s, len, min(q) AS q FROM isl WHERE len >= greatest(6, 4 * q) GROUP BY rid, s, len),
sums AS (SELECT rid, count(*) AS n_runs, arg_min({{'s': s, 'len': len, 'q': q}}, [-len, s, q]) AS b,
           string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM run GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT rid, string_agg(x.x, ' ' ORDER BY i) AS txt FROM x ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length, b.q::BIGINT AS period,
  (1000 * b.len // b.q)::BIGINT AS exponent_milli, sha256(coalesce(sums.txt, '')) AS runs_sha256,
  sha256(coalesce(kept.txt, '')) AS collapsed_sha256
FROM w LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)"""

# Letters in either case, A-Z only (the engine's own flag would fold more).
_ANY_CASE = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in
             ("password", "passwd", "secret", "token", "api", "key")}
_VALUE = "[A-Za-z0-9+/_.=-]+"
_ASSIGN = ("(?:{password}|{passwd}|{secret}|{token}|{api}_?{key})[\"'']?\\x20*[:=]\\x20*[\"'']?".format(**_ANY_CASE)
           + "(" + _VALUE + ")")
_TOKEN = "(?:gh[opusr]|npm)_"
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _matches(kind: str, pattern: str, keep: str) -> str:
    """Spans of ``pattern`` by the lengths of the pieces between its matches."""
    return rf"""{kind} AS (SELECT rid, '{kind}' AS kind, s, s + length(m) AS e FROM (
        SELECT rid, m, v, sum(length(piece)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM (
          SELECT rid, unnest(range(0, len(ms))) AS k, unnest(ms) AS m, unnest(vs) AS v, unnest(pieces[1:len(ms)]) AS piece FROM (
            SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {1 if kind == "assign_" else 0}) AS vs,
              string_split_regex(text, '{pattern}') AS pieces FROM d))
        WINDOW w AS (PARTITION BY rid ORDER BY k)) WHERE {keep})"""


ORACLE["op12_secret_scan"] = rf"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_matches("assign_", _ASSIGN, "length(v) >= 6")},
{_matches("access_", "AKIA[A-Z0-9]+", "length(m) >= 20")},
{_matches("hex_", "[0-9a-f]+", "length(m) >= 24")},
{_matches("at_", _TOKEN, "true")},
tok AS (SELECT rid, s, regexp_extract(substr(text, (s + 1)::BIGINT), '^{_TOKEN}[A-Za-z0-9]{{36}}') AS m FROM at_ JOIN d USING (rid)),
good AS (SELECT rid, CASE WHEN starts_with(m, 'npm') THEN 'npm_' ELSE 'github_' END AS kind, s, s + length(m) AS e FROM tok, crc WHERE m <> ''
   AND list_reduce(list_transform(string_split(m[-6:], ''), lambda c: (instr('{_BASE62}', c) - 1)::BIGINT), lambda v, c: v * 62 + c)
     = {_CRC.format(_BYTES.format("m[5:-7]"))}),
f AS (SELECT rid, rtrim(kind, '_') AS kind, s::BIGINT AS s, e::BIGINT AS e, CASE kind WHEN 'assign_' THEN 0 WHEN 'access_' THEN 1 WHEN 'hex_' THEN 2
        WHEN 'github_' THEN 3 ELSE 4 END AS rank FROM (FROM assign_ UNION ALL FROM access_ UNION ALL FROM hex_ UNION ALL FROM good)),
a AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""

ORACLE["op13_filter_audit"] = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, ['A', 'B', 'C', 'D', 'E'] AS letters,
        [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS bad
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
f AS (SELECT part, good, toxic, list_filter(letters, lambda c, i: bad[i]) AS fails FROM m),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o AS filter_order, step, o[step] AS letter, string_split(o[1:step - 1], '') AS earlier FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, letter,
        sum(CASE WHEN NOT list_has_any(fails, earlier) AND NOT list_contains(fails, letter) THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT list_has_any(fails, earlier) AND list_contains(fails, letter) THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN list_has_any(fails, earlier) AND list_contains(fails, letter) THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = [letter] THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT list_has_any(fails, earlier) AND list_contains(fails, letter) THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT list_has_any(fails, earlier) AND list_contains(fails, letter) THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""
