"""URL filters (operator 7): host-suffix and path-prefix expressions.

Each url is expanded into expressions ``host suffix + directory prefix``. The
rules are keyed by ``host + directory part of their path``; urls and rules meet
on a short prefix of the key's SHA-256 (4 bytes), then the full digests must
agree and the url's path must start with the rule's whole path (a rule path
may end inside a segment). Longest rule wins; among equal lengths the one with
the longer host, then the smaller text, then block.

Urls are first reduced to distinct (host, leading directories), so a host with
a third of all pages is expanded and joined once; pages then pick up their
site's few rules through an equi-join whose large side AQE can split. No join
is hinted: the rule table may be small or a block list of millions.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or end. Null urls and urls
without ``://`` have an empty host and path and fit no rule. A rule fits its
host and all subdomains. Rule hosts are lower-cased; rules with a null host or
verdict never fit, a null rule path counts as empty. Repeated rows and null
ids are kept as they are; other columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplespark.llm.common import ascii_lower

#: The contract's rules (fixed values): host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumn("host", ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))).withColumn(
        "path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def _dirs(path: str, depth: str) -> str:
    """SQL: the leading directories of a path, at most ``depth`` of them, each
    up to and with its slash; '' first."""
    return (f"transform(sequence(0, least({depth}, size(split({path}, '/', -1)) - 1)), "
            f"k -> CASE WHEN k = 0 THEN '' ELSE concat(array_join(slice(split({path}, '/', -1), 1, k), '/'), '/') END)")


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict`` for every row of ``pages``."""
    spark = pages.sparkSession
    r = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce(F.col("path"), F.lit("")).alias("r_path"),
                     F.col("verdict").alias("r_verdict")).where("r_host IS NOT NULL AND r_verdict IS NOT NULL").distinct()
    r = r.withColumn("r_dir", F.regexp_extract("r_path", r"(?s)^.*/", 0))
    deepest = r.agg(F.coalesce(F.max(F.expr("size(split(r_dir, '/', -1)) - 1")), F.lit(0)),
                    F.coalesce(F.max(F.expr("size(split(r_host, '[.]', -1))")), F.lit(0))).first()
    dirs, labels = int(deepest[0]), int(deepest[1])  # no rule is longer, so no longer expression can fit
    digest = F.sha2(F.concat_ws("\n", "x_host", "x_dir"), 256)
    keyed = r.withColumnsRenamed({"r_host": "x_host", "r_dir": "x_dir"}).withColumn("r_digest", digest).select(
        F.substring("r_digest", 1, 8).alias("prefix"), "r_digest", F.col("x_host").alias("r_host"), "r_path", "r_verdict")

    p = split_url(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    p = p.withColumn("site_dirs", F.expr(_dirs("path", str(dirs)))).withColumn("site_dir", F.element_at("site_dirs", -1))
    sites = p.select("host", "site_dir", "site_dirs").distinct()
    suffixes = (f"transform(sequence(greatest(1, size(split(host, '[.]', -1)) - {max(labels, 1) - 1}), size(split(host, '[.]', -1))), "
                "k -> array_join(slice(split(host, '[.]', -1), k, size(split(host, '[.]', -1))), '.'))")
    expanded = sites.select("host", "site_dir", "site_dirs", F.explode(F.expr(suffixes)).alias("x_host")).select(
        "host", "site_dir", "x_host", F.explode("site_dirs").alias("x_dir"))
    expanded = expanded.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, 8))
    fits = expanded.join(keyed, "prefix").where("digest = r_digest").groupBy("host", "site_dir").agg(
        F.collect_set(F.struct("r_host", "r_path", "r_verdict")).alias("site_rules"))
    best = ("array_sort(filter(site_rules, x -> startswith(path, x.r_path)), (a, b) -> "
            "CASE WHEN length(a.r_host) + length(a.r_path) <> length(b.r_host) + length(b.r_path) "
            "THEN length(b.r_host) + length(b.r_path) - length(a.r_host) - length(a.r_path) "
            "WHEN length(a.r_host) <> length(b.r_host) THEN length(b.r_host) - length(a.r_host) "
            "WHEN a < b THEN IF(a.r_host = b.r_host AND a.r_path = b.r_path, 1, -1) "
            "WHEN a > b THEN IF(a.r_host = b.r_host AND a.r_path = b.r_path, -1, 1) ELSE 0 END)")
    out = p.join(fits, ["host", "site_dir"], "left").withColumn("hit", F.expr(f"get({best}, 0)"))
    return out.select(F.col("id").alias(id_col), "host", "path",
                      F.expr("concat(hit.r_host, hit.r_path)").alias("rule"),
                      F.coalesce(F.col("hit.r_verdict"), F.lit(default)).alias("verdict"))
