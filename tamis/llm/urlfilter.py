"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

Every distinct (host, path) is expanded into host suffix + path prefix, only for the label counts and path
lengths that rules have. Expressions meet the rules on the first 4 bytes of their SHA-256; the full digest
then decides. Of the rules that fit, the longest (host and path together) wins; ties go to the longer host,
then to block. Without a rule the verdict is `allow`.

A null url, or one without ://, has an empty host and path. Any number of equal rows is judged once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, table

#: The contract's rules: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; rules(verdict, host, path). Lengths of rules are few, so they are collected."""
    pages = pages.drop(*(c for c in ("host", "path", "rule", "verdict") if c in pages.columns and c != url))
    rules = rules.select("verdict", "host", "path").dropDuplicates().withColumn("rule", F.concat("host", "path"))
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("h"), F.collect_set(F.length("path")).alias("p")).first()
    rules = rules.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, 8))
    rules = rules.withColumn("r", F.struct(F.length("rule").alias("n"), F.length("host").alias("h"), F.col("verdict").alias("v"), F.col("rule")))
    keyed = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    ints = lambda xs: F.array(*(F.lit(x) for x in sorted(xs))).cast("array<int>")
    d = keyed.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    suffixes = F.transform(F.filter(ints(shape["h"]), lambda n: n <= F.size("labels")), lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), "."))
    prefixes = F.transform(F.filter(ints(shape["p"]), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    d = d.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    d = d.select("host", "path", F.explode(F.transform("prefixes", lambda p: F.concat("suffix", p))).alias("expression"))
    d = d.withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, 8))
    hit = d.join(small(rules.select("short", "digest", "r")), "short").where(F.col("full") == F.col("digest"))
    best = hit.groupBy("host", "path").agg(F.max("r").alias("best"))
    out = keyed.join(best, ["host", "path"], "left")
    return out.select(*(F.col(c) for c in pages.columns), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def op7_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(RULES, "verdict string, host string, path string")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op7_url_filters": op7_url_filters}
SQL = {
    "op7_url_filters": r"""
WITH p AS (SELECT page_id, row_number() OVER () AS k, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(v, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT k, arg_max(h || q, length(h || q) * 1000 + length(h)) AS rule, arg_max(v, length(h || q) * 1000 + length(h)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (k)"""
}
