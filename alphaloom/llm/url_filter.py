"""URL filters, native: hashed host-suffix and path-prefix expressions, after the manner of public safe-browsing lists.

A url is cut into host and path. Each host suffix (by labels) with each path prefix (up to a slash) is an expression;
expressions are equi-joined with the rules on the first four bytes of their SHA-256 digests, matches are confirmed by
the full digest, and the longest matching rule decides. Only suffixes with as many labels, and prefixes with as many
slashes, as some rule has are expanded, so long urls stay cheap and nothing is lost. Equal (host, path) are judged once; pages without a
matching rule stay out of the join, and keys with very many rows are joined in parts.

Defined results: a null url or one without `://` has an empty host and path and matches nothing; very long urls are judged whole; rule paths must end in
a slash; of rules with equal host and path the verdict that sorts last holds; repeated page rows are each judged; no rules: every verdict is the default; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, saved, split, table

#: (verdict, rule) of the query; a rule is host + path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Hex digits of the short prefix: four bytes.
SHORT = 8


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = lowered(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """A rules DataFrame (verdict, rule) from a list."""
    if any("/" not in r or not r.endswith("/") for _, r in rules):
        raise ValueError("a rule is a host and a path that ends in a slash")
    return spark.createDataFrame(rules, "verdict string, rule string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict in place of all other columns but page_id."""
    rules = rules.select(
        "verdict", "rule", F.length("rule").alias("rule_length"), F.size(F.split(F.substring_index("rule", "/", 1), "\\.")).alias("labels"), (F.size(F.split("rule", "/")) - 1).alias("slashes"), F.sha2("rule", 256).alias("digest")
    ).withColumn("short", F.substring("digest", 1, SHORT))
    # Two numbers whatever the size of the list: which suffixes and prefixes any rule can equal.
    labels, slashes = rules.agg(F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.max("slashes"), F.lit(0))).first()
    host, path = host_and_path(F.col(url))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, labels)))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    folders = F.split("path", "/")
    depth = F.least(F.size(folders) - 1, F.lit(slashes))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.array_join(F.slice(folders, 1, n), "/"), F.lit("/"))))
    urls = pages.where("host <> '' AND path <> ''").select("host", "path").distinct()
    expressions = urls.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
    expressions = expressions.select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("full")).withColumn("short", F.substring("full", 1, SHORT))
    # Rules that share a short prefix stand in one row, so each prefix is there once.
    known = rules.groupBy("short").agg(F.collect_list(F.struct("digest", "rule_length", "rule", "verdict")).alias("rules"))
    matched = join_unique(expressions, saved(known, "url-rules"), "short").select("host", "path", "full", F.explode("rules").alias("r")).where("full = r.digest")
    best = matched.groupBy("host", "path").agg(F.max(F.struct("r.rule_length", "r.rule", "r.verdict")).alias("best"))
    # A path is empty or begins with a slash, and a host has none: joined they still tell all urls apart.
    found = saved(best.select(F.concat("host", "path").alias("key"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "url-matches")
    pages = pages.withColumn("key", F.concat("host", "path"))
    maybe, other = split(pages, found, "key")
    out = join_unique(maybe, found, "key", "left").unionByName(other, allowMissingColumns=True)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP3_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), rules(verdict, rule, h, p) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), fits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""
