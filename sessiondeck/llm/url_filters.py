"""URL filters: rules of a host and a path prefix, found through their rarest literal token.

A rule becomes a regular expression and a set of literal tokens that every fitting URL must hold: the labels of its host,
and the path segments that end inside its path (a segment that the rule breaks off is no token). Each rule is indexed
under the one of its tokens that the URLs hold least often. The tokens of each distinct host and path fetch candidate
rules, only candidates run their expression, and the longest that fits wins.

Defined cases: a null URL, or one without `://`, has an empty host and path and gets the default verdict; a tie in length
goes to the rule that sorts first; repeated pages repeat in the result; other columns are ignored; no rules: all default.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

DEFAULT = "allow"
#: The index is broadcast while it has at most so many rules (a rule is some 200 bytes); a larger one is joined by shuffle.
BROADCAST_RULES = 10_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return common.ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def literal_tokens(rule: Rule) -> list[str]:
    """`h:` labels of the host and `p:` segments of the path that are whole in every URL that fits."""
    return sorted({f"h:{x}" for x in rule.host.split(".") if x} | {f"p:{x}" for x in rule.path.split("/")[:-1] if x})


def expressions(rule: Rule) -> tuple[str, str]:
    """Over the host and over the path; either may hold any character."""
    return rf"(?s)\A(?:.*\.)?{re.escape(rule.host)}\z" if rule.host else r"\A", rf"(?s)\A{re.escape(rule.path)}"


def judge(pages: DataFrame, rules: list[Rule] = RULES, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """pages with `host`, `path`, `rule` and `verdict` (replacing columns so named)."""
    spark = pages.sparkSession
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    distinct = parsed.select("host", "path").distinct()
    tokens = distinct.select("host", "path", F.explode(F.array_distinct(F.concat(
        F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p:"), x)), F.array(F.lit("*")),
    ))).alias("token"))
    made = [(i, r.verdict, r.host + r.path, *expressions(r), literal_tokens(r) or ["*"]) for i, r in enumerate(rules)]
    book = spark.createDataFrame(made, "id long, v string, name string, on_host string, on_path string, literals array<string>")
    small = len(rules) <= BROADCAST_RULES
    offered = book.select("id", F.explode("literals").alias("token"))
    wanted = offered.select("token").distinct()
    seen = tokens.join(F.broadcast(wanted) if small else wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = offered.join(seen, "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = rarest.join(book.drop("literals"), "id")
    fitting = (
        tokens.join(F.broadcast(index) if small else index, "token")
        .where(F.expr("host rlike on_host and path rlike on_path"))
        .groupBy("host", "path").agg(F.min_by(F.struct("name", "v"), F.struct(-F.length("name"), "name")).alias("won"))
    )
    out = parsed.join(fitting, ["host", "path"], "left")
    return out.select(*own, "host", "path", F.col("won.name").alias("rule"), F.coalesce("won.v", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


ORACLE_SQL = """
WITH parsed AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*') ELSE '' END AS raw,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), hosted AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parsed
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT h.page_id, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.rpath) DESC, r.rhost || r.rpath) AS k
  FROM hosted h JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
)
SELECT h.page_id, coalesce(h.host, '') AS host, coalesce(h.path, '') AS path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM hosted h LEFT JOIN fits f ON f.page_id = h.page_id AND f.k = 1
"""
