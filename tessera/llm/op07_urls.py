"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes.

A rule is a host and the start of a path; it fits the host and all its subdomains. Every URL is
expanded into one expression for each host suffix of as many labels, and each path start of the length,
that some rule has, so the work is linear in the URL however many labels or characters it has.
The expressions meet the rules in an equi-join on the first 32 bits of a SHA-256 digest; the full
digests then confirm the match, and the longest rule of a URL wins (a block before an allow of the
same length). A URL that no rule fits gets ``default``.

Defined results: a null URL or one without ``://`` has an empty host and path and so no rule; a
repeated row is judged as often as it occurs; null ids are kept; very long hosts and paths are judged
whole; of rules that fit, equal in length, a block wins; an empty table gives an empty result; other columns of the input are not read. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

#: The rules of the registered query, as (action, host, path start).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Rules are broadcast up to this many rows; larger tables are joined by a shuffle.
BROADCAST_RULES = 200_000
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    n = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    fitting = [F.when(n >= m, F.substring_index(host, ".", -m)) for m in labels]
    suffixes = F.array_compact(F.array(*fitting).cast("array<string>"))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    rules = rules.where("host is not null and path is not null").groupBy(F.concat("host", "path").alias("rule")).agg(F.max("action").alias("action"), F.max(F.length("path")).alias("n"), F.max(F.size(F.split("host", r"\."))).alias("m"))
    # path lengths and label counts of the rules, never more than the longest path and host have
    lengths, labels = (sorted(r[0] for r in rules.select(c).distinct().toLocalIterator()) for c in ("n", "m"))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    rules = rules.select("rule", "action", F.sha2("rule", 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    # repeated rows are counted before anything is dealt out, so no page is a hot key
    pages = pages.groupBy(F.col(id_col).alias("id"), F.col(url_col).alias("url")).agg(F.count("*").alias("times"))
    host, path = url_parts(F.col("url"))
    pages = pages.select("id", "url", "times", host.alias("host"), path.alias("path"))
    made = pages.select("*", F.explode_outer(_expressions(F.col("host"), F.col("path"), labels, lengths)).alias("expression"))
    made = made.select("*", F.sha2("expression", 256).alias("full")).withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    met = made.join(F.broadcast(rules) if few else rules, "prefix", "left")
    sure = F.col("full") == F.col("digest")
    best = F.max(F.when(sure, F.struct(F.length("rule").alias("length"), F.col("action").alias("action"), F.col("rule").alias("rule")))).alias("best")
    judged = met.groupBy("id", "url").agg(F.first("times").alias("times"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    once = judged.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"))
    return once.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark))


ORACLE = r"""
WITH rules(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (SELECT row_number() OVER () AS n, page_id,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT n, page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT p.page_id, any_value(p.host) AS host, any_value(p.path) AS path,
  arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(arg_max(r.action, length(r.host || r.path)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
GROUP BY p.n, p.page_id
"""
