"""URL rules by host suffix and path prefix, with DataFrame functions only.

Each url is expanded into expressions: its host and the host's parents, each with the path's prefixes that end at a
slash, as deep as the deepest rule. Expressions meet rules in an equi-join on four bytes of their SHA-256, the whole
digest then confirms, and of a url's rules the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """host, path, verdict, and the digest by which urls find the rule. Paths must end with a slash."""
    for host, path, verdict in rules:
        if not host or not path.startswith("/") or not path.endswith("/") or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {host}{path} {verdict}")
    values = ", ".join(f"(:h{k}, :p{k}, :v{k})" for k in range(len(rules)))
    args = {f"{c}{k}": x for k, rule in enumerate(rules) for c, x in zip("hpv", rule, strict=True)}
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)", args=args)
    return table.select(F.concat("host", "path").alias("rule"), "verdict", F.sha2(F.concat("host", "path"), 256).alias("digest"))


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """All host suffixes of up to ``labels`` labels, each with all path prefixes of up to ``depth`` slashes."""
    suffixes = F.array(*[F.substring_index(host, ".", -k) for k in range(1, labels + 1)])
    suffixes = F.array_distinct(suffixes)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    prefixes = F.filter(F.array(*[F.when(slashes >= k, F.concat(F.substring_index(path, "/", k), F.lit("/"))) for k in range(1, depth + 1)]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins. No rule
    fits a null url, one without ``://`` (host and path are empty) or an empty path; these get ``default``. Repeated
    rows are judged alike. An empty rule list leaves all to ``default``.
    """
    spark = pages.sparkSession
    base = pages.select("page_id", F.col("url").cast("string").alias("url"))
    parts = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # longer expressions than the deepest rule can't meet one
    labels = max(h.count(".") + 1 for h, _, _ in rules)
    depth = max(p.count("/") for _, p, _ in rules)
    expanded = parts.where("host <> '' and path <> ''").select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, depth)).alias("expression"))
    hashed = expanded.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8))
    table = rule_table(spark, rules).select("rule", F.col("verdict").alias("said"), F.col("digest").alias("full"), F.substring("digest", 1, 8).alias("short"))
    met = hashed.join(table, "short").where(F.col("digest") == F.col("full"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "said")).alias("best"))
    key = F.sha2(F.concat_ws("\0", "host", "path"), 256)  # both sides are exchanged anew, so a hot url can be split
    best = best.select(key.alias("key"), "best")
    out = parts.withColumn("key", key).join(best, "key", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"))


#: The same for DuckDB, rule by rule.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
