"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every URL is expanded into expressions (a suffix of its host at a dot boundary, followed by a prefix of its path
that ends in a slash or is empty). A rule is stored under one such expression: its host and its path up to the last
slash. Expressions and rules meet in an equi-join on the first 32 bits of their SHA-256; then the full digest and the
rest of the rule's path are compared, and the longest rule wins.

Only DataFrame functions are used. Expansion is bounded exactly: no expression is made with more host labels or path
segments than the largest rule has, for none of those could meet a rule.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed. Rules with
a null host are ignored, a null path counts as empty. Of rules of equal length the one with the longer host wins, then
``block``. Repeated rows stay repeated. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.sources.scratch import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"

#: The rules of the registered query.
QUERY_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A small rule list as a local relation, whose exact size Spark knows."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in rule) + ")" for rule in rules)
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS rules(host, path, verdict)")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?s:.*)/", 0)


def _key(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, directory), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule and verdict of every row of ``pages``; rules has host, path and verdict."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rules = (
        rules.where(F.col("host").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .withColumn("r_digest", _key(F.col("r_host"), _directory(F.col("r_path"))))
        .withColumn("r_prefix", F.substring("r_digest", 1, 8))
    )
    most = rules.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_path", "/")))).first()
    labels_most, segments_most = most[0] or 1, most[1] or 1

    host, path = url_parts(F.col("url"))
    urls = rows.select("url").where(F.col("url").isNotNull()).distinct().select("url", host.alias("host"), path.alias("path"))
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(labels_most))), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(segments) - 1, F.lit(segments_most))),
        lambda j: F.when(j == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, F.lit(1), F.greatest(j, F.lit(1))), "/"), F.lit("/"))),
    )
    expressions = (
        urls.withColumn("suffix", F.explode(suffixes))
        .withColumn("directory", F.explode(prefixes))
        .select("url", "path", _key(F.col("suffix"), F.col("directory")).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    hits = expressions.join(rules, F.col("prefix") == F.col("r_prefix")).where((F.col("digest") == F.col("r_digest")) & F.startswith("path", "r_path"))
    rule = F.concat("r_host", "r_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").cast("int").alias("b"), rule.alias("rule"), F.col("r_verdict").alias("verdict")))
    # written, so that the join can split the rows of a URL that very many pages have
    won = cut(hits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict"), "verdicts")
    return rows.join(won, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))


ORACLE = """
WITH rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
r AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
      FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
"""
