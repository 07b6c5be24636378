"""Crawl relations derived from the driver's tables, for the registered queries.

``fetch_log``: every event is a fetch (or a discovered link) of one of five URLs of a domain, so that URLs repeat. ``log_event``: the
same events as service log lines. ``crawl_result``: a page as the result of one fetch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.functions import html as H
from weblattice.functions import keys as K
from weblattice.sources.tables import read_table

#: Records before this time make the state that later records are folded into.
SPLIT_AT = "2024-01-16 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, fail, new = (F.col("status") == s for s in ("ok", "fail", "new"))
    page = lambda user, k: F.concat(F.lit("http://d"), user.cast("string"), F.lit(".example.net/p"), k.cast("string"))
    rows = _events(spark, sf_dir).withColumn("status", F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "new").otherwise("ok"))
    return rows.select(
        F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 500).cast("long").alias("batch_no"), F.when(new, 0).otherwise(1).alias("kind"),
        "ts", F.to_date("ts").alias("day"), F.col("user_id").alias("domain_id"), (F.col("user_id") % 16).cast("int").alias("shard_id"), page(F.col("user_id"), F.col("k") % 5).alias("url"), "status",
        F.when(fail, F.when(F.col("k") % 3 == 0, "HttpError 404").when(F.col("k") % 3 == 1, "TimeoutError").otherwise("DNSLookupError, retry")).alias("fail_reason"),
        F.when(ok & (F.col("k") % 11 != 0), F.concat(F.lit("h"), (F.floor("value") % 4).cast("string"))).alias("content_hash"),
        F.when(ok & (F.col("k") % 4 != 0), F.concat(F.lit("t"), (F.col("k") % 3).cast("string"))).alias("title"),
        F.when(new, page((F.col("user_id") + 1) % 150, F.lit(0))).alias("discovered_from"), ((F.col("user_id") % 10) / 10.0).alias("domain_score"),
    )


def log_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind.isin("click", "purchase"), "request.end").when(kind == "error", "request.fail").when(kind == "signup", "request.scheduled").otherwise("spider.heartbeat")
    reason = F.when(F.col("k") % 3 == 0, "HttpError 404").when(F.col("k") % 3 == 1, "TimeoutError").otherwise("DNSLookupError")
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "ts", event.alias("event"), (F.col("user_id") % 16).cast("int").alias("worker_id"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain"),
        F.when(kind == "error", "WARNING").otherwise("INFO").alias("level"), F.when(event == "request.end", F.when(F.col("k") % 10 < 8, 200).otherwise(404)).alias("status"),
        F.when(event == "request.end", F.round(F.col("value") * 10).cast("long")).alias("latency_ms"), F.when(kind == "error", reason).alias("fail_reason"),
        F.when(kind == "error", F.concat(F.lit("batch "), F.col("k").cast("string"), F.lit(" failed on shard "), (F.col("k") % 7).cast("string"), F.lit("\ntrace"))).alias("error"),
        *[F.when(event == "spider.heartbeat", F.col("k") * n).alias(name) for n, name in enumerate(("inflight", "pending", "active_domains", "transferring", "slot_queue"), 1)],
    )


def crawl_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = K.host_of(F.col("url"))
    ok = F.coalesce(F.col("html"), F.lit("")) != ""
    return read_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), "url", host.alias("host"), F.when(ok, "ok").otherwise("fail").alias("status"), F.col("html").alias("content"),
        F.when(ok, F.sha1("html")).alias("content_hash"), H.title_of(F.col("html")).alias("title"), H.links_of(F.col("url"), F.col("html")).alias("outlinks"),
    )


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that may be scheduled, with scores; some are not to be crawled."""
    page = F.concat(F.lit("http://d"), F.col("user_id").cast("string"), F.lit(".example.net/p"), (F.col("k") % 5).cast("string"))
    rows = _events(spark, sf_dir).select(page.alias("url"), F.col("user_id").alias("domain_id"), (F.col("user_id") % 16).cast("int").alias("shard_id"), ((F.col("user_id") % 10) / 10.0).alias("domain_score"), "value", "event_type", "ts")
    return rows.groupBy("url", "domain_id", "shard_id").agg(
        F.max("value").alias("url_score"), F.max("domain_score").alias("domain_score"), F.max(F.when((F.col("event_type") == "purchase") & (F.floor("value") % 3 == 0), F.col("ts"))).alias("last_scheduled"),
        F.min("ts").alias("first_seen"), (F.count("*") % 3 != 0).alias("should_crawl"), F.count("*").alias("num_scheduled_90d"),
    )
