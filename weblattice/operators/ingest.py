"""Folding crawl records into URL state: ordered upserts as window functions, with one history row per change.

Records apply in the order (batch_no, kind, seq): within a batch links (kind 0) before results (kind 1). All windows
share one partitioning by URL, so a fold costs one shuffle of the records and one of the current rows they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblattice.functions.keys import MAX_URL
from weblattice.operators.numbering import numbered

STATE = [
    "url", "domain_id", "first_seen", "last_scheduled", "last_fetch_ok", "last_content_update", "num_scheduled_90d", "num_fetch_ok_90d", "num_fetch_fail_90d", "num_content_update_90d",
    "num_consecutive_fail", "last_fail_reason", "content_hash", "should_crawl", "url_score", "domain_score", "title", "source", "discovered_from",
]
_KINDS = "url string, domain_id long, first_seen timestamp, last_scheduled timestamp, last_fetch_ok timestamp, last_content_update timestamp, num_scheduled_90d long, num_fetch_ok_90d long, num_fetch_fail_90d long, num_content_update_90d long, num_consecutive_fail long, last_fail_reason string, content_hash string, should_crawl boolean, url_score double, domain_score double, title string, source int, discovered_from string"


def no_state(spark) -> DataFrame:
    return spark.createDataFrame([], _KINDS)


def fold(records: DataFrame, current: DataFrame, most: int = MAX_URL) -> DataFrame:
    """Every state that a record leaves behind: the STATE columns, and seq, batch_no, kind, ts, is_ok, is_upd, fail_reason, inserted and step.

    Links to known URLs leave none. ``records``: seq, batch_no, kind, ts, url, domain_id, status, fail_reason, content_hash, title, discovered_from, domain_score.
    """
    base = current.select(*[F.col(c).alias(f"b_{c}") for c in STATE])
    order = Window.partitionBy("url").orderBy("batch_no", "kind", "seq")
    run, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    is_link = F.col("kind") == 0
    rows = (
        records.where(F.col("url").isNotNull() & (F.length("url") <= most))
        .join(base, F.col("url") == F.col("b_url"), "left")
        .withColumn("inserted", F.col("b_url").isNull() & (F.row_number().over(order) == 1))
        .where(~is_link | F.col("inserted"))
        .withColumn("is_ok", ~is_link & (F.col("status") == "ok"))
        .withColumn("is_fail", ~is_link & (F.col("status") != "ok"))
        .withColumn("new_hash", F.when(F.col("is_ok") | (F.col("inserted") & ~is_link), F.col("content_hash")))
    )
    stored = F.coalesce(F.last("new_hash", ignorenulls=True).over(past), F.col("b_content_hash"))
    rows = rows.withColumn("is_upd", F.col("is_ok") & F.col("content_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(stored)).withColumn("streak", F.sum(F.col("is_ok").cast("long")).over(run))

    def total(flag: str, base_col: str) -> Column:
        return F.coalesce(f"b_{base_col}", F.lit(0)) + F.sum(F.col(flag).cast("long")).over(run)

    def latest(value: Column, base_col: str) -> Column:
        return F.coalesce(F.last(value, ignorenulls=True).over(run), F.col(f"b_{base_col}"))

    def at_insert(value: Column, base_col: str) -> Column:
        return F.when(F.col("b_url").isNotNull(), F.col(f"b_{base_col}")).otherwise(F.first(value).over(run))

    in_streak = Window.partitionBy("url", "streak").orderBy("batch_no", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    fails = F.sum(F.col("is_fail").cast("long")).over(in_streak) + F.when(F.col("streak") == 0, F.coalesce("b_num_consecutive_fail", F.lit(0))).otherwise(0)
    return rows.select(
        "url", at_insert(F.col("domain_id"), "domain_id").alias("domain_id"), at_insert(F.col("ts"), "first_seen").alias("first_seen"), F.col("b_last_scheduled").alias("last_scheduled"),
        latest(F.when(F.col("is_ok"), F.col("ts")), "last_fetch_ok").alias("last_fetch_ok"), latest(F.when(F.col("is_upd"), F.col("ts")), "last_content_update").alias("last_content_update"),
        F.coalesce("b_num_scheduled_90d", F.lit(0)).cast("long").alias("num_scheduled_90d"), total("is_ok", "num_fetch_ok_90d").alias("num_fetch_ok_90d"), total("is_fail", "num_fetch_fail_90d").alias("num_fetch_fail_90d"),
        total("is_upd", "num_content_update_90d").alias("num_content_update_90d"), fails.alias("num_consecutive_fail"), F.when(F.col("is_fail"), F.col("fail_reason")).alias("last_fail_reason"),
        latest(F.col("new_hash"), "content_hash").alias("content_hash"), is_link.alias("should_crawl"), F.coalesce("b_url_score", F.lit(0.0)).alias("url_score"),
        at_insert(F.when(is_link, F.coalesce("domain_score", F.lit(0.0))).otherwise(0.0), "domain_score").alias("domain_score"), latest(F.when(F.col("is_ok"), F.col("title")), "title").alias("title"),
        F.coalesce("b_source", F.lit(0)).cast("int").alias("source"), at_insert(F.when(is_link, F.col("discovered_from")), "discovered_from").alias("discovered_from"),
        "seq", "batch_no", "kind", "ts", "is_ok", "is_upd", F.when(F.col("is_fail"), F.col("fail_reason")).alias("fail_reason"), "inserted", F.row_number().over(order).alias("step"),
    )


def apply_fold(folded: DataFrame, current: DataFrame) -> DataFrame:
    """The current rows after a fold: the last state of each URL it touched, and all others as they were."""
    # stored rows count as a step before all others: the fold is computed once, and one window picks the last step
    steps = folded.select(*STATE, "step").unionByName(current.select(*STATE, F.lit(0).alias("step")))
    newest = Window.partitionBy("url").orderBy(F.desc("step"))
    return steps.withColumn("_k", F.row_number().over(newest)).where("_k = 1").select(*STATE)


def outcomes(folded: DataFrame, by: list[str]) -> DataFrame:
    """Counts of what a fold did: new links, fetches that succeeded or failed, content updates."""
    n = lambda c: F.sum(c.cast("long"))
    return folded.groupBy(*by).agg(n(F.col("inserted")).alias("new_links"), n(F.col("is_ok")).alias("num_fetch_ok"), n((F.col("kind") == 1) & ~F.col("is_ok")).alias("num_fetch_fail"), n(F.col("is_upd")).alias("num_content_update"))


def event_counters(folded: DataFrame, day: Column) -> DataFrame:
    """url, event_date and counts of the results of a fold, all accounted."""
    n = lambda c: F.sum(c.cast("long"))
    rows = folded.where("kind = 1").withColumn("event_date", day)
    return rows.groupBy("url", "event_date").agg(F.lit(0).cast("long").alias("num_scheduled"), n(F.col("is_ok")).alias("num_fetch_ok"), n(~F.col("is_ok")).alias("num_fetch_fail"), n(F.col("is_upd")).alias("num_content_update"), F.lit(True).alias("accounted"))


def merge_counters(stored: DataFrame, added: DataFrame, accounted_by_add: bool = False) -> DataFrame:
    """Additive upsert of daily counters; the stored ``accounted`` stays unless the addition sets it."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)))
    sums = [F.sum(c).alias(c) for c in ("num_scheduled", "num_fetch_ok", "num_fetch_fail", "num_content_update")]
    kept = F.max("accounted") if accounted_by_add else F.min_by("accounted", "_new")
    return both.groupBy("url", "event_date").agg(*sums, kept.alias("accounted"))


def snapshot_ids(history: DataFrame, order: list[str], start: DataFrame | None = None) -> DataFrame:
    """history with a snapshot_id per shard, after the largest one in ``start`` (shard_id, last)."""
    rows = numbered(history, "shard_id", order, "snapshot_id")
    if start is None:
        return rows
    return rows.join(start, "shard_id", "left").withColumn("snapshot_id", F.col("snapshot_id") + F.coalesce("last", F.lit(0))).drop("last")
