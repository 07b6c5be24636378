"""Choosing what to crawl next, the work queue, and the 90-day rolloff."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblattice.operators.numbering import numbered

#: Order in which a domain's URLs are offered; the URL breaks ties.
OFFER_ORDER = [F.desc_nulls_last, F.desc_nulls_last, F.asc_nulls_first, F.asc_nulls_last, F.asc]
OFFER_KEYS = ["url_score", "domain_score", "last_scheduled", "first_seen", "url"]


def eligible(urls: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    rows = urls.where(F.coalesce("should_crawl", F.lit(False)))
    return rows if exclude is None else rows.join(exclude.select("domain_id").distinct(), "domain_id", "left_anti")


def pick_domains(rows: DataFrame, slots: int) -> DataFrame:
    """The first ``slots`` domains, shard by shard: each counts where it first occurs."""
    return rows.groupBy("domain_id").agg(F.min("shard_id").alias("slot_shard")).orderBy("slot_shard", "domain_id").limit(slots)


def select_by_domain(urls: DataFrame, per_domain: int, most_domains: int, exclude: DataFrame | None = None) -> DataFrame:
    """url, domain_id and rank of the best ``per_domain`` URLs of up to ``most_domains`` domains."""
    if per_domain <= 0 or most_domains <= 0:
        return urls.select("url", "domain_id", F.lit(0).alias("rank")).limit(0)
    rows = eligible(urls, exclude)
    rows = rows.join(pick_domains(rows, most_domains).select("domain_id"), "domain_id", "left_semi")
    order = Window.partitionBy("domain_id").orderBy(*[how(key) for how, key in zip(OFFER_ORDER, OFFER_KEYS, strict=True)])
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_domain).select("url", "domain_id", "rank")


def mark_scheduled(urls: DataFrame, picked: DataFrame, now: Column) -> DataFrame:
    """The URLs after scheduling those picked: not to be crawled again, stamped and counted."""
    hit = F.col("_hit").isNotNull()
    rows = urls.join(picked.select("url", F.lit(1).alias("_hit")), "url", "left")
    return rows.withColumn("should_crawl", ~hit & F.col("should_crawl")).withColumn("last_scheduled", F.when(hit, now).otherwise(F.col("last_scheduled"))).withColumn("num_scheduled_90d", F.col("num_scheduled_90d") + F.when(hit, 1).otherwise(0)).drop("_hit")


#: Selection strategies by name: what is picked, and the URLs afterwards.
STRATEGIES: dict[str, Callable] = {
    "read_only": lambda urls, picked, now: urls,
    "mutating": mark_scheduled,
}


def offer(urls: DataFrame, strategy: str, per_domain: int, most_domains: int, now: Column, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a strategy picks, and the URLs after it; any name but ``read_only`` changes them."""
    picked = select_by_domain(urls, per_domain, most_domains, exclude)
    return picked, STRATEGIES.get(strategy, mark_scheduled)(urls, picked, now)


def refill(queue: DataFrame, most: int, low: int) -> DataFrame:
    """One row: queued domains, the action and the free slots."""
    n = queue.agg(F.count_distinct("domain_id").alias("queued"))
    return n.select("queued", F.when(F.col("queued") >= low, "noop").when(F.col("queued") == 0, "refill_empty").otherwise("refill").alias("action"), F.when(F.col("queued") >= low, 0).otherwise(F.greatest(F.lit(0), F.lit(most) - F.col("queued"))).cast("long").alias("slots"))


def enqueue(queue: DataFrame, picked: DataFrame, now: Column) -> DataFrame:
    """The queue after one file per picked domain, which replaces an older one."""
    files = picked.groupBy("domain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("urls")).withColumn("enqueued_at", now)
    return queue.join(files.select("domain_id"), "domain_id", "left_anti").unionByName(files)


def pop(queue: DataFrame, limit: int, exclude: list[int] = ()) -> DataFrame:
    """The oldest files of domains not excluded (limit 0: all), without empty ones; ties by domain."""
    rows = queue.where(~F.col("domain_id").isin(list(exclude))) if exclude else queue
    rows = rows.orderBy("enqueued_at", "domain_id")
    rows = rows.limit(limit) if limit > 0 else rows
    return rows.where(F.size("urls") > 0)


def pop_and_rest(queue: DataFrame, limit: int, exclude: list[int] = ()) -> tuple[DataFrame, DataFrame]:
    """What ``pop`` takes, and the queue afterwards: files that were read are gone, also the empty ones; a file without a list (urls null) cannot be read and stays."""
    rows = queue.where(F.col("urls").isNotNull())
    rows = rows.where(~F.col("domain_id").isin(list(exclude))) if exclude else rows
    rows = rows.orderBy("enqueued_at", "domain_id")
    read = rows.limit(limit) if limit > 0 else rows
    rest = queue.join(read.select(F.col("domain_id").alias("read_id"), F.col("enqueued_at").alias("read_at")), (F.col("domain_id") == F.col("read_id")) & F.col("enqueued_at").eqNullSafe(F.col("read_at")), "left_anti")
    return read.where(F.size("urls") > 0), rest


def rolloff(events: DataFrame, current: DataFrame, as_of: dt.date, days: int = 90, batch: int = 1000) -> dict[str, DataFrame]:
    """Subtract the counts of accounted events that are ``days`` old from their URLs, in batches of each shard.

    Returns picked (with batch_no and missing), history (one row per URL and batch), current and events afterwards. Every batch subtracts down to
    zero at most; batches of a URL subtract in turn, which is a running fold: value = max(0, value - count).
    """
    cutoff = F.date_sub(F.lit(as_of), days)
    due = F.col("accounted") & (F.col("event_date") <= cutoff)
    counts = ["num_scheduled", "num_fetch_ok", "num_fetch_fail", "num_content_update"]
    picked = numbered(events.where(due), "shard_id", ["event_date", "url"], "n_th").withColumn("batch_no", F.floor((F.col("n_th") - 1) / batch).cast("long")).drop("n_th")
    picked = picked.join(current.select("url", F.lit(False).alias("_known")), "url", "left").withColumn("missing", F.col("_known").isNull()).drop("_known")
    per_batch = picked.where("NOT missing").groupBy("url", "batch_no").agg(*[F.sum(c).alias(c) for c in counts])
    running = Window.partitionBy("url").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, 0)
    # counts are not negative, so max(0, max(0, v - a) - b) is max(0, v - a - b)
    history = per_batch.join(current, "url")
    for c in counts:
        history = history.withColumn(f"{c}_90d", F.greatest(F.lit(0), F.col(f"{c}_90d") - F.sum(c).over(running)))
    history = history.drop(*counts)
    total = per_batch.groupBy(F.col("url").alias("_u")).agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    after = current.join(total, F.col("url") == F.col("_u"), "left")
    for c in counts:
        after = after.withColumn(f"{c}_90d", F.greatest(F.lit(0), F.col(f"{c}_90d") - F.coalesce(f"_{c}", F.lit(0))))
    return {"picked": picked, "history": history, "current": after.select(*current.columns), "events": events.withColumn("accounted", F.col("accounted") & ~due)}


def should_run(now: dt.datetime, last_day: dt.date | None, hour: int = 3, minute: int = 0) -> bool:
    """Whether the daily run is due: once a day, from that time on."""
    return (now.hour, now.minute) >= (hour, minute) and last_day != now.date()
