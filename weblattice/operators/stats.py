"""Statistics: deltas folded into daily summaries, and service metrics from log events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counters with a column of their own; other names are dropped.
COUNTERS = ["new_links", "num_scheduled", "num_fetch_ok", "num_fetch_fail", "num_content_update", "error_count", "offer_error", "route_error", "ingest_error", "stats_error", "extract_error"]
GAUGES = ["inflight", "pending", "active_domains", "transferring", "slot_queue"]


def summary_daily(deltas: DataFrame, keys: list[str], counters: list[str] = COUNTERS) -> DataFrame:
    """Sums of known counters by ``keys``; ``deltas`` is long: the keys, counter and n."""
    return deltas.where(F.col("counter").isin(counters)).groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in counters])


def merge_summary(stored: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    counters = [c for c in stored.columns if c not in keys]
    return stored.unionByName(added).groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters])


def reasons(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Additive merge of reason counts, one row for each reason."""
    return deltas.where(F.col("reason").isNotNull()).groupBy(*keys, "reason").agg(F.sum("n").alias("n"))


def reason_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One map per key from reason to count; reasons are opaque keys."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("fail_reasons"))


def merge_maps_right(left: Column, right: Column) -> Column:
    """Union of two maps in which the right one wins."""
    left, right = (F.coalesce(x, F.create_map().cast("map<string,bigint>")) for x in (left, right))
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def bind_domains(deltas: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deltas with their domain's shard, and those whose domain id is unknown or no number."""
    rows = deltas.withColumn("_id", F.expr("try_cast(domain_id AS BIGINT)"))
    known = domains.select(F.col("domain_id").alias("_known"), "shard_id")
    bound = rows.join(known, F.col("_id") == F.col("_known"))
    return bound.drop("domain_id", "_known").withColumnRenamed("_id", "domain_id"), rows.join(known, F.col("_id") == F.col("_known"), "left_anti").drop("_id")


def rate(events: DataFrame, by: str, width: str, seconds: float, slide: str | None = None) -> DataFrame:
    """Events a second in windows, by one label."""
    return events.groupBy(F.window("ts", width, slide)["start"].alias("step_at"), by).agg((F.count("*") / F.lit(float(seconds))).alias("rate"))


def top_of_step(rates: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy("step_at").orderBy(F.desc("rate"), by)
    return rates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def success_rate(events: DataFrame, width: str) -> DataFrame:
    """Good answers (status below 400) over those and the failures that are not HTTP errors."""
    good = F.sum(F.when((F.col("event") == "request.end") & (F.col("status") < 400), 1).otherwise(0))
    bad = F.sum(F.when((F.col("event") == "request.fail") & ~F.col("fail_reason").rlike("^(?:HttpError.*)$"), 1).otherwise(0))
    return events.groupBy(F.window("ts", width)["start"].alias("step_at")).agg(good.alias("good"), (good + bad).alias("total")).select("step_at", "good", "total", F.try_divide("good", "total").alias("success_rate"))


def latency(events: DataFrame, width: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    ended = events.where((F.col("event") == "request.end") & F.col("latency_ms").isNotNull())
    names = [f"p{round(100 * s)}" for s in shares]
    return ended.groupBy(F.window("ts", width)["start"].alias("step_at"), "worker_id").agg(*[F.round(F.percentile("latency_ms", F.lit(s)), 6).alias(n) for s, n in zip(shares, names, strict=True)])


def gauges(events: DataFrame, width: str, names: list[str] = GAUGES) -> DataFrame:
    return events.where("event = 'spider.heartbeat'").groupBy(F.window("ts", width)["start"].alias("step_at"), "worker_id").agg(*[F.avg(g).alias(g) for g in names])


def _so_far(rows: DataFrame, by: str, values: list[str], fold: Callable[[str], Column]) -> DataFrame:
    """``fold`` (sum or max) of each value over the rows of one ``by`` so far, in order of ts and seq: seq, by and the values.

    Two levels, so that a frequent key is split by hour: totals of each key and hour are folded in order of hours, and each hour
    begins with one row that carries what came before. Rows without a key are a group of their own, rows without a time come first.
    """
    hours = rows.select("seq", by, "ts", F.date_trunc("hour", "ts").alias("_hour"), F.lit(False).alias("_carry"), *values)
    totals = hours.groupBy(by, "_hour").agg(*[fold(v).alias(v) for v in values])
    before = Window.partitionBy(by).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(by, "_hour", F.lit(True).alias("_carry"), *[fold(v).over(before).alias(v) for v in values])
    run = Window.partitionBy(by, "_hour").orderBy(F.desc("_carry"), "ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    both = hours.unionByName(carry, allowMissingColumns=True)
    return both.select("seq", by, "_carry", *[fold(v).over(run).alias(v) for v in values]).where(~F.col("_carry")).drop("_carry")


def running_max(events: DataFrame, names: list[str] = GAUGES) -> DataFrame:
    beats = events.where("event = 'spider.heartbeat'").select("seq", "worker_id", "ts", *[F.col(g).alias(f"{g}_max") for g in names])
    return _so_far(beats, "worker_id", [f"{g}_max" for g in names], F.max)


def pending(events: DataFrame) -> DataFrame:
    """Running number of requests that wait, by domain: scheduled adds one, an end or a failure takes one off."""
    change = F.when(F.col("event") == "request.scheduled", 1).when(F.col("event").isin("request.end", "request.fail"), -1).otherwise(0)
    return _so_far(events.select("seq", "domain", "ts", change.alias("pending")).where("pending <> 0"), "domain", ["pending"], F.sum)


def normalise_error(text: Column) -> Column:
    """The first line of an error with its numbers as N."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\n.*", ""), "[0-9]+", "N")


def error_kinds(events: DataFrame, since: Column) -> DataFrame:
    rows = events.where(F.col("error").isNotNull())
    return rows.groupBy(normalise_error(F.col("error")).alias("kind")).agg(F.count("*").alias("total"), F.sum(F.when(F.col("ts") >= since, 1).otherwise(0)).alias("recent"))


def tail(events: DataFrame, n: int) -> DataFrame:
    return events.where(F.col("level").isin("WARNING", "ERROR")).orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def lag(events: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Minutes between ``now`` and the last bucket of each worker."""
    bucket = F.window("ts", f"{minutes} minutes")["start"]
    return events.groupBy("worker_id").agg(F.max(bucket).alias("bucket")).select("worker_id", "bucket", ((F.unix_micros(now.cast("timestamp")) - F.unix_micros("bucket")) / 60e6).alias("lag_minutes"))


def retained(events: DataFrame, now: Column, hours: int = 720) -> DataFrame:
    return events.where(F.col("ts") >= now - F.expr(f"INTERVAL {hours} HOURS"))


def request_latency(starts: DataFrame, ends: DataFrame, request: str = "request") -> DataFrame:
    """Ends with their latency in whole milliseconds since the start of the same request; 0 where no start is known."""
    began = starts.groupBy(F.col(request).alias("started_request")).agg(F.max("ts").alias("started"))
    joined = ends.join(began, F.col(request) == F.col("started_request"), "left")
    millis = F.floor((F.unix_micros("ts") - F.unix_micros(F.coalesce("started", "ts"))) / 1000).cast("long")
    return joined.withColumn("latency_ms", millis).drop("started", "started_request")


def offer_counters(picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an offer adds to the statistics: num_scheduled of all, and by domain."""
    count = F.count("*").alias("num_scheduled")
    return picked.agg(count).where("num_scheduled > 0"), picked.groupBy("domain_id").agg(count)


def average_lag(events: DataFrame, now: Column, width: str, minutes: int = 10) -> DataFrame:
    """Average minutes, by worker and step, between an event and the start of the bucket that the worker had then reached."""
    bucket = F.window("ts", f"{minutes} minutes")["start"]
    rows = events.where(F.col("ts") <= now).select("worker_id", "ts", ((F.unix_micros("ts") - F.unix_micros(bucket)) / 60e6).alias("lag"))
    return rows.groupBy(F.window("ts", width)["start"].alias("step_at"), "worker_id").agg(F.round(F.avg("lag"), 6).alias("lag_minutes"))
