"""Queries of the crawl-frontier operators on the driver's tables; their SQL oracles are in ``oracles``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.functions import html as H
from weblattice.functions import keys as K
from weblattice.operators import ingest, maintain, routing, selection, stats
from weblattice.plans import oracles, service
from weblattice.sources import derive
from weblattice.sources.records import MICROS
from weblattice.sources.scratch import cut, fresh
from weblattice.sources.store import Store
from weblattice.sources.tables import read_table
from weblattice.streaming import ingest as streaming

#: Parameters of the registered queries.
NOW = "2024-02-01 00:00:00"
PINNED = {"example.com": 0, "example.org": 32}
AS_OF = dt.date(2024, 4, 15)


def _now():
    return F.lit(NOW).cast("timestamp")


def _hosts_as_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl results in which every host is a split host, so that it is its own domain."""
    return derive.crawl_result(spark, sf_dir).withColumn("domain", F.col("host")).withColumn("shard_id", K.shard_of(F.col("host")))


def _folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The early state, the fold of the later records into it, and the state after."""
    log = derive.fetch_log(spark, sf_dir)
    split = F.lit(derive.SPLIT_AT).cast("timestamp")
    none = ingest.no_state(spark)
    base = cut(ingest.apply_fold(ingest.fold(log.where(F.col("ts") < split), none), none), "state")
    folded = ingest.fold(log.where(F.col("ts") >= split), base)
    return base, folded, ingest.apply_fold(folded, base)


def shard_assign(spark, sf_dir):
    rows = derive.crawl_result(spark, sf_dir).select("seq", "host")
    return routing.assign_shards(rows, pinned=PINNED).select("seq", "host", "shard_key", "shard_id", "ingestor_id")


def shard_assign_split(spark, sf_dir):
    rows = derive.crawl_result(spark, sf_dir).select("seq", "host")
    hosts = [f"{a}.example.net" for a in ("tionsh", "blog.ththth", "m.ththth", "blog.ththan", "blog.tionsh")]
    return routing.assign_shards(rows, shards=100, split_hosts=hosts, per_ingestor=10).select("seq", "shard_key", "shard_id", "ingestor_id")


def shard_distribution(spark, sf_dir):
    rows = _hosts_as_domains(spark, sf_dir).withColumn("old", F.col("shard_id")).withColumn("shard_id", K.shard_of(K.shard_key(F.col("host")), 256, PINNED))
    return maintain.shard_spread(maintain.move_plan(rows, F.col("host")))


def host_counts(spark, sf_dir):
    rows = _hosts_as_domains(spark, sf_dir).withColumn("last_fetch_ok", F.when(F.col("seq") % 3 != 0, F.col("seq")))
    return maintain.host_counts(rows).select("host", "urls", "fetched", F.array_join("shards", ",").alias("shards"))


def extract_titles(spark, sf_dir):
    return derive.crawl_result(spark, sf_dir).select("seq", "url", "title")


def page_overview(spark, sf_dir):
    return routing.page_features(derive.crawl_result(spark, sf_dir))


def outlinks_exploded(spark, sf_dir):
    return routing.explode_links(derive.crawl_result(spark, sf_dir)).select("seq", "position", "url", "host")


def route_new_links(spark, sf_dir):
    results = derive.crawl_result(spark, sf_dir)
    return routing.first_links(routing.explode_links(results), results.select("url")).select("url", "host", "discovered_from", K.shard_of(K.shard_key(F.col("host"))).alias("shard_id"))


def _domain_tables(spark, sf_dir):
    seen = _hosts_as_domains(spark, sf_dir).select("seq", "domain", "shard_id")
    known = seen.where("seq % 4 = 0").groupBy("domain").agg((F.min("seq") + 1).alias("domain_id"), F.when(F.min("seq") % 3 == 0, F.min("shard_id")).otherwise(1).alias("shard_id"), F.lit(0.5).alias("domain_score"))
    return seen, known


def domain_registry(spark, sf_dir):
    seen, known = _domain_tables(spark, sf_dir)
    return routing.resolve_domains(seen, known)


def domain_overview(spark, sf_dir):
    """Fetches, links and new links of every domain: pages to routed results to domains."""
    results = _hosts_as_domains(spark, sf_dir)
    links = routing.explode_links(results).groupBy("seq").agg(F.count("*").alias("links"))
    per = results.join(links, "seq", "left").groupBy("domain", "shard_id").agg(F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("num_fetch_ok"), F.sum(F.coalesce("links", F.lit(0))).alias("num_links"))
    return per.orderBy("domain")


def ingest_current(spark, sf_dir):
    return _folds(spark, sf_dir)[2]


def ingest_history(spark, sf_dir):
    return _folds(spark, sf_dir)[1].drop("source")


def ingest_snapshots(spark, sf_dir):
    rows = _folds(spark, sf_dir)[1].withColumn("shard_id", (F.col("domain_id") % 16).cast("int"))
    start = spark.sql("SELECT CAST(id AS INT) AS shard_id, CAST(1000 * id AS BIGINT) AS last FROM range(8)")
    return ingest.snapshot_ids(rows, ["batch_no", "kind", "seq"], start).select("shard_id", "snapshot_id", "url", "seq")


def ingest_outcomes(spark, sf_dir):
    return ingest.outcomes(_folds(spark, sf_dir)[1], ["domain_id"])


def _counters(spark, sf_dir):
    log = derive.fetch_log(spark, sf_dir)
    return ingest.event_counters(ingest.fold(log, ingest.no_state(spark)), F.to_date("ts"))


def event_counter_daily(spark, sf_dir):
    return _counters(spark, sf_dir)


def event_counter_merge(spark, sf_dir):
    counters = _counters(spark, sf_dir)
    stored = counters.where(F.col("event_date") < F.lit(derive.SPLIT_AT).cast("date")).withColumn("accounted", F.day("event_date") % 4 != 0)
    offered = counters.select("url", "event_date", F.lit(1).cast("long").alias("num_scheduled"), *[F.lit(0).cast("long").alias(c) for c in ("num_fetch_ok", "num_fetch_fail", "num_content_update")], F.lit(True).alias("accounted"))
    return ingest.merge_counters(stored, offered, accounted_by_add=True)


def _feature_rows(spark, sf_dir):
    log = derive.fetch_log(spark, sf_dir).where("status = 'ok'")
    return log.select("seq", "url", (F.col("domain_id") + F.col("seq") % 2 * 1000).alias("domain_id"), F.col("ts").alias("fetched_at"), (F.col("seq") % 977).alias("content_length"), "content_hash", (F.col("seq") % 13).alias("num_links"))


def content_feature_current(spark, sf_dir):
    return routing.latest_features(_feature_rows(spark, sf_dir))


def content_feature_history(spark, sf_dir):
    return _feature_rows(spark, sf_dir)


def select_topk_by_domain(spark, sf_dir):
    return selection.select_by_domain(derive.frontier(spark, sf_dir), 3, 40)


def select_with_exclusions(spark, sf_dir):
    urls = derive.frontier(spark, sf_dir)
    return selection.select_by_domain(urls, 2, 25, exclude=urls.where("domain_id % 5 = 0").select("domain_id"))


def schedule_update(spark, sf_dir):
    picked, after = selection.offer(derive.frontier(spark, sf_dir), "mutating", 3, 40, _now())
    return after.select("url", "domain_id", "should_crawl", "last_scheduled", "num_scheduled_90d")


def _queue(spark, sf_dir):
    return derive.frontier(spark, sf_dir).groupBy("domain_id").agg(F.max("first_seen").alias("enqueued_at"), F.array_sort(F.collect_list(F.when(F.col("should_crawl"), F.col("url")))).alias("urls"))


def queue_pop(spark, sf_dir):
    return selection.pop(_queue(spark, sf_dir), 30, [3, 7, 11]).select("domain_id", F.posexplode("urls").alias("position", "url"))


def queue_upsert(spark, sf_dir):
    after = selection.enqueue(_queue(spark, sf_dir), selection.select_by_domain(derive.frontier(spark, sf_dir), 2, 60), _now())
    return after.select("domain_id", "enqueued_at", F.array_join("urls", " ").alias("urls"))


def refill_decision(spark, sf_dir):
    queue = _queue(spark, sf_dir)
    cases = [(200, 120), (200, 500), (100, 160)]
    parts = [selection.refill(queue, most, low).withColumns({"most": F.lit(most), "low": F.lit(low)}) for most, low in cases]
    parts.append(selection.refill(queue.limit(0), 200, 120).withColumns({"most": F.lit(200), "low": F.lit(120)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rolled(spark, sf_dir):
    events = _counters(spark, sf_dir).withColumn("num_scheduled", F.lit(1).cast("long"))
    events = events.withColumn("shard_id", (F.expr("CAST(regexp_extract(url, 'd([0-9]+)', 1) AS BIGINT)") % 4).cast("int")).withColumn("accounted", F.day("event_date") != 5)
    events = cut(events, "events")  # the counters, and the fold behind them, are made once
    counts = ["num_scheduled", "num_fetch_ok", "num_fetch_fail", "num_content_update"]
    domain = F.expr("CAST(regexp_extract(url, 'd([0-9]+)', 1) AS BIGINT)")
    current = events.where(domain % 7 != 0).groupBy("url").agg(*[F.floor(F.sum(c) * 2 / 3).cast("long").alias(f"{c}_90d") for c in counts])
    return selection.rolloff(events, current, AS_OF, 90, 100)


def rolloff_counters(spark, sf_dir):
    return _rolled(spark, sf_dir)["current"]


def rolloff_history(spark, sf_dir):
    return _rolled(spark, sf_dir)["history"]


def rolloff_events(spark, sf_dir):
    return _rolled(spark, sf_dir)["events"].select("url", "event_date", "accounted")


def rolloff_report(spark, sf_dir):
    rolled = _rolled(spark, sf_dir)
    totals = rolled["picked"].agg(F.count("*").alias("picked_count"), F.count_if(~F.col("missing")).alias("processed_count"), F.count_if("missing").alias("missing_count"), F.count("*").alias("marked_count"))
    return totals.crossJoin(rolled["history"].agg(F.count("*").alias("history_count")))


def rolloff_missing(spark, sf_dir):
    return _rolled(spark, sf_dir)["picked"].where("missing").select("url", "event_date", "batch_no")


def _deltas(spark, sf_dir):
    """Long-form stats deltas of every worker and day, with a counter that nobody knows and ids that are no numbers."""
    log = derive.fetch_log(spark, sf_dir)
    name = F.when(F.col("status") == "ok", "num_fetch_ok").when(F.col("status") == "fail", "num_fetch_fail").when(F.col("seq") % 50 == 1, "shard_error").otherwise("new_links")
    domain = F.when(F.col("seq") % 97 == 0, "n/a").when(F.col("seq") % 89 == 0, "999999").otherwise(F.col("domain_id").cast("string"))
    return log.groupBy("day", "shard_id", domain.alias("domain_id"), name.alias("counter"), F.col("fail_reason").alias("reason")).agg(F.count("*").alias("n"))


def summary_daily(spark, sf_dir):
    deltas = _deltas(spark, sf_dir)
    early = stats.summary_daily(deltas.where("shard_id < 8"), ["day"])
    return stats.merge_summary(early, stats.summary_daily(deltas.where("shard_id >= 8"), ["day"]), ["day"])


def _known_domains(spark):
    return spark.sql("SELECT CAST(id AS BIGINT) AS domain_id, CAST(id % 256 AS INT) AS shard_id FROM range(150)")


def domain_stats_daily(spark, sf_dir):
    bound, _ = stats.bind_domains(_deltas(spark, sf_dir).drop("shard_id"), _known_domains(spark))
    return stats.summary_daily(bound, ["domain_id", "shard_id", "day"], ["num_fetch_ok", "num_fetch_fail", "new_links"])


def unknown_domain_deadletter(spark, sf_dir):
    _, lost = stats.bind_domains(_deltas(spark, sf_dir).drop("shard_id"), _known_domains(spark))
    return lost.groupBy("domain_id", "counter").agg(F.sum("n").alias("n"))


def fail_reason_histogram(spark, sf_dir):
    return stats.reasons(_deltas(spark, sf_dir), ["day"])


def fail_reason_maps(spark, sf_dir):
    maps = stats.reason_map(stats.reasons(_deltas(spark, sf_dir), ["day"]), ["day"])
    return maps.select("day", F.array_join(F.transform(F.array_sort(F.map_entries("fail_reasons")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("fail_reasons"))


def qps_per_worker(spark, sf_dir):
    ended = derive.log_event(spark, sf_dir).where("event = 'request.end'")
    return stats.rate(ended, "worker_id", "1 minute", 60)


def qps_sliding(spark, sf_dir):
    ended = derive.log_event(spark, sf_dir).where("event = 'request.end'")
    return stats.rate(ended, "worker_id", "1 minute", 60, "30 seconds")


def qps_topk_domain(spark, sf_dir):
    return stats.top_of_step(stats.rate(derive.log_event(spark, sf_dir).where("event = 'request.end'"), "domain", "6 hours", 21600), "domain", 10)


def success_rate(spark, sf_dir):
    return stats.success_rate(derive.log_event(spark, sf_dir), "1 hour")


def latency_percentiles(spark, sf_dir):
    return stats.latency(derive.log_event(spark, sf_dir), "12 hours")


def heartbeat_avg(spark, sf_dir):
    return stats.gauges(derive.log_event(spark, sf_dir), "12 hours")


def gauge_running_max(spark, sf_dir):
    return stats.running_max(derive.log_event(spark, sf_dir))


def pending_per_domain(spark, sf_dir):
    return stats.pending(derive.log_event(spark, sf_dir))


def ingest_lag(spark, sf_dir):
    return stats.lag(derive.log_event(spark, sf_dir), _now())


def batch_errors_5m(spark, sf_dir):
    failed = derive.log_event(spark, sf_dir).where("event = 'request.fail'")
    return failed.groupBy(F.window("ts", "5 minutes")["start"].alias("step_at"), "worker_id").agg(F.count("*").alias("errors"))


def error_kinds(spark, sf_dir):
    return stats.error_kinds(derive.log_event(spark, sf_dir), F.lit("2024-01-25 00:00:00").cast("timestamp"))


def error_tail(spark, sf_dir):
    return stats.tail(stats.retained(derive.log_event(spark, sf_dir), _now()), 100).select("seq", "ts", "worker_id", "error")


def label_filter(spark, sf_dir):
    rows = derive.log_event(spark, sf_dir)
    return rows.where(F.col("domain").rlike("^(?:d1.|d2)$") & (F.col("event") == "request.fail") & ~F.col("fail_reason").rlike("^(?:HttpError.*)$")).select("seq", "domain", "fail_reason")


def time_buckets(spark, sf_dir):
    rows = derive.fetch_log(spark, sf_dir).select(K.time_bucket(F.col("ts")).alias("bucket"))
    ready = K.bucket_ready(F.col("bucket"), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("ready", ready)


def golden_inject_plan(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    batches = spark.sql("SELECT CAST(id AS BIGINT) AS id, CAST('2023-12-01 00:00:00' AS TIMESTAMP) + make_interval(0, 0, 0, CAST(7 * id AS INT)) AS created_at FROM range(10)")
    queries = spark.sql("SELECT CAST(id AS BIGINT) AS id, CAST(id % 10 AS BIGINT) AS batch_id FROM range(50)")
    urls = pages.select("url", (F.col("page_id") % 50).alias("query_id"))
    current = pages.where("page_id % 3 = 0").select("url")
    return maintain.golden_plan(batches, queries, urls, current, _now())


def oversized_urls(spark, sf_dir):
    rows = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return maintain.oversized(rows, 45)


def merge_subdomains(spark, sf_dir):
    log = derive.fetch_log(spark, sf_dir)
    rows = log.groupBy("url", (F.col("seq") % 3).alias("copy")).agg(F.max("ts").alias("last_fetch_ok"), F.max("domain_id").alias("domain_id"))
    rows = rows.select("url", (F.col("copy") == 0).alias("canonical"), F.col("copy").cast("int").alias("source"), "domain_id", "last_fetch_ok")
    return maintain.merge_rows(rows)


def merge_event_rows(spark, sf_dir):
    rows = _counters(spark, sf_dir)
    twin = rows.where("day(event_date) % 2 = 0").withColumn("accounted", F.lit(False))
    return maintain.merge_events(rows.withColumn("accounted", F.day("event_date") % 3 == 0).unionByName(twin))


def newest_feature_rows(spark, sf_dir):
    return maintain.newest_features(_feature_rows(spark, sf_dir).drop("seq", "content_length", "num_links", "domain_id"))


def shard_split_plan(spark, sf_dir):
    rows = _hosts_as_domains(spark, sf_dir).withColumn("shard_id", K.shard_of(K.shard_key(F.col("host"))))
    plan = maintain.move_plan(rows, K.shard_key(F.col("host"), ["tionsh.example.net", "blog.tionsh.example.net", "m.ththth.example.net"]))
    return plan.where("moves").select("seq", "url", "shard_id", "new_shard")


def unsplit_plan(spark, sf_dir):
    rows = _hosts_as_domains(spark, sf_dir)
    gone = maintain.subdomains(rows.withColumnRenamed("host", "_h"), "example.net", ("www.example.net",))
    plan = maintain.move_plan(gone, K.registered_domain(F.col("domain")))
    return plan.where("moves").select("seq", "domain", "shard_id", "new_shard")


def parent_reshard_plan(spark, sf_dir):
    rows = derive.crawl_result(spark, sf_dir).withColumn("shard_id", K.shard_of(K.shard_key(F.col("host"))))
    return maintain.move_plan(rows, K.shard_key(F.col("host")), pinned=PINNED).where("moves").select("seq", "url", "shard_id", "new_shard")


def prefer_destination(spark, sf_dir):
    """URLs seen early are there already; all arrive."""
    urls = derive.frontier(spark, sf_dir)
    names = ("url", "domain_id", "num_scheduled_90d")
    return maintain.prefer_destination(urls.where(F.col("first_seen") < F.lit(derive.SPLIT_AT).cast("timestamp")).select(*names), urls.withColumn("num_scheduled_90d", F.lit(0).cast("long")).select(*names))


def snapshot_resync(spark, sf_dir):
    history = derive.fetch_log(spark, sf_dir).select("shard_id", F.col("seq").alias("snapshot_id"))
    sequences = spark.sql("SELECT CAST(id AS INT) AS shard_id, CAST(IF(id % 2 = 0, 10, 100000000) AS BIGINT) AS last_value FROM range(16)")
    return maintain.resync(history, sequences)


def url_link_edges(spark, sf_dir):
    links = routing.explode_links(derive.crawl_result(spark, sf_dir)).select(F.col("discovered_from").alias("src_url"), F.col("url").alias("dst_url"), "anchor", F.col("seq").alias("seen_at"))
    return routing.link_edges(links).withColumn("anchor_hash", F.lower(F.hex("anchor_hash")))


def outlinks_rewritten(spark, sf_dir):
    """Each page's outlinks as one array again, with the ids of the domains that are known."""
    results = derive.crawl_result(spark, sf_dir)
    _, known = _domain_tables(spark, sf_dir)
    rows = routing.rewrite_outlinks(results, known, F.col("host"))
    text = F.transform("outlinks", lambda x: F.concat_ws("|", x["url"], F.coalesce(x["domain_id"].cast("string"), F.lit("-")), x["anchor"]))
    return rows.select("seq", F.size("outlinks").cast("long").alias("num_links"), F.array_join(text, "\n").alias("outlinks"))


def qps_policy(spark, sf_dir):
    hosts = derive.crawl_result(spark, sf_dir).select("host").distinct()
    rates = hosts.where(F.col("host").startswith("blog.")).select("host", F.lit(1.5).alias("delay"), F.lit(2).alias("concurrency"))
    return routing.with_rates(hosts, rates)


def dns_names(spark, sf_dir):
    rows = derive.crawl_result(spark, sf_dir).select(F.when(F.col("seq") % 10 == 0, F.concat(F.col("host"), F.lit("_x"))).otherwise(F.col("host")).alias("name"))
    rows = rows.unionByName(rows.select(F.regexp_extract("name", r"^[^.]*", 0).alias("name"))).unionByName(rows.select(F.repeat(F.substring("name", 1, 1), 70).alias("name")))
    return rows.groupBy(maintain.is_dns_name(F.col("name")).alias("valid")).agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


def _fetch_errors(spark, sf_dir):
    """Every event as the outcome of a fetch: status, error, message and content type."""
    k, m = F.col("event_id") % 7, F.col("event_id") % 5
    size = F.concat(F.lit("Response of "), F.col("user_id").cast("string"), F.lit(" bytes exceeded DOWNLOAD_MAXSIZE by some"))
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.when(k == 0, 400 + F.col("user_id") % 5).when(k == 1, 200).cast("int").alias("status"), F.when(k.isin(2, 3), "IgnoreRequest").when(k == 4, "TimeoutError").alias("error"),
        F.when(k == 2, size).when(k == 3, "Forbidden by robots.txt").alias("message"), F.when(m == 0, "Text/HTML; charset=utf-8").when(m == 1, "application/xhtml+xml").when(m == 2, "image/png").when(m == 3, "").alias("content_type"),
    )


def fail_reasons(spark, sf_dir):
    return _fetch_errors(spark, sf_dir).select("event_id", H.fail_reason(F.col("status"), F.col("error"), F.col("message"), F.col("content_type")).alias("fail_reason"))


def page_types(spark, sf_dir):
    return _fetch_errors(spark, sf_dir).groupBy("content_type").agg(F.count("*").alias("n"), F.max(H.is_page(F.col("content_type"))).alias("is_page"))


def canonicalize_urls(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", H.canonical_url("url").alias("url"))


def parse_pages(spark, sf_dir):
    return H.extract_pages(read_table(spark, sf_dir, "pages").select("url", "html")).select("url", "title", F.size("outlinks").alias("num_links"))


def stream_ingest(spark, sf_dir):
    """The fetch log in two parts of JSON files, each streamed into a store as one batch; the current state afterwards."""
    base = fresh(spark, "stream")
    log, split = derive.fetch_log(spark, sf_dir), F.lit(derive.SPLIT_AT).cast("timestamp")
    store = Store(spark, f"{base}/store")
    for part in (F.col("ts") < split, F.col("ts") >= split):
        log.where(part).write.mode("append").option("timestampFormat", MICROS).json(f"{base}/in")
        streaming.run(streaming.source(spark, f"{base}/in", files_per_batch=None), store, f"{base}/checkpoint").awaitTermination()
    return store.read("url_state_current")


def stream_event_counters(spark, sf_dir):
    """The same stream's daily counters."""
    base = fresh(spark, "stream")
    derive.fetch_log(spark, sf_dir).write.option("timestampFormat", MICROS).json(f"{base}/in")
    store = Store(spark, f"{base}/store")
    streaming.run(streaming.source(spark, f"{base}/in", files_per_batch=None), store, f"{base}/checkpoint").awaitTermination()
    return store.read("url_event_counter")


QUERIES = [
    shard_assign, shard_assign_split, shard_distribution, host_counts, extract_titles, page_overview, outlinks_exploded, route_new_links, domain_registry, domain_overview, ingest_current, ingest_history,
    ingest_snapshots, ingest_outcomes, event_counter_daily, event_counter_merge, content_feature_current, content_feature_history, select_topk_by_domain, select_with_exclusions, schedule_update, queue_pop,
    queue_upsert, refill_decision, rolloff_counters, rolloff_history, rolloff_events, rolloff_report, rolloff_missing, summary_daily, domain_stats_daily, unknown_domain_deadletter, fail_reason_histogram,
    fail_reason_maps, qps_per_worker, qps_sliding, qps_topk_domain, success_rate, latency_percentiles, heartbeat_avg, gauge_running_max, pending_per_domain, ingest_lag, batch_errors_5m, error_kinds, error_tail,
    label_filter, time_buckets, golden_inject_plan, oversized_urls, merge_subdomains, merge_event_rows, newest_feature_rows, shard_split_plan, unsplit_plan, parent_reshard_plan, prefer_destination,
    snapshot_resync, url_link_edges, outlinks_rewritten, qps_policy, dns_names, fail_reasons, page_types, canonicalize_urls, parse_pages, stream_ingest, stream_event_counters,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [*QUERIES, *service.QUERIES]}


def oracle_sql() -> dict[str, str]:
    return oracles.all_oracles() | service.SQL
