"""Maintenance: re-sharding, merging, sweeps and repairs, each as a plan and as the tables it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblattice.functions import keys as K


def oversized(urls: DataFrame, most: int = K.MAX_URL, columns: tuple[str, ...] = ("url",)) -> DataFrame:
    """Rows of which any of the columns has more bytes than the cap."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.coalesce(F.octet_length(c), F.lit(0)) > most)
    return urls.where(hit)


def sweep(urls: DataFrame, most: int = K.MAX_URL, columns: tuple[str, ...] = ("url",)) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.coalesce(F.octet_length(c), F.lit(0)) <= most)
    return urls.where(keep)


def host_counts(urls: DataFrame) -> DataFrame:
    """URLs of each host, how many were ever fetched, and the shards they lie in."""
    host = F.coalesce(K.http_host(F.col("url")), F.lit("(null)"))
    return urls.groupBy(host.alias("host")).agg(F.count("*").alias("urls"), F.sum(F.when(F.col("last_fetch_ok").isNotNull(), 1).otherwise(0)).alias("fetched"), F.sort_array(F.collect_set("shard_id")).alias("shards"))


def subdomains(domains: DataFrame, parent: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Domains below a parent that are not on the keep list."""
    return domains.where(F.col("domain").endswith(f".{parent}") & (F.col("domain") != parent) & ~F.col("domain").isin(*keep, ""))


def is_dns_name(name: Column) -> Column:
    return F.coalesce(name.rlike(K.DNS_NAME), F.lit(False))


def move_plan(urls: DataFrame, new_key: Column, shards: int = 256, pinned: dict[str, int] | None = None) -> DataFrame:
    """urls with their new shard and whether they move."""
    rows = urls.withColumn("new_shard", K.shard_of(new_key, shards, pinned))
    return rows.withColumn("moves", ~F.col("new_shard").eqNullSafe(F.col("shard_id")))


def shard_spread(plan: DataFrame) -> DataFrame:
    return plan.groupBy("new_shard").agg(F.count("*").alias("urls"), F.sum(F.col("moves").cast("long")).alias("moving"))


def prefer_destination(there: DataFrame, arriving: DataFrame, key: str = "url") -> DataFrame:
    """Rows at the destination, and arriving ones whose key is not there yet."""
    return there.unionByName(arriving.join(there.select(key), key, "left_anti").select(*there.columns))


def merge_rows(rows: DataFrame) -> DataFrame:
    """Rows of one URL become one: the canonical row wins, the source is the greatest. ``rows`` has canonical (boolean)."""
    columns = [c for c in rows.columns if c not in ("url", "canonical", "source")]
    order = Window.partitionBy("url").orderBy(F.desc("canonical"), *[F.asc_nulls_last(c) for c in columns])
    best = rows.withColumn("source", F.max("source").over(Window.partitionBy("url"))).withColumn("_k", F.row_number().over(order))
    return best.where("_k = 1").drop("_k", "canonical")


def merge_events(rows: DataFrame) -> DataFrame:
    """Additive by URL and day; accounted if any row is."""
    return rows.groupBy("url", "event_date").agg(*[F.sum(c).alias(c) for c in ("num_scheduled", "num_fetch_ok", "num_fetch_fail", "num_content_update")], F.max("accounted").alias("accounted"))


def newest_features(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("url").orderBy(F.desc_nulls_last("fetched_at"), F.asc_nulls_last("content_hash"))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def moved_events(events: DataFrame, moving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of URLs that move, and those that stay."""
    return events.join(moving.select("url"), "url", "left_semi"), events.join(moving.select("url"), "url", "left_anti")


def resync(history: DataFrame, sequences: DataFrame) -> DataFrame:
    """Shards whose sequence (shard_id, last_value) is behind their largest snapshot id."""
    top = history.groupBy("shard_id").agg(F.max("snapshot_id").alias("max_id"))
    return top.join(sequences, "shard_id").where("max_id > last_value")


def golden_plan(batches: DataFrame, queries: DataFrame, urls: DataFrame, current: DataFrame, now: Column, weeks: int = 4) -> DataFrame:
    """What happens to each URL of the batches that are old enough: inject, mark or failed; with its domain and shard. One row for each URL, however often ``current`` has it."""
    old = batches.where(F.col("created_at") <= now - F.expr(f"INTERVAL {7 * weeks} DAYS")).select(F.col("id").alias("batch_id"))
    asked = queries.join(old, "batch_id", "left_semi").select(F.col("id").alias("query_id"))
    rows = urls.join(asked, "query_id", "left_semi").select("url").distinct()
    domain = K.registered_domain(K.host_of(F.col("url")))
    rows = rows.withColumn("domain", domain).join(current.select("url").distinct().withColumn("_known", F.lit(1)), "url", "left")
    action = F.when(~K.fits_url_cap(F.col("url")) | F.col("domain").isNull(), "failed").when(F.col("_known").isNotNull(), "mark").otherwise("inject")
    return rows.select("url", "domain", F.when(action != "failed", K.shard_of(F.col("domain"))).alias("shard_id"), action.alias("action"))


def apply_golden(plan: DataFrame, current: DataFrame, source: int = 1) -> DataFrame:
    """current after the plan: known URLs are marked, new ones inserted; both with that source."""
    marked = plan.where("action = 'mark'").select("url", F.lit(source).alias("_source"))
    rows = current.join(marked, "url", "left").withColumn("source", F.coalesce("_source", "source").cast("int")).drop("_source")
    return rows.unionByName(plan.where("action = 'inject'").select("url", F.lit(source).cast("int").alias("source")), allowMissingColumns=True)


def top_hosts(counts: DataFrame, n: int) -> DataFrame:
    """The hosts with most fetched URLs, with the sum of all hosts; ties by host."""
    total = counts.agg(F.sum("fetched").alias("total"), F.count("*").alias("hosts"))  # one row
    return counts.orderBy(F.desc("fetched"), "host").limit(n).crossJoin(F.broadcast(total))


def apply_move(tables: dict[str, DataFrame], moving: DataFrame, additive: bool = True, new_ids: bool = True, drop_domains: bool = False) -> dict[str, DataFrame]:
    """The tables after their rows of some domains have moved; ``moving`` has domain_id, new_domain_id and new_shard, once for each domain.

    current: url, domain_id, shard_id and more; a row that is at the destination already wins. history: url, domain_id, shard_id, snapshot_id and more; rows get the next
    ids of their new shard (``new_ids``) or keep theirs. events: url, event_date, shard_id, counters and accounted, which go with their URLs, and are added to
    those at the destination (``additive``) or give way to them. domains: domain_id, shard_id and more; a domain that has moved has its new shard, or is gone (``drop_domains``).
    """
    to = moving.select(F.col("domain_id").alias("m_from"), F.col("new_domain_id").alias("m_to"), F.col("new_shard").alias("m_shard"))
    moved = F.col("m_from").isNotNull()

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(to, F.col("domain_id") == F.col("m_from"), "left").withColumn("m_moved", moved)
        return rows.withColumn("domain_id", F.when(moved, F.col("m_to")).otherwise(F.col("domain_id"))).withColumn("shard_id", F.when(moved, F.col("m_shard")).otherwise(F.col("shard_id"))).drop("m_from", "m_to", "m_shard")

    out = {}
    here = Window.partitionBy("shard_id", "url").orderBy("m_moved", "m_old")
    arrived = placed(tables["current"].withColumn("m_old", F.col("domain_id")))
    out["current"] = arrived.withColumn("m_k", F.row_number().over(here)).where("m_k = 1").drop("m_k", "m_old", "m_moved")

    history = placed(tables["history"])
    if new_ids:
        last = tables["history"].groupBy(F.col("shard_id").alias("l_shard")).agg(F.max("snapshot_id").alias("l_last"))
        came = history.where("m_moved").join(last, F.col("shard_id") == F.col("l_shard"), "left")
        order = Window.partitionBy("shard_id").orderBy("snapshot_id", "url")
        came = came.withColumn("snapshot_id", F.coalesce("l_last", F.lit(0)) + F.row_number().over(order)).drop("l_shard", "l_last")
        history = history.where("NOT m_moved").unionByName(came)
    out["history"] = history.drop("m_moved")

    urls = tables["current"].join(to, F.col("domain_id") == F.col("m_from")).select(F.col("url").alias("m_url"), F.col("shard_id").alias("m_at"), "m_shard").distinct()
    same = (F.col("url") == F.col("m_url")) & (F.col("shard_id") == F.col("m_at"))
    goes = tables["events"].join(urls, same).withColumn("shard_id", F.col("m_shard")).drop("m_url", "m_at", "m_shard")
    stays = tables["events"].join(urls, same, "left_anti")
    if additive:
        both = stays.unionByName(goes).groupBy("shard_id", "url", "event_date")
        out["events"] = both.agg(*[F.sum(c).alias(c) for c in ("num_scheduled", "num_fetch_ok", "num_fetch_fail", "num_content_update")], F.max("accounted").alias("accounted"))
    else:
        out["events"] = stays.unionByName(goes.join(stays.select("shard_id", "url", "event_date"), ["shard_id", "url", "event_date"], "left_anti").select(*stays.columns))

    domains = tables["domains"].join(to, F.col("domain_id") == F.col("m_from"), "left")
    domains = domains.where(~moved) if drop_domains else domains.withColumn("shard_id", F.when(moved, F.col("m_shard")).otherwise(F.col("shard_id")))
    out["domains"] = domains.drop("m_from", "m_to", "m_shard")
    return out


def move_counts(tables: dict[str, DataFrame], moving: DataFrame) -> DataFrame:
    """What a move would take along, as a dry run says: table and rows."""
    of = moving.select("domain_id").distinct()
    urls = tables["current"].join(of, "domain_id", "left_semi").select("url", "shard_id").distinct()
    taken = {"current": tables["current"].join(of, "domain_id", "left_semi"), "history": tables["history"].join(of, "domain_id", "left_semi"), "event": tables["events"].join(urls, ["url", "shard_id"], "left_semi")}
    parts = [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, rows in taken.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def add_column(rows: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """rows with a further column, unless they have it; nulls take the default."""
    value = F.lit(default).cast(kind)
    return rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
