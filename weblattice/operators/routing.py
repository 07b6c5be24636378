"""Routing crawl results to shards, binding domains and exploding outlinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblattice.functions import keys as K


def assign_shards(rows: DataFrame, host: str = "host", shards: int = 256, pinned: Mapping[str, int] | None = None, split_hosts: Iterable[str] = (), per_ingestor: int = 16) -> DataFrame:
    """rows with shard_key, shard_id and ingestor_id."""
    keyed = rows.withColumn("shard_key", K.shard_key(F.col(host), split_hosts))
    return keyed.withColumn("shard_id", K.shard_of(F.col("shard_key"), shards, pinned)).withColumn("ingestor_id", K.ingestor_of(F.col("shard_id"), per_ingestor))


def shard_range(offerer_id: int, shards: int = 256, each: int = 16) -> range:
    """The shards of one offerer; an id beyond the last is an error."""
    if offerer_id < 0 or (offerer_id + 1) * each > shards:
        raise ValueError(f"offerer {offerer_id} has no shards")
    return range(offerer_id * each, (offerer_id + 1) * each)


def resolve_domains(domains: DataFrame, known: DataFrame) -> DataFrame:
    """The domain table after binding ``domains`` (domain, shard_id): new ones get the next ids, a changed shard is rewritten.

    New domains are numbered within 4,096 buckets of their MD5, by name, after the counts of the buckets before: only those counts meet in one place.

    ``known`` has domain_id, domain, shard_id and domain_score; the result adds ``change``: new, moved or same.
    """
    seen = domains.groupBy("domain").agg(F.min("shard_id").alias("new_shard"))
    last = known.agg(F.coalesce(F.max("domain_id"), F.lit(0)).alias("last"))
    fresh = seen.join(known.select("domain"), "domain", "left_anti")
    fresh = fresh.withColumn("bucket", F.substring(F.md5(F.col("domain").cast("binary")), 1, 3))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = fresh.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("domain"))
    numbered = fresh.join(starts, "bucket").withColumn("domain_id", within + F.col("start")).crossJoin(F.broadcast(last))
    fresh = numbered.select((F.col("domain_id") + F.col("last")).alias("domain_id"), "domain", F.col("new_shard").alias("shard_id"), F.lit(0.0).alias("domain_score"), F.lit("new").alias("change"))
    moved = F.col("new_shard").isNotNull() & ~F.col("new_shard").eqNullSafe(F.col("shard_id"))
    old = known.join(seen, "domain", "left").select("domain_id", "domain", F.when(moved, F.col("new_shard")).otherwise(F.col("shard_id")).alias("shard_id"), "domain_score", F.when(moved, "moved").otherwise("same").alias("change"))
    return old.unionByName(fresh)


def explode_links(results: DataFrame, url: str = "url", outlinks: str = "outlinks") -> DataFrame:
    """One row per outlink of a page: seq, position, url, host, anchor and the page it was found on; no empty or oversized ones."""
    rows = results.select("seq", F.col(url).alias("discovered_from"), F.posexplode(outlinks).alias("position", "link"))
    rows = rows.select("seq", "position", F.col("link.url").alias("url"), F.col("link.anchor").alias("anchor"), "discovered_from")
    return rows.where(K.fits_url_cap(F.col("url")) & (F.col("url") != "")).select("seq", "position", "url", K.host_of(F.col("url")).alias("host"), "anchor", "discovered_from")


def rewrite_outlinks(results: DataFrame, domains: DataFrame, key: Column) -> DataFrame:
    """seq and outlinks (url, domain_id, anchor) of every page that has any, in order, with the ids of the links' domains; ``key`` is a link's domain by its host."""
    known = domains.select(F.col("domain").alias("known_domain"), F.col("domain_id").alias("known_id"))
    rows = explode_links(results).withColumn("domain", key)
    bound = rows.join(known, F.col("domain") == F.col("known_domain"), "left")
    link = F.struct("position", F.struct("url", F.col("known_id").alias("domain_id"), "anchor").alias("link"))
    return bound.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(link)), lambda x: x["link"]).alias("outlinks"))


def first_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links to URLs that are not known yet, each with the first page that has it."""
    first = Window.partitionBy("url").orderBy("seq", "position")
    return links.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").join(known.select("url"), "url", "left_anti")


def link_edges(links: DataFrame, anchors: str = "anchor") -> DataFrame:
    """Edges with the digest of the anchor text, and the first and last time they were seen."""
    return links.groupBy("src_url", "dst_url", F.unhex(F.md5(F.col(anchors).cast("binary"))).alias("anchor_hash")).agg(F.min(anchors).alias("anchor_text"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def page_features(results: DataFrame) -> DataFrame:
    """Content length, digest and number of links of pages that were fetched."""
    return results.where("status = 'ok'").select("seq", "url", F.length("content").cast("long").alias("content_length"), "content_hash", F.greatest(F.size("outlinks"), F.lit(0)).cast("long").alias("num_links"))


def latest_features(rows: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One feature row per URL: the last to arrive, but with the domain of the first (or of the stored row)."""
    order = Window.partitionBy("url").orderBy(F.desc("seq"))
    last = rows.withColumn("_k", F.row_number().over(order)).withColumn("domain_id", F.last("domain_id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("_k = 1").drop("_k", "seq")
    if current is None:
        return last
    kept = current.select(F.col("url").alias("u"), F.col("domain_id").alias("d"))
    merged = last.join(kept, last.url == kept.u, "left").withColumn("domain_id", F.coalesce("d", "domain_id")).drop("u", "d")
    return merged.unionByName(current.join(last.select("url"), "url", "left_anti").select(*merged.columns))


def with_rates(domains: DataFrame, rates: DataFrame, delay: float = 5.0, concurrency: int = 4) -> DataFrame:
    """Politeness of each host, with defaults."""
    return domains.join(rates, "host", "left").withColumn("delay", F.coalesce("delay", F.lit(delay))).withColumn("concurrency", F.coalesce("concurrency", F.lit(concurrency)))
