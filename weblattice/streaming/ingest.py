"""Structured Streaming over record files: each micro-batch is folded into the store in one commit.

Files that arrive late are still read (a folder reader with a progress mark would lose them); event-time windows drop
what is older than the watermark. A micro-batch that is run again finds its number, kept under its stream's id, in the store and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weblattice.operators import ingest, stats
from weblattice.sources import records as files
from weblattice.sources.store import Rule, Store

RECORD = "seq long, batch_no long, kind int, ts timestamp, day date, domain_id long, shard_id int, url string, status string, fail_reason string, content_hash string, title string, discovered_from string, domain_score double"
CURRENT = Rule(["url"])
COUNTER = Rule(["url", "event_date"], sum=["num_scheduled", "num_fetch_ok", "num_fetch_fail", "num_content_update"], first=["accounted"])


def source(spark: SparkSession, path: str, schema: str = RECORD, files_per_batch: int | None = 10) -> DataFrame:
    """JSON line files below ``path``, oldest first, a few at a time; None takes all there are in one batch."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*")
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).json(path)


def fold_batch(store: Store, rows: DataFrame, batch: int, stream: str = "") -> bool:
    """Fold one micro-batch into current rows, event counters and history, all in one commit.

    It meets only the current rows of its own URLs and writes only what it changes, as a run of each table.
    """
    spark = rows.sparkSession
    current = store.read("url_state_current", ingest.no_state(spark), keys=rows.select("url").distinct())
    folded = ingest.fold(rows, current).persist()
    try:
        newest = ingest.apply_fold(folded, ingest.no_state(spark))
        added = ingest.event_counters(folded, F.to_date("ts"))
        return store.commit(batch=batch, stream=stream, merge={"url_state_current": (newest, CURRENT), "url_event_counter": (added, COUNTER), "url_state_history": (folded, Rule())})
    finally:
        folded.unpersist()


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that has this checkpoint; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def start(records: DataFrame, apply: Callable[[DataFrame, int, str], object], checkpoint: str) -> StreamingQuery:
    """Start ``apply`` (rows, batch, stream id) on all files there are; the checkpoint is the progress mark."""

    def step(rows: DataFrame, batch: int) -> None:
        apply(rows, batch, _stream_id(rows.sparkSession, checkpoint))

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(records: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Start folding all files there are into the store."""
    return start(records, lambda rows, batch, stream: fold_batch(store, rows, batch, stream), checkpoint)


def apply_deltas(store: Store, rows: DataFrame, batch: int, stream: str = "") -> bool:
    """Add a batch of stats deltas to the daily summary, in one commit."""
    added = stats.summary_daily(files.long_deltas(rows).where("scope = 'all'"), ["day"])
    stored = store.read("summary_daily")
    return store.commit({"summary_daily": added if stored is None else stats.merge_summary(stored, added, ["day"])}, batch=batch, stream=stream)


def delta_source(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """Stats delta files, ten a pass."""
    return source(spark, path, files.STATS_DELTA, files_per_batch)


def windowed_counts(records: DataFrame, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Fetches by event-time window and status, with a watermark of twice the bucket."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "status", "n")
