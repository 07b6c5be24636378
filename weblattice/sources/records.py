"""Record files: JSON lines in time-bucketed folders, queue files, stats deltas, and settings."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
#: Timestamps in JSON keep their microseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
OUTLINKS = "array<struct<url:string,domain:string,anchor:string>>"
CRAWL_RESULT = f"url string, domain string, fetched_at timestamp, status string, fail_reason string, content string, outlinks {OUTLINKS}, title string"
ROUTED = "url string, status string, fetched_at timestamp, fail_reason string, content string, outlinks array<struct<url:string,domain_id:long,anchor:string>>, shard_id int, domain_id long, content_hash string, title string, domain_score double, discovered_from string"
QUEUE_FILE = "generated_at timestamp, domain_id long, urls array<string>"
STATS_DELTA = "generated_at timestamp, source string, counters map<string,string>, domains map<string,map<string,string>>"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, pattern: str = "*.{json,jsonl}") -> tuple[DataFrame, DataFrame]:
    """Records of all matching files below ``path`` and, apart, the lines that do not parse; blank lines are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).where(F.trim("value") != "")
    rows = lines.select(F.input_file_name().alias("file"), F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return rows.where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT), rows.where(F.col(f"r.{CORRUPT}").isNotNull()).select(f"r.{CORRUPT}", "file")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def bucket_of(path: Column) -> Column:
    """Start of the time bucket in a file's path, ``.../YYYYMMDD/HHMM/...``; null if it has none."""
    day, minute = (F.regexp_extract(path, r"/(\d{8})/(\d{4})/[^/]*$", k) for k in (1, 2))
    return F.try_to_timestamp(F.nullif(F.concat(day, minute), F.lit("")), F.lit("yyyyMMddHHmm"))


def ready_records(rows: DataFrame, path: Column, now: Column, after: Column | None = None, minutes: int = 10) -> DataFrame:
    """Rows of buckets that are ready at ``now`` and later than the progress mark ``after``."""
    bucket = bucket_of(path)
    fit = now >= bucket + F.expr(f"INTERVAL {2 * minutes} MINUTES")
    return rows.withColumn("bucket", bucket).where(fit if after is None else fit & (F.col("bucket") > after))


def ready_folders(folders: DataFrame, now: Column, after: Column | None = None, minutes: int = 10) -> DataFrame:
    """Folders (bucket) later than the progress mark, up to the first that is not ready."""
    late = folders.where("bucket IS NOT NULL" if after is None else F.col("bucket") > after)
    stop = late.where(now < F.col("bucket") + F.expr(f"INTERVAL {2 * minutes} MINUTES")).agg(F.min("bucket").alias("stop"))  # one row
    return late.crossJoin(F.broadcast(stop)).where("stop IS NULL OR bucket < stop").drop("stop")


def folder_counters(good: DataFrame, bad: DataFrame, folder: str = "folder", file: str = "file") -> DataFrame:
    """Files and records that failed, by folder."""
    every = good.select(folder, file, F.lit(0).alias("failed")).unionByName(bad.select(folder, file, F.lit(1).alias("failed")))
    return every.groupBy(folder).agg(F.count_distinct(file).alias("file_cnt"), F.sum("failed").alias("error"))


def error_delta(bad: DataFrame, source: str, counter: str, now: Column) -> DataFrame:
    """The stats delta of records that could not be used: each counts as an error, and as one of that kind; no row if there is none."""
    n = bad.agg(F.count("*").alias("n")).where("n > 0")
    counters = F.create_map(F.lit("error_count"), F.col("n").cast("string"), F.lit(counter), F.col("n").cast("string"))
    return n.select(now.alias("generated_at"), F.lit(source).alias("source"), counters.alias("counters"), F.create_map().cast("map<string,map<string,string>>").alias("domains"))


def write_deltas(deltas: DataFrame, path: str, by: str) -> None:
    """One JSON file for each value of ``by``, in whole seconds."""
    rows = deltas.withColumn("generated_at", F.date_trunc("second", "generated_at"))
    rows.repartition(by).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").partitionBy(by).json(path)


LOG_LINE = "ts timestamp, level string, logger string, message string, event string, service string, worker_id int, shard int, url string, domain string, status int, latency_ms long, fail_reason string"


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log lines as columns, the labels among them; lines that do not parse are dropped."""
    rows = lines.select(F.from_json(line, f"{LOG_LINE}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return rows.where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)


def land(items: DataFrame, path: str, now: Column, minutes: int = 10) -> None:
    """Append fetched items as JSON lines by time bucket; status and fetch time are derived."""
    start = F.window(now.cast("timestamp"), f"{minutes} minutes")["start"]
    rows = items.withColumn("fetched_at", F.coalesce("fetched_at", now)).withColumn("status", F.when(F.coalesce("content", F.lit("")) != "", "ok").otherwise("fail"))
    rows.withColumn("date", F.date_format(start, "yyyyMMdd")).withColumn("time", F.date_format(start, "HHmm")).write.mode("append").option("timestampFormat", MICROS).partitionBy("date", "time").json(path)


def queue_ids(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct domain ids of queue file names ``domain_{id:06d}.json``; other names are ignored."""
    found = F.regexp_extract(column, r"(?:^|/)domain_(\d+)\.json$", 1)
    return paths.where(found != "").select(found.cast("long").alias("domain_id")).distinct()


def queue_counts(paths: DataFrame, column: str = "path") -> DataFrame:
    """One row: files that are ready (named for a domain) and their domains."""
    ready = F.regexp_extract(column, r"(?:^|/)domain_(\d+)\.json$", 1)
    return paths.agg(F.count_if(ready != "").alias("batches"), F.count_distinct(F.nullif(ready, F.lit("")).cast("long")).alias("domains"))


def queue_name(domain_id: Column) -> Column:
    """Name of a domain's queue file."""
    return F.concat(F.lit("domain_"), F.when(F.length(domain_id.cast("string")) < 6, F.lpad(domain_id.cast("string"), 6, "0")).otherwise(domain_id.cast("string")), F.lit(".json"))


def long_deltas(deltas: DataFrame) -> DataFrame:
    """Stats deltas as rows day, scope, domain_id, counter, reason and n; what is no number is dropped."""
    day = F.to_date(F.coalesce("generated_at", F.current_timestamp())).alias("day")

    def rows(frame: DataFrame, scope: str, domain: Column, counters: str) -> DataFrame:
        every = frame.select("day", domain.alias("domain_id"), F.explode(counters).alias("counter", "value"))
        plain = every.where("counter <> 'fail_reasons'").select("day", F.lit(scope).alias("scope"), "domain_id", "counter", F.lit(None).cast("string").alias("reason"), F.expr("try_cast(value AS BIGINT)").alias("n"))
        told = every.where("counter = 'fail_reasons'").select("day", "domain_id", F.explode(F.from_json("value", "map<string,bigint>")).alias("reason", "n"))
        return plain.unionByName(told.select("day", F.lit(scope).alias("scope"), "domain_id", F.lit("fail_reasons").alias("counter"), "reason", "n"))

    whole = rows(deltas.select(day, "counters"), "all", F.lit(None).cast("string"), "counters")
    each = deltas.select(day, F.explode("domains").alias("domain_id", "counters"))
    return whole.unionByName(rows(each, "domain", F.col("domain_id"), "counters")).where("n IS NOT NULL")


def require(settings: dict[str, Any], *names: str) -> Any:
    """A nested setting; ValueError if any part of its name is missing."""
    found: Any = settings
    for k, name in enumerate(names):
        if not isinstance(found, dict) or name not in found:
            raise ValueError(f"missing setting: {'.'.join(names[: k + 1])}")
        found = found[name]
    return found


def load_settings(path: str) -> dict[str, Any]:
    """A YAML file of the driver."""
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}
