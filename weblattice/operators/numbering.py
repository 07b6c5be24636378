"""Consecutive numbers in an order, without a window over all rows of a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblattice.sources.scratch import cut


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows with a column ``name``: 1, 2, 3 and so on in each group of ``by`` (not null), in that order.

    Rows are dealt by ranges of group and order and written; only the ranges' counts meet, as many rows as ranges and groups. A large group
    takes many ranges, each of which numbers its own rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(by), *map(F.col, order)]
    ranges = cut(rows.repartitionByRange(parts, *keys).withColumn("n_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("n_by").orderBy("n_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(F.col(by).alias("n_by"), F.col("n_range").alias("n_at")).agg(F.count("*").alias("n_rows"))
    starts = counts.select("n_by", "n_at", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("n_start"))
    within: Column = F.row_number().over(Window.partitionBy("n_range", by).orderBy(*order))
    joined = ranges.withColumn("n_within", within).join(starts, (F.col(by) == F.col("n_by")) & (F.col("n_range") == F.col("n_at")))
    return joined.withColumn(name, (F.col("n_start") + F.col("n_within")).cast("long")).drop("n_range", "n_by", "n_at", "n_start", "n_within")
