"""Tables of a database: partitioned reads, and writes in batches over a bounded number of connections.

The driver's class has to be on Spark's class path. A read by a whole-number column opens ``parts`` connections, each for one range of
its values; rows without a value are read with the first range. Filters and column choices reach the database.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, url: str, table: str, by: str | None = None, parts: int = 16, options: Mapping[str, str] | None = None) -> DataFrame:
    """All rows of ``table``; with ``by`` in ranges between its least and greatest value, which the database is asked for."""
    reader = spark.read.format("jdbc").options(**(options or {})).option("url", url)
    if by is not None:
        name = f'"{by}"'
        low, high = reader.option("query", f"SELECT min({name}) AS low, max({name}) AS high FROM {table}").load().first()
        reader = spark.read.format("jdbc").options(**(options or {})).option("url", url)
        if low is not None:
            reader = reader.option("partitionColumn", name).option("lowerBound", str(low)).option("upperBound", str(high + 1)).option("numPartitions", str(parts))
    return reader.option("dbtable", table).load()


def write(rows: DataFrame, url: str, table: str, mode: str = "append", connections: int = 16, batch: int = 500, options: Mapping[str, str] | None = None) -> None:
    """Write ``rows`` in batches; each connection commits by itself, so an append that is tried again can repeat rows: write to a table of its own and move it within the database."""
    writer = rows.write.format("jdbc").mode(mode).options(**(options or {}))
    writer.option("url", url).option("dbtable", table).option("numPartitions", str(connections)).option("batchsize", str(batch)).option("truncate", "true").save()
