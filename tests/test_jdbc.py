"""Database tables, with the embedded database that comes with Spark."""

import pytest

from weblattice.sources import jdbc


@pytest.fixture(scope="module")
def url(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return "jdbc:derby:memory:weblattice;create=true"


def test_round_trip_in_ranges(spark, url):
    rows = [(k, k % 7 if k % 11 else None, f"http://h{k}/") for k in range(1000)]
    table = spark.createDataFrame(rows, "id long, shard_id int, url string")
    jdbc.write(table, url, "urls", mode="overwrite")
    found = jdbc.read(spark, url, "urls", by="shard_id", parts=5)
    assert found.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, found.collect())) == rows
    one = found.where("shard_id = 3").select("url")
    assert "PushedFilters" in one._jdf.queryExecution().toString() and one.count() == sum(r[1] == 3 for r in rows)
    jdbc.write(table.limit(10), url, "urls")
    assert jdbc.read(spark, url, "urls").count() == 1010


def test_a_table_without_rows(spark, url):
    none = spark.createDataFrame([], "id long, url string")
    jdbc.write(none, url, "no_urls", mode="overwrite")
    found = jdbc.read(spark, url, "no_urls", by="id")
    assert found.count() == 0 and [c.lower() for c in found.columns] == ["id", "url"]
