import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from weblattice.sources.tables import reach_workers

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    reach_workers(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Compare a query with its SQL, as sets of rows with columns by name."""

    def check(query, sql):
        frame = query(spark, sf_dir)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(frame.columns)
        order = sorted(names)
        ours = sorted(tuple(repr(r[c]) for c in order) for r in frame.collect())
        theirs = sorted(tuple(repr(r[names.index(c)]) for c in order) for r in found.fetchall())
        assert ours == theirs

    return check
