"""The driver tables and how Python workers find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers started from here on import this package from the driver's path.

    On a cluster without a common file system, submit with ``--py-files`` instead; then this adds nothing.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder, through Spark's own readers only."""
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
