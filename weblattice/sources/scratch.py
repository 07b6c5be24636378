"""Intermediate tables in the folder that the driver and all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset and the master is local (tests, a single
machine) is a temporary folder made. A written table cuts the lineage and survives the loss of any executor.

Tables lie in one folder for each application. ``drop`` deletes one whose readers are done; what a returned DataFrame still reads stays until
``clear``, or until the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_USED: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; ValueError on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share: the master is {master}")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        made = tempfile.mkdtemp(prefix="weblattice-")
        atexit.register(shutil.rmtree, made, True)
        _OWN[app] = f"file://{made}"
    return _OWN[app]


def _home(spark: SparkSession) -> str:
    return f"{folder(spark)}/weblattice-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    home = _home(spark)
    if home not in _USED:
        if not _USED:
            atexit.register(_clear_all)
        _USED[home] = spark
    return f"{home}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete a table made by ``cut`` whose rows nothing will read again."""
    path = getattr(df, "scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has left in the shared folder."""
    _delete(spark, _home(spark))


def _clear_all() -> None:
    for spark in _USED.values():
        with contextlib.suppress(Exception):  # the session may be stopped already
            clear(spark)
