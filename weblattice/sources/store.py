"""Tables that change together: versions in Parquet, and one manifest that names the version of each.

A commit writes new folders for the tables that change, then puts a new manifest in place with a single rename. Readers see all of a
commit or none of it. Each commit can carry a stream's id and batch number; a number that this stream has committed before is refused, so that a
repeated micro-batch changes nothing, while another stream (or a new checkpoint) counts for itself. There is one writer.

Tables can be partitioned, by shard say; a reader that filters by that column reads only its folders.

A table can also be merged: a commit writes only the rows that it changes, as a run, and readers put the runs together by the table's
``Rule``, which the manifest keeps. A run takes in the runs before it that are at most twice as large, so a row is written again a number of
times that grows with the logarithm of the table, and there are as few runs. Column ``_run`` is the store's own in such tables.

Folders and manifests that were replaced stay for ``keep`` commits, for those who still read them, and are then deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """How rows of one ``key`` in several runs become one: columns in ``sum`` are added, those in ``first`` are of the oldest run, all others of the newest. Without a key all rows stay."""

    key: list[str] = field(default_factory=list)
    sum: list[str] = field(default_factory=list)
    first: list[str] = field(default_factory=list)

    def combine(self, rows: DataFrame) -> DataFrame:
        if not self.key:
            return rows
        rest = [c for c in rows.columns if c not in (*self.key, *self.sum, *self.first)]
        values = [F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in self.sum] + [F.min_by(c, "_run").alias(c) for c in self.first] + [F.max_by(F.struct(*rest), "_run").alias("_rest")]
        return rows.groupBy(*self.key).agg(*values).select(*[F.col("_rest")[c].alias(c) if c in rest else c for c in rows.columns])


class Store:
    def __init__(self, spark: SparkSession, path: str, partition_by: Mapping[str, str] | None = None, keep: int = 10):
        self.spark, self.path, self.partition_by, self.keep = spark, path.rstrip("/"), dict(partition_by or {}), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*.json"))
        return sorted(int(x.getPath().getName()[9:-5]) for x in found or [])

    def manifest(self) -> dict:
        """The newest manifest: version, the last batch of each stream and the folders of each table."""
        numbers = self._manifests()
        if not numbers:
            return {"version": 0, "batches": {}, "tables": {}}
        text = self.spark.read.text(f"{self.path}/manifest-{numbers[-1]:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, empty: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """The current rows of a table, or ``empty`` if it was never written; with ``keys`` only rows whose columns of these names have those values."""
        manifest = self.manifest()
        folders = manifest["tables"].get(table)
        if not folders:
            return empty
        rows = self.spark.read.parquet(*folders)
        if keys is not None:
            rows = rows.join(keys, keys.columns, "left_semi")
        rule = manifest.get("rules", {}).get(table)
        if rule is None:
            return rows
        return (Rule(**rule).combine(rows) if len(folders) > 1 else rows).drop("_run")

    def commit(
        self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, batch: int | None = None, stream: str = "", merge: dict[str, tuple[DataFrame, Rule]] | None = None
    ) -> bool:
        """Replace, extend or merge into tables in one step; False if that stream has committed this batch, or a later one, before."""
        old = self.manifest()
        batches = dict(old["batches"])
        if batch is not None:
            if batch <= batches.get(stream, -1):
                return False
            batches[stream] = batch
        tables, rules, version, unused = dict(old["tables"]), dict(old.get("rules", {})), old["version"] + 1, []
        for name, rows in (replace or {}).items():
            unused += tables.get(name, [])
            tables[name] = [self._write(name, rows)]
            rules.pop(name, None)
        for name, rows in (append or {}).items():
            tables[name] = [*tables.get(name, []), self._write(name, rows)]
        for name, (rows, rule) in (merge or {}).items():
            runs = [*tables.get(name, []), self._write(name, rows.withColumn("_run", F.lit(version)))]
            tables[name], rules[name] = self._merged(name, runs, rule, version), asdict(rule)
            unused += [r for r in runs if r not in tables[name]]
        dropped = [*old.get("dropped", []), *([version, folder] for folder in unused)]
        gone = [x for x in dropped if x[0] <= version - self.keep]
        text = json.dumps({"version": version, "batches": batches, "tables": tables, "rules": rules, "dropped": [x for x in dropped if x not in gone]})
        trying = self._path(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(trying, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(trying, self._path(f"{self.path}/manifest-{version:012d}.json")):
            raise RuntimeError("another writer has committed this version")
        for folder in [x[1] for x in gone] + [f"{self.path}/manifest-{n:012d}.json" for n in self._manifests() if n <= version - self.keep]:
            self._fs.delete(self._path(folder), True)
        return True

    def _merged(self, name: str, runs: list[str], rule: Rule, version: int) -> list[str]:
        """The runs, the last one put together with those before it that are at most twice as large."""
        sizes = [self._fs.getContentSummary(self._path(r)).getLength() for r in runs]
        first, total = len(runs) - 1, sizes[-1]
        while first and sizes[first - 1] <= 2 * total:
            first -= 1
            total += sizes[first]
        if first == len(runs) - 1:
            return runs
        rows = rule.combine(self.spark.read.parquet(*runs[first:]))
        return [*runs[:first], self._write(name, rows.withColumn("_run", F.lit(version)))]

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
        by = self.partition_by.get(name)
        (rows.write.partitionBy(by) if by else rows.write).parquet(folder)
        return folder
