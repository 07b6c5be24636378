"""The shared folder of intermediate tables."""

import os
from types import SimpleNamespace

import pytest

from weblattice.sources import scratch


def session(master, named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named or default), sparkContext=SimpleNamespace(master=master, applicationId="app-test"))


def test_a_cluster_must_name_its_folder():
    for master in ("spark://h:7077", "yarn", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.folder(session(master))
        assert scratch.folder(session(master, "hdfs://n/shared/")) == "hdfs://n/shared"
    assert scratch.folder(session("local[2]")).startswith("file://")


def test_tables_are_dropped(spark):
    one, two = (scratch.cut(spark.range(3), "test") for _ in range(2))
    paths = [t.scratch_path.removeprefix("file://") for t in (one, two)]
    assert one.count() == 3 and all(map(os.path.isdir, paths))
    scratch.drop(one)
    assert [os.path.isdir(p) for p in paths] == [False, True]
    scratch.drop(spark.range(1))  # not a table of cut: nothing happens
    scratch.clear(spark)
    assert not os.path.isdir(paths[1])
