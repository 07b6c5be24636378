"""Merged tables of the store against a dict, and what stays on disk."""

import os
import random

from weblattice.sources.store import Rule, Store

RULE = Rule(["k"], sum=["n"], first=["born"])


def test_runs_equal_a_dict(spark, tmp_path):
    store, model, rng, runs = Store(spark, f"file://{tmp_path}/s", keep=3), {}, random.Random(5), []
    for batch in range(12):
        changed = rng.sample(range(40), 6)
        rows = [(k, batch, f"b{batch}", None if k % 4 == 0 else f"t{batch}") for k in changed]
        for k, n, born, text in rows:
            before = model.get(k)
            model[k] = (n + before[0], before[1], text) if before else (n, born, text)
        table = spark.createDataFrame(rows, "k int, n long, born string, text string").coalesce(1)
        assert store.commit(batch=batch, merge={"t": (table, RULE), "h": (table, Rule())})
        assert not store.commit(batch=batch, merge={"t": (table, RULE)})
        runs.append(len(store.manifest()["tables"]["t"]))
    found = Store(spark, f"file://{tmp_path}/s").read("t")
    assert found.columns == ["k", "n", "born", "text"]
    assert {r.k: (r.n, r.born, r.text) for r in found.collect()} == model
    assert store.read("h").count() == 72 and max(runs) <= 4
    some = spark.createDataFrame([(k,) for k in (1, 2, 99)], "k int")
    assert {r.k for r in store.read("t", keys=some).collect()} == {1, 2} & set(model)
    manifest = store.manifest()
    kept = {f.rsplit("/", 1)[1] for f in manifest["tables"]["t"]} | {f.rsplit("/", 1)[1] for _, f in manifest["dropped"]}
    assert set(os.listdir(tmp_path / "s" / "t")) <= kept
    assert len([f for f in os.listdir(tmp_path / "s") if f.startswith("manifest-")]) == 3


def test_small_batches_leave_a_large_run_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(merge={"t": (spark.range(200_000).selectExpr("id AS k", "uuid() AS text"), Rule(["k"]))})
    large = store.manifest()["tables"]["t"]
    for n in range(3):
        store.commit(merge={"t": (spark.createDataFrame([(n, "new")], "k long, text string"), Rule(["k"]))})
    assert store.manifest()["tables"]["t"][:1] == large
    assert store.read("t").count() == 200_000 and store.read("t").where("text = 'new'").count() == 3


def test_a_replaced_table_is_no_longer_merged(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([(1, "a")], "k long, text string")
    store.commit(merge={"t": (one, Rule(["k"]))})
    store.commit({"t": one.unionAll(one)})
    assert store.read("t").count() == 2
