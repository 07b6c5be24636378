"""The Jaccard join where ids are shared, missing or very frequent, and where columns clash."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblattice.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset()


def like(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def brute(rows):
    """component of each id, and links of each row with an id: the other pairs of an id and a set."""
    sets = [(i, shingles(t)) for i, t in rows]
    ids = {i: i for i, _ in rows if i is not None}
    pairs = {(i, s) for i, s in sets if i is not None}
    for i, s in pairs:
        for j, r in pairs:
            if ids[i] != ids[j] and like(s, r):
                low, high = sorted((ids[i], ids[j]))
                ids = {k: low if v == high else v for k, v in ids.items()}
    links = [None if i is None else sum(like(s, r) for p in pairs for r in [p[1]] if p != (i, s)) for i, s in sets]
    return [(i, len(s), ids.get(i), n) for (i, s), n in zip(sets, links, strict=True)]


def found(spark, table, **more):
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})
    return [tuple(r) for r in jaccard.similar(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_ids_with_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, a), (5, a), (5, b), (7, b), (7, "alone with a seven of its own"), (7, None), (9, "alone"), (9, "alone again"), (None, a)]
    assert order(found(spark, rows, block=1, grams="x", rows=2)) == order(brute(rows))
    assert {r[2] for r in found(spark, rows) if r[0] in (3, 5, 7)} == {3}


@pytest.mark.parametrize("seed", [1])
def test_random_shared_ids(spark, seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 20, 60]))] for _ in range(25)]
    rows = []
    for _ in range(160):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((rng.choice([None, *range(1, 90)]), rng.choice([" ", "\n"]).join(own)))
    rows += rows[:10] + [(k, t and t.upper()) for k, t in rows[10:20]]
    assert order(found(spark, rows)) == order(brute(rows))


def test_frequent_texts_and_null_ids(spark):
    """A third of the rows is one text, a third has no id; blocks do not gather either."""
    text = "one text that very many documents have in common"
    rows = [(k, text) for k in range(300)] + [(None, f"no id {k} " * 4) for k in range(300)] + [(1000 + k, f"own text number {k} " * 3) for k in range(300)]
    out = {r[0]: r for r in found(spark, rows) if r[0] is not None}
    assert all(out[k][2:] == (0, 299) for k in range(300)) and all(out[k][2] == k for k in range(1000, 1300))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = docs.groupBy(F.pmod(F.xxhash64("doc_id", "text"), F.lit(8))).count().collect()
    assert max(r["count"] for r in counts) < 0.3 * len(rows)


def test_blocks_of_few_bytes(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*base[: rng.randrange(60, 80)], f"z{rng.randrange(3)}"])) for k in range(60)]
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 900)
    assert order(found(spark, rows)) == order(brute(rows))


def test_keep_first_with_clashing_names(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words"), (3, "other words"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_gone": F.lit(1), "_id": F.lit(2), "gone": F.lit(3), "rows": F.lit(4), "_row": F.lit(5), "c0": F.lit(6)})
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["_row"], r["c0"]) for r in kept.collect()) == [("1", 5, 6), ("3", 5, 6), ("None", 5, 6)]


def test_very_long_text(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(50000)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:])), (3, " ".join(words[150_000:]))]
    assert [r[2] for r in sorted(found(spark, rows))] == [1, 1, 3]


def test_links_of_a_large_family():
    """All pairs of a family of near copies, with n-grams beyond one step of the walk."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**60, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.95], rng.integers(0, 2**60, 5, dtype=np.uint64)])) for _ in range(120)]
    weights = rng.integers(1, 5, 120)
    _, counts = jaccard.join_counts(sets, None, (80, 100), weights)
    linked = np.array([[a != b and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)) for b, y in enumerate(sets)] for a, x in enumerate(sets)])
    assert counts.tolist() == (linked * weights).sum(axis=1).tolist() and linked.any() and not linked.all()
    _, both = jaccard.join_counts(sets[:50], sets[50:], (80, 100), weights)
    across = linked.copy()
    across[:50, :50] = across[50:, 50:] = False
    assert both.tolist() == (across * weights).sum(axis=1).tolist()
