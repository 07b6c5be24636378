"""Targets of many sources, caps and their ties, against plain sums."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weblattice.llm import mixing

DOCS = "doc_id long, text string, source string"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Fill all sources evenly by weight, a cap at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, free, target = sum(sizes.values()), set(order), {}
    rest = Fraction(total)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: Fraction(most * sizes[s]) for s in over}
        rest -= sum(most * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("case", ["many", "ties", "one", "empty"])
def test_targets(spark, case):
    rng = random.Random(4)
    sizes = {
        "many": {**{f"site{k}é"[: rng.randrange(4, 9)] + str(k): rng.choice([0, 1, 2, 10, 1000, 100_000]) for k in range(300)}, None: 7, "": 5, "Z": 9, "a": 3},
        "ties": {"a": 1, "b": 2, "c": 3, "d": 1, "e": 2, "f": 3, "g": 500, "h": 0},
        "one": {None: 12},
        "empty": {"a": 0, None: 0},
    }[case]
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r["source"]: r for r in mixing.targets(rows, (1, 2, 3), 3).collect()}
    expected = plain_targets(sizes)
    assert set(found) == set(sizes)
    for s, r in found.items():
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(float(expected.get(s, 0)))


def test_ranks(spark):
    names = [None, "", "a", "b", "é", "z", "Ω", "😀", *map(str, range(200))]
    rows = mixing.ranked(spark.createDataFrame([(s,) for s in names], "source string")).collect()
    order = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    assert [r["source"] for r in sorted(rows, key=lambda r: r["rank"])] == order and sorted(r["rank"] for r in rows) == list(range(len(names)))


def test_no_fourth_copy(spark):
    """Empty documents of a source at its cap are taken no more often than the others."""
    rows = [(k, "", "a") for k in range(50)] + [(50, "one two", "a")] + [(100 + k, "w " * 100, "b") for k in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    assert max(r["copies"] for r in mixing.mix(docs).where("source = 'a'").collect()) == 3
    assert mixing.take(docs).where("source = 'a'").groupBy("doc_id").count().agg(F.max("count")).first()[0] == 3


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c", "x")] * 5 + [(None, "d e", None)] * 3 + [(2, None, "x"), (3, "  ", "")]
    found = mixing.mix(spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("z") for c in ("rank", "w", "ratio", "bucket", "range")})).collect()
    assert len(found) == len(rows)
    assert len({(r["taken"], r["copies"]) for r in found if r["doc_id"] == 1}) == 1 and all(r["taken"] <= 3 * r["size"] for r in found)
