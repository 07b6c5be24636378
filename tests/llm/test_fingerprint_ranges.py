"""Fingerprints: parsing against a plain version, small edits of short texts, ids that many rows share."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblattice.llm import fingerprints as fp

MASK = 2**64 - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_parse(names):
    """One level, symbol by symbol: runs, three tosses, phrases that begin at local maxima."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    names = [x if n == 1 else mix(x ^ (n * 0xA0761D6478BD642F & MASK)) for x, n in runs]
    labels = names
    for _ in range(3):
        tossed = []
        for k, x in enumerate(labels):
            differ = x ^ (labels[k - 1] if k else x ^ 1)
            low = (differ & -differ).bit_length() - 1
            tossed.append(2 * low + (x >> low & 1))
        labels = tossed
    begin = [k for k in range(len(names)) if k == 0 or (k + 1 < len(names) and labels[k] > labels[k - 1] and labels[k] > labels[k + 1])]
    out = []
    for b, e in zip(begin, [*begin[1:], len(names)]):
        total, power = e - b, 1
        for x in names[b:e]:
            total, power = (total + x * power) & MASK, power * (0x9E3779B97F4A7C15 | 1) & MASK
        out.append(mix(total & MASK))
    return out


def plain_fingerprint(text):
    names, slots = [mix(ord(c) + 1) for c in text], {}
    for level in (1, 2, 3):
        names = plain_parse(names)
        for x in names:
            x = mix(x ^ (level * 0x5851F42D4C957F2D & MASK))
            value = min(x >> 41 & 0xFFFF, 0xFFFE)
            slots[x >> 57] = min(slots.get(x >> 57, 0xFFFF), value)
    return "".join(f"{slots.get(k, 0xFFFF):04x}" for k in range(128))


def test_parse_equals_plain_version():
    rng = random.Random(3)
    texts = ["", "a", "ab", "aaaa", "aab" * 9, "é漢😀 words", *("".join(rng.choice("abc dé\n") for _ in range(rng.randrange(1, 300))) for _ in range(40))]
    assert fp.as_text(fp.fingerprints(texts)) == [plain_fingerprint(t) for t in texts]


def test_one_word_more_changes_little():
    """No text is compared by other features than the text it was made from."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(15, 91))) for _ in range(400)]
    one, two = fp.fingerprints(texts), fp.fingerprints([f"{t} {rng.choice(words)}" for t in texts])
    assert fp.likeness(one, two).min() >= 0.6 and (fp.likeness(one, fp.fingerprints(texts)) == 1).all()


def check(spark, rows, found):
    """Against the plain order: by id (null last), hash of the text and text."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    plain = sorted(((r["i"], r["h"], r["text"], r["doc_id"]) for r in keyed), key=lambda r: (*r[:3], r[3] is None))
    expected = []
    for (_, _, text, doc_id), (_, _, after, _) in zip(plain, plain[1:] + plain[:1], strict=True):
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        prints = fp.fingerprints([text, changed, after])
        expected.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), *fp.as_text(prints[:2]), round(float(fp.likeness(prints[:1], prints[1:2])[0]), 9), round(float(fp.likeness(prints[:1], prints[2:])[0]), 9)))
    out = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found]
    assert sorted(out, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("case", ["shared", "null", "one text", "mixed"])
def test_ids_that_many_rows_share(spark, case):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 12)))
    rows = {
        "shared": [(7, text()) for _ in range(80)] + [(k, text()) for k in range(30)],
        "null": [(None, text()) for _ in range(60)],
        "one text": [(3, "the same")] * 40 + [(None, None)] * 3,
        "mixed": [(rng.choice([None, 1, 1, 2**63 - 1, -5, 9]), rng.choice([None, "", text()])) for _ in range(90)],
    }[case]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "id": F.lit("y"), "part": F.lit(1)})
    check(spark, rows, fp.compare_edited(docs.repartition(3)).collect())


def test_ranges_split_a_frequent_id(spark):
    rows = spark.createDataFrame([(7, f"t{k}") for k in range(300)] + [(k, "x") for k in range(100, 200)], "id long, text string").withColumn("h", F.xxhash64("text"))
    bounds = fp._bounds(rows.select("id", "h"), 8)
    assert sum(i == 7 for i, _ in bounds) >= 5 and bounds == sorted(set(bounds)) and len(bounds) <= 9


def test_very_long_text(spark):
    rows = [(1, "ab cd " * 80_000), (2, "x"), (3, "ab cd " * 80_000)]
    check(spark, rows, fp.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert np.array_equal(*fp.fingerprints([rows[0][1], rows[2][1]]))
