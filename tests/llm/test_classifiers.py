"""The trained operators against plain versions of the same methods, and their defined cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblattice.llm import grams, language_id, quality, registry, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, of):
    return " ".join(rng.choice(of) for _ in range(n))


def bucket_of(gram, bits):
    """One n-gram's bucket, by Python's numbers."""
    total = (sum(ord(c) * int(s) for c, s in zip(gram, grams._STEPS)) + len(gram) * 0x3C6EF372) % 2**32
    total = (total ^ (total >> 15)) * 0x2C1B3C6D % 2**32
    total = (total ^ (total >> 12)) * 0x297A2D39 % 2**32
    return total >> (32 - bits)


def all_grams(text, sizes):
    padded = f" {(text or '').lower()} "
    return [padded[k : k + n] for n in sizes for k in range(len(padded) - n + 1)]


# --- toxicity


def plain_toxicity(rows, texts, sizes, bits, evidence, rounds, penalty):
    """Scores of ``texts`` after learning from ``rows`` (text, toxic), feature by feature."""
    sets = [({bucket_of(g, bits) for g in all_grams(t, sizes)}, y) for t, y in rows]
    n, n_toxic = len(sets), sum(y for _, y in sets)
    ratios = {}
    for feature in set().union(*(s for s, _ in sets)):
        cells = {(p, y): sum((feature in s) == p and label == y for s, label in sets) for p in (True, False) for y in (0, 1)}
        seen = cells[True, 0] + cells[True, 1]
        statistic = 0.0
        for (p, y), found in cells.items():
            expected = (seen if p else n - seen) * (n_toxic if y else n - n_toxic) / n
            statistic += 2 * found * math.log(found / expected) if found else 0.0
        if statistic >= evidence:
            ratios[feature] = math.log((cells[True, 1] + 1) / (n_toxic + 2) / ((cells[True, 0] + 1) / (n - n_toxic + 2)))
    w, g2, b, gb2 = dict.fromkeys(ratios, 0.0), dict.fromkeys(ratios, 0.0), 0.0, 0.0
    margin = lambda s: sum(w[f] * ratios[f] for f in s if f in w) + b
    for _ in range(rounds):
        errors = [(1 / (1 + math.exp(-margin(s))) - y) * (0.5 / (n_toxic / n) if y else 0.5 / (1 - n_toxic / n)) / n for s, y in sets]
        grads = {f: sum(e for (s, _), e in zip(sets, errors, strict=True) if f in s) * ratios[f] + penalty * w[f] / n for f in w}
        for f, g in grads.items():
            g2[f] += g * g
            w[f] -= 0.1 * g / (math.sqrt(g2[f]) + 1e-8)
        gb2 += sum(errors) ** 2
        b -= 0.1 * sum(errors) / (math.sqrt(gb2) + 1e-8)
    return [1 / (1 + math.exp(-margin({bucket_of(g, bits) for g in all_grams(t, sizes)}))) for t in texts]


def test_toxicity_equals_plain_version(spark):
    rng = random.Random(6)
    plain = [words(rng, 8, ["aba", "bac", "cab", "dad"]) for _ in range(30)]
    bad = [words(rng, 6, ["aba", "bac", "cab"]) + " zzz " + rng.choice(["qx", "dad"]) for _ in range(12)]
    texts = plain + bad + ["", None, "É zzz"]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(k, int(k >= 30)) for k in range(42)] * 2, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sizes=(2, 3), bits=16, evidence=6.0, rounds=20, penalty=1.0)
    expected = plain_toxicity([(t, int(k >= 30)) for k, t in enumerate(texts[:42])], texts, (2, 3), 16, 6.0, 20, 1.0)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert [found[k] for k in range(len(texts))] == pytest.approx(expected, abs=1e-5)
    assert found[30] > 0.5 > found[0]


def test_toxicity_sample_is_bounded(spark):
    """Repeated documents and labels multiply nothing; the sample does not depend on how rows are dealt."""
    docs = spark.createDataFrame([(k % 50, f"text {k % 50} of {k // 400}", None, None, 0) for k in range(800)], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] * 5 + [(3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = sorted(map(tuple, toxicity._sample(docs, labels, 10).collect()))
    assert len(rows) == 20 and rows == sorted(map(tuple, toxicity._sample(docs.repartition(7), labels.repartition(3), 10).collect()))


def test_toxicity_recall_on_tables(spark, sf_dir):
    """Held-out recall at 0.7 and false alarms on the tables of a tenth of the scale."""
    folder = sf_dir.replace("sf0.001", "sf0.1")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").collect()}
    rows = [r for r in registry.op9_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in toxic]
    caught, false = ([r["predicted"] for r in rows if toxic[r["doc_id"]] == y] for y in (1, 0))
    assert sum(caught) >= 0.84 * len(caught) and sum(false) <= 0.005 * len(false)


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, None, "y"), (2, "é " * 60_000, "z")], "doc_id long, text string, score string").withColumn("held_out", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1 and all(0 <= r["score"] <= 1 for r in rows)
    none = docs.where("false")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert toxicity.score(named, toxicity.train(named, labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))).count() == 4
    assert toxicity.keep_clean(docs, toxicity.train(none, labels)).columns == docs.columns


# --- languages


def plain_language(rows, text, sizes, bits):
    """Posteriors of one text after learning from ``rows`` (text, lang), n-gram by n-gram."""
    counts = {}
    for t, lang in rows:
        own = counts.setdefault(lang, {})
        for g in all_grams(t, sizes):
            own[bucket_of(g, bits)] = own.get(bucket_of(g, bits), 0) + 1
    found = all_grams(text, sizes)
    logs = {}
    for lang, own in counts.items():
        total = sum(own.values()) + 0.5 * 2**bits
        logs[lang] = sum(math.log((own.get(bucket_of(g, bits), 0) + 0.5) / total) for g in found) / math.sqrt(len(found))
    odds = {lang: math.exp(x - max(logs.values())) for lang, x in logs.items()}
    best = min(odds, key=lambda lang: (-odds[lang], lang))
    return best, odds[best] / sum(odds.values())


def test_language_equals_plain_version(spark):
    rng = random.Random(2)
    texts = {"a": ["la", "le", "ma"], "b": ["ko", "ki", "tek"], "c": ["Zü", "öz", "ka"]}
    rows = [(words(rng, rng.randrange(1, 30), texts[lang]), lang) for lang in "abc" for _ in range(12)]
    asked = [words(rng, 5, texts[rng.choice("abc")]) for _ in range(20)] + ["la ko", "É", "ÖZ"]
    docs = spark.createDataFrame([(k, t, lang, None, 0) for k, (t, lang) in enumerate(rows)], DOCS)
    model = language_id.train(docs, sizes=(1, 2), bits=12)
    found = language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, text in zip(found, asked, strict=True):
        lang, score = plain_language(rows, text, (1, 2), 12)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)


def test_language_of_many_and_of_other_ids(spark, monkeypatch):
    """More languages than a worker holds, string ids, clashing names and a long text."""
    monkeypatch.setattr(language_id, "HELD", 3)
    docs = spark.createDataFrame([(f"id{k}", f"{chr(97 + k % 20) * 3} {chr(97 + k % 20) * 5}", f"l{k % 20:02}") for k in range(60)], "doc_id string, text string, lang string").withColumns({"score": F.lit(1), "k": F.lit(2), "held_out": F.lit(3)})
    more = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit("long"), "text": F.repeat(F.lit("bbb "), 200_000), "lang": F.lit(None).cast("string")}))
    rows = {r["doc_id"]: r for r in language_id.predict(more, language_id.train(more)).collect()}
    assert all(rows[f"id{k}"]["lang_pred"] == f"l{k % 20:02}" for k in range(60)) and rows["long"]["lang_pred"] == "l01"
    assert rows["id1"]["held_out"] == (zlib.crc32(b"id1") % 3 == 1)
    none = docs.where("false")
    assert language_id.identify(none).count() == 0


@pytest.mark.parametrize(("text", "known"), [("½ ² Ⅷ 12 _", False), ("٣", False), ("ª", True), ("漢", True), ("1a", True), ("", False), (None, False)])
def test_letters(text, known):
    model = language_id.LanguageModel(["x"], np.zeros((4, 1), np.float32), np.zeros(1), (1,), 2)
    assert (model.scores([text])[0] == ["x"]) == known


# --- quality


def plain_histograms(text):
    chars, found = [0] * 10, [0] * (len(quality._WORDS) + 1)
    for c in text or "":
        raw = c.encode()[0]
        chars[
            0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\x0c\r" else 4 if c in ".,;:'\"-()" else 5 if c in "!?"
            else 9 if c in "|<>" else 6 if c in "#*$%&" else 7 if raw >= 0xC0 else 8
        ] += 1
    for w in [x for x in (text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if x]:
        for _ in range(2):
            w = w[:-1] if len(w) > 1 and w[-1] in ".,;:!?\"'()" else w
            w = w[1:] if len(w) > 1 and w[0] in ".,;:!?\"'()" else w
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
        found[quality._WORDS.index(w) if w in quality._WORDS else len(quality._WORDS)] += 1
    return chars, found


def plain_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, q if a is p else p, strict=True) if x)
    return math.sqrt(max((part(p) + part(q)) / 2, 0))


def test_references_and_verdicts_equal_plain_version(spark):
    """Reference sums, distances and verdicts, with limits of this table's own spread and with given ones."""
    rng = random.Random(9)
    lists = {"en": "the cat of and Dog. in is (it) was".split(), "de": "der Hund und die Katze, für ist".split()}
    rows = [(words(rng, rng.randrange(60, 90), [*lists[lang], *(f"{lang}{k}" for k in range(40))]), lang) for lang in ("en", "de") for _ in range(20)]
    rows += [("| x < y " * 30 + " ".join(f"n{k}" for k in range(200)), "en"), ("too short", "en"), (None, "de"), (words(rng, 80, [f"v{k}" for k in range(300)]), None), ("", None)]
    docs = spark.createDataFrame([(k, t, lang, None, 0) for k, (t, lang) in enumerate(rows)], DOCS)
    base = {r["doc_id"]: r["base_failed"] for r in quality.judge(docs, quality.References({}, {})).collect()}
    sums = {}
    for k, (t, lang) in enumerate(rows):
        if lang and not base[k]:
            chars, found = sums.setdefault(lang, ([0] * 10, [0] * (len(quality._WORDS) + 1)))
            for own, more in zip((chars, found), plain_histograms(t), strict=True):
                own[:] = [x + y for x, y in zip(own, more, strict=True)]
    known = quality.references(docs)
    assert {x: (known.chars[x].tolist(), known.words[x].tolist()) for x in known.chars} == {x: tuple(map(list, y)) for x, y in sums.items()}
    limits = quality.Limits({None: 0.2, "en": 0.25}, {None: 0.5})
    for r in quality.judge(docs, known, limits).collect():
        text = rows[r["doc_id"]][0]
        if not (text or "").strip():
            assert not r["kept"]
            continue
        chars, found = plain_histograms(text)
        both = {lang: (plain_distance(chars, own[0]), plain_distance(found, own[1])) for lang, own in sums.items()}
        lang = min(sorted(both), key=lambda x: sum(both[x]))
        assert (r["char_distance"], r["word_distance"]) == pytest.approx(both[lang], abs=1e-6)
        far = both[lang][0] > limits.chars.get(lang, 0.2) and r["word_chars"] >= quality.LEAST_CHARS or both[lang][1] > 0.5
        assert r["kept"] == (not base[r["doc_id"]] and not far)


def test_quality_odd_tables(spark):
    rows = [(1, "a b " * 30_000, "en"), (1, "a b " * 30_000, "en"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"kept": F.lit("x"), "n_words": F.lit("y"), "at": F.lit(1)})
    found = quality.judge(docs, quality.references(docs)).collect()
    assert [r["n_words"] for r in sorted(found, key=lambda r: r["n_words"])] == [0, 60_000, 60_000] and all(r["base_failed"] for r in found)
    none = docs.where("false")
    assert quality.judge(none, quality.references(none)).count() == 0
