"""Operators against brute force, and their defined cases, on small fixtures."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblattice.llm import bpe, components, fingerprints, jaccard, language_id, licenses, mixing, quality, registry, toxicity, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "one two three four", "A b c D e", "a B c d E", "tab\tand\x0bmore\x0c words here", "😀 é ñ ü 漢字 " * 5, "x" * 5000, "word " * 3000, "\n\nline one two three\nline one two three\n"]


def frame(spark, texts, **more):
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join(rng.choice(words if isinstance(words, list) else [f"w{k}" for k in range(words)]) for _ in range(n))


def near_family(seed=5):
    """Texts with exact copies, near copies, chains of near copies and a passage that all share."""
    rng = random.Random(seed)
    texts = list(ODD)
    passage = prose(rng, 60)
    for _ in range(25):
        base = prose(rng, rng.choice([3, 7, 30, 80, 200])).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            base = own if rng.random() < 0.5 else base
            texts.append(" ".join(own) + ("\n" + passage if rng.random() < 0.4 else ""))
    big = prose(rng, 120).split()
    for _ in range(60):  # a large group, each a little away from one text
        own = list(big)
        for _ in range(rng.choice([0, 1, 2, 3])):
            own[rng.randrange(len(own))] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    return texts


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return {k: (len(sets[k]), label[k]) for k in range(len(texts))}


@pytest.mark.parametrize("seed", [5, 6])
def test_jaccard_equals_brute_force(spark, seed):
    texts = near_family(seed)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(frame(spark, texts)).collect()}
    assert found == brute_components(texts)


def test_jaccard_in_blocks(spark, monkeypatch):
    """Large components split over tasks give the same components."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    texts = near_family(7)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(frame(spark, texts)).collect()}
    assert found == brute_components(texts)


@pytest.mark.parametrize("block", [1 << 11, 7])
def test_jaccard_counts_all_links(spark, monkeypatch, block):
    """Every link counts, not only those that a forest needs; also in blocks, with repeated rows and null ids."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    texts = near_family(8)
    sets = [shingles(t) for t in texts]
    like = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    expected = {k: sum(like(own, other) for other in sets) - bool(own) for k, own in enumerate(sets)}
    docs = frame(spark, texts)
    more = docs.where("doc_id % 4 = 0").unionByName(docs.where("doc_id % 5 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    rows = jaccard.similar(docs.unionByName(more)).where("doc_id IS NOT NULL").collect()
    assert len(rows) == len(texts) + len(texts[::4]) and max(expected.values()) > 20
    assert all(r["n_links"] == expected[r["doc_id"]] for r in rows)


def test_prefix_tree_forest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**60, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(80) < 0.93], rng.integers(0, 2**60, rng.integers(0, 8), dtype=np.uint64)])) for _ in range(60)] + [np.array([5], np.uint64)] * 3
    links = jaccard.join_sets(sets, None, (80, 100))
    for a, b in links:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])):
                label = [label[a] if x == label[b] else x for x in label]
    own = list(range(len(sets)))
    for a, b in links:
        assert own[a] != own[b]
        own = [own[a] if x == own[b] else x for x in own]
    groups = lambda m: {frozenset(k for k in range(len(m)) if m[k] == x) for x in m}
    assert groups(own) == groups(label)


def test_jaccard_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.similar(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (7, "a b c d e f", "q")], "doc_id long, text string, n string").withColumns({"block": F.lit(1), "component_id": F.lit("c"), "digest": F.lit(2)})
    found = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in jaccard.similar(rows).collect() if r["doc_id"] is not None)
    assert found == [(False, 1, 1), (False, 1, 1), (False, 7, 1)]
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_first(rows.where("doc_id IS NULL OR doc_id = 7 OR n = 'x'")).collect()) == ["1", "None"]


def test_keep_first_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (7, "a b c d e f"), (8, "other words"), (8, "other words"), (9, None), (9, None), (10, "alone")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.keep_first(rows).collect()) == [1, 8, 9, 10]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (200, 200)] + [(300, 300 + k) for k in range(1, 30)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["label"], set()).add(r["v"])
    assert sorted(map(sorted, groups.values())) == [list(range(41)), [100, 101, 102], list(range(300, 330))]


# --- BPE


@pytest.fixture(scope="module")
def codec():
    return registry.tokenizer()


def test_bpe_equals_tiktoken(codec):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(registry.TOKENIZER))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = " \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u200bab'sdtrevlm12٣é漢ß😀_-.,!<|endoftext|>"
    texts = [*[t or "" for t in ODD], *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(2000)), "I'll we've it's <|endoftext|>", "ab" * 20000]
    for text in texts:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text), text[:80]
        assert codec.decode(ids) == text.encode()
    with pytest.raises(ValueError):
        codec.decode(np.array([60000], "<u4").tobytes())


def test_bpe_memo_changes_nothing(codec):
    small = bpe.Bpe({token: rank for rank, token in codec.tokens.items()}, codec.pattern, memo=2)
    for text in ("some words and some more words, some of them twice", "other words", "some words and some more"):
        assert small.encode(text) == codec.encode(text)


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    assert (table.slots([b"none", b"", b"k5000"]) == -1).all()
    assert len(bpe.PerfectHash([]).slots([b"a"])) == 1


def test_bpe_frames(spark, codec):
    docs = frame(spark, ODD).withColumn("ids", F.lit("clash"))
    both = {r["doc_id"]: r for r in bpe.digests(bpe.encode_decode(docs, codec)).collect()}
    steps = {r["doc_id"]: r for r in bpe.digests(bpe.decode(bpe.encode(docs, codec), codec)).collect()}
    assert both == steps
    for k, text in enumerate(ODD):
        assert both[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


# --- fingerprints


def test_fingerprints_follow_shared_text():
    rng = random.Random(2)
    a, b = prose(rng, 900, 4000), prose(rng, 900, 4000)
    rows = fingerprints.fingerprints([a, a, "some words before " + a, b, a[: len(a) // 2] + b[: len(a) // 2], ""])
    like = lambda x, y: fingerprints.likeness(rows[x : x + 1], rows[y : y + 1])[0]
    assert like(0, 1) == 1 and like(0, 2) > 0.9 and like(0, 3) < 0.1 and 0.2 < like(0, 4) < 0.5 and like(0, 5) == 0 and like(5, 5) == 1


def test_parse_is_local():
    """Phrases inside a shared string are the same wherever it stands."""
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 50, 2000).astype(np.uint64)
    one, two = (np.concatenate([rng.integers(0, 50, k).astype(np.uint64), shared]) for k in (3, 117))
    names = [set(fingerprints.parse(x, np.zeros(len(x), np.int64))[0].tolist()) for x in (one, two)]
    assert len(names[0] ^ names[1]) <= 80 and len(names[0] & names[1]) > 300


def test_compare_edited_equals_plain(spark):
    texts = [*ODD, *near_family()[:40]]
    docs = frame(spark, texts).select((F.col("doc_id") * 7 % 101).alias("doc_id"), "text")
    plain = sorted((k * 7 % 101, t or "") for k, t in enumerate(texts))
    found = {r["doc_id"]: r for r in fingerprints.compare_edited(docs.repartition(5)).collect()}
    assert len(found) == len(texts)
    for (i, text), (_, following) in zip(plain, plain[1:] + plain[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r, rows = found[i], fingerprints.fingerprints([text, changed, following])
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert [r["fingerprint"], r["edited_fingerprint"]] == fingerprints.as_text(rows[:2])
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(rows[:1], rows[1:2])[0]) and r["near_next"] == pytest.approx(fingerprints.likeness(rows[:1], rows[2:])[0])


@pytest.mark.parametrize("rows", [[], [(None, "a b")], [(3, "only one text")], [(1, "x"), (1, "x"), (None, None), (2, "y")]])
def test_compare_edited_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("turn", F.lit(9))
    assert fingerprints.compare_edited(docs).count() == len(rows)
    assert fingerprints.fingerprint(docs).count() == len(rows)


# --- licences


def test_licence_scan(spark):
    scanner = licenses.Scanner()
    wrapped = "// Permission is hereby granted, free of charge, to any person\n// obtaining a copy of this software"
    mit = "\n".join(licenses.SENTENCES[x] + "." for x in ("mit-grant", "mit-notice", "mit-as-is"))
    texts = ["Some text\nReleased under the MIT License.\nmore", "licensed under the apache license, version 2.0", "no licence here", mit, wrapped, licenses.SENTENCES["bsd-source"], "I said: Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", None, "this is not Released under the MIT License"]
    rows = [scanner.scan(t) for t in texts]
    assert [[x[0] for x in r[0]] for r in rows] == [["MIT"], ["Apache-2.0"], [], ["MIT"], [], [], ["CC-BY-NC-4.0"] * 2, [], []]
    assert rows[5][1:] == (1, 1) and rows[3][1:] == (3, 0)
    begin, end = rows[0][0][0][1:]
    assert texts[0][begin:end] == "Released under the MIT License"
    found = licenses.scan(frame(spark, texts)).collect()
    assert found[6]["licenses"] == ["CC-BY-NC-4.0"] and len(found[6]["spans"]) == 2 and found[7]["licenses"] == []


def test_licences_of_whole_texts():
    """The longer sequence wins, and the common licences are known."""
    scanner = licenses.Scanner()
    said = lambda *names: "\n".join(f"{k + 1}. {licenses.SENTENCES[x]}." if x.startswith("bsd-") and k else licenses.SENTENCES[x] + "." for k, x in enumerate(names))
    names = lambda text: [x[0] for x in scanner.scan(text)[0]]
    bsd = ("bsd-grant", "bsd-source", "bsd-binary")
    assert names(said(*bsd)) == ["BSD-2-Clause"] and names(said(*bsd, "bsd-endorse")) == ["BSD-3-Clause"] and scanner.scan(said(*bsd, "bsd-endorse"))[2] == 0
    assert names(said("gpl2-redistribute", "gpl-no-warranty")) == ["GPL-2.0-or-later"] and names(said("gpl-redistribute", "gpl-no-warranty")) == ["GPL-3.0-or-later"]
    assert names(said("lgpl21-redistribute", "lgpl-no-warranty")) == ["LGPL-2.1-or-later"] and names(said("agpl3-redistribute", "gpl-no-warranty")) == ["AGPL-3.0-or-later"]
    assert names("This is free and unencumbered software released into the public domain.") == ["Unlicense"] and names("CC0 1.0 Universal") == ["CC0-1.0"]
    assert names("// SPDX-License-Identifier: GPL-2.0-or-later\nint main;") == ["GPL-2.0-or-later"] and names("# SPDX-License-Identifier: EPL-2.0") == ["EPL-2.0"]
    assert names(said("zlib-grant")) == ["Zlib"] and names(said("bsl-grant")) == ["BSL-1.0"] and names(said("epl2-line")) == ["EPL-2.0"]


def test_licence_lines_of_documents(spark, sf_dir):
    """Every document with one of the licence lines is found, and no other."""
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.op5_license_scan(spark, sf_dir).collect():
        assert r["licenses"] == ",".join(sorted(k for k, line in lines.items() if line in docs[r["doc_id"]].split("\n"))), r["doc_id"]


# --- classifiers


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_accuracy(spark, sf_dir):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.op6_language_id(spark, sf_dir).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {k: held(k) for k in langs}
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in out) > 0.93 * len(out) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark):
    model = language_id.LanguageModel(["a", "b"], np.zeros((1 << 8, 2), np.float32), np.zeros(2), (1, 2), 8)
    rows = {r["doc_id"]: r for r in language_id.predict(frame(spark, ODD), model).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[2]["lang_pred"] == "und" and rows[3]["lang_pred"] == "a"
    none = language_id.train(frame(spark, ODD).where("false").select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in language_id.predict(frame(spark, ODD), none).collect()} == {"und"}
    assert language_id.keep_known(frame(spark, ODD), model, 0.4).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_naive_bayes_equals_plain_sums():
    rng = np.random.default_rng(1)
    model = language_id.LanguageModel(["a", "b", "c"], rng.normal(size=(1 << 10, 3)).astype(np.float32), np.log(np.full(3, 1 / 3)), (1, 2, 3), 10)
    texts = ["Hello World", "a", "été " * 30, ""]
    langs, scores = model.scores(texts)
    for k, text in enumerate(texts):
        alone = model.scores([text])
        assert alone[0][0] == langs[k] and alone[1][0] == pytest.approx(scores[k])


def test_toxicity_learns_planted_words(spark):
    rng = random.Random(3)
    clean = [prose(rng, rng.randrange(5, 200)) for _ in range(400)]
    toxic = [" ".join([*(w := prose(rng, rng.randrange(5, 200)).split()), rng.choice(["Blargh", "GROKK"]), *w[:3]]) for _ in range(100)]
    docs = frame(spark, clean + toxic + [None, ""])
    labels = spark.createDataFrame([(k, int(k >= 400)) for k in range(0, 500, 2)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    odd = range(1, 500, 2)
    assert sum(rows[k]["predicted"] == int(k >= 400) for k in odd) >= 0.97 * len(odd)
    assert rows[500]["score"] == rows[501]["score"] and rows[500]["predicted"] == 0
    assert toxicity.keep_clean(docs, model).count() == sum(r["predicted"] == 0 for r in rows.values())


def test_toxicity_without_labels(spark):
    model = toxicity.train(frame(spark, ODD), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(frame(spark, ODD), model).collect()} == {0}


# --- quality


def brute_quality(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    dup = sum(1 for k, line in enumerate(lines) if WORD.search(line) and line in lines[:k])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_base_counts(spark):
    texts = [t if t is None else t[:2000] for t in ODD] + ["a b c a b c d", "x # $ y\nx # $ y\n\n \n \n", "one two three one two three " * 20]
    rows = {r["doc_id"]: r for r in quality.judge(frame(spark, texts), quality.References({}, {})).collect()}
    for k, text in enumerate(texts):
        r, expected = rows[k], brute_quality(text)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0]) and r["kept"] == (not r["base_failed"])


def test_divergence():
    p, q = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]), np.array([0.0, 5.0])
    assert quality.distances(p, q) == pytest.approx([1.0, 0.5579230452841438, 0.0])


def test_quality_keeps_good_documents(spark, sf_dir):
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in registry.op8_quality(spark, sf_dir).collect() if r["doc_id"] in good and not r["base_failed"]]
    assert all(r["kept"] for r in rows if good[r["doc_id"]] == 1)


def test_quality_rejects_bad_documents(spark, sf_dir):
    """Recall on labelled junk and false alarms, with limits that see no label; menus with separators are the hard kind."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in registry.op8_quality(spark, folder).collect() if r["doc_id"] in labels and not r["base_failed"]]
    bad, good = ([r["kept"] for r in rows if labels[r["doc_id"]] == q] for q in (0, 1))
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.99 * len(good)


def test_no_language_is_left_out(spark):
    """References and models know every language."""
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, text, f"l{k}" if k else None) for k in range(301)], "doc_id long, text string, lang string")
    assert len(quality.references(docs).chars) == 300
    assert len(language_id.train(docs).languages) == 300


def test_quality_limits():
    steps = np.zeros(1000)
    steps[100:110], steps[300:310] = 95, 5  # two kinds, apart
    assert 0.11 <= quality.limit(steps) <= 0.30
    steps[300:310] = 0  # one kind: all of it is kept
    assert quality.limit(steps) >= 0.11
    only = np.zeros(1000)
    only[999] = 3
    assert quality.limit(only) >= 1
    assert quality.length_class(np.array([0, 1, 2, 63, 64, 127])).tolist() == [0, 0, 1, 5, 6, 6]
    limits = quality.Limits({("en", 6): 0.1, "en": 0.2, None: 0.3}, {("en", 6): 0.4, "en": 0.5, None: 0.6})
    assert [x.tolist() for x in limits.of(np.array(["en", "en", "fr"], object), np.array([6, 7, 6]))] == [[0.1, 0.2, 0.3], [0.4, 0.5, 0.6]]


# --- URLs, mixing, archives


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_filter_equals_brute_force(spark):
    rules = [*url_filter.QUERY_RULES, ("a.b.c", "", "block"), ("c", "/x/y", "allow"), ("c", "/x/", "block"), ("", "/q/", "block"), ("x.y", "/'\\", "block")]
    rng = random.Random(8)
    urls = [None, "", "no scheme", "http://", "http://net", "HTTP://EXAMPLE.Net/en/?q#f", "http://net?x://y/", "http://a.b.c", "http://z.a.b.c/x/yy/z", "http://c/x/y", "http://.net/", "http://net./", "a://b://c/x/", "http://net/ü/" + "p/" * 300, "http://" + "l." * 500 + "net/", "http://q.x.y/'\\z"]
    urls += [f"http://{'.'.join(rng.choice(['a', 'b', 'c', 'net', 'org', 'example', 'fr']) for _ in range(rng.randrange(1, 5)))}{rng.choice(['', '/', '/fr/', '/x/yz', '/en/', '/de/1?a', '/x/'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, None), (5, urls[5])], "page_id long, url string").withColumns({"host": F.lit(1), "digest": F.lit(2)})
    rows = url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(urls[r["page_id"]], rules)
    assert url_filter.judge(pages, url_filter.rule_table(spark, [])).where("verdict = 'allow'").count() == len(urls) + 2


def test_mixing(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([0, 1, 5, 50, 300])) for _ in range(300)] + ODD
    docs = frame(spark, texts)
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    per = {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        per.setdefault(r["source"], []).append(r)
    assert sum(x[0]["target"] for x in per.values()) == pytest.approx(total)
    for own in per.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own) and own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    clash = docs.withColumns({"threshold": F.lit("a"), "whole": F.lit("b"), "place": F.lit("c")})
    taken = mixing.take(clash)
    assert taken.columns == clash.columns and taken.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mix(docs.where("doc_id < 3")).count() == 3


def test_warc_round_trip(spark, tmp_path):
    texts = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 200_000, "x" * 65536, "<p>a</p>"]
    rows = [(k if k != 7 else None, f"http://h/{k}\r\n", t) for k, t in enumerate(texts)] + [(1, "again", "<p>b</p>"), (1, "other", "third")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hex", F.lit("clash"))
    folder = f"file://{tmp_path}/warc"
    files = spark.createDataFrame(warc.write(pages.repartition(3), folder).collect(), "file string, records long")
    chunks = warc.read_chunks(spark, files, folder)
    found = sorted(map(tuple, warc.index(chunks).collect()), key=str)
    expected = []
    for page_id, _, text in rows:
        raw = (text or "").encode()
        first = min(p for p, _, t in rows if (t or "") == (text or "") and p is not None)
        refers = first if page_id != first else None
        expected.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert found == sorted(expected, key=str)
    whole = b"".join(r["chunk"] for r in chunks.where("page_id = 5").orderBy("chunk_no").collect())
    assert whole.decode() == texts[5] and chunks.where("page_id = 5").count() == 7
    assert {len(x) for x in (r["chunk"] for r in chunks.where("page_id = 6").collect())} == {65536}
    few = warc.decisions(warc.payload_digests(pages), least=9)
    assert few.where("refers_to IS NOT NULL").count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def test_pipeline_stages(spark, sf_dir):
    """Each stage keeps what the operator it applies says, on its own input."""
    import corpus_pipeline as p
    from weblattice.sources.scratch import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in p.STAGES:
        after = cut(stage(spark, docs, sf_dir), "test")
        if name != "bpe":
            assert after.columns == docs.columns
        if name == "jaccard_join":
            before = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
            parts = brute_components([t for _, t in before])
            assert sorted(r[0] for r in after.select("doc_id").collect()) == [before[k][0] for k in range(len(before)) if parts[k][1] == k]
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            counts = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
            assert counts == {k: n for k, n in copies.items() if n}
        elif name != "bpe":
            assert after.join(docs, "doc_id", "left_anti").count() == 0 and after.count() >= 0.7 * docs.count()
        else:
            codec = registry.tokenizer()
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            for r in after.collect():
                assert r["n_tokens"] * 4 == len(codec.encode(texts[r["doc_id"]])) and r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        docs = after
