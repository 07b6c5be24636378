"""Licence scans against a plain version, and the catalogue's longer texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weblattice.llm import licenses

SAID = licenses.SENTENCES


def text_of(names, holder="the Example Society, Inc"):
    return "\n".join(SAID[x].replace("<name>", holder) + "." for x in names)


def names(text):
    return [x[0] for x in licenses.Scanner().scan(text)[0]]


def plain_scan(text):
    """Sentence by sentence and rule by rule, by regular expressions on the words of the whole text."""
    word = r"[^\W_]+(?:\.[^\W_]+)*"
    gap = r"(?:(?!" + word + r").)*"
    spots = {0} | {m.end() for m in re.finditer(r"[.!?;:,)\]]+(?=\s|$)|[(\[\n]", text)}
    starts = [m.start() for m in re.finditer(word, text)]
    heads = {min((s for s in starts if s >= p), default=None) for p in spots} - {None}
    hits, free = [], 0
    for at in sorted(heads):
        if at < free:
            continue
        best = None
        for name, sentence in SAID.items():
            parts = [gap.join(re.escape(w) for w in re.findall(word, p)) for p in sentence.split("<name>")]
            some = gap + rf"(?:{word}{gap}){{1,{licenses.NAME_WORDS}}}"
            pattern = (some.join(parts) if len(parts) > 1 else parts[0]) + r"(?!" + word + r")(?<=[^\W_])(?!\.[^\W_])"
            m = re.compile(pattern, re.I | re.S).match(text, at)
            if m and (best is None or m.end() > best[2]):
                best = (name, at, m.end())
        if best:
            hits.append(best)
            free = best[2]
    out, k, unmatched = [], 0, 0
    while k < len(hits):
        fits = [(len(own), -i, lic) for i, (lic, own) in enumerate(sorted(licenses.RULES)) if [h[0] for h in hits[k : k + len(own)]] == own]
        if fits:
            n, _, lic = max(fits)
            out.append((lic, hits[k][1], hits[k + n - 1][2]))
            k += n
        else:
            unmatched, k = unmatched + 1, k + 1
    return out, len(hits), unmatched


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_plain_version(seed):
    rng = random.Random(seed)
    fill = ["Some words, and more", "(c) 2020 A. Person", "permission to speak", "version 2.0", "", "in no event", "GNU", "licence:"]
    scanner = licenses.Scanner()
    for _ in range(25):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            name = rng.choice([*SAID])
            said = SAID[name].replace("<name>", rng.choice(["Acme", "the A. B. Society and its friends"]))
            said = rng.choice([said, said.upper(), said.replace(" ", "\n// ", 3), said[: rng.randrange(5, len(said))], rng.choice(fill)])
            parts += [said, rng.choice([". ", ".\n", ", ", " ", "\n\n", " ("])]
        text = "".join(parts)
        if any(t in text.lower() for t in licenses.TRIGGERS):
            assert scanner.scan(text) == plain_scan(text), text


@pytest.mark.parametrize(("licence", "said"), [(lic, own) for lic, own in licenses.RULES])
def test_every_rule_names_its_licence(licence, said):
    """A whole text is one licence with nothing unmatched, also where a shorter rule fits its beginning."""
    found, n, unmatched = licenses.Scanner().scan(text_of(said))
    assert [x[0] for x in found] == [licence] and n == len(said) and unmatched == 0


def test_holders_commas_and_expressions():
    bsd = ["bsd-grant", "bsd-source", "bsd-binary"]
    assert names(text_of(bsd)) == ["BSD-2-Clause"]
    for holder in ("Google Inc.", "the copyright holder", "the University of Somewhere, Department of Long Names"):
        assert names(text_of([*bsd, "bsd-endorse"], holder)) == ["BSD-3-Clause"]
    assert names(text_of([*bsd, "bsd-endorse"], "x " * 13)) == ["BSD-2-Clause"]  # too long for a name
    assert names("This project, released under the MIT License, is old") == ["MIT"] and names("The code (licensed under CC BY 4.0) is here") == ["CC-BY-4.0"]
    assert names("not released under the MIT License") == []
    assert names("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+") == ["MIT", "Apache-2.0", "GPL-2.0-or-later"]
    assert names("SPDX-License-Identifier: LGPL-2.1 WITH unknown\n") == ["LGPL-2.1-only"] and names("spdx-license-identifier:\nMIT") == []
    text = "SPDX-License-Identifier: MIT"
    assert licenses.Scanner().scan(text) == ([("MIT", 0, len(text))], 1, 0)


def test_scan_odd_tables(spark):
    rows = [(1, None), (1, ""), (2, "Released under the MIT License."), (2, "Released under the MIT License."), (None, "a " * 300_000 + "\nReleased under the MIT License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"licenses": F.lit("x"), "spans": F.lit(1)})
    found = sorted((str(r["doc_id"]), r["licenses"], len(r["spans"])) for r in licenses.scan(docs).collect())
    assert found == [("1", [], 0), ("1", [], 0), ("2", ["MIT"], 1), ("2", ["MIT"], 1), ("None", ["MIT"], 1)]
    assert licenses.scan(docs.where("false")).count() == 0
