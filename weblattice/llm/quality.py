"""Quality rules: divergence of a document's histograms from those of its language.

Two histograms are taken of every document: of character classes, and of the common words of the languages (with all
other words as one more class). The same histograms, summed over all documents of a language that pass the base rules, are that language's
references. A document is compared with every reference by Jensen-Shannon distance (base 2, 0 to 1), the nearest counts, and it is rejected when
a histogram with enough entries is farther from it than the limit. Reference sums are made by each task and merged by language.

Limits come from the spread of the distances of all documents that pass the base rules, by nearest language and length (powers of two of the word count): the
larger of the outer fence of the quartiles (Q3 + 3 (Q3 - Q1)) and the threshold that parts the distances best in two (Otsu's). The fence keeps a table without junk whole, the
threshold finds the gap where there is junk. No label is used. A group with fewer than ``LEAST_GROUP`` documents takes the limits of its language, or of all. Texts are
read twice, for the references and for the counts and distances, which are written; spread and verdicts cover all of those rows.

Base rules fail a document with fewer than ``least_words`` words, or more than half of whose words lie in repeated three-word windows.

Defined cases: a null text has no words and fails. Documents without a language add to no reference; where there is no reference, the base rules alone
decide. Guards: the character histogram counts from ``least_chars`` word characters on, the word histogram from ``least_words`` words on.
Repeated rows are judged alike. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblattice.llm.arrow import ASCII_LOWER, BLANK, NEWLINE, mix64, pieces, run_hashes, runs, utf8
from weblattice.sources.scratch import cut

#: Common words of the languages.
COMMON_WORDS = {
    "en": "the of and to in is that for it with as on be at by this are was from have",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par plus sur au avec",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, LEAST_CHARS = 50, 200
#: Marks that separate the entries of menus and tables, a class of their own.
SEPARATORS = b"|<>"
#: Steps in which distances are counted, and the fewest documents of a group with limits of its own.
STEPS, LEAST_GROUP = 1000, 100

_WORDS = sorted({w for line in COMMON_WORDS.values() for w in line.split()})
_CLASSES = 10
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _classes() -> np.ndarray:
    """The class of each byte; bytes within a character have none of their own."""
    kind = np.full(256, 8, np.int64)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[0x20, *range(0x09, 0x0E)]] = 3
    for c in b".,;:'\"-()":
        kind[c] = 4
    for c in b"!?":
        kind[c] = 5
    for c in SYMBOLS:
        kind[c] = 6
    for c in SEPARATORS:
        kind[c] = 9
    kind[0xC0:] = 7
    kind[0x80:0xC0] = _CLASSES
    return kind


_KIND = _classes()
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_EDGE_MARKS = np.zeros(256, bool)
_EDGE_MARKS[list(b".,;:!?\"'()")] = True


def _word_keys() -> tuple[np.ndarray, np.ndarray]:
    data, _ = utf8(_WORDS)
    keys = run_hashes(data, *runs(data, BLANK))
    order = np.argsort(keys)
    return keys[order], order


_KEYS, _KEY_WORD = _word_keys()


@dataclass
class Measures:
    """Base counts and histograms of a slice of texts, one row for each."""

    base: dict[str, np.ndarray]
    chars: np.ndarray
    words: np.ndarray


def _per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weights, minlength=n).astype(np.int64)


def _twice(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its key is there twice in its text, and whether an entry before it has that key."""
    order = np.lexsort((np.arange(len(keys)), keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def measure(texts: list[str | None]) -> Measures:
    n = len(texts)
    data, text_ends = utf8(texts)
    starts, ends = runs(data, BLANK)
    owner = np.searchsorted(text_ends, starts, side="right")
    per_byte = np.repeat(np.arange(n), np.diff(text_ends, prepend=0))
    visible = ~BLANK[data] & ((data & 0xC0) != 0x80)
    hashes = run_hashes(data, starts, ends)

    # three-word windows that are there twice, and the words they cover
    repeat = np.zeros(len(starts), bool)
    if len(starts) > 2:
        whole = owner[2:] == owner[:-2]
        windows = mix64((hashes[:-2] * np.uint64(3) + hashes[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + hashes[2:])
        at = np.flatnonzero(whole)
        again, _ = _twice(owner[at], windows[at])
        for k in range(3):
            repeat[at[again] + k] = True

    line_starts, line_ends = runs(data, NEWLINE)
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_owner = np.searchsorted(text_ends, line_starts, side="right")
    _, later = _twice(line_owner, run_hashes(data, line_starts, line_ends))

    base = {
        "n_words": _per_text(owner, n), "word_chars": _per_text(per_byte[visible], n), "n_symbols": _per_text(per_byte[_IS_SYMBOL[data]], n),
        "n_dup_lines": _per_text(line_owner[later], n), "n_repeat_words": _per_text(owner[repeat], n),
    }
    kinds = _KIND[data]
    chars = np.bincount(per_byte * (_CLASSES + 1) + kinds, minlength=n * (_CLASSES + 1)).reshape(n, -1)[:, :_CLASSES].astype(np.int64)
    chars[:, 3] -= 1  # the line feed that ends the text here

    # common words, without marks at their ends and in lower case
    lower = ASCII_LOWER[data]
    head, tail = starts.copy(), ends.copy()
    for _ in range(2):
        tail -= (tail - head > 1) & _EDGE_MARKS[data[tail - 1]]
        head += (tail - head > 1) & _EDGE_MARKS[data[head]]
    keys = run_hashes(lower, head, tail)
    slot = np.minimum(np.searchsorted(_KEYS, keys), len(_KEYS) - 1)
    word = np.where(_KEYS[slot] == keys, _KEY_WORD[slot], len(_WORDS))
    words = np.bincount(owner * (len(_WORDS) + 1) + word, minlength=n * (len(_WORDS) + 1)).reshape(n, -1).astype(np.int64)
    return Measures(base, chars, words)


def base_failed(base: dict[str, np.ndarray], least_words: int = LEAST_WORDS) -> np.ndarray:
    return (base["n_words"] < least_words) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to one reference; 0 for a row without entries."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.where(total[:, 0] > 0, np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1)), 0.0)


@dataclass
class References:
    """Summed histograms of each language."""

    chars: dict[str, np.ndarray]
    words: dict[str, np.ndarray]

    def nearest(self, seen: Measures) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances of characters and words to the reference whose sum of both is least, and its language."""
        n = len(seen.chars)
        if not self.chars:
            return np.zeros(n), np.zeros(n), np.full(n, None, object)
        chars = np.stack([distances(seen.chars, self.chars[x]) for x in self.chars])
        words = np.stack([distances(seen.words, self.words[x]) for x in self.chars])
        best = (chars + words).argmin(axis=0)
        return chars[best, np.arange(n)], words[best, np.arange(n)], np.array(list(self.chars), object)[best]


def references(docs: DataFrame) -> References:
    """Histograms of all documents with a language that pass the base rules, by language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch, texts in pieces(batches, 0):
            seen = measure(texts)
            good = ~base_failed(seen.base)
            of = np.array(batch.column(1).to_pylist(), object)
            for lang in set(of[good]) - {None}:
                mine = good & (of == lang)
                add = [seen.chars[mine].sum(axis=0), seen.words[mine].sum(axis=0)]
                sums[lang] = [x + y for x, y in zip(sums[lang], add, strict=True)] if lang in sums else add
        for lang, (chars, words) in sums.items():
            both = np.concatenate([chars, words])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(both)), pa.array(np.arange(len(both)), pa.int64()), pa.array(both)], names=["lang", "at", "n"])

    rows = docs.select("text", "lang").mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    found = References({}, {})
    for lang in sorted({r["lang"] for r in rows}):
        both = np.zeros(_CLASSES + len(_WORDS) + 1)
        for r in rows:
            if r["lang"] == lang:
                both[r["at"]] = r["n"]
        found.chars[lang], found.words[lang] = both[:_CLASSES], both[_CLASSES:]
    return found


def length_class(n_words: np.ndarray) -> np.ndarray:
    """The power of two of each word count."""
    return np.frexp(np.maximum(n_words, 1).astype(np.float64))[1] - 1


def limit(counts: np.ndarray) -> float:
    """The larger of the outer fence of the quartiles and Otsu's threshold, for counts of distances in equal steps from 0 to 1."""
    part = np.cumsum(counts) / counts.sum()
    low, high = (np.searchsorted(part, x) + 1 for x in (0.25, 0.75))
    mean = np.cumsum(counts * (np.arange(len(counts)) + 0.5)) / counts.sum()
    inside = (part > 0) & (part < 1 - 1e-12)
    between = np.where(inside, (mean[-1] * part - mean) ** 2 / np.where(inside, part * (1 - part), 1), 0)
    best = np.flatnonzero(between >= between.max() * (1 - 1e-9))  # one gap, of which the middle counts
    return max(high + 3 * (high - low), (best[0] + best[-1]) / 2 + 1 if inside.any() else 0) / len(counts)


@dataclass
class Limits:
    """Limits of both distances by language and length class, by language, and of all (None)."""

    chars: dict
    words: dict

    def of(self, langs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = [next((k for k in ((g, int(x)), g, None) if k in self.chars), None) for g, x in zip(langs, lengths, strict=True)]
        return tuple(np.array([own.get(k, np.inf) for k in keys], np.float64) for own in (self.chars, self.words))


def measured(docs: DataFrame, known: References, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, both distances, the nearest language and the length class of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, 1):
            seen = measure(texts)
            chars, words, langs = sent.value.nearest(seen)
            lengths = length_class(seen.base["n_words"]).astype(np.int32)
            columns = [batch.column(0), *(pa.array(seen.base[x]) for x in _BASE), pa.array(base_failed(seen.base)), pa.array(chars), pa.array(words), pa.array(langs, pa.string()), pa.array(lengths)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_BASE, "base_failed", "char_distance", "word_distance", "nearest", "length"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + "".join(f"{x} long, " for x in _BASE) + "base_failed boolean, char_distance double, word_distance double, nearest string, length int")


def spread(rows: DataFrame) -> Limits:
    """Limits from the distances of all ``measured`` documents that pass the base rules."""
    step = lambda c: F.least(F.floor(F.col(c) * STEPS), F.lit(STEPS - 1)).cast("int")
    places = F.explode(F.array(step("char_distance"), step("word_distance") + STEPS))
    counts = rows.where(~F.col("base_failed") & F.col("nearest").isNotNull()).select("nearest", "length", places.alias("at")).groupBy("nearest", "length", "at").agg(F.count("*").alias("n"))
    groups: dict = {}
    for r in counts.collect():
        for key in ((r["nearest"], r["length"]), r["nearest"], None):
            groups.setdefault(key, np.zeros(2 * STEPS))[r["at"]] += r["n"]
    large = {key: own.reshape(2, STEPS) for key, own in groups.items() if key is None or own.sum() >= 2 * LEAST_GROUP}
    return Limits(*({key: limit(own[k]) for key, own in large.items()} for k in range(2)))


def judge(docs: DataFrame, known: References, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, both distances and kept of every row; without ``limits``, those of the spread of ``docs``."""
    rows = measured(docs, known, id_col, text_col)
    if limits is None and known.chars:
        rows = cut(rows, "measured")  # written: spread and verdict read numbers, no text
        limits = spread(rows)
    sent = docs.sparkSession.sparkContext.broadcast(limits or Limits({}, {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, words, langs, lengths, n_words, n_chars = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("char_distance", "word_distance", "nearest", "length", "n_words", "word_chars"))
            char_limits, word_limits = sent.value.of(langs, lengths)
            far = (chars > char_limits) & (n_chars >= LEAST_CHARS) | (words > word_limits) & (n_words >= LEAST_WORDS)
            kept = ~batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool) & ~far
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(kept)], names=[*batch.schema.names[:-2], "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + "".join(f"{x} long, " for x in _BASE) + "base_failed boolean, char_distance double, word_distance double, kept boolean")
