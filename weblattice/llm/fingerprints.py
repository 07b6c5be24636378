"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. On each level runs of one symbol become one symbol; deterministic coin tossing (the
lowest bit in which a symbol differs from its left neighbour, three times) labels the symbols with fewer than eight labels, so that equal
neighbours do not occur; phrases begin where a label is a local maximum; and a phrase's name is a hash of its symbols, which are the next level's
text. Where a phrase begins depends on four symbols before it and one after it, so equal substrings have the same phrases inside,
wherever they stand. The names of all three levels are the features of a text, of whatever length.

A fingerprint keeps, for each of 128 slots, the least of the features that fall into it, as four hexadecimal digits (``ffff``: none).
Likeness is the share of slots that agree among those that either fingerprint has; it estimates the Jaccard similarity of the feature sets.

The next document in the order of ids is found without a global sort: documents are dealt by ranges of id and text hash, whose bounds are
pairs that occur; the documents at a bound are also sent to the range before it, and each range is read in order, one document ahead. An id
that very many rows have, or none, takes several ranges.

Defined cases: a null text is empty; the fingerprint of an empty text has no features, and two such are alike (1). Null ids come last, with the largest
64-bit number. Rows that share an id are ordered by a hash of their text, then by text. After the last document comes the first, which may be the document
itself. Repeated rows stay repeated; rows equal in id and text lie in one range. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblattice.llm.arrow import code_points, mix64, powers

SLOTS, EMPTY = 128, 0xFFFF
LEVELS = (1, 2, 3)
_ONE = np.uint64(1)


def _first_of_text(owner: np.ndarray) -> np.ndarray:
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    return first


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit that differs from the left neighbour, plus that bit."""
    left = np.empty_like(labels)
    left[1:] = labels[:-1]
    left[first] = labels[first] ^ labels.dtype.type(1)
    change = labels ^ left
    low = np.bitwise_count((change & (~change + labels.dtype.type(1))) - labels.dtype.type(1))
    return (low << 1 | ((labels >> low.astype(labels.dtype)) & labels.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def parse(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of one level, and their texts."""
    if not len(names):
        return names, owner
    first = _first_of_text(owner)
    new = first.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    if len(at) < len(names):
        lengths = np.diff(at, append=len(names)).astype(np.uint64)
        names, owner, first = names[at], owner[at], first[at]
        long = np.flatnonzero(lengths > _ONE)
        names[long] = mix64(names[long] ^ (lengths[long] * np.uint64(0xA0761D6478BD642F)))
    labels = _toss(names, first)
    labels = _toss(labels, first)
    labels = _toss(labels, first)
    begin = first.copy()
    peak = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[1:-1] & ~first[2:]
    begin[1:-1] |= peak
    at = np.flatnonzero(begin)
    lengths = np.diff(at, append=len(names))
    place = np.arange(len(names)) - np.repeat(at, lengths)
    sums = np.add.reduceat(names * powers(int(lengths.max()))[place], at)
    return mix64(sums + lengths.astype(np.uint64)), owner[at]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts and the index of the text of each."""
    points, ends = code_points(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends, prepend=0))
    names, found = mix64(points.astype(np.uint64) + _ONE), []
    for level in range(1, max(LEVELS) + 1):
        names, owner = parse(names, owner)
        if level in LEVELS:
            found.append((mix64(names ^ np.uint64(level * 0x5851F42D4C957F2D & (2**64 - 1))), owner))
    return np.concatenate([x for x, _ in found]), np.concatenate([o for _, o in found])


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of slots for each text."""
    out = np.full(len(texts) * SLOTS, EMPTY, np.uint16)
    names, owner = features(texts)
    if len(names):
        slot = owner * SLOTS + (names >> np.uint64(57)).astype(np.int64)
        value = np.minimum((names >> np.uint64(41)) & np.uint64(0xFFFF), np.uint64(EMPTY - 1))
        keys = np.sort((slot.astype(np.uint64) << np.uint64(16)) | value)
        slots = (keys >> np.uint64(16)).astype(np.int64)
        least = np.ones(len(keys), bool)
        least[1:] = slots[1:] != slots[:-1]
        out[slots[least]] = (keys[least] & np.uint64(0xFFFF)).astype(np.uint16)
    return out.reshape(len(texts), SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    some = (a != EMPTY) | (b != EMPTY)
    total = some.sum(axis=1)
    return np.where(total > 0, ((a == b) & some).sum(axis=1) / np.maximum(total, 1), 1.0)


def as_text(rows: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in rows.astype(">u2")]


def edited(text: str, following: str) -> str:
    """The text with the last half of its code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; moves no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(as_text(fingerprints([t or "" for t in part.column(1).to_pylist()])))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


#: The number that a null id is ordered by.
LAST = np.iinfo(np.int64).max


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Up to ``parts`` pairs of id and text hash that occur, the least of all first, at about equal distances in their order; ``rows`` has id and h."""
    shares = [k / parts for k in range(parts)]
    found = rows.agg(F.min("id").alias("least"), F.percentile_approx("id", shares, max(10_000, 20 * parts)).alias("at")).first()
    if found["least"] is None:
        return []
    # an id with more than a part of the rows is found several times, and is cut by its hashes into as many ranges
    times = Counter([found["least"], *found["at"]])
    slots = F.create_map(*[F.lit(x) for pair in times.items() for x in pair])
    n = F.element_at(slots, F.col("id"))
    slot = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * n)
    firsts = rows.where(F.col("id").isin(list(times))).groupBy("id", F.least(slot, n - 1).alias("slot")).agg(F.min("h").alias("h")).collect()
    return sorted((r["id"], r["h"]) for r in firsts)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every row; ids are whole numbers."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(int(LAST))).alias("id"), F.xxhash64("text").alias("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows.select("id", "h"), parts)
    bound_ids, bound_hashes = (np.array([x[k] for x in bounds], np.int64) for k in (0, 1))
    last = max(len(bounds) - 1, 0)
    names = ["doc_id", "text", "id", "h", "part", "turn"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # turn: 0 an own document, 1 the first one of the next range, 2 the first one of all
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy() for k in (2, 3))
            part = np.searchsorted(bound_ids, ids, side="left")  # the first bound of that id, or of a larger one
            at = []
            for k in np.flatnonzero(np.isin(bound_ids, ids)):  # bounds of one id are side by side, in the order of hashes
                own = bound_ids[k] == ids
                part[own & (hashes >= bound_hashes[k])] = k + 1
                same = np.flatnonzero(own & (hashes == bound_hashes[k])).tolist()
                if same:  # rows of one id and hash nearly always have one text
                    at.append(min(same, key=lambda i: batch.column(1)[i].as_py()))
            part = np.clip(part - 1, 0, last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32()), pa.array(np.zeros(len(part)), pa.int32())], names=names)
            if at:
                where = part[at]
                again = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(np.where(where > 0, where - 1, last), pa.int32()), pa.array(np.where(where > 0, 1, 2), pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition is one range: its own documents in order, then copies of the document that follows the last of them
        ready: list[tuple[int | None, str, str]] = []
        size, held = 0, None

        def flush() -> pa.RecordBatch:
            ids, own, following = zip(*ready, strict=True)
            changed = [edited(a, b) for a, b in zip(own, following, strict=True)]
            n = len(own)
            prints = fingerprints([*own, following[-1], *changed])  # each following text but the last is the next row's own
            mine, after, other = prints[:n], prints[1 : n + 1], prints[n + 1 :]
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
            columns = [pa.array(ids, pa.int64()), pa.array(list(map(len, own)), pa.int64()), pa.array(digests), pa.array(as_text(mine)), pa.array(as_text(other)), pa.array(likeness(mine, other)), pa.array(likeness(mine, after))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for doc_id, text, turn in zip(*(batch.column(k).to_pylist() for k in (0, 1, 5)), strict=True):
                if held is not None:
                    ready.append((*held, text))
                    size += len(text)
                    if size >= 1 << 17:
                        yield flush()
                        ready, size = [], 0
                held = (doc_id, text) if turn == 0 else None
        if ready:
            yield flush()

    dealt = rows.mapInArrow(deal, "doc_id long, text string, id long, h long, part int, turn int")
    dealt = dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "turn", "id", "h", "text", F.col("doc_id").asc_nulls_last())
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
