"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training reads the texts of a bounded sample: of each language about ``per_language`` documents, chosen by a hash of
their id and text (the only bound, and a parameter; languages with fewer documents give all they have). All languages are learned. Workers
count hashed n-grams by language and send the counts that are not 0, Spark sums them by language, and the matrix of
log-probabilities, 128 KB a language at 2**15 buckets in single precision, goes to the workers. Scoring gathers the rows of
that matrix for the n-grams of a batch and sums them by document in numpy.

Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0. Where no labelled row can be learned from,
all is ``und``. Repeated rows are scored alike. Ties go to the language that sorts first. Ids may be of any type. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblattice.llm.arrow import pieces
from weblattice.llm.grams import hashed, lowered

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Languages whose counts a worker holds before it sends them.
HELD = 64


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # bucket x language
    priors: np.ndarray
    sizes: tuple[int, ...]
    bits: int

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its posterior, tempered by the root of the text's length."""
        points, ends = lowered(texts)
        n, k = len(texts), len(self.languages)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        total, grams = np.zeros((n, k)), np.zeros(n)
        for bucket, owner in hashed(points, ends, self.sizes, self.bits):
            if len(owner):
                here, first = np.unique(owner, return_index=True)
                total[here] += np.add.reduceat(self.logs[bucket], first, axis=0, dtype=np.float64)
                grams += np.bincount(owner, minlength=n)
        total = total / np.sqrt(np.maximum(grams, 1))[:, None] + self.priors
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        score = odds[np.arange(n), best] / odds.sum(axis=1)
        known = np.fromiter((bool(t and LETTER.search(t)) for t in texts), bool, n)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def train(docs: DataFrame, per_language: int = 1000, sizes: tuple[int, ...] = (1, 2, 3), bits: int = 15) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang); rows with a null text or lang teach nothing."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), sizes, bits)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)) * 1_000_000)
    index = {lang: k for k, lang in enumerate(languages)}

    def sent(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, own in held.items():
            full = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([full.astype("<i4").tobytes()]), pa.array([own[full].astype("<i8").tobytes()])], names=["k", "at", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch, texts in pieces(batches, 0):
            langs = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            here, local = np.unique(langs, return_inverse=True)
            if len(held) + len(here) > HELD:
                yield from sent(held)
                held = {}
            points, ends = lowered(texts)
            for bucket, owner in hashed(points, ends, sizes, bits):
                order = np.argsort(local[owner], kind="stable")
                cuts = np.searchsorted(local[owner][order], np.arange(len(here) + 1))
                for k, lang in enumerate(here.tolist()):
                    own = held.setdefault(lang, np.zeros(1 << bits, np.int64))
                    own += np.bincount(bucket[order[cuts[k] : cuts[k + 1]]], minlength=1 << bits)
        yield from sent(held)

    def total(at: list[bytes], n: list[bytes]) -> np.ndarray:
        out = np.zeros(1 << bits, np.int64)
        for x, y in zip(at, n, strict=True):
            out[np.frombuffer(x, "<i4")] += np.frombuffer(y, "<i8")
        return out

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        own = total(table.column("at").to_pylist(), table.column("n").to_pylist())
        full = np.flatnonzero(own)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([full.astype("<i4").tobytes()]), "n": pa.array([own[full].astype("<i8").tobytes()])})

    schema = "k int, at binary, n binary"
    logs = np.zeros((1 << bits, len(languages)), np.float32)
    logs[:] = -np.log(1 << bits)  # of a language without any n-gram
    for r in chosen.select("text", "lang").mapInArrow(count, schema).groupBy("k").applyInArrow(merge, schema).coalesce(4).toLocalIterator():
        own = total([r["at"]], [r["n"]]) + 0.5
        logs[:, r["k"]] = np.log(own / own.sum())
    priors = np.log(np.full(len(languages), 1 / len(languages)))
    return LanguageModel(languages, logs, priors, sizes, bits)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, 2):
            langs, score = sent.value.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learn from the documents that are not held out, then predict all."""
    return predict(docs, train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **options))


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a known language, with at least that score; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, at):
            langs, score = sent.value.scores(texts)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
