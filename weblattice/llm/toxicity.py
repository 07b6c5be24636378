"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of the lower-cased text. Each is scaled by the logarithm of the ratio of its
smoothed frequencies in toxic and other training texts; a logistic regression with an L2 penalty is fitted on those.
All n-grams are counted. Those that tell the classes apart take part: the likelihood-ratio statistic of their presence
against the label has to reach ``evidence`` (11: chance does so once in a thousand); there is no limit to their number.

Training uses a bounded sample of labelled rows, the only bound and a parameter: at most ``per_class`` labelled documents of
each class, chosen by a hash of their id. Their texts are written once to the shared scratch folder; workers count
n-grams there and then list each text's n-grams that take part, so that the driver gets sparse rows and no text.

Defined cases: null and empty texts score as a text without features. Labels that are null or whose document is missing
teach nothing; a document labelled both ways counts once for each. Of several texts of one id the one with the smallest hash
teaches. Without two classes to learn from every score is 0. Repeated rows are scored alike. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblattice.llm.arrow import pieces
from weblattice.llm.grams import hashed, lowered
from weblattice.llm.language_id import held_out
from weblattice.sources.scratch import cut, drop


def presence(texts: list[str | None], sizes: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every feature that is present, once for each text, in that order."""
    points, ends = lowered(texts)
    keys = []
    for bucket, owner in hashed(points, ends, sizes, bits):
        if wanted is not None:
            hit = wanted[bucket]
            bucket, owner = bucket[hit], owner[hit]
        keys.append((owner.astype(np.int64) << bits) | bucket)
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found >> bits, found & ((1 << bits) - 1)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # one for each bucket
    wanted: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    bits: int

    def scores(self, texts: list[str | None]) -> np.ndarray:
        owner, bucket = presence(texts, self.sizes, self.bits, self.wanted)
        total = np.bincount(owner, weights=self.weights[bucket], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def telling(seen: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """For features with their numbers of texts and of toxic texts: the log-count ratio, and the likelihood-ratio statistic of presence and label."""
    ratio = np.log(((toxic + 1.0) / (n_toxic + 2)) / ((seen - toxic + 1.0) / (n - n_toxic + 2)))
    total = np.zeros(len(seen))
    for label, present in ((n_toxic, toxic), (n - n_toxic, seen - toxic)):
        for found, expected in ((present, seen * (label / n)), (label - present, (n - seen) * (label / n))):
            found, expected = found.astype(float), np.maximum(expected, 1e-300)
            total += np.where(found > 0, found * np.log(np.maximum(found, 1) / expected), 0)
    return ratio, 2 * total


def regress(owner: np.ndarray, feature: np.ndarray, ratio: np.ndarray, toxic: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights (of presence, the ratios multiplied in) and bias of a logistic regression in which both classes weigh alike."""
    n, dims = len(toxic), len(ratio)
    value, target = ratio[feature], toxic.astype(float)
    share = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (~toxic).mean()) / n
    w, b = np.zeros(dims), 0.0
    step_w, step_b, eps = np.zeros(dims), 0.0, 1e-8
    for _ in range(rounds):  # gradient steps, scaled for each weight by its past gradients
        margin = np.bincount(owner, weights=w[feature] * value, minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target) * share
        grad = np.bincount(feature, weights=error[owner] * value, minlength=dims) + penalty * w / n
        step_w += grad**2
        step_b += error.sum() ** 2
        w -= 0.1 * grad / (np.sqrt(step_w) + eps)
        b -= 0.1 * error.sum() / (np.sqrt(step_b) + eps)
    return w * ratio, float(b)


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """text, toxic and k (a key that orders the rows) of the labelled documents that teach, written."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("toxic = 0").orderBy(*order).limit(per_class).unionByName(known.where("toxic = 1").orderBy(*order).limit(per_class))
    chosen = cut(chosen.withColumnRenamed("doc_id", "id"), "labels")  # written: Spark knows its size when it plans the join
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("id", "toxic", "text", F.xxhash64("text").alias("h"))
    one = rows.groupBy("id", "toxic").agg(F.min_by("text", F.struct("h", "text")).alias("text"))
    out = cut(one.select("text", "toxic", F.xxhash64("id", "toxic").alias("k")), "texts")
    drop(chosen)
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, sizes: tuple[int, ...] = (3, 4, 5, 6), bits: int = 20, evidence: float = 11.0, rounds: int = 300, penalty: float = 5.0) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    dims, rows = 1 << bits, _sample(docs, labels, per_class)
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        drop(rows)
        return ToxicityModel(np.zeros(dims, np.float32), np.zeros(dims, bool), -50.0, sizes, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch, texts in pieces(batches, 0):
            owner, bucket = presence(texts, sizes, bits)
            is_toxic = np.array(batch.column(1).to_pylist(), np.int64) == 1
            seen += np.bincount(bucket, minlength=dims)
            toxic += np.bincount(bucket[is_toxic[owner]], minlength=dims)
        at = np.flatnonzero(seen)
        for part in np.array_split(at, -(-len(at) // (1 << 16)) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part]), pa.array(toxic[part])], names=["bucket", "seen", "toxic"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, statistic = telling(batch.column(1).to_numpy(), batch.column(2).to_numpy(), n, n_toxic)
            yield batch.filter(pa.array(statistic >= evidence))

    schema = "bucket long, seen long, toxic long"
    counts = rows.select("text", "toxic").mapInArrow(count, schema).groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    found = counts.mapInArrow(told, schema).toArrow().sort_by("bucket")  # one row for each n-gram that takes part
    chosen = found.column("bucket").to_numpy()
    ratio, _ = telling(found.column("seen").to_numpy(), found.column("toxic").to_numpy(), n, n_toxic)
    wanted = np.zeros(dims, bool)
    wanted[chosen] = True

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, 0):
            owner, bucket = presence(texts, sizes, bits, wanted)
            hits = np.split(bucket.astype("<i4"), np.searchsorted(owner, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([x.tobytes() for x in hits], pa.binary())], names=["k", "toxic", "hits"])

    learned = rows.select("text", "toxic", "k").mapInArrow(sparse, "k long, toxic int, hits binary").toArrow().sort_by([("k", "ascending"), ("toxic", "ascending")])
    drop(rows)
    hits = [np.frombuffer(x, "<i4") for x in learned.column("hits").to_pylist()]
    owner = np.repeat(np.arange(len(hits)), list(map(len, hits)))
    feature = np.searchsorted(chosen, np.concatenate(hits))
    own, bias = regress(owner, feature, ratio, learned.column("toxic").to_numpy() == 1, rounds, penalty)
    weights = np.zeros(dims, np.float32)
    weights[chosen] = own
    return ToxicityModel(weights, wanted, bias, sizes, bits)


def score(docs: DataFrame, model: ToxicityModel, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, 2):
            found = sent.value.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``least``; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, at):
            yield batch.filter(pa.array(sent.value.scores(texts) < least))

    return docs.mapInArrow(run, docs.schema)
