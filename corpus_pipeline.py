"""A corpus pipeline: toxicity, language, near duplicates, mixing and encoding, each stage on what the one before it kept.

Every stage but the last returns the columns of ``documents``. Stages are written as Parquet and read again, so none
depends on the lineage of another. The labels that the first stage learns from are read from the tables' folder.

No stage but mixing can be said in SQL (two are trained models), so ORACLE_SQL is None; the tests hold the stages
against brute-force versions.

Defined cases, of every stage: an empty table gives an empty table; further columns stay, whatever their names, but in the last stage, which
returns four columns of its own. A null text is not toxic, has no language and therefore goes in the second stage. Rows with a null
id are judged like others but are nobody's copies. Of repeated rows one stays in the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weblattice.llm import bpe, jaccard, language_id, mixing, toxicity
from weblattice.llm.registry import tokenizer
from weblattice.sources.scratch import cut, drop
from weblattice.sources.tables import read_table

#: Documents that score as much for toxicity go; so do those whose best language has less than the other score.
TOXIC, SURE = 0.7, 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below TOXIC; without labels of both classes, all."""
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels.where(~language_id.held_out(labels.doc_id))), TOXIC)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text has a language, as sure as SURE; where no row has a lang to learn from, none."""
    learned = language_id.train(docs.where(~language_id.held_out(docs.doc_id)).select("doc_id", "text", "lang"))
    return language_id.keep_known(docs, learned, SURE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar documents, that of its smallest id; rows with a null id all stay."""
    return jaccard.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a null source is a source of its own."""
    return mixing.take(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of every row that was mixed in."""
    return bpe.digests(bpe.encode_decode(docs, tokenizer()))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
