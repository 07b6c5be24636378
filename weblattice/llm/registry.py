"""Queries of the training-data operators, with SQL oracles where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.llm import bpe, fingerprints, jaccard, language_id, licenses, mixing, quality, toxicity, url_filter, warc
from weblattice.sources.scratch import cut, fresh
from weblattice.sources.tables import read_table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def tokenizer(name: str = TOKENIZER) -> bpe.Bpe:
    """The public tokenizer of that name, as installed on the driver."""
    import public_tokenizers

    return bpe.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.QUERY_RULES))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_jaccard_links(spark, sf_dir).drop("n_links")


def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer()))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(read_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("spans").cast("long").alias("n_licenses"), "n_sentences", "n_unmatched")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels.where(~language_id.held_out(labels.doc_id))))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "warc")
    written = cut(warc.write(read_table(spark, sf_dir, "pages"), folder), "warc-files")
    warc.tidy(written, folder)
    return warc.index(warc.read_chunks(spark, written, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_jaccard_join, op2_jaccard_links, op3_bpe, op4_fingerprints, op5_license_scan, op6_language_id, op7_mixing, op8_quality, op9_toxicity, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": url_filter.ORACLE, "op2_jaccard_join": jaccard.ORACLE, "op2_jaccard_links": jaccard.LINKS_ORACLE, "op7_mixing": mixing.ORACLE, "op10_warc": warc.ORACLE}
