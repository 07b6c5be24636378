"""The pipeline's stages on odd tables, and the classifiers' stages against their own operators."""

import pytest
from pyspark.sql import functions as F

from weblattice.llm import language_id, registry, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, f"the text of number {k} is a text of words " * 3, "en", f"s{k % 3}", 0) for k in range(12)] + [(k, f"der Satz mit der Nummer {k} ist ein Satz " * 3, "de", None, 0) for k in range(12, 24)]
    rows += [rows[0], rows[0], (None, rows[1][1], "en", "s1", 0), (30, None, None, None, None), (31, "", "en", "s0", 0), (32, "12 34 ½", "de", "s1", 0), (33, rows[2][1], None, "s2", 0), (34, "x " * 50_000, "en", "s2", 0)]
    clash = {c: F.lit("c") for c in ("score", "_id", "rows", "gone", "c0", "threshold", "whole", "_copies", "held_out", "digest", "ids")}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


def test_stages_on_odd_rows(spark, sf_dir, odd):
    import corpus_pipeline as p
    from weblattice.sources.scratch import cut

    docs = odd
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), "odd")
        assert docs.columns == odd.columns
        ids = [r["doc_id"] for r in docs.collect()]
        if name == "toxicity":
            assert docs.count() == odd.count()
        if name == "language_id":
            assert not {30, 31, 32} & set(ids) and ids.count(0) == 3 and None in ids and 12 in ids
        if name == "jaccard_join":
            assert ids.count(0) == 1 and 33 not in ids and None in ids and 2 in ids
    last = p.STAGES[-1][1](spark, docs, sf_dir)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()


def test_stages_on_an_empty_table(spark, sf_dir, odd):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(spark, odd.where("false"), sf_dir).count() == 0


def test_filters_keep_what_their_operators_accept(spark, sf_dir):
    """Each filter drops exactly the rows that its operator, trained in the same way, rejects; clean documents stay."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marks = toxicity.score(docs, toxicity.train(docs, labels.where(~language_id.held_out(labels.doc_id))), p.TOXIC).collect()
    assert sorted(r["doc_id"] for r in p.drop_toxic(spark, docs, sf_dir).collect()) == sorted(r["doc_id"] for r in marks if r["score"] < p.TOXIC)
    langs = registry.op6_language_id(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in p.drop_unknown_language(spark, docs, sf_dir).collect()) == sorted(r["doc_id"] for r in langs if r["lang_pred"] != "und" and r["score"] >= p.SURE)
    clean = {r["doc_id"] for r in labels.where("toxic = 0 AND quality = 1").collect()}
    kept = {r["doc_id"] for r in p.drop_unknown_language(spark, p.drop_toxic(spark, docs, sf_dir), sf_dir).collect()}
    assert len(clean - kept) <= 0.02 * len(clean)
