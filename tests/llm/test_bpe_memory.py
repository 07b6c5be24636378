"""The encoder's memory, and its defined cases on tables."""

import base64
import hashlib
import random

from pyspark.sql import functions as F

from weblattice.llm import bpe, registry


def held(memo):
    return sum(len(k) + len(v) + bpe.ENTRY for part in (memo.young, memo.old) for k, v in part.items())


def test_memo_is_bounded_by_bytes():
    """Text without blanks makes pieces of any length; none of the long ones stays, and short ones are dropped by bytes."""
    codec = registry.tokenizer()
    fresh = bpe.Bpe({token: rank for rank, token in codec.tokens.items()}, codec.pattern, memo=50_000)
    rng = random.Random(2)
    for k in range(30):
        blob = base64.b64encode(rng.randbytes(30_000)).decode()
        text = f"{blob} {'漢字' * 2000}。{' '.join(f'word{k}x{i}' for i in range(200))}"
        assert fresh.encode(text) == codec.encode(text)
        for memo, size in ((fresh.of_pieces, 50_000), (fresh.of_tokens, 100_000)):
            assert max(map(len, [*memo.young, *memo.old, ""])) <= bpe.LONGEST
            assert memo.used <= size and held(memo) <= 3 * size  # a generation is full when it is beyond its size


def test_encoding_odd_tables(spark):
    codec = registry.tokenizer()
    rows = [("a", "same text"), ("a", "same text"), (None, None), ("b", ""), ("c", "x" * 200_000 + " é" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"n_tokens": F.lit(1), "decoded": F.lit("x")})
    found = bpe.digests(bpe.encode_decode(docs, codec)).collect()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in found) == sorted((str(k), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    assert bpe.digests(bpe.encode_decode(docs.where("false"), codec)).count() == 0
