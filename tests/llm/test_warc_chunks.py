"""WARC archives: shared and missing ids, repeated tasks, large payloads, odd tables."""

import base64
import hashlib
import os

from pyspark.sql import functions as F

from weblattice.llm import warc

PAGES = "page_id long, url string, html string"


def trip(spark, rows, folder, **options):
    pages = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, PAGES)
    files = spark.createDataFrame(warc.write(pages, folder, **options).collect(), "file string, records long")
    return files, warc.read_chunks(spark, files, folder)


def plain(rows, least=0):
    """What the records must be, page by page."""
    out = []
    for page_id, _, text in rows:
        raw = (text or "").encode()
        same = [p for p, _, t in rows if (t or "") == (text or "") and p is not None]
        refers = min(same) if same and page_id != min(same) and len(raw) >= least else None
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_pages_without_ids(spark, tmp_path):
    """Rows are joined by id and digest: as many chunk rows leave the join as enter it."""
    rows = [(None, f"u{k}", f"<p>{k}</p>") for k in range(300)] + [(1, "a", "<p>7</p>"), (1, "a", "<p>7</p>"), (1, "b", "x"), (2, "c", "x")]
    files, chunks = trip(spark, rows, f"file://{tmp_path}/w")
    assert sum(r["records"] for r in files.collect()) == len(rows)
    assert sorted(map(tuple, warc.index(chunks).collect()), key=str) == plain(rows)


def test_repeated_tasks(spark, tmp_path):
    """Archives that are there already, and what a failed attempt left, change nothing."""
    rows = [(k, f"u{k}", "<p>same</p>" if k % 2 else f"<p>{k}</p>") for k in range(40)]
    folder = f"file://{tmp_path}/w"
    first, _ = trip(spark, rows, folder)
    second, chunks = trip(spark, rows, folder)
    assert sorted(map(tuple, warc.index(chunks).collect()), key=str) == plain(rows)
    (tmp_path / "w" / "part-000000-broken.warc.gz").write_bytes(b"\x1f\x8b half a rec")
    assert warc.tidy(second, folder) == first.count() + 1
    assert sorted(os.path.basename(x) for x in os.listdir(tmp_path / "w") if not x.startswith(".")) == sorted(r["file"] for r in second.collect())
    assert sorted(map(tuple, warc.index(warc.read_chunks(spark, second, folder)).collect()), key=str) == plain(rows)


def test_large_payload(spark, tmp_path):
    """A payload of many chunks, equal rows of it, and a copy under another id."""
    text = "".join(f"<p>{k} é</p>" for k in range(300_000))
    rows = [(4, "u", text), (4, "u", text), (9, "v", text), (5, "w", "small")]
    _, chunks = trip(spark, rows, f"file://{tmp_path}/w")
    assert sorted(map(tuple, warc.index(chunks).collect()), key=str) == plain(rows)
    sizes = chunks.where("page_id = 4").groupBy("chunk_no").agg(F.count("*").alias("n"), F.max(F.length("chunk")).alias("most"), F.count_distinct("digest").alias("digests"))
    assert all(r["n"] == 2 and r["most"] <= warc.CHUNK and r["digests"] == 1 for r in sizes.collect())
    assert chunks.where("page_id = 9").count() == 1


def test_empty_table_and_clashing_names(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    files, chunks = trip(spark, none, f"file://{tmp_path}/none")
    assert files.count() == 0 and warc.index(chunks).count() == 0 and warc.tidy(files, f"file://{tmp_path}/none") == 0
    rows = [(1, None, None), (2, "u", ""), (3, "u", "a")]
    clash = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("chunk", "refers_to", "payload_digest", "row_no", "of", "id")})
    _, chunks = trip(spark, clash, f"file://{tmp_path}/clash", least=1)
    assert sorted(map(tuple, warc.index(chunks).collect()), key=str) == plain(rows, 1)
