"""Readers, the store and the stream, on small hand-made files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weblattice.functions import html as H
from weblattice.functions import keys as K
from weblattice.operators import maintain, routing, selection, stats
from weblattice.sources import records
from weblattice.sources.store import Store


def column(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(("url", "host"), [
    ("http://User:pw@Ex.COM:80/a", "ex.com"), ("//cdn.x.org/a", "cdn.x.org"), ("http://[2001:DB8::1]:8/", "2001:db8::1"), ("mailto:a@b.c", ""), ("http://a_b.example.net?q", "a_b.example.net"), ("/only/path", ""), ("HTTPS://A.b/", "a.b"),
])
def test_host_of(spark, url, host):
    assert column(spark, url, K.host_of) == host


@pytest.mark.parametrize(("host", "domain"), [("a.b.example.com", "example.com"), ("x.co.uk", "x.co.uk"), ("co.uk", None), ("com", None), ("a.b.x.co.uk", "x.co.uk"), ("localhost", None), ("1.2.3.4", None), ("", None)])
def test_registered_domain(spark, host, domain):
    assert column(spark, host, K.registered_domain) == domain


@pytest.mark.parametrize("n", [256, 100, 97])
def test_md5_mod(spark, n):
    import hashlib

    names = [f"d{k}.example.net" for k in range(40)] + ["", "unknown", "é"]
    rows = spark.createDataFrame([(x,) for x in names], "x string").select("x", K.shard_of(F.col("x"), n, {"d1.example.net": 7}).alias("s")).collect()
    for r in rows:
        assert r["s"] == (7 if r["x"] == "d1.example.net" else int(hashlib.md5(r["x"].encode()).hexdigest(), 16) % n)


def test_shard_key_and_ranges(spark):
    assert column(spark, "m.example.net", lambda c: K.shard_key(c, ["m.example.net"])) == "m.example.net"
    assert column(spark, "x.example.net", lambda c: K.shard_key(c, ["m.example.net"])) == "example.net"
    assert column(spark, None, K.shard_key) == "unknown"
    assert list(routing.shard_range(1))[:2] == [16, 17]
    with pytest.raises(ValueError):
        routing.shard_range(16)


def test_page_parser():
    page = '<html><title> A &amp; B </title><a href="/x#f" rel="nofollow">n</a><a href="/y?b=2&a=1#z"> first </a><a href="/y?a=1&b=2">again</a><a href="http://o.org/%7ea"><b>o</b></a><a href="mailto:x">m</a></html>'
    title, links = H.parse_page("http://h.net/d/", page)
    assert title == "A & B"
    assert links[0] == ("http://h.net/y?a=1&b=2", "first") and links[1][0].startswith("http://o.org/") and len(links) == 2
    assert H.parse_page("http://h.net/", "") == (None, [])


def test_jsonl_with_bad_lines(spark, tmp_path):
    folder = tmp_path / "20240101" / "0010"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text('{"url": "u1", "status": "ok"}\n\n{broken\n{"url": "u2"}\n')
    (folder / "b.txt").write_text('{"url": "no"}\n')
    good, bad = records.read_jsonl(spark, str(tmp_path), "url string, status string")
    assert sorted(r["url"] for r in good.collect()) == ["u1", "u2"]
    assert bad.count() == 1
    paths = spark.createDataFrame([(f"{tmp_path}/20240101/0010/a.jsonl",), ("x",)], "path string")
    assert [r[0] for r in paths.select(records.bucket_of(F.col("path"))).collect()] == [dt.datetime(2024, 1, 1, 0, 10), None]
    ts = lambda x: F.lit(x).cast("timestamp")
    assert records.ready_records(paths, F.col("path"), ts("2024-01-01 00:29:59")).count() == 0
    assert records.ready_records(paths, F.col("path"), ts("2024-01-01 00:30:00")).count() == 1
    assert records.ready_records(paths, F.col("path"), ts("2024-01-01 00:30:00"), ts("2024-01-01 00:10:00")).count() == 0


def test_landing_and_queue_names(spark, tmp_path):
    items = spark.createDataFrame([("u", "", None), ("v", "<p>", None)], "url string, content string, fetched_at timestamp")
    records.land(items, str(tmp_path / "out"), F.lit("2024-01-01 10:17:00").cast("timestamp"))
    good, _ = records.read_jsonl(spark, str(tmp_path / "out" / "date=20240101" / "time=1010"), "url string, status string")
    assert {r["url"]: r["status"] for r in good.collect()} == {"u": "fail", "v": "ok"}
    names = spark.createDataFrame([("/q/domain_000012.json",), ("/q/domain_1234567.json",), ("/q/domain_x.json",), ("/q/.tmp",)], "path string")
    assert sorted(r[0] for r in records.queue_ids(names).collect()) == [12, 1234567]
    assert spark.range(12, 13).select(records.queue_name(F.col("id"))).first()[0] == "domain_000012.json"
    with pytest.raises(ValueError):
        records.require({"a": {}}, "a", "b")
    assert records.require({"a": {"b": 1}}, "a", "b") == 1


def test_deltas(spark, tmp_path):
    delta = {"generated_at": "2024-01-02T03:04:05Z", "source": "s", "counters": {"new_links": 2, "shard_error": 1, "fail_reasons": {"a, b": 3}}, "domains": {"7": {"num_fetch_ok": 4}, "x": {"num_fetch_ok": 1}}}
    (tmp_path / "d.json").write_text(json.dumps(delta))
    rows = records.long_deltas(records.read_json(spark, str(tmp_path), records.STATS_DELTA))
    day = stats.summary_daily(rows.where("scope = 'all'"), ["day"]).first()
    assert (day["new_links"], day["num_fetch_ok"]) == (2, 0)
    assert [(r["reason"], r["n"]) for r in stats.reasons(rows, ["day"]).collect()] == [("a, b", 3)]
    bound, lost = stats.bind_domains(rows.where("scope = 'domain'"), spark.createDataFrame([(7, 1)], "domain_id long, shard_id int"))
    assert [r["domain_id"] for r in bound.collect()] == [7] and [r["domain_id"] for r in lost.collect()] == ["x"]


def test_maps(spark):
    row = spark.sql("SELECT map('a', 1L, 'b', 2L) AS l, map('b', 5L, 'c', 6L) AS r, CAST(NULL AS map<string,bigint>) AS n")
    assert row.select(stats.merge_maps_right(F.col("l"), F.col("r"))).first()[0] == {"a": 1, "b": 5, "c": 6}
    assert row.select(stats.merge_maps_right(F.col("n"), F.col("r"))).first()[0] == {"b": 5, "c": 6}


def test_store_commits_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    one, two = (spark.createDataFrame([(k,)], "x long") for k in (1, 2))
    assert store.read("t") is None
    assert store.commit({"t": one}, {"h": one}, batch=0)
    assert not store.commit({"t": two}, {"h": two}, batch=0)
    assert store.commit({"t": two}, {"h": two}, batch=1)
    assert store.commit(append={"h": one}, batch=0, stream="another") and not store.commit(append={"h": one}, batch=0, stream="another")
    assert [r[0] for r in store.read("t").collect()] == [2]
    assert sorted(r[0] for r in store.read("h").collect()) == [1, 1, 2]


def test_selection_guards(spark):
    urls = spark.createDataFrame([("u", 1, 0, None, None, None, None, True), ("v", 1, 0, 2.0, None, None, None, True), ("w", 2, 0, 1.0, None, None, None, False)], "url string, domain_id long, shard_id int, url_score double, domain_score double, last_scheduled timestamp, first_seen timestamp, should_crawl boolean")
    assert selection.select_by_domain(urls, 0, 5).count() == 0
    assert [(r["url"], r["rank"]) for r in selection.select_by_domain(urls, 5, 5).orderBy("rank").collect()] == [("v", 1), ("u", 2)]
    assert selection.should_run(dt.datetime(2024, 1, 1, 3, 0), None) and not selection.should_run(dt.datetime(2024, 1, 1, 2, 59), None)
    assert not selection.should_run(dt.datetime(2024, 1, 1, 5, 0), dt.date(2024, 1, 1))


def test_rolloff_edges(spark):
    day = dt.date
    events = spark.createDataFrame([("a", day(2024, 1, 16), 0, 5, 0, 0, True, 0), ("a", day(2024, 1, 17), 0, 1, 0, 0, True, 0), ("gone", day(2024, 1, 1), 0, 1, 0, 0, True, 0)], "url string, event_date date, num_scheduled long, num_fetch_ok long, num_fetch_fail long, num_content_update long, accounted boolean, shard_id int")
    current = spark.createDataFrame([("a", 0, 3, 0, 0)], "url string, num_scheduled_90d long, num_fetch_ok_90d long, num_fetch_fail_90d long, num_content_update_90d long")
    out = selection.rolloff(events, current, day(2024, 4, 15))
    assert [r["num_fetch_ok_90d"] for r in out["current"].collect()] == [0]
    assert {(r["url"], r["event_date"].day): r["accounted"] for r in out["events"].collect()} == {("a", 16): False, ("a", 17): True, ("gone", 1): False}
    assert [r["url"] for r in out["picked"].where("missing").collect()] == ["gone"]


def test_sweeps_by_bytes_and_characters(spark):
    rows = spark.createDataFrame([("é" * 1300,), ("x" * 2500,), ("x" * 2501,), (None,)], "url string")
    assert maintain.oversized(rows).count() == 2 and maintain.sweep(rows).count() == 2
    assert rows.where(K.fits_url_cap(F.col("url"))).count() == 2
    assert maintain.add_column(rows, "source", "int", 0).where("source = 0").count() == 4


def test_fail_reasons(spark):
    rows = spark.createDataFrame([(404, None, None, None), (None, "IgnoreRequest", "robots", None), (None, "IgnoreRequest", "9 bytes exceeded DOWNLOAD_MAXSIZE 8", None), (None, "TimeoutError", "exceeded", None), (200, None, None, "image/png"), (200, None, None, "Text/HTML; x")], "s int, e string, m string, t string")
    assert [r[0] for r in rows.select(H.fail_reason(*map(F.col, "semt"))).collect()] == ["HttpError 404", "IgnoreRequest robots", "IgnoreRequest exceeded DOWNLOAD_MAXSIZE", "TimeoutError", "NonHTML content-type", None]


def test_settings_and_schedule(tmp_path):
    (tmp_path / "a.yaml").write_text("a:\n  b: [1, 2]\n")
    (tmp_path / "b.yaml").write_text("")
    assert records.require(records.load_settings(str(tmp_path / "a.yaml")), "a", "b") == [1, 2] and records.load_settings(str(tmp_path / "b.yaml")) == {}


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    """Batches of a second checkpoint start at 0 again and are folded; a batch that is run again is not."""
    from weblattice.streaming import ingest as streaming

    store = Store(spark, f"file://{tmp_path}/store")
    for part, checkpoint in (("one", "a"), ("two", "b"), ("two", "b")):
        folder = tmp_path / part
        folder.mkdir(exist_ok=True)
        (folder / "x.json").write_text(json.dumps({"seq": 1, "batch_no": 1, "kind": 1, "ts": "2024-01-01T00:00:00Z", "url": f"http://{part}/", "domain_id": 1, "status": "ok", "content_hash": "h"}) + "\n")
        streaming.run(streaming.source(spark, f"file://{folder}"), store, f"file://{tmp_path}/{checkpoint}").awaitTermination()
    assert {r["url"]: r["num_fetch_ok_90d"] for r in store.read("url_state_current").collect()} == {"http://one/": 1, "http://two/": 1}
    (tmp_path / "two" / "late.json").write_text(json.dumps({"seq": 0, "batch_no": 0, "kind": 1, "ts": "2023-12-01T00:00:00Z", "url": "http://late/", "domain_id": 1, "status": "fail"}) + "\n")
    streaming.run(streaming.source(spark, f"file://{tmp_path}/two"), store, f"file://{tmp_path}/b").awaitTermination()
    assert store.read("url_state_current").where("url = 'http://late/'").count() == 1  # late files are read
