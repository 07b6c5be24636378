"""Running values in two levels against a plain loop over the rows."""

from collections import defaultdict
from datetime import datetime, timedelta

from weblattice.operators import stats


def _rows(spark):
    start = datetime(2024, 1, 1)
    rows = [(n, start + timedelta(minutes=n * 37 % 900), "hot" if n % 3 else f"d{n % 5}", ("request.scheduled", "request.end", "request.fail", "spider.heartbeat")[n * 7 % 4], n * 13 % 101) for n in range(400)]
    rows += [(400, None, "hot", "request.scheduled", 1), (401, start, None, "request.scheduled", 2), (402, start + timedelta(hours=5), None, "request.end", None), (403, None, None, "spider.heartbeat", None)]
    return rows, spark.createDataFrame(rows, "seq long, ts timestamp, domain string, event string, inflight int")


def _ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.min, r[0]))


def test_pending_equals_a_loop(spark):
    rows, table = _rows(spark)
    waiting, expected = defaultdict(int), {}
    for seq, _, domain, event, _ in _ordered(rows):
        if event != "spider.heartbeat":
            waiting[domain] += 1 if event == "request.scheduled" else -1
            expected[seq] = (domain, waiting[domain])
    assert {r.seq: (r.domain, r.pending) for r in stats.pending(table).collect()} == expected


def test_running_max_equals_a_loop(spark):
    rows, table = _rows(spark)
    top, expected = {}, {}
    for seq, _, domain, event, value in _ordered(rows):
        if event == "spider.heartbeat":
            top[domain] = max((x for x in (top.get(domain), value) if x is not None), default=None)
            expected[seq] = (domain, top[domain])
    found = stats.running_max(table.withColumnRenamed("domain", "worker_id"), ["inflight"]).collect()
    assert {r.seq: (r.worker_id, r.inflight_max) for r in found} == expected


def test_running_values_of_no_rows(spark):
    _, table = _rows(spark)
    assert stats.pending(table.limit(0)).count() == 0
