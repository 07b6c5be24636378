"""The fold against a record-by-record model, on random records."""

import datetime as dt
import random

import pytest

from weblattice.operators import ingest

T0 = dt.datetime(2024, 1, 1)
FIELDS = "seq long, batch_no long, kind int, ts timestamp, url string, domain_id long, status string, fail_reason string, content_hash string, title string, discovered_from string, domain_score double"


def model(state, records):
    """Apply records one by one; returns the history rows that matter."""
    history = []
    for r in sorted(records, key=lambda r: (r["batch_no"], r["kind"], r["seq"])):
        if r["url"] is None or len(r["url"]) > 2500:
            continue
        row = state.get(r["url"])
        if r["kind"] == 0:
            if row is not None:
                continue
            row = dict(domain_id=r["domain_id"], first_seen=r["ts"], ok=0, fail=0, upd=0, streak=0, reason=None, hash=None, title=None, crawl=True, last_ok=None, last_upd=None, score=r["domain_score"] or 0.0, parent=r["discovered_from"])
        else:
            ok = r["status"] == "ok"
            old = row["hash"] if row else None
            upd = ok and r["content_hash"] is not None and r["content_hash"] != old
            if row is None:
                row = dict(domain_id=r["domain_id"], first_seen=r["ts"], ok=0, fail=0, upd=0, streak=0, reason=None, hash=r["content_hash"], title=None, crawl=False, last_ok=None, last_upd=None, score=0.0, parent=None)
            row = dict(row, ok=row["ok"] + ok, fail=row["fail"] + (not ok), upd=row["upd"] + upd, streak=0 if ok else row["streak"] + 1, reason=None if ok else r["fail_reason"], crawl=False)
            if upd:
                row.update(hash=r["content_hash"], last_upd=r["ts"])
            if ok:
                row.update(last_ok=r["ts"], title=r["title"] if r["title"] is not None else row["title"])
        state[r["url"]] = row
        history.append((r["seq"], r["url"], *row.values()))
    return history


def records(rng, n, start=0, urls=12):
    out = []
    for k in range(start, start + n):
        kind = int(rng.random() > 0.25)
        ok = rng.random() < 0.6
        url = rng.choice([f"http://h/{rng.randrange(urls)}", None if rng.random() < 0.1 else "x" * rng.choice([2500, 2501])]) if rng.random() < 0.1 else f"http://h/{rng.randrange(urls)}"
        out.append(dict(
            seq=k, batch_no=k // 20, kind=kind, ts=T0 + dt.timedelta(minutes=k), url=url, domain_id=rng.randrange(5), status="new" if kind == 0 else "ok" if ok else "fail", fail_reason=None if ok else rng.choice(["a", "b, c", None]),
            content_hash=rng.choice(["h1", "h2", None]) if kind and (ok or rng.random() < 0.1) else None, title=rng.choice(["t", "u", None]) if ok else None, discovered_from="p" if kind == 0 else None, domain_score=0.5,
        ))
    return out


COLUMNS = ["domain_id", "first_seen", "num_fetch_ok_90d", "num_fetch_fail_90d", "num_content_update_90d", "num_consecutive_fail", "last_fail_reason", "content_hash", "title", "should_crawl", "last_fetch_ok", "last_content_update", "domain_score", "discovered_from"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_upserts(spark, seed):
    rng = random.Random(seed)
    first, second = records(rng, 150), records(rng, 250, 160)
    state = {}
    model(state, first)
    none = ingest.no_state(spark)
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], FIELDS)
    base = ingest.apply_fold(ingest.fold(frame(first), none), none)
    folded = ingest.fold(frame(second), base)
    expected = model(state, second)
    keys = ["domain_id", "first_seen", "ok", "fail", "upd", "streak", "reason", "hash", "title", "crawl", "last_ok", "last_upd", "score", "parent"]
    assert len(COLUMNS) == len(keys)
    found = sorted((r["seq"], r["url"], *[r[c] for c in COLUMNS]) for r in folded.collect())
    assert [tuple(map(str, x)) for x in found] == [tuple(map(str, x)) for x in sorted(expected, key=lambda x: x[0])]
    after = {r["url"]: tuple(str(r[c]) for c in COLUMNS) for r in ingest.apply_fold(folded, base).collect()}
    assert after == {u: tuple(str(row[k]) for k in keys) for u, row in state.items()}


def test_fold_of_nothing(spark):
    none = ingest.no_state(spark)
    assert ingest.apply_fold(ingest.fold(spark.createDataFrame([], FIELDS), none), none).count() == 0
