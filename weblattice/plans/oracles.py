"""The registered queries in SQL, for DuckDB on the same tables."""

from __future__ import annotations

#: Fixed values, written out here again so that an error in the library's own does not hide.
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^/?#:@\[]*))"
HTTP_HOST = r"^https?://([^/:]+)"
DNS_NAME = r"[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?)*"
SUFFIXES = "com net org edu gov mil int info biz io ai dev app de fr es it nl uk us jp cn tw hk kr in au ca br ru eu ch at be se no dk fi pl cz pt gr tr mx za nz".split()
LONG_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp ac.jp com.cn net.cn org.cn gov.cn com.tw org.tw edu.tw gov.tw com.hk co.kr or.kr co.in com.br com.mx co.za co.nz com.tr".split()

SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
_LOWER_HOST = "lower(regexp_extract({u}, '{p}', 1) || regexp_extract({u}, '{p}', 2))"


def host(url: str) -> str:
    return _LOWER_HOST.format(u=url, p=HOST)


def registered(h: str) -> str:
    """Registered domain of a host expression."""
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    short = ", ".join(f"'{x}'" for x in SUFFIXES)
    labels = f"string_split({h}, '.')"
    return (
        f"CASE WHEN len({labels}) >= 3 AND array_to_string({labels}[-2:], '.') IN ({long}) THEN array_to_string({labels}[-3:], '.') "
        f"WHEN len({labels}) >= 2 AND array_to_string({labels}[-2:], '.') NOT IN ({long}) AND {labels}[-1] IN ({short}) THEN array_to_string({labels}[-2:], '.') END"
    )


def key(h: str, split: tuple[str, ...] = ()) -> str:
    own = f"WHEN {h} IN ({', '.join(repr(x) for x in split)}) THEN {h} " if split else ""
    return f"CASE WHEN {h} IS NULL OR {h} = '' THEN 'unknown' {own}ELSE coalesce({registered(h)}, {h}) END"


def shard(k: str, n: int = 256, pinned: dict[str, int] | None = None) -> str:
    """MD5 modulo n by way of its four 32-bit words."""
    total = "0::BIGINT"
    for i in range(4):
        total = f"(({total}) * {(1 << 32) % n} + ('0x' || substr(md5({k}), {8 * i + 1}, 8))::BIGINT) % {n}"
    plain = f"({total})::INT"
    if not pinned:
        return plain
    return f"CASE {k} " + " ".join(f"WHEN '{d}' THEN {s}" for d, s in pinned.items()) + f" ELSE {plain} END"


PINNED = {"example.com": 0, "example.org": 32}
EVENTS = """e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""
LOG = (
    EVENTS
    + """,
fetch_log AS (SELECT event_id AS seq, CAST(floor(event_id / 500) AS BIGINT) AS batch_no, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS kind, ts, CAST(ts AS DATE) AS day, user_id AS domain_id, CAST(user_id % 16 AS INT) AS shard_id,
  'http://d' || user_id || '.example.net/p' || (k % 5) AS url, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'new' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'HttpError 404' WHEN 1 THEN 'TimeoutError' ELSE 'DNSLookupError, retry' END END AS fail_reason,
  CASE WHEN event_type NOT IN ('error', 'signup') AND k % 11 <> 0 THEN 'h' || (CAST(floor(value) AS BIGINT) % 4) END AS content_hash,
  CASE WHEN event_type NOT IN ('error', 'signup') AND k % 4 <> 0 THEN 't' || (k % 3) END AS title,
  CASE WHEN event_type = 'signup' THEN 'http://d' || ((user_id + 1) % 150) || '.example.net/p0' END AS discovered_from, (user_id % 10) / 10.0::DOUBLE AS domain_score FROM e)"""
)
LINES = (
    EVENTS
    + """,
x AS (SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN 'request.end' WHEN event_type = 'error' THEN 'request.fail' WHEN event_type = 'signup' THEN 'request.scheduled' ELSE 'spider.heartbeat' END AS event FROM e),
log_event AS (SELECT event_id AS seq, ts, event, CAST(user_id % 16 AS INT) AS worker_id, 'd' || user_id AS domain, CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS level,
  CASE WHEN event = 'request.end' THEN CASE WHEN k % 10 < 8 THEN 200 ELSE 404 END END AS status, CASE WHEN event = 'request.end' THEN CAST(round(value * 10) AS BIGINT) END AS latency_ms,
  CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'HttpError 404' WHEN 1 THEN 'TimeoutError' ELSE 'DNSLookupError' END END AS fail_reason,
  CASE WHEN event_type = 'error' THEN 'batch ' || k || ' failed on shard ' || (k % 7) || chr(10) || 'trace' END AS error,
  """
    + ", ".join(f"CASE WHEN event = 'spider.heartbeat' THEN k * {n} END AS {g}" for n, g in enumerate(("inflight", "pending", "active_domains", "transferring", "slot_queue"), 1))
    + " FROM x)"
)
_TITLE, _LINK = "<title[^>]*>(.*?)</title>", '<a\\s+href="([^"]*)"[^>]*>(.*?)</a>'
#: The character references that the pages have.
_TEXT = "replace(replace(replace(replace({t}, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
RESULTS = f"""crawl_result AS (SELECT page_id AS seq, url, {host("url")} AS host, CASE WHEN coalesce(html, '') <> '' THEN 'ok' ELSE 'fail' END AS status, html AS content, CASE WHEN coalesce(html, '') <> '' THEN sha1(html) END AS content_hash,
  nullif(substr(regexp_replace({_TEXT.format(t=f"regexp_extract(html, '{_TITLE}', 1, 'is')")}, '^\\s+|\\s+$', '', 'g'), 1, 500), '') AS title, regexp_extract_all(html, '{_LINK}', 1, 'is') AS hrefs, regexp_extract_all(html, '{_LINK}', 2, 'is') AS anchors FROM pages)"""
DOMAINS = RESULTS + f", hd AS (SELECT *, host AS domain, {shard('host')} AS shard_id FROM crawl_result)"
#: Links of pages, each target once: the pages have links from the root only, whose words are percent-encoded.
LINKS = f"""raw AS (SELECT seq, url AS page, unnest(hrefs) AS href, unnest(anchors) AS anchor, unnest(range(1, len(hrefs) + 1)) AS pos FROM crawl_result),
absolute AS (SELECT *, lower(regexp_extract(page, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) || array_to_string(list_transform(string_split(href, '/'), lambda x: replace(url_encode(x), '%2C', ',')), '/') AS url FROM raw),
once AS (SELECT * FROM absolute QUALIFY row_number() OVER (PARTITION BY seq, url ORDER BY pos) = 1),
links AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS position, url, page, substr(regexp_replace({_TEXT.format(t="regexp_replace(anchor, '<[^>]*>', '', 'g')")}, '^\\s+|\\s+$', '', 'g'), 1, 200) AS anchor FROM once WHERE length(url) <= 2500)"""
FRONTIER = (
    EVENTS
    + """,
frontier AS (SELECT 'http://d' || user_id || '.example.net/p' || (k % 5) AS url, user_id AS domain_id, CAST(user_id % 16 AS INT) AS shard_id, max(value) AS url_score, max((user_id % 10) / 10.0::DOUBLE) AS domain_score,
  max(CASE WHEN event_type = 'purchase' AND CAST(floor(value) AS BIGINT) % 3 = 0 THEN ts END) AS last_scheduled, min(ts) AS first_seen, count(*) % 3 <> 0 AS should_crawl, count(*) AS num_scheduled_90d FROM e GROUP BY ALL)"""
)
OFFER = "ORDER BY url_score DESC NULLS LAST, domain_score DESC NULLS LAST, last_scheduled ASC NULLS FIRST, first_seen ASC NULLS LAST, url ASC"


def fold(name: str, records: str, base: str | None) -> str:
    """CTEs that fold records into the state ``base``: {name} has every state, {name}_state the current rows afterwards."""
    b = (lambda c: f"b.{c}") if base else (lambda c: "NULL")
    joined = f"LEFT JOIN {base} b ON b.url = r.url" if base else ""
    known = "b.url IS NOT NULL" if base else "false"
    w = "PARTITION BY url ORDER BY batch_no, kind, seq"
    columns = "first_seen last_scheduled last_fetch_ok last_content_update num_scheduled_90d num_fetch_ok_90d num_fetch_fail_90d num_content_update_90d num_consecutive_fail content_hash url_score domain_score title source discovered_from domain_id".split()
    kinds = {"first_seen": "TIMESTAMP", "last_scheduled": "TIMESTAMP", "last_fetch_ok": "TIMESTAMP", "last_content_update": "TIMESTAMP", "content_hash": "VARCHAR", "title": "VARCHAR", "discovered_from": "VARCHAR", "url_score": "DOUBLE", "domain_score": "DOUBLE"}
    carried = ", ".join(f"CAST({b(c)} AS {kinds.get(c, 'BIGINT')}) AS b_{c}" for c in columns)
    state = "url, domain_id, first_seen, last_scheduled, last_fetch_ok, last_content_update, num_scheduled_90d, num_fetch_ok_90d, num_fetch_fail_90d, num_content_update_90d, num_consecutive_fail, last_fail_reason, content_hash, should_crawl, url_score, domain_score, title, source, discovered_from"
    return f"""
{name}_1 AS (SELECT r.*, {known} AS known, {carried}, row_number() OVER (PARTITION BY r.url ORDER BY batch_no, kind, seq) AS rn FROM {records} r {joined} WHERE length(r.url) <= 2500),
{name}_2 AS (SELECT *, NOT known AND rn = 1 AS inserted, kind = 1 AND status = 'ok' AS is_ok, kind = 1 AND status <> 'ok' AS is_fail FROM {name}_1 WHERE kind = 1 OR (NOT known AND rn = 1)),
{name}_3 AS (SELECT *, CASE WHEN is_ok OR (inserted AND kind = 1) THEN content_hash END AS nh FROM {name}_2),
{name}_4 AS (SELECT *, coalesce(last_value(nh IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b_content_hash) AS prev, sum(is_ok::INT) OVER ({w}) AS streak FROM {name}_3),
{name}_5 AS (SELECT *, is_ok AND content_hash IS NOT NULL AND content_hash IS DISTINCT FROM prev AS is_upd FROM {name}_4),
{name} AS (SELECT url, CASE WHEN known THEN b_domain_id ELSE first_value(domain_id) OVER ({w}) END AS domain_id, CASE WHEN known THEN b_first_seen ELSE first_value(ts) OVER ({w}) END AS first_seen, b_last_scheduled AS last_scheduled,
  coalesce(last_value(CASE WHEN is_ok THEN ts END IGNORE NULLS) OVER ({w}), b_last_fetch_ok) AS last_fetch_ok, coalesce(last_value(CASE WHEN is_upd THEN ts END IGNORE NULLS) OVER ({w}), b_last_content_update) AS last_content_update,
  coalesce(b_num_scheduled_90d, 0) AS num_scheduled_90d, (coalesce(b_num_fetch_ok_90d, 0) + sum(is_ok::INT) OVER ({w}))::BIGINT AS num_fetch_ok_90d, (coalesce(b_num_fetch_fail_90d, 0) + sum(is_fail::INT) OVER ({w}))::BIGINT AS num_fetch_fail_90d,
  (coalesce(b_num_content_update_90d, 0) + sum(is_upd::INT) OVER ({w}))::BIGINT AS num_content_update_90d,
  (sum(is_fail::INT) OVER (PARTITION BY url, streak ORDER BY batch_no, kind, seq) + CASE WHEN streak = 0 THEN coalesce(b_num_consecutive_fail, 0) ELSE 0 END)::BIGINT AS num_consecutive_fail, CASE WHEN is_fail THEN fail_reason END AS last_fail_reason,
  coalesce(last_value(nh IGNORE NULLS) OVER ({w}), b_content_hash) AS content_hash, kind = 0 AS should_crawl, coalesce(b_url_score, 0.0)::DOUBLE AS url_score,
  CASE WHEN known THEN b_domain_score ELSE first_value(CASE WHEN kind = 0 THEN domain_score ELSE 0.0 END) OVER ({w}) END AS domain_score, coalesce(last_value(CASE WHEN is_ok THEN title END IGNORE NULLS) OVER ({w}), b_title) AS title,
  coalesce(b_source, 0)::INT AS source, CASE WHEN known THEN b_discovered_from ELSE first_value(CASE WHEN kind = 0 THEN discovered_from END) OVER ({w}) END AS discovered_from,
  seq, batch_no, kind, ts, is_ok, is_upd, CASE WHEN is_fail THEN fail_reason END AS fail_reason, inserted, row_number() OVER ({w}) AS step FROM {name}_5),
{name}_last AS (SELECT {state} FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY step DESC) AS k FROM {name}) WHERE k = 1),
{name}_state AS (SELECT * FROM {name}_last {f"UNION ALL SELECT {state} FROM {base} WHERE url NOT IN (SELECT url FROM {name}_last)" if base else ""})"""


FOLDS = f"WITH {LOG}, early AS (SELECT * FROM fetch_log WHERE ts < {SPLIT}), late AS (SELECT * FROM fetch_log WHERE ts >= {SPLIT}), {fold('f0', 'early', None)}, {fold('f1', 'late', 'f0_state')}"
COUNTERS = f"""{LOG}, {fold("f", "fetch_log", None)},
counters AS (SELECT url, CAST(ts AS DATE) AS event_date, 0::BIGINT AS num_scheduled, sum(is_ok::INT)::BIGINT AS num_fetch_ok, sum((NOT is_ok)::INT)::BIGINT AS num_fetch_fail, sum(is_upd::INT)::BIGINT AS num_content_update, true AS accounted
  FROM f WHERE kind = 1 GROUP BY ALL)"""
_C = ["num_scheduled", "num_fetch_ok", "num_fetch_fail", "num_content_update"]
_DOMAIN = "CAST(regexp_extract(url, 'd([0-9]+)', 1) AS BIGINT)"
ROLLED = f"""{COUNTERS},
ev AS (SELECT url, event_date, 1::BIGINT AS num_scheduled, num_fetch_ok, num_fetch_fail, num_content_update, day(event_date) <> 5 AS accounted, CAST({_DOMAIN} % 4 AS INT) AS shard_id FROM counters),
cur AS (SELECT url, {", ".join(f"CAST(floor(sum({c}) * 2 / 3) AS BIGINT) AS {c}_90d" for c in _C)} FROM ev WHERE {_DOMAIN} % 7 <> 0 GROUP BY url),
picked AS (SELECT ev.*, CAST(floor((row_number() OVER (PARTITION BY shard_id ORDER BY event_date, url) - 1) / 100) AS BIGINT) AS batch_no, url NOT IN (SELECT url FROM cur) AS missing FROM ev WHERE accounted AND event_date <= DATE '2024-01-16'),
per AS (SELECT url, batch_no, {", ".join(f"sum({c})::BIGINT AS {c}" for c in _C)} FROM picked WHERE NOT missing GROUP BY ALL),
hist AS (SELECT per.url, batch_no, {", ".join(f"greatest(0, {c}_90d - sum({c}) OVER (PARTITION BY per.url ORDER BY batch_no))::BIGINT AS {c}_90d" for c in _C)} FROM per JOIN cur ON cur.url = per.url)"""
DELTAS = f"""{LOG},
deltas AS (SELECT day, shard_id, CASE WHEN seq % 97 = 0 THEN 'n/a' WHEN seq % 89 = 0 THEN '999999' ELSE domain_id::VARCHAR END AS domain_id,
  CASE WHEN status = 'ok' THEN 'num_fetch_ok' WHEN status = 'fail' THEN 'num_fetch_fail' WHEN seq % 50 = 1 THEN 'shard_error' ELSE 'new_links' END AS counter, fail_reason AS reason, count(*) AS n FROM fetch_log GROUP BY ALL)"""
COUNTER_NAMES = ["new_links", "num_scheduled", "num_fetch_ok", "num_fetch_fail", "num_content_update", "error_count", "offer_error", "route_error", "ingest_error", "stats_error", "extract_error"]
QUEUE = FRONTIER + ", q AS (SELECT domain_id, max(first_seen) AS enqueued_at, list(url ORDER BY url) FILTER (should_crawl) AS urls FROM frontier GROUP BY domain_id)"
FEATURES = f"WITH {LOG}, feat AS (SELECT seq, url, domain_id + seq % 2 * 1000 AS domain_id, ts AS fetched_at, seq % 977 AS content_length, content_hash, seq % 13 AS num_links FROM fetch_log WHERE status = 'ok')"


def _sums(counters: list[str]) -> str:
    return ", ".join(f"coalesce(sum(n) FILTER (counter = '{c}'), 0)::BIGINT AS {c}" for c in counters)


def _pick(cap: int, slots: int, where: str = "true") -> str:
    return f"""el AS (SELECT * FROM frontier WHERE should_crawl AND {where}), dom AS (SELECT domain_id FROM el GROUP BY domain_id ORDER BY min(shard_id), domain_id LIMIT {slots}),
picked AS (SELECT url, domain_id, rank FROM (SELECT el.*, CAST(row_number() OVER (PARTITION BY domain_id {OFFER}) AS INT) AS rank FROM el WHERE domain_id IN (SELECT domain_id FROM dom)) WHERE rank <= {cap})"""


def _seen_and_known() -> str:
    return f"""WITH {DOMAINS}, seen AS (SELECT domain, min(shard_id) AS new_shard FROM hd GROUP BY domain),
known AS (SELECT domain, min(seq) + 1 AS domain_id, CASE WHEN min(seq) % 3 = 0 THEN min(shard_id) ELSE 1 END AS shard_id FROM hd WHERE seq % 4 = 0 GROUP BY domain)"""


def all_oracles() -> dict[str, str]:
    split = ("tionsh.example.net", "blog.ththth.example.net", "m.ththth.example.net", "blog.ththan.example.net", "blog.tionsh.example.net")
    moving = ("tionsh.example.net", "blog.tionsh.example.net", "m.ththth.example.net")
    return {
        "shard_assign": f"WITH {RESULTS}, a AS (SELECT seq, host, {key('host')} AS shard_key FROM crawl_result), b AS (SELECT *, {shard('shard_key', 256, PINNED)} AS shard_id FROM a) SELECT *, CAST(shard_id // 16 AS INT) AS ingestor_id FROM b",
        "shard_assign_split": f"WITH {RESULTS}, a AS (SELECT seq, {key('host', split)} AS shard_key FROM crawl_result), b AS (SELECT *, {shard('shard_key', 100)} AS shard_id FROM a) SELECT *, CAST(shard_id // 10 AS INT) AS ingestor_id FROM b",
        "shard_distribution": f"WITH {RESULTS}, a AS (SELECT host, {key('host')} AS k FROM crawl_result), b AS (SELECT {shard('host')} AS new_shard, {shard('k', 256, PINNED)} AS shard_id FROM a) SELECT new_shard, count(*) AS urls, sum((new_shard <> shard_id)::INT)::BIGINT AS moving FROM b GROUP BY new_shard",
        "host_counts": f"WITH {DOMAINS}, a AS (SELECT coalesce(nullif(lower(regexp_extract(url, '{HTTP_HOST}', 1)), ''), '(null)') AS host, seq, shard_id FROM hd) SELECT host, count(*) AS urls, sum((seq % 3 <> 0)::INT)::BIGINT AS fetched, array_to_string(list(DISTINCT shard_id ORDER BY shard_id), ',') AS shards FROM a GROUP BY host",
        "extract_titles": f"WITH {RESULTS} SELECT seq, url, title FROM crawl_result",
        "page_overview": f"WITH {RESULTS}, {LINKS}, n AS (SELECT seq, count(*) AS n FROM links GROUP BY seq) SELECT seq, url, length(content)::BIGINT AS content_length, content_hash, coalesce(n, 0)::BIGINT AS num_links FROM crawl_result LEFT JOIN n USING (seq) WHERE status = 'ok'",
        "outlinks_exploded": f"WITH {RESULTS}, {LINKS} SELECT seq, position::INT AS position, url, {host('url')} AS host FROM links WHERE length(url) <= 2500",
        "route_new_links": f"WITH {RESULTS}, {LINKS}, l AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq, position) AS k FROM links WHERE length(url) <= 2500), h AS (SELECT url, {host('url')} AS host, page AS discovered_from FROM l WHERE k = 1 AND url NOT IN (SELECT url FROM pages)), s AS (SELECT *, {key('host')} AS sk FROM h) SELECT url, host, discovered_from, {shard('sk')} AS shard_id FROM s",
        "domain_registry": _seen_and_known() + ", fresh AS (SELECT domain, new_shard FROM seen WHERE domain NOT IN (SELECT domain FROM known)) SELECT (row_number() OVER (ORDER BY substr(md5(domain), 1, 3), domain) + coalesce((SELECT max(domain_id) FROM known), 0))::BIGINT AS domain_id, domain, new_shard AS shard_id, 0.0::DOUBLE AS domain_score, 'new' AS change FROM fresh UNION ALL SELECT domain_id, domain, CASE WHEN new_shard IS NOT NULL THEN new_shard ELSE shard_id END, 0.5::DOUBLE, CASE WHEN new_shard IS NOT NULL AND new_shard IS DISTINCT FROM shard_id THEN 'moved' ELSE 'same' END FROM known LEFT JOIN seen USING (domain)",
        "domain_overview": f"WITH {DOMAINS}, {LINKS}, n AS (SELECT seq, count(*) AS links FROM links WHERE length(url) <= 2500 GROUP BY seq) SELECT domain, shard_id, sum((status = 'ok')::INT)::BIGINT AS num_fetch_ok, sum(coalesce(links, 0))::BIGINT AS num_links FROM hd LEFT JOIN n USING (seq) GROUP BY domain, shard_id",
        "ingest_current": FOLDS + " SELECT * FROM f1_state",
        "stream_ingest": FOLDS + " SELECT * FROM f1_state",
        "stream_event_counters": f"WITH {COUNTERS} SELECT * FROM counters",
        "ingest_history": FOLDS + " SELECT * EXCLUDE (source) REPLACE (step::INT AS step) FROM f1",
        "ingest_snapshots": FOLDS + " SELECT CAST(domain_id % 16 AS INT) AS shard_id, (row_number() OVER (PARTITION BY domain_id % 16 ORDER BY batch_no, kind, seq) + CASE WHEN domain_id % 16 < 8 THEN 1000 * (domain_id % 16) ELSE 0 END)::BIGINT AS snapshot_id, url, seq FROM f1",
        "ingest_outcomes": FOLDS + " SELECT domain_id, sum(inserted::INT)::BIGINT AS new_links, sum(is_ok::INT)::BIGINT AS num_fetch_ok, sum((kind = 1 AND NOT is_ok)::INT)::BIGINT AS num_fetch_fail, sum(is_upd::INT)::BIGINT AS num_content_update FROM f1 GROUP BY domain_id",
        "event_counter_daily": f"WITH {COUNTERS} SELECT * FROM counters",
        "event_counter_merge": f"WITH {COUNTERS}, both_sides AS (SELECT url, event_date, num_scheduled, num_fetch_ok, num_fetch_fail, num_content_update, day(event_date) % 4 <> 0 AS accounted FROM counters WHERE event_date < DATE '2024-01-16' UNION ALL SELECT url, event_date, 1, 0, 0, 0, true FROM counters) SELECT url, event_date, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _C)}, bool_or(accounted) AS accounted FROM both_sides GROUP BY url, event_date",
        "content_feature_current": FEATURES + " SELECT url, arg_min(domain_id, seq) AS domain_id, arg_max(fetched_at, seq) AS fetched_at, arg_max(content_length, seq) AS content_length, arg_max_null(content_hash, seq) AS content_hash, arg_max(num_links, seq) AS num_links FROM feat GROUP BY url",
        "content_feature_history": FEATURES + " SELECT * FROM feat",
        "select_topk_by_domain": f"WITH {FRONTIER}, {_pick(3, 40)} SELECT * FROM picked",
        "select_with_exclusions": f"WITH {FRONTIER}, {_pick(2, 25, 'domain_id % 5 <> 0')} SELECT * FROM picked",
        "schedule_update": f"WITH {FRONTIER}, {_pick(3, 40)} SELECT f.url, f.domain_id, f.should_crawl AND p.url IS NULL AS should_crawl, CASE WHEN p.url IS NOT NULL THEN {NOW} ELSE f.last_scheduled END AS last_scheduled, (f.num_scheduled_90d + (p.url IS NOT NULL)::INT)::BIGINT AS num_scheduled_90d FROM frontier f LEFT JOIN picked p ON p.url = f.url",
        "queue_pop": f"WITH {QUEUE}, p AS (SELECT * FROM q WHERE domain_id NOT IN (3, 7, 11) ORDER BY enqueued_at, domain_id LIMIT 30) SELECT domain_id, unnest(range(0, len(urls)))::INT AS position, unnest(urls) AS url FROM p WHERE len(urls) > 0",
        "queue_upsert": f"WITH {QUEUE}, {_pick(2, 60)}, n AS (SELECT domain_id, {NOW} AS enqueued_at, list(url ORDER BY rank) AS urls FROM picked GROUP BY domain_id), u AS (SELECT * FROM q WHERE domain_id NOT IN (SELECT domain_id FROM n) UNION ALL SELECT * FROM n) SELECT domain_id, enqueued_at, coalesce(array_to_string(urls, ' '), '') AS urls FROM u",
        "refill_decision": f"WITH {QUEUE}, n AS (SELECT count(DISTINCT domain_id) AS queued FROM q), c(most, low, filled) AS (VALUES (200, 120, 1), (200, 500, 1), (100, 160, 1), (200, 120, 0)), z AS (SELECT queued * filled AS queued, most, low FROM c, n) SELECT queued, CASE WHEN queued >= low THEN 'noop' WHEN queued = 0 THEN 'refill_empty' ELSE 'refill' END AS action, CASE WHEN queued >= low THEN 0 ELSE greatest(0, most - queued) END::BIGINT AS slots, most, low FROM z",
        "rolloff_counters": f"WITH {ROLLED}, t AS (SELECT url, {', '.join(f'sum({c}) AS {c}' for c in _C)} FROM per GROUP BY url) SELECT cur.url, {', '.join(f'greatest(0, {c}_90d - coalesce({c}, 0))::BIGINT AS {c}_90d' for c in _C)} FROM cur LEFT JOIN t ON t.url = cur.url",
        "rolloff_history": f"WITH {ROLLED} SELECT * FROM hist",
        "rolloff_events": f"WITH {ROLLED} SELECT url, event_date, accounted AND NOT event_date <= DATE '2024-01-16' AS accounted FROM ev",
        "rolloff_report": f"WITH {ROLLED} SELECT count(*) AS picked_count, count(*) FILTER (NOT missing) AS processed_count, count(*) FILTER (missing) AS missing_count, count(*) AS marked_count, (SELECT count(*) FROM hist) AS history_count FROM picked",
        "rolloff_missing": f"WITH {ROLLED} SELECT url, event_date, batch_no FROM picked WHERE missing",
        "summary_daily": f"WITH {DELTAS} SELECT day, {_sums(COUNTER_NAMES)} FROM deltas WHERE counter <> 'shard_error' GROUP BY day",
        "domain_stats_daily": f"WITH {DELTAS} SELECT CAST(domain_id AS BIGINT) AS domain_id, CAST(CAST(domain_id AS BIGINT) % 256 AS INT) AS shard_id, day, {_sums(['num_fetch_ok', 'num_fetch_fail', 'new_links'])} FROM deltas WHERE TRY_CAST(domain_id AS BIGINT) < 150 AND counter <> 'shard_error' GROUP BY ALL",
        "unknown_domain_deadletter": f"WITH {DELTAS} SELECT domain_id, counter, sum(n)::BIGINT AS n FROM deltas WHERE TRY_CAST(domain_id AS BIGINT) IS NULL OR TRY_CAST(domain_id AS BIGINT) >= 150 GROUP BY ALL",
        "fail_reason_histogram": f"WITH {DELTAS} SELECT day, reason, sum(n)::BIGINT AS n FROM deltas WHERE reason IS NOT NULL GROUP BY ALL",
        "fail_reason_maps": f"WITH {DELTAS}, r AS (SELECT day, reason, sum(n)::BIGINT AS n FROM deltas WHERE reason IS NOT NULL GROUP BY ALL) SELECT day, string_agg(reason || '=' || n, ';' ORDER BY reason) AS fail_reasons FROM r GROUP BY day",
        "qps_per_worker": f"WITH {LINES} SELECT date_trunc('minute', ts) AS step_at, worker_id, count(*) / 60.0::DOUBLE AS rate FROM log_event WHERE event = 'request.end' GROUP BY ALL",
        "qps_sliding": f"WITH {LINES}, s AS (SELECT unnest([time_bucket(INTERVAL 30 SECONDS, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 30 SECONDS, ts, TIMESTAMP '2000-01-01') - INTERVAL 30 SECONDS]) AS step_at, worker_id FROM log_event WHERE event = 'request.end') SELECT step_at, worker_id, count(*) / 60.0::DOUBLE AS rate FROM s GROUP BY ALL",
        "qps_topk_domain": f"WITH {LINES}, r AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') AS step_at, domain, count(*) / 21600.0::DOUBLE AS rate FROM log_event WHERE event = 'request.end' GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY step_at ORDER BY rate DESC, domain) AS INT) AS rank FROM r) SELECT * FROM k WHERE rank <= 10",
        "success_rate": f"WITH {LINES}, g AS (SELECT date_trunc('hour', ts) AS step_at, sum((event = 'request.end' AND status < 400)::INT)::BIGINT AS good, sum((event = 'request.fail' AND NOT regexp_full_match(fail_reason, 'HttpError.*'))::INT)::BIGINT AS bad FROM log_event GROUP BY ALL) SELECT step_at, coalesce(good, 0) AS good, coalesce(good, 0) + coalesce(bad, 0) AS total, CASE WHEN coalesce(good, 0) + coalesce(bad, 0) > 0 THEN coalesce(good, 0)::DOUBLE / (coalesce(good, 0) + coalesce(bad, 0)) END AS success_rate FROM g",
        "latency_percentiles": f"WITH {LINES} SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2000-01-01') AS step_at, worker_id, round(quantile_cont(latency_ms::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(latency_ms::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(latency_ms::DOUBLE, 0.99), 6) AS p99 FROM log_event WHERE event = 'request.end' GROUP BY ALL",
        "heartbeat_avg": f"WITH {LINES} SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2000-01-01') AS step_at, worker_id, {', '.join(f'avg({g}) AS {g}' for g in ('inflight', 'pending', 'active_domains', 'transferring', 'slot_queue'))} FROM log_event WHERE event = 'spider.heartbeat' GROUP BY ALL",
        "gauge_running_max": f"WITH {LINES} SELECT seq, worker_id, {', '.join(f'max({g}) OVER (PARTITION BY worker_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS {g}_max' for g in ('inflight', 'pending', 'active_domains', 'transferring', 'slot_queue'))} FROM log_event WHERE event = 'spider.heartbeat'",
        "pending_per_domain": f"WITH {LINES} SELECT seq, domain, sum(CASE WHEN event = 'request.scheduled' THEN 1 ELSE -1 END) OVER (PARTITION BY domain ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS pending FROM log_event WHERE event <> 'spider.heartbeat'",
        "ingest_lag": f"WITH {LINES}, b AS (SELECT worker_id, max(time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '2000-01-01')) AS bucket FROM log_event GROUP BY worker_id) SELECT *, (epoch_us({NOW}) - epoch_us(bucket)) / 60e6::DOUBLE AS lag_minutes FROM b",
        "batch_errors_5m": f"WITH {LINES} SELECT time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '2000-01-01') AS step_at, worker_id, count(*) AS errors FROM log_event WHERE event = 'request.fail' GROUP BY ALL",
        "error_kinds": f"WITH {LINES} SELECT regexp_replace(regexp_replace(error, '(?s)\\n.*', ''), '[0-9]+', 'N', 'g') AS kind, count(*) AS total, sum((ts >= TIMESTAMP '2024-01-25 00:00:00')::INT)::BIGINT AS recent FROM log_event WHERE error IS NOT NULL GROUP BY kind",
        "error_tail": f"WITH {LINES} SELECT seq, ts, worker_id, error FROM log_event WHERE level IN ('WARNING', 'ERROR') AND ts >= {NOW} - INTERVAL 720 HOURS ORDER BY ts DESC, seq DESC LIMIT 100",
        "label_filter": f"WITH {LINES} SELECT seq, domain, fail_reason FROM log_event WHERE regexp_full_match(domain, 'd1.|d2') AND event = 'request.fail' AND NOT regexp_full_match(fail_reason, 'HttpError.*')",
        "time_buckets": f"WITH {LOG}, b AS (SELECT time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '2000-01-01') AS bucket FROM fetch_log) SELECT bucket, count(*) AS n, TIMESTAMP '2024-01-20 00:00:00' >= bucket + INTERVAL 20 MINUTES AS ready FROM b GROUP BY bucket",
        "golden_inject_plan": f"""WITH batches AS (SELECT id, TIMESTAMP '2023-12-01 00:00:00' + INTERVAL 7 DAYS * id AS created_at FROM range(10) t(id)), old AS (SELECT id FROM batches WHERE created_at <= {NOW} - INTERVAL 28 DAYS),
asked AS (SELECT id FROM range(50) t(id) WHERE id % 10 IN (SELECT id FROM old)), u AS (SELECT DISTINCT url, {host("url")} AS h FROM pages WHERE page_id % 50 IN (SELECT id FROM asked)), d AS (SELECT url, {registered("h")} AS domain FROM u),
a AS (SELECT *, CASE WHEN length(url) > 2500 OR domain IS NULL THEN 'failed' WHEN url IN (SELECT url FROM pages WHERE page_id % 3 = 0) THEN 'mark' ELSE 'inject' END AS action FROM d) SELECT url, domain, CASE WHEN action <> 'failed' THEN {shard("domain")} END AS shard_id, action FROM a""",
        "oversized_urls": "SELECT page_id, url FROM pages WHERE octet_length(encode(url)) > 45",
        "merge_subdomains": f"WITH {LOG}, r AS (SELECT url, seq % 3 AS copy, max(ts) AS last_fetch_ok, max(domain_id) AS domain_id FROM fetch_log GROUP BY ALL), k AS (SELECT *, max(copy) OVER (PARTITION BY url) AS top, row_number() OVER (PARTITION BY url ORDER BY copy = 0 DESC, domain_id ASC, last_fetch_ok ASC) AS n FROM r) SELECT url, domain_id, last_fetch_ok, top::INT AS source FROM k WHERE n = 1",
        "merge_event_rows": f"WITH {COUNTERS}, b AS (SELECT url, event_date, num_scheduled, num_fetch_ok, num_fetch_fail, num_content_update, day(event_date) % 3 = 0 AS accounted FROM counters UNION ALL SELECT url, event_date, num_scheduled, num_fetch_ok, num_fetch_fail, num_content_update, false FROM counters WHERE day(event_date) % 2 = 0) SELECT url, event_date, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _C)}, bool_or(accounted) AS accounted FROM b GROUP BY url, event_date",
        "newest_feature_rows": FEATURES + " SELECT url, fetched_at, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, content_hash ASC NULLS LAST) AS k FROM feat) WHERE k = 1",
        "shard_split_plan": f"WITH {RESULTS}, a AS (SELECT seq, url, {key('host')} AS k0, {key('host', moving)} AS k1 FROM crawl_result), b AS (SELECT seq, url, {shard('k0')} AS shard_id, {shard('k1')} AS new_shard FROM a) SELECT * FROM b WHERE shard_id <> new_shard",
        "unsplit_plan": f"WITH {DOMAINS}, a AS (SELECT seq, domain, shard_id, {registered('domain')} AS p FROM hd WHERE domain LIKE '%.example.net' AND domain <> 'example.net' AND domain <> 'www.example.net'), b AS (SELECT seq, domain, shard_id, {shard('p')} AS new_shard FROM a) SELECT * FROM b WHERE shard_id <> new_shard",
        "parent_reshard_plan": f"WITH {RESULTS}, a AS (SELECT seq, url, {key('host')} AS k FROM crawl_result), b AS (SELECT seq, url, {shard('k')} AS shard_id, {shard('k', 256, PINNED)} AS new_shard FROM a) SELECT * FROM b WHERE shard_id <> new_shard",
        "prefer_destination": f"WITH {FRONTIER} SELECT url, domain_id, CASE WHEN first_seen < {SPLIT} THEN num_scheduled_90d ELSE 0 END AS num_scheduled_90d FROM frontier",
        "snapshot_resync": f"WITH {LOG}, t AS (SELECT shard_id, max(seq) AS max_id FROM fetch_log GROUP BY shard_id), s AS (SELECT *, CASE WHEN shard_id % 2 = 0 THEN 10 ELSE 100000000 END::BIGINT AS last_value FROM t) SELECT * FROM s WHERE max_id > last_value",
        "url_link_edges": f"WITH {RESULTS}, {LINKS} SELECT page AS src_url, url AS dst_url, md5(anchor) AS anchor_hash, min(anchor) AS anchor_text, min(seq) AS first_seen, max(seq) AS last_seen FROM links GROUP BY page, url, md5(anchor)",
        "outlinks_rewritten": _seen_and_known() + f", {LINKS}, b AS (SELECT l.*, known.domain_id FROM (SELECT *, {host('url')} AS h FROM links) l LEFT JOIN known ON known.domain = l.h) SELECT seq, count(*) AS num_links, string_agg(url || '|' || coalesce(domain_id::VARCHAR, '-') || '|' || anchor, chr(10) ORDER BY position) AS outlinks FROM b GROUP BY seq",
        "qps_policy": f"WITH {RESULTS}, h AS (SELECT DISTINCT host FROM crawl_result) SELECT host, CASE WHEN starts_with(host, 'blog.') THEN 1.5 ELSE 5.0 END::DOUBLE AS delay, CASE WHEN starts_with(host, 'blog.') THEN 2 ELSE 4 END AS concurrency FROM h",
        "canonicalize_urls": """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[^/]*//[^/?#]*')) AS origin, regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^#?]*[?]([^#]*)', 1) AS query FROM pages)
  SELECT page_id, origin || CASE WHEN path = '' THEN '/' ELSE array_to_string(list_transform(string_split(path, '/'), lambda x: replace(url_encode(x), '%2C', ',')), '/') END || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS url FROM p""",
        "parse_pages": f"WITH {RESULTS}, {LINKS}, n AS (SELECT seq, count(*) AS n FROM links GROUP BY seq) SELECT url, title, coalesce(n, 0)::INT AS num_links FROM crawl_result LEFT JOIN n USING (seq)",
        "dns_names": f"WITH {RESULTS}, m AS (SELECT CASE WHEN seq % 10 = 0 THEN host || '_x' ELSE host END AS name FROM crawl_result), n AS (SELECT name FROM m UNION ALL SELECT regexp_extract(name, '^[^.]*') FROM m UNION ALL SELECT repeat(substr(name, 1, 1), 70) FROM m) SELECT regexp_full_match(name, '{DNS_NAME}') AS valid, count(*) AS n, count(DISTINCT name) AS names FROM n GROUP BY ALL",
        "fail_reasons": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'HttpError ' || (400 + user_id % 5) WHEN event_id % 7 = 2 THEN 'IgnoreRequest exceeded DOWNLOAD_MAXSIZE' WHEN event_id % 7 = 3 THEN 'IgnoreRequest Forbidden by robots.txt'
  WHEN event_id % 7 = 4 THEN 'TimeoutError' WHEN event_id % 5 NOT IN (0, 1) THEN 'NonHTML content-type' END AS fail_reason FROM events""",
        "page_types": "SELECT CASE event_id % 5 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'application/xhtml+xml' WHEN 2 THEN 'image/png' WHEN 3 THEN '' END AS content_type, count(*) AS n, event_id % 5 IN (0, 1) AS is_page FROM events GROUP BY event_id % 5",
    }
