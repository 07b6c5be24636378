"""Queries against their SQL on tables with what the smallest ones do not have."""

import shutil
from pathlib import Path

import duckdb
import pytest

from weblattice.functions import html as H
from weblattice.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TITLES = ["A&amp;B &amp", "x &quot;y&quot", "1 &am", "2 &copy;&middot", "& &amp;quot; &ampx;"]


@pytest.fixture(scope="module")
def larger(sf_dir, tmp_path_factory):
    """A folder of tables whose pages have cut titles and come twice, the second time with another id; one has no URL. Events are of 1,500 users, so that domains and their copies share numbers."""
    out, con = tmp_path_factory.mktemp("larger"), duckdb.connect()
    for path in Path(sf_dir).iterdir():
        shutil.copyfile(path, out / path.name)
    cut = f"CASE WHEN page_id % 4 = 0 THEN '<title> ' || ({TITLES!r})[page_id // 4 % {len(TITLES)} + 1] || ' </title>' || html ELSE html END"
    twice = "unnest([page_id, page_id + 300])"  # of 50 queries and of every third page, both have the same
    con.execute(f"COPY (SELECT {twice} AS page_id, url, {cut} AS html FROM '{sf_dir}/pages.parquet' UNION ALL SELECT 1001, NULL, '<title>x</title>') TO '{out}/pages.parquet'")
    user = "user_id + 150 * (event_id % 10) AS user_id"
    con.execute(f"COPY (SELECT * REPLACE ({user}, event_id + 1000 * k AS event_id) FROM '{sf_dir}/events.parquet', range(3) r(k) WHERE k <= event_id % 3) TO '{out}/events.parquet'")
    return out


@pytest.fixture(scope="module")
def equal(spark, larger):
    """Compare a query with its SQL on these tables, as sets of rows with columns by name."""
    con = duckdb.connect()
    for path in larger.iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def check(name):
        frame, found = QUERIES[name](spark, str(larger)), con.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(frame.columns)
        theirs = sorted(tuple(repr(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
        assert sorted(tuple(repr(r[c]) for c in sorted(names)) for r in frame.collect()) == theirs

    return check


def test_titles_with_cut_references(equal):
    equal("extract_titles")


def test_pages_with_cut_references(equal):
    equal("parse_pages")


def test_references_in_links():
    page = '<title>a&amp</title><a href="/x?a=1&copy=2&amp;b=3">1 &lt 2 &lt; 3<script>x&&y&amp;</script></a>&#' + "9" * 5000 + ";"
    assert H.parse_page("http://h.net/", page) == ("a&amp", [("http://h.net/x?a=1&b=3&copy=2", "1 &lt 2 < 3x&&y&amp;")])


def test_golden_set_marks_repeated_urls_once(equal):
    equal("golden_applied")


def test_golden_plan_has_every_url_once(equal):
    equal("golden_inject_plan")


@pytest.mark.parametrize("name", ["move_events", "split_history", "move_counts", "move_history", "split_events", "move_current", "move_domains"])
def test_moves_of_many_domains(equal, name):
    equal(name)
