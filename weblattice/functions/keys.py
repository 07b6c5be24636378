"""Hosts, registered domains and shards, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of host in a URL (general, and http only), and of a strict DNS name.
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^/?#:@\[]*))"
HTTP_HOST = r"^https?://([^/:]+)"
DNS_NAME = r"^[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?)*$"
MAX_URL = 2500
#: Public suffixes known without a network; any other ending has no registered domain.
SUFFIXES = "com net org edu gov mil int info biz io ai dev app de fr es it nl uk us jp cn tw hk kr in au ca br ru eu ch at be se no dk fi pl cz pt gr tr mx za nz".split()
LONG_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp ac.jp com.cn net.cn org.cn gov.cn com.tw org.tw edu.tw gov.tw com.hk co.kr or.kr co.in com.br com.mx co.za co.nz com.tr".split()


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port or brackets; empty where there is none."""
    return F.lower(F.concat(F.regexp_extract(url, HOST, 1), F.regexp_extract(url, HOST, 2)))


def http_host(url: Column) -> Column:
    """Host as a plain http(s) pattern sees it; null where it does not fit."""
    return F.nullif(F.lower(F.regexp_extract(url, HTTP_HOST, 1)), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written, and evaluated, once: keeps nested expressions small enough to be compiled."""
    return F.transform(F.array(value), body)[0]


def registered_domain(host: Column) -> Column:
    """The label before the longest known suffix, with the suffix; null where no suffix fits or nothing stands before it."""
    return _let(F.split(host, r"\."), _registered)


def _registered(labels: Column) -> Column:
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    long = (n >= 2) & tail(2).isin(LONG_SUFFIXES)
    return F.when((n >= 3) & tail(2).isin(LONG_SUFFIXES), tail(3)).when((n >= 2) & ~long & F.element_at(labels, -1).isin(SUFFIXES), tail(2))


def shard_key(host: Column, split_hosts: Iterable[str] = ()) -> Column:
    """The split host itself, else the registered domain, else the host; ``unknown`` for no host."""
    split = sorted(split_hosts)
    own = host.isin(split) if split else F.lit(False)
    return F.when(F.coalesce(host, F.lit("")) == "", "unknown").when(own, host).otherwise(F.coalesce(registered_domain(host), host))


def md5_mod(key: Column, shards: int) -> Column:
    """The MD5 of a key, as a big number, modulo ``shards``: Horner's rule over its four 32-bit words.

    Where 2**32 is a multiple of ``shards`` the last word alone decides.
    """
    word = lambda digest, k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    digest = F.md5(key.cast("binary"))
    if (1 << 32) % shards == 0:
        return (word(digest, 3) % shards).cast("int")

    def horner(text: Column) -> Column:
        total = word(text, 0) % shards
        for k in range(1, 4):
            total = (total * ((1 << 32) % shards) + word(text, k)) % shards
        return total

    return _let(digest, horner).cast("int")


def shard_of(key: Column, shards: int = 256, pinned: Mapping[str, int] | None = None) -> Column:
    """The pinned shard of a key, or the one its MD5 gives."""
    plain = md5_mod(key, shards)
    if not pinned:
        return plain
    table = F.create_map(*[F.lit(x) for pair in sorted(pinned.items()) for x in pair])
    return F.coalesce(F.element_at(table, key).cast("int"), plain)


def ingestor_of(shard: Column, per_ingestor: int = 16) -> Column:
    return F.floor(shard / per_ingestor).cast("int")


def fits_url_cap(url: Column, most: int = MAX_URL) -> Column:
    return url.isNotNull() & (F.length(url) <= most)


def time_bucket(ts: Column, minutes: int = 10) -> Column:
    """Start of the interval of an hour that holds ``ts``."""
    return F.window(ts, f"{minutes} minutes")["start"]


def bucket_ready(start: Column, now: Column, minutes: int = 10) -> Column:
    return now >= start + F.expr(f"INTERVAL {2 * minutes} MINUTES")
