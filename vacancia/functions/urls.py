"""URL canonicalisation and trust, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track where a visitor came from.
TRACKING_KEYS = ("fbclid", "gclid", "ref", "source")
TRACKING_PREFIX = "utm_"

_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, k)


def path_of(url: Column) -> Column:
    return part(url, 5)


def query_pairs(url: Column) -> Column:
    return F.filter(F.split(part(url, 6), "&"), lambda p: p != "")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, tracking key or final slash, keys in order; null without a host."""
    scheme, host, port = F.lower(part(url, 1)), F.lower(part(url, 3)), part(url, 4)
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(query_pairs(url), lambda p: ~key(p).isin(*TRACKING_KEYS) & ~F.startswith(key(p), F.lit(TRACKING_PREFIX)))
    pairs = F.array_sort(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))
    shown = F.when((port == "") | (scheme == "https") & (port == "443") | (scheme == "http") & (port == "80"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(part(url, 5), "/+$", "")
    query = F.array_join(pairs, "&")
    built = F.concat(scheme, F.lit("://"), host, shown, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host != "", built)


def trusted(url: Column, hosts: tuple[str, ...]) -> Column:
    """https, a listed host, no user, no port but 443, no control or space characters."""
    clean = F.coalesce(url, F.lit("")).rlike(r"^[^\x00-\x20\x7F]+$")
    return F.coalesce(clean & (F.lower(part(url, 1)) == "https") & F.lower(part(url, 3)).isin(*hosts) & ~F.rlike(url, F.lit(r"^[^/]*//[^/?#]*@")) & part(url, 4).isin("", "443"), F.lit(False))


def trusted_listing(source: Column, url: Column, hosts: Mapping[str, tuple[str, ...]]) -> Column:
    """Sources with listed hosts must link to one of them by https; others always pass."""
    ok = ~source.isin(*hosts)
    low = F.lower(url)
    for name, allowed in hosts.items():
        for host in allowed:
            ok = ok | (source == name) & (low.startswith(f"https://{host}/") | low.startswith(f"https://{host}:443/"))
    return ok


def with_parameter(url: Column, key: str, value: str) -> Column:
    """The URL with one query parameter replaced, or added last."""
    others = F.filter(query_pairs(url), lambda p: F.substring_index(p, "=", 1) != key)
    query = F.array_join(F.array_append(others, F.lit(f"{key}={value}")), "&")
    return F.concat(F.regexp_extract(F.trim(url), r"^[^?#]*", 0), F.lit("?"), query)


def path_id(url: Column, pattern: str = r"/(\d+)(?:[/?#]|$)") -> Column:
    """An identifier out of a URL's path; a hash of the URL where there is none."""
    found = F.regexp_extract(url, pattern, 1)
    return F.when(found != "", found).otherwise(F.sha2(url, 256))


def _encoded(pairs: Column) -> Column:
    """Query pairs with a value each, as forms send them."""
    coded = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
    return F.array_join(F.transform(pairs, lambda p: F.concat(coded(F.substring_index(p, "=", 1)), F.lit("="), coded(F.regexp_extract(p, r"=(.*)$", 1)))), "&")


# Paths of searches that a feed stands for.
FEED_PATHS, UNFILTERED_PATHS, FEED_PATH = ("/jobs/", "/jobs/remote/", "/jobs/rss/"), ("/jobs/l-nonhr/", "/jobs/l-nonhr/remote/"), "/jobs/rss/"


def feed_url(url: Column, hosts: tuple[str, ...], remote_only: bool) -> Column:
    """The feed of a search: no page number, remote work where asked for or in the path; null for other hosts and paths."""
    path = path_of(url)
    key = lambda p: F.substring_index(p, "=", 1)
    pairs = F.filter(query_pairs(url), lambda p: key(p) != "page")
    named = F.exists(pairs, lambda p: key(p) == "editorial")
    pairs = F.when(path.isin(*UNFILTERED_PATHS) & ~named, F.array_append(pairs, F.lit("editorial=nonhr"))).otherwise(pairs)
    forced = F.array_append(F.filter(pairs, lambda p: key(p) != "employment"), F.lit("employment=remote"))
    query = _encoded(F.when(F.lit(remote_only) | F.endswith(path, F.lit("/remote/")), forced).otherwise(pairs))
    built = F.concat(F.regexp_extract(F.trim(url), r"^[^:]+://[^/?#]*", 0), F.lit(FEED_PATH), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(trusted(url, hosts) & path.isin(*FEED_PATHS, *UNFILTERED_PATHS), built)


def page_url(url: Column, page: Column, in_path: bool = False) -> Column:
    """The URL of a page of a search, by a parameter or by the path's end; the first page is the search itself."""
    query = F.regexp_extract(F.trim(url), r"\?[^#]*", 0)
    if in_path:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.trim(url), r"^[^?#]*", 0), "/+$", ""), r"/params;page=\d+$", "")
        other = F.concat(bare, F.lit("/params;page="), page.cast("string"), query)
    else:
        pairs = F.filter(query_pairs(url), lambda p: F.substring_index(p, "=", 1) != "page")
        other = F.concat(F.regexp_extract(F.trim(url), r"^[^?#]*", 0), F.lit("?"), _encoded(F.array_append(pairs, F.concat(F.lit("page="), page.cast("string")))))
    return F.when(page <= 1, url).otherwise(other)


def reader_url(base: str, url: Column, hosts: tuple[str, ...]) -> Column:
    """A URL's path and query at a reader; null for other hosts."""
    path, query = F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/")), F.regexp_extract(F.trim(url), r"\?[^#]+", 0)
    return F.when(F.lower(part(url, 3)).isin(*hosts), F.concat(F.lit(base), path, query))


def vacancy_url(url: Column, host: str) -> Column:
    """A vacancy's address on its main host, without query and final slashes."""
    return F.concat(F.lit(f"https://{host}"), F.regexp_replace(path_of(url), "/+$", ""))


# Filters of a feed that may be shown, and the most values of each.
LEVELS = ("no_exp", *(f"{years}y" for years in range(1, 11)))
MOST_VALUES = 4


def feed_identity(url: Column, english: tuple[str, ...]) -> Column:
    """struct(feed_id, filters): a hash of the URL, and the filters' values, those not listed redacted and categories hashed."""
    shown = {"exp_level": LEVELS, "english_level": english, "employment": ("remote", "office"), "editorial": ("nonhr",)}
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731 - what is named in a function is computed once, not wherever it stands

    def safe(p: Column) -> Column:
        key, value = p["key"], p["value"]
        kept = F.when(key == "primary_keyword", F.concat(F.lit("sha256:"), F.substring(F.sha2(value, 256), 1, 16))).when(key == "country", F.when(F.rlike(value, F.lit("^[A-Z]{3}$")), value).otherwise("redacted"))
        for name, allowed in shown.items():
            kept = kept.when(key == name, F.when(value.isin(*allowed), value).otherwise("redacted"))
        return F.struct(key.alias("key"), F.when(value != "", kept).alias("value"))

    named = F.transform(query_pairs(url), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), decoded(F.regexp_extract(p, r"=(.*)$", 1)).alias("value")))
    shown_pairs = F.filter(F.transform(named, safe), lambda p: p["value"].isNotNull())

    def filters(pairs: Column) -> Column:
        values = lambda k: F.slice(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]), 1, MOST_VALUES)
        return once(F.array_distinct(F.transform(pairs, lambda p: p["key"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, values)))

    return F.struct(F.substring(F.sha2(url, 256), 1, 16).alias("feed_id"), once(shown_pairs, filters).alias("filters"))
