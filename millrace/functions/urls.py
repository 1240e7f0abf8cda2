"""URL expressions. Parts come from the RFC 3986 appendix-B pattern, which accepts anything
and keeps ports; query fields are split, filtered and joined without re-encoding."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import vocab as V
from millrace.functions.text import has_any, is_noise_title, let, matches, one_of, or_empty, strip

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: Column, index: int) -> Column:
    return F.regexp_extract(strip(or_empty(url)), PARTS, index)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Lower-case authority (with port)."""
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def looks_like_url(url: Column) -> Column:
    return matches(strip(or_empty(url)), r"(?i)^https?://")


def _fields(url: Column) -> Column:
    return F.filter(F.split(query(url), "&"), lambda f: f != "")


def _name(field: Column) -> Column:
    return F.lower(F.substring_index(field, "=", 1))


def _joined(url: Column, fields: Column, tail: Column) -> Column:
    base = F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit("://"))).otherwise(""), host(url), F.regexp_replace(path(url), "/+$", ""))
    asked = F.array_join(fields, "&")
    whole = F.concat(base, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""), tail)
    return F.when(strip(or_empty(url)) == "", "").otherwise(whole)


def dedupe_url(url: Column) -> Column:
    """Without fragment, trailing slashes and tracking fields."""
    return _joined(url, F.filter(_fields(url), lambda f: ~one_of(_name(f), V.TRACKING_KEYS)), F.lit(""))


def identity_url(url: Column) -> Column:
    """Only what names one posting: host, path, identity fields, a job fragment."""
    job = F.lower(F.regexp_extract(fragment(url), V.JOB_FRAGMENT, 1))
    tail = F.when(job != "", F.concat(F.lit("#/job/"), job)).otherwise("")
    return _joined(url, F.filter(_fields(url), lambda f: one_of(_name(f), V.IDENTITY_KEYS)), tail)


def synthetic_url(list_url: Column, title: Column, *parts: Column, most: int = 240) -> Column:
    """Stable stand-in for a posting without a page of its own: its list's link with the
    title and further parts, ``most`` characters of them, as one more field."""
    named = F.array_join(F.filter(F.array(*[strip(or_empty(p)) for p in (title, *parts)]), lambda p: p != ""), " | ")
    own = F.concat(F.lit("__job="), F.url_encode(F.left(named, F.lit(most))))
    kept = F.filter(_fields(list_url), lambda f: F.substring_index(f, "=", 1) != "__job")
    base = F.regexp_replace(strip(or_empty(list_url)), r"[?#].*$", "")
    return F.concat(base, F.lit("?"), F.array_join(F.array_append(kept, own), "&"))


def is_trusted(url: Column) -> Column:
    return looks_like_url(url) & has_any(host(url), V.TRUSTED_HOSTS)


def is_campus_url(url: Column) -> Column:
    return looks_like_url(url) & (is_trusted(url) | has_any(F.lower(url), V.CAMPUS_PATHS))


def is_nav_url(url: Column, text: Column | None = None) -> Column:
    noise = matches(or_empty(url), V.NAV_URL)
    return noise if text is None else noise | ((strip(or_empty(text)) != "") & is_noise_title(text))


def is_detail_link(url: Column, text: Column | None = None) -> Column:
    """A posting's page, judged by URL or, off portal roots, by the link's text."""
    by_url = matches(or_empty(url), V.DETAIL_URL)
    if text is None:
        return ~is_nav_url(url) & by_url
    root = matches(F.lower(or_empty(url)), r"/(campus|career|careers|recruit|school|joinus)/*$")
    by_text = matches(strip(text), V.DETAIL_TEXT) & ~is_noise_title(text) & ~root
    return ~is_nav_url(url, text) & (by_url | by_text)


def is_detail_url(url: Column) -> Column:
    """A posting's page by URL alone."""
    tail = F.when(F.contains(fragment(url), F.lit("?")), F.split(F.substring_index(fragment(url), "?", -1), "&")).otherwise(F.array().cast("array<string>"))
    named = F.exists(F.concat(_fields(url), tail), lambda f: one_of(_name(f), V.DETAIL_KEYS) & F.rlike(f, F.lit("=.")))
    routed = matches(F.lower(F.concat(path(url), F.lit("#"), F.substring_index(fragment(url), "?", 1))), r"#/(?:job|position)/[^/?#]+")
    hit = named | routed | matches(path(url), V.DETAIL_PATH) | matches(url, V.DETAIL_URL_STRICT)
    return looks_like_url(url) & ~F.contains(F.lower(url), F.lit("__job=")) & ~is_nav_url(url) & hit


def is_listing_url(url: Column) -> Column:
    """A list or portal page without one posting's identity."""
    low_path = F.regexp_replace(F.lower(path(url)), "/+$", "")
    low_fragment = F.regexp_replace(F.substring_index(F.lower(fragment(url)), "?", 1), "/+$", "")
    ends = reduce(or_, [F.endswith(low_path, F.lit(e)) for e in V.LISTING_ENDS])
    return looks_like_url(url) & ~is_detail_url(url) & (ends | one_of(low_fragment, V.LISTING_FRAGMENTS) | has_any(F.lower(url), V.LISTING_MARKS))


def adapter(url: Column) -> Column:
    """Which parser a page belongs to, by host."""
    chain = F.when(F.lit(False), "")
    for name, hosts in V.ADAPTER_HOSTS:
        chain = chain.when(reduce(or_, [F.contains(host(url), F.lit(h)) for h in hosts]), name)
    return chain.otherwise("generic")


def apply_score(url: Column) -> Column:
    """Rank of a URL as the place to apply at."""
    low = F.lower(or_empty(url))
    points = lambda test, n: F.when(test, n).otherwise(0)
    return points(is_trusted(url), 100) + points(has_any(low, V.DETAIL_MARKS), 50) + points(is_campus_url(url), 20) - points(F.contains(low, F.lit("mp.weixin.qq.com")), 30) - points(is_nav_url(url), 80)


def preferred(urls: Column, limit: int = 8) -> Column:
    """The best distinct URLs of an array; equal scores keep their order."""
    kept = F.array_distinct(F.filter(F.transform(urls, lambda u: strip(or_empty(u))), lambda u: u != ""))

    def ranked(found: Column) -> Column:
        scored = F.array_sort(F.transform(found, lambda u, i: F.struct((-apply_score(u)).alias("s"), i.alias("i"), u.alias("u"))))
        return F.transform(scored, lambda x: x["u"])

    best = let(kept, lambda found: F.when(F.size(found) > 1, ranked(found)).otherwise(found))  # one needs no score
    return F.slice(best, F.lit(1), F.lit(limit))


def parse_urls(raw: Column) -> Column:
    """URLs of a JSON list, or of a bare URL; anything else is an empty list."""
    listed = F.from_json(raw, "array<string>")
    bare = F.when(looks_like_url(raw), F.array(strip(raw))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.filter(F.transform(listed, strip), looks_like_url), bare)
