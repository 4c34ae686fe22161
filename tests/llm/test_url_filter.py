"""URL rules and lists against plain Python."""

import re
from itertools import product

from causeway.llm import _bloom, queries, url_filter

URLS = [
    None, "", "no scheme", "http://", "http://NET", "https://a.Net/x", "https://example.net/en/a?b#c", "https://www.example.net/en", "ftp://sub.example.net/en/",
    "http://example.com/de/1", "http://example.com/DE/1", "http://notexample.com/de/", "http://x.org/fr/", "http://org/fr/", "http://x.org?/fr/", "a://b://net/", "http://spam.site/a/index.html",
    "http://www.spam.site/a/", "http://m.spam.site/a", "http://spam.site/A", "http://spam.site\n/a", "http://é.net/", "http://x.org/fr/" + "a/" * 100_000, "http://" + "h" * 200_000 + ".net", "http://spam.site/a" + "/" * 10_000,
]


def plain(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
    hit = bool(url and "://" in url) and re.sub(r"^(www|m)\.", "", host) + re.sub(r"(/|/index\.html?|\.html?)+$", "", path) in listed
    return host, path, rule, hit, verdict or ("block" if hit else "allow")


def frames(spark, listed):
    pages = spark.createDataFrame([(k, u, "x", True) for k, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, listed boolean")
    return pages, spark.createDataFrame([(x, 1) for x in listed], "entry string, page_id int")


def judged(pages, entries):
    return {(r.page_id, r.host, r.path, r.rule, r.listed, r.verdict) for r in url_filter.filter_urls(pages, queries.URL_RULES, entries, "entry").collect()}


def test_against_plain_rules_and_lists(spark):
    for listed in (["spam.site/a", "spam.site/a", None, "x.org/fr"], []):
        pages, entries = frames(spark, listed)
        want = {(k, *plain(u, set(listed))) for k, u in enumerate(URLS + URLS[:3])}
        assert judged(pages, entries) == want
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES, entries, "entry").count() == 0


def test_closings_are_trimmed_as_the_pattern_would(spark):
    parts = ["/", "/index.html", "/index.htm", ".html", ".htm", "/index", "l", "a", "/index.htmlx", "\x01", "."]
    paths = ["".join(p) for n in range(5) for p in product(parts, repeat=n)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.short for r in df.withColumn("short", url_filter.without_closing(df.p)).collect()}
    assert all(got[p] == re.sub(r"(/|/index\.html?|\.html?)+$", "", p) for p in paths)


def test_false_hits_of_the_filter_are_removed(spark, monkeypatch):
    """A filter of one block that is full passes every URL; the join alone decides."""
    every = spark.range(2000).selectExpr("concat('k', id) key")
    entries = spark.range(0, 2000, 2).selectExpr("concat('k', id) entry")
    marked = _bloom.mark(every, "key", _bloom.build(entries, "entry", 1), 1, "maybe")
    assert marked.where("maybe").count() == 2000
    out = url_filter.mark_listed(every, "key", entries, "entry", blocks=1)
    assert {r.key for r in out.where("listed").collect()} == {f"k{k}" for k in range(0, 2000, 2)} and out.count() == 2000
