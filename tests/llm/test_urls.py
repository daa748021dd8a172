import random

import pytest

from shelfmark.llm.url_cascade import build_cascade, judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.b.org", "", "block"),
         ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         (None, "/", "block"), ("COM", "/de/", "allow"), ("b.exam", "ple.net/", "block"),
         ("example.net", "/", "allow"), ("example.net/x", "/y", "block")]
URLS = ["http://example.org/es/1", "http://x.EXAMPLE.org/es/?q", "https://org/", "https://org",
        "http://notexample.com/de/x", "http://notexample.com/fr/x", "ftp://a.com:80/de/", None, "",
        "no scheme org/", "http://", "http://?a://b.org/", "http://a.b.org", "x://a.b.org/y/#/z",
        "http://example.org/EN/1", "http://example.org/en/12", "http://" + "w." * 5000 + "org/a",
        "http://org/" + "p" * 100_000, "http://example.org/es/1", "http://b.example.net/",
        "http://example.net/x/y", "http://b.exam/ple.net/"]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = {}
    for rule_host, rule_path, verdict in RULES:
        rule_host = (rule_host or "").lower()
        if rule_host and host and (host == rule_host or host.endswith("." + rule_host)) \
                and path.startswith(rule_path):
            block = fits.get(rule_host + rule_path, (0, 0, ""))[2] == "block"
            fits[rule_host + rule_path] = (len(rule_host + rule_path), len(rule_host),
                                           "block" if block else verdict)
    if not fits:
        return host, path, None, "allow"
    rule = max(fits, key=lambda r: fits[r])
    return host, path, rule, fits[rule][2]


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_verdicts(spark, room):
    pages = spark.createDataFrame(
        [(i, u, "h", "p", "r") for i, u in enumerate(URLS)],
        "page_id long, url string, host string, path string, rule string")
    rules = spark.createDataFrame([(*r, 5) for r in RULES],
                                  "host string, path string, verdict string, key int")
    got = {r[0]: tuple(r)[1:] for r in judge_urls(pages, rules, max_filter_bytes=room).collect()}
    assert got == {i: expected(u) for i, u in enumerate(URLS)}
    assert judge_urls(pages.limit(0), rules, max_filter_bytes=room).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(4)
    keys = sorted({f"k{rng.randrange(100_000)}" for _ in range(4000)})
    listed = set(rng.sample(keys, 300))
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = build_cascade(universe.filter(universe.key.isin(list(listed))), universe)
    assert len(cascade.levels) > 1
    found = {r[0] for r in universe.filter(cascade.member(universe.key)).collect()}
    assert found == listed
