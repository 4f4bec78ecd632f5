import random
import re

from gridcube.llm import url_filters
from gridcube.llm.queries import URL_RULES
from tests.llm.helpers import groups_of

RULES = "host string, path string, verdict string"
PAGES = "page_id bigint, url string, html string"


def canonical(url):
    return f'<html><head><link rel="canonical" href="{url}"></head></html>'


def judged(spark, pages, rules=URL_RULES, redirects=None):
    found = url_filters.judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, RULES),
                                   redirects=redirects and spark.createDataFrame(redirects, "src string, dst string"))
    return {r.page_id: tuple(r.url_filter) for r in found.collect()}


def rule_of(host, path, rules):
    fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_longest_rule_decides(spark):
    urls = ["http://A.Example.com/en/1", "https://www.example.com/en/", "https://x.www.example.com/en/q?z", "http://example.com/de/1",
            "http://www.example.com/en", "http://badexample.com/en/1", "ftp://x.net/es/#f", "http://net/fr/", "http://x.net/Fr/", "x.net/es/",
            None, "", "http://x.net", "http://x.net?a=/es/", "://x.net/es/1", "a://b://net/es/", "http://user@x.net:80/es/", "http:///es/"]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)])
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        rule, verdict = rule_of(host, path, URL_RULES)
        assert got[i] == (host, path, rule, verdict or "allow"), u


def test_blocks_reach_aliases_and_allow_stays(spark):
    pages = [(1, "https://free.org/a", canonical("http://m.example.com/en/7")),      # its target is blocked, and no page
             (2, "http://free.org/b#top", canonical("https://free.org/a")),           # two steps away
             (3, "http://www.example.com/en/9", canonical("http://free.org/b")),      # allowed by rule
             (4, "http://other.org/c", canonical("http://www.example.com/en/9")),     # linked through the allowed one
             (5, "http://other.org/d", canonical("http://other.org/e")),              # a group without a block
             (6, "http://FREE.org/a", None),                                          # the same URL but for scheme and case
             (7, "http://free.org/a?x=1", None), (8, "http://gone.org/1", None), (9, "http://gone.org/2", "")]
    got = judged(spark, pages, redirects=[("http://gone.org/1", "http://gone.org/2"), ("http://gone.org/2", "http://x.net/fr/"), (None, "http://a.b/")])
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "block", 7: "allow",
                                                 8: "block", 9: "block"}
    assert got[1][2] is None and got[3][2] == "www.example.com/en/"


def test_random_graphs_equal_brute_force(spark):
    rng = random.Random(8)
    rules = [("a.org", "/", "block"), ("b.a.org", "/x", "allow"), ("c.org", "/x", "block"), ("c.org", "/xy", "allow"), ("c.org", "/xy", "block")]
    urls = [f"http://{h}/{p}{k}" for h in ("a.org", "b.a.org", "c.org", "d.org", "e.org") for p in ("x", "xy", "z") for k in range(6)]
    edges = [tuple(rng.sample(urls, 2)) for _ in range(60)]
    pages = [(i, u, canonical(v)) for i, (u, v) in enumerate(edges[:30])] + [(100 + i, u, None) for i, u in enumerate(urls)]
    got = judged(spark, pages, rules, redirects=edges[30:])
    low = groups_of(edges, urls)
    own = {u: rule_of(*re.match(r"http://([^/]*)(.*)", u).groups(), rules)[1] for u in urls}
    blocked = {low[u] for u in urls if own[u] == "block"}
    for i, u, _ in pages:
        assert got[i][3] == (own[u] or ("block" if low[u] in blocked else "allow")), u


def test_links_of_pages(spark):
    at = "https://h.org/dir/page?q=1#f"
    cases = {
        '<link rel="canonical" href="/a?b=1&amp;c=2">': "https://h.org/a?b=1&c=2", "<LINK HREF='//o.org/x' REL='shortlink Canonical'/>": "https://o.org/x",
        "<link rel=canonical href=sub/x.html>": "https://h.org/dir/sub/x.html", '<link rel="canonical" href="?z">': "https://h.org/dir/page?z",
        '<link rel="canonical" href="../up/./x/..">': "https://h.org/up/", '<link rel="canonical" href="/../../x">': "https://h.org/x",
        '<meta http-equiv="Refresh" content="0; URL=\'http://n.org/\'">': "http://n.org/", '<meta http-equiv=refresh content="5">': None,
        '<link rel="canonical" href="mailto:x@y.z">': None, '<link rel="canonical" href="#top">': None, '<link rel="canonical" href="">': None,
        '<link rel="stylesheet" href="http://n.org/s.css"> canonical': None, '<!-- <link rel="canonical" href="/c"> -->': None,
        '<script>"<link rel=\'canonical\' href=\'/c\'>"</script>': None, '<link rel="canonical" href=" /sp ">': "https://h.org/sp",
        '<link rel="canonical"': None, "plain text about canonical links": None}
    pages = spark.createDataFrame([(i, at, html * (1 if i else 1)) for i, html in enumerate(cases)], PAGES)
    for html, want in cases.items():
        got = [r.dst for r in url_filters.page_links(pages.where(pages.html == html)).collect()]
        assert got == ([] if want is None else [want]), html
    far = canonical("http://n.org/far").replace("<link", " " * 300_000 + "<link")
    assert url_filters.page_links(spark.createDataFrame([(1, at, "x" * 300_000 + far)], PAGES)).count() == 1


def test_awkward_tables(spark):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame([(1, "http://x.net/es/", None), (1, "http://x.net/es/", None), (None, None, None)], PAGES)
    clash = pages.withColumns({c: F.lit("own") for c in ("host", "path", "rule", "verdict", "h", "p", "name", "alias", "url_filter")})
    rules = spark.createDataFrame([("NET", "/es/", "block"), (None, None, "allow"), ("net", "/es/", "maybe")], RULES)
    got = url_filters.judge_urls(clash, rules)
    assert got.columns == [c for c in clash.columns if c != "url_filter"] + ["url_filter"]
    assert sorted(tuple(r.url_filter) for r in got.collect()) == [("", "", "", "allow")] + [("x.net", "/es/", "net/es/", "block")] * 2
    assert {r.host for r in got.collect()} == {"own"}
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {tuple(r.url_filter)[2:] for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {(None, "allow")}
    dots = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "net/es/" + "p" * 100_000, None)], PAGES)
    assert url_filters.judge_urls(dots, rules).first().url_filter.verdict == "block"
