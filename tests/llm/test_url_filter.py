import re

from flowlab.llm.queries import URL_RULES
from flowlab.llm.url_filter import judge_urls, link_edges

URLS = [
    "https://x.example.org/es/1", "http://example.org/en/12?x#y", "http://a.example.org/en/2", "HTTPS://B.EXAMPLE.COM/fr/1",
    "https://badexample.org/es/", "http://c.com/de/", "http://com/de/9", "http://d.net/", "http://e.org", "http://f.org?q=/es/",
    "no scheme/es/", "", None, "a://b.org/c://d", "http://g.com#/fr/", "http://h.com/FR/", "http://Ä.Com/fr/", "x\n://i.org/\nz",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_rules(spark):
    pages = spark.createDataFrame([(k, u, None, 1, "x") for k, u in enumerate(URLS + URLS[:2])],
                                  "page_id long, url string, html string, host int, rule string")
    made = sorted(judge_urls(pages, URL_RULES).collect())
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in made] == [
        (k, *plain(u)) for k, u in enumerate(URLS + URLS[:2])]
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_decisions_spread_over_links(spark):
    link = '<LINK data-x=1 rel="canonical" href="{}">'
    refresh = "<meta http-equiv=refresh content='0; URL={}'>"
    rows = [
        (1, "http://one.net/a#top", link.format("http://bad.com/de/1")), (2, "http://two.net/", refresh.format("http://one.net/a")),
        (3, "http://three.net/x/y", link.format("../z") + link.format("/w")), (4, "http://three.net/w", None),
        (5, "http://five.net/", link.format("//bad.com/de/2#f")), (6, "http://good.org/", link.format("http://five.net/")),
        (7, "http://seven.net/", link.format("#")), (8, "http://bad.com/de/1", ""), (9, "http://nine.net/a?b=1&c=2", ""),
        (10, "http://ten.net/", link.format("http://nine.net/a?b=1&amp;c=2") + link.format("http://bad.com/de/3")),
        (2, "http://two.net/", refresh.format("http://one.net/a")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = {r.page_id: r for r in judge_urls(pages, URL_RULES).collect()}
    # 5 is an alias of a blocked and of an allowed address: the allow rule goes before
    assert {k: r.verdict for k, r in made.items()} == {
        1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "block"}
    assert made[1].component == made[2].component == made[8].component and made[7].component is None
    assert made[3].component == made[4].component
    more = spark.createDataFrame([("http://seven.net/", "http://x.com/de/"), (None, "http://y.net/")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in judge_urls(pages, URL_RULES, more).collect()}[7] == "block"


def test_relative_links(spark):
    rows = [("http://h.net/a/b", '<link rel=canonical href="c">'), ("http://h.net", "<link rel=canonical href=d>"), ("x", '<link rel=canonical href="/e">')]
    made = link_edges(spark.createDataFrame(rows, "url string, html string")).collect()
    assert {(r.a, r.b) for r in made} == {("http://h.net/a/b", "http://h.net/a/c"), ("http://h.net/", "http://h.net/d")}
