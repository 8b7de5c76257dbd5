import random

import pytest
from pyspark.sql import functions as F

from gneiss.llm.urls import OP7_SQL, RULES, filter_urls, op7_urls
from tests.llm.test_common import roots
from tests.oracle import connection, same


def test_rules_and_aliases(spark):
    rows = [
        (1, "http://a.x.org/es/1", '<link rel="canonical" href="http://b.y.info/z">'),
        (2, "http://b.y.info/z#q", ""),
        (3, "http://c.q.info/", '<meta http-equiv="refresh" content="0; url=http://b.y.info/z">'),
        (4, None, None),
        (5, "http://d.info/k/l", "<link href='/m' rel=canonical>"),
        (6, "http://D.info/m", ""),
        (7, "nope", ""),
        (8, "http://e.info/", '<LINK REL="canonical" HREF="http://f.info/?q=1&amp;r=2">'),
        (9, "HTTP://w.com/en/", "<p>canonical refresh</p>"),
        (10, "http://f.info/?q=1&r=2", ""),
        (11, "http://g.net/de/8/x", ""),
        (12, "http://Example.net/de/81", ""),
        (13, "http://notexample.com/en/7", ""),
        (14, "http://m.example.com/en/77?a#b", ""),
        (14, "http://m.example.com/en/77?a#b", ""),
        (15, "http://x://y/en/", ""),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, RULES).collect()}
    assert out[1] == ("a.x.org", "/es/1", "org/es/", "block")
    assert out[2] == ("b.y.info", "/z", None, "block") and out[3][3] == "block"
    assert out[4] == out[7] == ("", "", None, "allow")
    assert out[5][3] == out[6][3] == out[8][3] == "allow" and out[6][0] == "d.info"
    assert out[9][2:] == ("com/en/", "block") and out[11][2:] == ("net/de/", "allow") and out[12][2:] == ("example.net/de/8", "block")
    assert out[13][2:] == ("com/en/", "block") and out[14] == ("m.example.com", "/en/77", "example.com/en/7", "allow")
    assert out[15] == ("x:", "//y/en/", None, "allow")
    assert filter_urls(pages, RULES).count() == len(rows) and filter_urls(pages.limit(0), RULES).count() == 0
    more = spark.createDataFrame([("http://e.info/", "http://m.example.com/en/7"), ("http://e.info/", "http://q.org/es/")], "a string, b string")
    out = {r["page_id"]: r["verdict"] for r in filter_urls(pages, RULES, more).collect()}
    assert out[8] == out[10] == "allow" and out[1] == "block"
    blocked = filter_urls(pages, RULES, more.where(F.col("b").contains("org"))).where("page_id = 10").first()
    assert blocked["verdict"] == "block" and blocked["component"] == "http://e.info/"


def link_graph(seed):
    """Pages that name others as canonical: chains, cycles, stars, with allowed, blocked and other URLs in one component."""
    rng = random.Random(seed)
    urls = [f"http://h{k}.{rng.choice(['info', 'info', 'example.com', 'com', 'net', 'org', 'example.net'])}/{rng.choice(['en/7', 'en/1', 'de/8', 'de/2', 'es/1', 'x'])}/{k}" for k in range(60)]
    links = [(k, (k + 1) % 6) for k in range(6)] + [(k, 10) for k in range(11, 16)]
    links += [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(10, 50))]
    pages = [(k, u, "".join(f'<link rel="canonical" href="{urls[b]}">' for a, b in links if a == k)) for k, u in enumerate(urls)]
    return pages, links


def plain_rule(url):
    host, _, path = url.partition("://")[2].partition("/")
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.mark.parametrize("seed", range(6))
def test_random_link_graphs(spark, tables, seed):
    pages, links = link_graph(seed)
    folder, c = tables("pages", pages, "page_id long, url string, html string")
    out = op7_urls(spark, folder)
    same(out, c, OP7_SQL)
    root, verdicts = roots([x for x in links if x[0] != x[1]]), {}
    for k, url, _ in pages:
        verdicts.setdefault(root.get(k, k), set()).add(plain_rule(url)[1])
    for r in out.collect():
        rule, verdict = plain_rule(pages[r["page_id"]][1])
        around = verdicts[root.get(r["page_id"], r["page_id"])]
        assert (r["rule"], r["verdict"]) == (rule, verdict or ("allow" if "allow" in around else "block" if "block" in around else "allow"))
    assert any(v >= {"allow", "block"} for v in verdicts.values())


def test_whole_table(spark, sf):
    same(op7_urls(spark, sf), connection(sf), OP7_SQL)
