import re

from shiftlens.llm.urls import canonical, filter_urls, host_and_path
from pyspark.sql import functions as F

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = ["https://a.Example.ORG/es/1?x=1", "http://example.org/en/12#f", "http://b.example.org/en/2", "HTTP://x.com/fr/", "ftp://com/de/é",
        "http://notcom/de/1", "http://x.com", "http://x.com?q=/de/", None, "", "no scheme/de/", "http://", "http://www.bad.net:80/p//", "http://bad.net/p",
        "https://a://b/c", "http://example.org", "x\n://y.com/de/\n1", "http://" + "a." * 300 + "com/de/" + "z" * 5000]


def naive(url, listed):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    plain = re.sub(r":(80|443)$", "", re.sub(r"^www\.", "", host)) + path.rstrip("/") if host else None
    return (host, path, *(max(fits)[1:] if fits else (None, "block" if plain in listed else "allow")))


def test_rules_and_list_match_a_plain_version(spark):
    listed = {"bad.net/p", "x.com"}
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, verdict string")
    rows = spark.createDataFrame([(x,) for x in [*listed, "bad.net/p", None]], "url string")
    for words in (1, 1 << 20):  # a filter of one word lets everything through; the exact join decides
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, RULES, rows, words=words).collect()}
        assert got == {i: naive(u, listed) for i, u in enumerate(URLS + URLS[:3])}


def test_empty_tables_and_no_rules(spark):
    none = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://a.com/de/1")], "page_id long, url string")
    assert filter_urls(pages.limit(0), RULES, none).count() == 0
    r = filter_urls(pages, [], none).first()
    assert (r.host, r.path, r.rule, r.verdict) == ("a.com", "/de/1", None, "allow")


def test_canonical_and_native_plan(spark):
    df = spark.createDataFrame([("http://www.a.b:443/x/",)], "url string")
    host, path = host_and_path(F.col("url"))
    assert df.select(canonical(host, path).alias("c")).first().c == "a.b/x"
    plan = filter_urls(df, RULES, df.select("url"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
