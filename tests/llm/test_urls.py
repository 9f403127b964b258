import os
import re

import duckdb
import pytest

from tidemill.llm import queries, urls


def brute(url):
    u = (url or "").lower()
    return sorted(t for t in {*urls.STRICT, *urls.SOFT} if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", u))


CASES = {
    "http://Example.COM/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
    "https://www.example.com/en/?q": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://a.www.example.com/en/x#y": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "https://blog.example.com/fr/": ("blog.example.com", "/fr/", "com/", "allow"),
    "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "https://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
    "https://x.net/en/1": ("x.net", "/en/1", None, "allow"),
    "https://com/": ("com", "/", "com/", "allow"),
    "https://telecom": ("telecom", "", None, "allow"),
    "https://a.com": ("a.com", "", None, "allow"),
    "https://spam-farm.example.org/en/1": ("spam-farm.example.org", "/en/1", None, "block"),
    "https://spam-farmers.example.org/": ("spam-farmers.example.org", "/", None, "allow"),
    "https://free.example.org/": ("free.example.org", "/", None, "allow"),
    "https://free.example.org/free-free": ("free.example.org", "/free-free", None, "allow"),
    "https://free.example.org/Poker?x=1": ("free.example.org", "/Poker", None, "block"),
    "https://freepoker.org/": ("freepoker.org", "/", None, "allow"),
    "no scheme porn": ("", "", None, "block"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "x://É.com/a": ("É.com", "/a", "com/", "allow"),
    "http://?q=/en/": ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
}


def test_cases(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "page_id int, url string")
    out = {r.page_id: r for r in urls.judge(df).collect()}
    for i, (url, want) in enumerate(CASES.items()):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == want, url
        assert out[i].terms == ",".join(brute(url))


def test_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    got = queries.op1_url_filter(spark, small)
    want = con.execute(queries.oracle_sql()["op1_url_filter"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_table_edges(spark):
    df = spark.createDataFrame([(None, None, "h", 1), (None, None, "h", 1)], "page_id bigint, url string, host string, id int")
    assert [tuple(r)[:5] for r in urls.judge(df).collect()] == [(None, "", "", None, "allow")] * 2
    assert urls.judge(df.limit(0)).count() == 0


def test_terms_equal_brute_force_on_pages(spark, small):
    terms = urls.Terms(urls.Vocabulary())
    for r in spark.read.parquet(os.path.join(small, "pages.parquet")).collect():
        assert terms.hits(r.url) == brute(r.url)


@pytest.mark.parametrize("vocabulary", [urls.Vocabulary((), ()), urls.Vocabulary(("a",), ("a", "b"))])
def test_vocabularies(vocabulary):
    assert urls.Terms(vocabulary).hits("http://a/b") == [t for t in ("a", "b") if t in vocabulary.weights()]
