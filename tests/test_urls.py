import pytest
from pyspark.sql import functions as F

from webstrata.functions import canonical_url, host_suffixes, resolve_href, surt_key, url_host

CANONICAL = [
    ("http://h/a#f", "http://h/a"), ("http://h/a#", "http://h/a"),
    ("http://h/?#f", "http://h/?"), ("http://h/%41%2Fb?x=%26y%20z", "http://h/A/b?x=&y%20z"),
    ("http://h/%C3%A9", "http://h/é"), ("http://h/a%25b", "http://h/a%25b"),
    ("http://h/?a=b+c%2Bd", "http://h/?a=b+c+d"), ("HTTP://H:80/a/../b", "HTTP://H:80/a/../b"),
    ("file:///tmp/x", "file:/tmp/x"), ("mailto:x", None), ("javascript:void(0)", None),
    ("about:blank", None), ("data:x,y", None), ("http://h/a b", None), ("http://h/a|b", None),
    ("http://h/[", None), ("http://h/%zz", None), ("http://[::1]:80/%41", "http://[::1]:80/A"),
    ("http://h/%FF", "http://h/�"), ("http://h/%5B?%5B%22", "http://h/%5B?[%22"),
    ("http://h/%E2%80%A8", "http://h/%E2%80%A8"), ("http://h%25/%41", "http://h%25/A"),
    ("file:////", None), ("file:////x", "file://x"), ("foo#f", "foo"), ("", ""), (None, None),
    ("http://h/%F0%9F%98%80", "http://h/😀"), ("http://", None), ("a%3Ab", "a:b"),
]


def test_canonical_url(spark):
    rows = spark.createDataFrame(CANONICAL, "url string, want string").select(
        "url", "want", canonical_url("url").alias("got")).collect()
    assert [(r.url, r.got) for r in rows] == [(r.url, r.want) for r in rows]


def test_canonical_url_is_idempotent_without_escapes(spark):
    urls = [(u,) for _, u in CANONICAL if u and "%" not in u and u.startswith("http:")]
    once = spark.createDataFrame(urls, "url string")
    assert once.where(~canonical_url("url").eqNullSafe(F.col("url"))).isEmpty()


def test_hosts(spark):
    cases = [("http://a_b.com/x", None), ("http://A.Com/x", "A.Com"),
             ("http://[::1]:8/x", "[::1]"), ("mailto:x", None), ("not a url", None)]
    rows = spark.createDataFrame(cases, "url string, want string").select(
        "want", url_host("url").alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_host_suffixes(spark):
    got = spark.createDataFrame([("a.b.c",)], "h string").select(host_suffixes("h")).first()[0]
    assert got == ["a.b.c", "b.c", "c"]


@pytest.mark.parametrize("base, href, want", [
    (None, "/q", "http://h/q"), (None, "q", "http://h/a/q"), (None, "../q", "http://h/q"),
    (None, "./", "http://h/a/"), (None, "..", "http://h/"), (None, "?z", "http://h/a/b?z"),
    (None, "#z", "http://h/a/b?x#z"), (None, "", "http://h/a/b?x"), (None, "//k/z", "http://k/z"),
    (None, "http://K:80", "http://k/"), (None, "mailto:x", "mailto:x"),
    (None, "HTTPS://User@EX.com:443/ä b?q=\"", "https://User@ex.com/%C3%A4%20b?q=%22"),
    (None, "MAILTO:x", "MAILTO:x"), (None, "../../../q/./z/..", "http://h/q/"),
    (None, "a/../b?../c", "http://h/a/b?../c"), (None, " /x\n", "http://h/x"),
    (None, "/für", "http://h/f%C3%BCr"), (None, "\\a\\b", "http://h/a/b"),
    (None, "http://a.b?x", "http://a.b/?x"), (None, "http://k/a/./b/../c", "http://k/a/c"),
    (None, "/a/../b", "http://h/b"), ("sub/", "q", "http://h/a/sub/q"),
    ("http://o/z", "q", "http://o/q"), (None, None, None)])
def test_resolve_href(spark, base, href, want):
    row = spark.createDataFrame([("http://h/a/b?x#y", base, href)], "p string, b string, h string")
    assert row.select(resolve_href("p", "b", "h")).first()[0] == want


def test_surt_key(spark):
    cases = [("http://www.Example.com:80/A/?b=2&a=1#f", "com,example)/a?a=1&b=2"),
             ("https://x.y:8443/", "y,x:8443)/"), ("mailto:q", "mailto:q")]
    rows = spark.createDataFrame(cases, "url string, want string").select(
        "want", surt_key("url").alias("got")).collect()
    assert all(r.want == r.got for r in rows)
