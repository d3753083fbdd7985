import base64
import hashlib

from pyspark.sql import functions as F

from webstrata import functions as fn
from webstrata.options import CaptureOptions, options_from_properties, parse_properties
from webstrata.sources.calls import HEADERS


def _digests(text: str) -> str:
    data = text.encode()
    return hashlib.md5(data).hexdigest() + "_" + hashlib.sha1(data).hexdigest()


def test_request_key(spark):
    body = bytes(range(256))
    rows = spark.createDataFrame(
        [("GET", "http://h/#x", body), ("POST", "http://h/", body), ("PUT", "http://h/", None),
         ("PATCH", "http://h/", body), ("GET", "mailto:x", None)],
        "method string, uri string, body binary")
    got = [r[0] for r in rows.select(fn.request_key("method", "uri", "body")).collect()]
    text = base64.b64encode(body).decode()
    assert got == [
        _digests("GET_http://h/"), _digests("POST_http://h/") + "_" + _digests(text),
        _digests("PUT_http://h/") + "_" + _digests(""), _digests("PATCH_http://h/"), None]
    assert [len(k) for k in got[:2]] == [73, 147]


def test_sql_functions_equal_column_functions(spark):
    fn.register_functions(spark)
    spark.createDataFrame(
        [("POST", "http://h/%41#f", b"x" * 300), ("GET", "http://h/a", None)],
        "method string, uri string, body binary").createOrReplaceTempView("_requests")
    df = spark.table("_requests").select(
        fn.request_key("method", "uri", "body").alias("a"),
        F.expr("request_key(method, uri, body)").alias("b"),
        fn.page_key("method", "uri").alias("c"), F.expr("page_key(method, uri)").alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in df.collect())


def _headers(spark, pairs):
    return spark.createDataFrame([(1, pairs)], f"call_id bigint, h {HEADERS}")


def test_header_functions(spark):
    df = _headers(spark, [("ACCEPT-encoding", "br"), ("X", "1"), ("user-agent", "u"),
                          ("X", "2"), ("Content-Type", "a"), ("content-type", "b"),
                          ("Content-Length", "3"), ("content-length", "4")])
    row = df.select(
        fn.override_headers("h", "me").alias("o"), fn.override_headers("h").alias("p"),
        fn.content_type("h").alias("t"), fn.single_content_length("h").alias("c")).first()
    assert [tuple(h) for h in row.o][-2:] == [("Accept-Encoding", ""), ("User-Agent", "me")]
    assert [h.name for h in row.o].count("X") == 2
    assert ("user-agent", "u") in [tuple(h) for h in row.p]
    assert row.t == "b"
    assert [tuple(h) for h in row.c if h.name.lower() == "content-length"] == [
        ("Content-Length", "3")]
    assert _headers(spark, []).select(fn.content_type("h")).first()[0] is None
    assert [(r.pos, r.name) for r in fn.headers_table(df, "h").collect()][-1] == (
        6, "Content-Length")


def test_flatten_headers(spark):
    df = spark.createDataFrame(
        [([("A", ["1", "2"]), ("CONTENT-LENGTH", ["7", "8"])],)],
        "m array<struct<name:string,values:array<string>>>")
    got = df.select(fn.flatten_headers("m")).first()[0]
    assert [tuple(h) for h in got] == [("A", "1"), ("A", "2"), ("CONTENT-LENGTH", "7")]


def test_recorded_body_and_label(spark):
    df = spark.createDataFrame([("GET", b"x", "u", []), ("PUT", b"x", "u", ["0>1>", "0>"])],
                               "m string, b binary, u string, p array<string>")
    got = df.select(fn.recorded_body("m", "b"), fn.ref_label("u", "p")).collect()
    assert [tuple(r) for r in got] == [(None, "u @"), (bytearray(b"x"), "u @ [0>1>] [0>]")]


def test_options():
    text = ("# c\n! d\nMAX_ANCESTOR_CLICK_DEPTH = 5\nSUBMIT_FORMS=TRUE\nUSER_AGENT: a \\\n  b\n"
            "EXTERNAL_DOMAIN_INCLUSION_PATTERNS = a\\\\.b ; ;c\n"
            "EXTERNAL_DOMAIN_EXCLUSION_PATTERNS = d\nCALL_RECORDER = some.java.Class\n"
            "UNKNOWN = 1\nPAGE_LOAD_TIMEOUT 30000")
    opts = options_from_properties(text)
    assert opts.max_click_depth == 5 and opts.submit_forms and opts.user_agent == "a b"
    assert opts.include_hosts == (r"a\.b", "c") and opts.exclude_hosts == ("d",)
    assert opts.page_load_timeout_ms == 30000 and opts.recorder == CaptureOptions().recorder
    assert parse_properties("k\\ 1=v\\u0041\nempty") == {"k 1": "vA", "empty": ""}
    piped = options_from_properties("DOMAIN_INCLUSION_PATTERN_DELIM=,\n"
                                    "EXTERNAL_DOMAIN_INCLUSION_PATTERNS=a,b")
    assert piped.include_hosts == ("a", "b")
