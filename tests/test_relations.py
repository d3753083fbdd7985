"""Filters, scope, joins, deduplication, order-dependent results."""

import datetime
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from webstrata.operators import dedup, filters, lookups, ordered, scope, skew, snapshots
from webstrata.options import CaptureOptions
from webstrata.sources.calls import CALL_SCHEMA

T0 = datetime.datetime(2024, 1, 1)


def _calls(spark, rows):
    """Rows of (call_id, second, method, uri, body, status)."""
    return spark.createDataFrame(
        [(i, T0 + datetime.timedelta(seconds=s), m, u, [], b, status, [], b"r%d" % i)
         for i, s, m, u, b, status in rows], CALL_SCHEMA)


@pytest.mark.parametrize("href, kept", [
    *[(f"{p}:x", False) for p in ("tel", "mailto", "ftp", "file", "sms", "geo", "callto", "sip")],
    ("MAILTO:x", True), ("mailto:", True), ("javascript:x", True), (None, True),
    ("xmailto:x", True), ("mailto:a\nb", True)])
def test_unwanted_protocols(spark, href, kept):
    df = spark.createDataFrame([("http://h/", href, href)],
                               "url string, href string, href_abs string")
    assert filters.drop_unwanted_href(df).isEmpty() is not kept


def test_relative_links_of_local_pages_are_file_links(spark):
    df = spark.createDataFrame([("file:///a", "b", "file:///b")],
                               "url string, href string, href_abs string")
    assert filters.drop_unwanted_href(df).isEmpty()


SCOPE_CASES = [
    ("a.com", True, (), (), True), ("b.a.com", True, (), (), True),
    ("b.a.com", False, (), (), False), ("evila.com", True, (), (), False),
    ("A.com", True, (), (), False), ("x.org", True, (r".*\.org",), (), True),
    ("x.organ", True, (r".*\.org",), (), False),
    ("x.org", True, (r".*\.org",), (r"x\..*",), False),
    ("a.com", True, (), (r".*",), True), ("y.net", True, (r"z", r"y\.net"), (), True),
    (None, True, (r".*",), (), False)]


@pytest.mark.parametrize("host, subdomains, include, exclude, want", SCOPE_CASES)
def test_scope(spark, host, subdomains, include, exclude, want):
    seeds = spark.createDataFrame([("a.com",), (None,), ("a.com",), ("w.b.a.com",)],
                                  "host string")
    opts = CaptureOptions(include_seed_subdomains=subdomains, include_hosts=include,
                          exclude_hosts=exclude)
    url = "http://a_b.c/" if host is None else f"http://{host}/p"
    df = spark.createDataFrame([(1, url)], "id int, url string")
    assert scope.in_scope(df, seeds, opts).isEmpty() is not want


def test_local_files_and_other_schemes(spark):
    seeds = spark.createDataFrame([("a.com",)], "host string")
    df = spark.createDataFrame([("file:///x",), ("ftp://a.com/",), ("https://a.com/",)],
                               "url string")
    assert [r.url for r in scope.in_scope(df, seeds, CaptureOptions()).collect()] == [
        "https://a.com/"]
    local = CaptureOptions(include_local_files=True)
    assert scope.in_scope(df, seeds, local).count() == 2


@pytest.mark.parametrize("status, omitted", [
    (None, True), (200, False), (204, False), (299, False), (301, True), (302, False),
    (303, True), (304, True), (307, True), (404, True), (500, True)])
def test_omitted_status(spark, status, omitted):
    df = spark.createDataFrame([(status,)], "status int")
    assert df.select(filters.omitted_status("status")).first()[0] is omitted


def test_dedup_ranks_recordable_calls_only(spark):
    calls = _calls(spark, [
        (1, 0, "GET", "http://h/#a", None, None), (2, 5, "GET", "http://h/#b", None, 404),
        (4, 3, "GET", "http://h/", None, 200), (3, 3, "GET", "http://h/#c", None, 200),
        (5, 9, "POST", "http://h/", b"x", 200), (6, 1, "POST", "http://h/", b"y", 200),
        (7, 1, "GET", "mailto:x", None, 200)])
    once = dedup.dedup_calls(calls)
    assert sorted(r.call_id for r in once.collect()) == [3, 5, 6]
    again = dedup.dedup_calls(once.drop("request_key"))
    assert sorted(r.call_id for r in again.collect()) == [3, 5, 6]


def _skewed(spark, rows=6000):
    """One group holds more than half of the rows; one group is NULL."""
    random.seed(7)
    groups = ["hot"] * 8 + ["a", "b", None, "c"]
    data = [(i, random.choice(groups), random.randint(0, 40), str(random.randint(0, 2)))
            for i in range(rows)]
    return spark.createDataFrame(data, "id bigint, g string, ts int, v string").repartition(6)


def test_rank_in_group_across_partitions(spark):
    df = _skewed(spark)
    laid = ordered.lay_out(df, ["g"], ["ts", "id"], partitions=7)
    parts = laid.where("g = 'hot'").select("_part").distinct().count()
    assert parts > 3
    got = ordered.rank_in_group(laid, ["g"], ["ts", "id"], "n").select("id", "n")
    want = df.select("id", F.row_number().over(
        Window.partitionBy("g").orderBy("ts", "id")).cast("bigint").alias("n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_previous_in_group_across_partitions(spark):
    df = _skewed(spark)
    laid = ordered.lay_out(df, ["g"], ["ts", "id"], partitions=7)
    got = ordered.previous_in_group(laid, ["g"], ["ts", "id"], "v", "p").select("id", "p")
    want = df.select("id", F.lag("v").over(
        Window.partitionBy("g").orderBy("ts", "id")).alias("p"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rounds_hold_one_request_per_host(spark):
    calls = _calls(spark, [(i, i % 5, "GET", f"http://h{i % 3}/{i}", None, 200)
                           for i in range(60)])
    rounds = dedup.politeness_rounds(calls)
    assert rounds.count() == 60
    assert rounds.groupBy("host", "round").count().where("count > 1").isEmpty()


def test_rounds_without_politeness(spark):
    calls = _calls(spark, [(i, i, "GET", "http://h/", None, 200) for i in range(5)])
    rounds = dedup.politeness_rounds(calls, one_per_host=False)
    assert [r["round"] for r in rounds.collect()] == [1] * 5


def test_rows_in_scope_stay_single(spark):
    """Repeated rows keep their number although several seeds lie above their host."""
    seeds = spark.createDataFrame([("a.com",), ("b.a.com",), ("com.",)], "host string")
    rows = spark.createDataFrame([("c.b.a.com", 1), ("c.b.a.com", 1), ("x.com", 2), (None, 3)],
                                 "host string, _key int")
    assert [tuple(r) for r in scope.seed_scope(rows, seeds).collect()] == [("c.b.a.com", 1)] * 2
    assert scope.seed_scope(rows, seeds.limit(0)).isEmpty()


@pytest.mark.parametrize("tops", [["top.org"], ["top.org", "org", "invalid"]])
def test_seeds_below_one_domain_are_dealt_over_tasks(spark, tops):
    """Of very many seeds below one domain, which may be a seed, no task joins most."""
    names = [f"h{i}.{top}" for i in range(2000) for top in ("top.org", "invalid")] + [
        f"{'a.' * (i % 3)}own{i}.com" for i in range(50)] + ["", ".", "..", "x..org", "own9.com", "com."]
    seeds = spark.createDataFrame([(name,) for name in [*names, *tops, None]], "host string")
    with_domains = {h: [".".join(h.split(".")[k:]) for k in range(1, h.count(".") + 1)]
                    for h in [*names, *tops]}
    want = sorted(h for h, above in with_domains.items() if not with_domains.keys() & set(above))
    got = scope.topmost_hosts(seeds, True)
    assert sorted(r[0] for r in got.collect()) == want
    join = re.search(r"Join \[_above.*LeftSemi", got._jdf.queryExecution().executedPlan().toString())
    assert "_salt" in join[0]


def test_hot_keys_and_salted_lookup(spark):
    left = _skewed(spark).withColumnRenamed("g", "k")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, w int")
    assert {"hot"} <= {r.k for r in skew.hot_keys(left, "k").collect()}
    for how in ("left", "left_semi", "left_anti", "inner"):
        got = skew.salted_lookup(left, right, "k", ["id"], how)
        want = left.join(right, "k", how)
        assert got.count() == want.count()
        assert got.exceptAll(want.select(*got.columns)).isEmpty()


def test_hot_keys_are_bounded(spark):
    even = spark.range(20_000).select((F.col("id") % 4000).alias("k"))
    assert skew.hot_keys(even, "k").isEmpty()


def test_lookup_joins(spark):
    requests = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, None)],
                                     "call_id bigint, request_key string")
    responses = spark.createDataFrame(
        [("k1", 200, [], b"x")], "request_key string, status int, "
        "resp_headers array<struct<name:string,value:string>>, resp_body binary")
    got = {r.call_id: (r.is_hit, r.stored_status)
           for r in lookups.lookup_responses(requests, responses).collect()}
    assert got == {1: (True, 200), 2: (False, None), 3: (False, None)}
    assert sorted(r.call_id for r in lookups.uncached_requests(requests, responses).collect()
                  ) == [2, 3]
    # Omission compares raw URLs, fresh navigations canonical ones.
    refs = spark.createDataFrame([(1, "http://h/#a"), (1, "http://h/"), (2, "http://h/")],
                                 "visit_id bigint, url string")
    omitted = spark.createDataFrame([(1, "http://h/"), (1, "http://h/")],
                                    "visit_id bigint, uri string")
    assert sorted(map(tuple, lookups.drop_omitted(refs, omitted).select("visit_id", "url")
                      .collect())) == [(1, "http://h/#a"), (2, "http://h/")]
    moves = spark.createDataFrame([(1, 0, "http://h/x#q"), (1, 1, "http://h/x")],
                                  "visit_id bigint, click_no int, current_url string")
    fetched = spark.createDataFrame([(1, 0, "http://h/x"), (1, 0, "http://h/x")],
                                    "visit_id bigint, click_no int, url string")
    assert [r.click_no for r in lookups.fresh_navigations(moves, fetched).collect()] == [0]


def test_unvisited(spark):
    found = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "url string")
    visited = spark.createDataFrame([("b",), ("c",)], "url string")
    assert [r.url for r in dedup.unvisited(found, visited).collect()] == ["a"]


def test_first_stable(spark):
    def shots(key, *pages):
        return [(key, i, T0 + datetime.timedelta(seconds=i), p) for i, p in enumerate(pages)]

    df = spark.createDataFrame(
        shots(1, "a", "a", "b", "b") + shots(2, "a", "b", "c", "c") + shots(3, "a", "b", "a")
        + shots(4, "a"), "key bigint, seq bigint, ts timestamp, html string")
    plain = {r.key: (r.outcome, r.stable_seq)
             for r in snapshots.first_stable(df, timeout_ms=None).collect()}
    assert plain == {1: ("stable", 1), 2: ("stable", 3), 3: ("timed_out", None),
                     4: ("timed_out", None)}
    short = {r.key: (r.outcome, r.stable_seq)
             for r in snapshots.first_stable(df, timeout_ms=2000).collect()}
    assert short[1] == ("stable", 1) and short[2] == ("timed_out", None)
    kept = snapshots.stable_only(df, snapshots.first_stable(df), "key")
    assert {r.key for r in kept.collect()} == {1, 2}
