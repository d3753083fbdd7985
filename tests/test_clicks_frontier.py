import os

import pytest

from webstrata.operators import clicks, filters, frontier
from webstrata.options import CaptureOptions

OBSERVED = ("url string, current_url string, click_path array<string>, "
            "candidates array<struct<path:string,href:string>>, mutated_paths array<string>, "
            "attr_mutated boolean")


def _seen(spark, path, candidates, mutated=(), attr=False):
    pairs = [c if isinstance(c, tuple) else (c, None) for c in candidates]
    return spark.createDataFrame([("u#1", "u", list(path), pairs, list(mutated), attr)], OBSERVED)


@pytest.mark.parametrize("path, candidates, mutated, attr, grown, again", [
    ([], ["a", "b", "b"], [], False, [["a"], ["b"], ["b"]], []),
    ([], [("a", "mailto:x"), "b"], [], True, [["b"]], []),
    (["a"], ["a", "b"], [], False, [], []),
    (["a"], ["a", "b"], ["b"], False, [["a", "b"]], [["a", "a"]]),
    (["a"], ["a", "b"], ["c"], False, [], [["a", "a"]]),
    (["a"], ["a", "b"], [], True, [], [["a", "a"]]),
    (["a"], ["b"], ["b"], True, [["a", "b"]], []),
    (["a"], ["b", "b"], ["b", "b"], False, [["a", "b"], ["a", "b"]], []),
    (["a"], [("a", "tel:1"), "b"], ["a", "b"], False, [["a", "b"]], [])])
def test_expansion(spark, path, candidates, mutated, attr, grown, again):
    df = _seen(spark, path, candidates, mutated, attr)
    assert sorted(r.click_path for r in clicks.expand_clicks(df).collect()) == sorted(grown)
    assert [r.click_path for r in clicks.reclick(df).collect()] == again
    assert all(r.url == "u" for r in clicks.expand_clicks(df).collect())


@pytest.mark.parametrize("limit, clicked, expands", [(2, 2, True), (2, 3, False), (0, 9, True)])
def test_depth_limit_still_expands_paths_of_its_own_length(spark, limit, clicked, expands):
    df = _seen(spark, ["a"] * clicked, ["b"], ["b"])
    opts = CaptureOptions(max_click_depth=limit)
    assert clicks.expand_clicks(df, opts).isEmpty() is not expands


def test_distinct_expansion(spark):
    df = _seen(spark, [], ["a", "a"])
    assert clicks.expand_clicks(df, distinct=True).count() == 1


def test_navigated_ignores_fragments(spark):
    df = spark.createDataFrame([("http://h/#a", "http://h/"), ("http://h/x", "http://h/")],
                               "current_url string, url string")
    assert [r.current_url for r in filters.navigated(df).collect()] == ["http://h/x"]


def test_next_frontier(spark):
    pages = spark.createDataFrame([
        (1, "http://a.com/d/p", "<a href=q><a href=/known#x><a href='http://sub.a.com/%41'>"
                                "<a href=//other.org/><a href=mailto:x@a.com><a href=q#again>"),
    ], "page_id bigint, url string, html string")
    hosts = spark.createDataFrame([("a.com",)], "host string")
    visited = spark.createDataFrame([("http://a.com/known",)], "url string")
    wave = frontier.next_frontier(pages, hosts, visited).collect()
    assert sorted((r.url, r.host, r.click_path) for r in wave) == [
        ("http://a.com/d/q", "a.com", []), ("http://sub.a.com/A", "sub.a.com", [])]


def _reached(spark, edges, seeds, scope=None):
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    start = spark.createDataFrame([(s,) for s in seeds], "node bigint")
    limit = None if scope is None else spark.createDataFrame([(s,) for s in scope], "node bigint")
    rows = [r.node for r in frontier.reachable(df, start, limit).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_reachable(spark):
    chain = [(i, i + 1) for i in range(40)] + [(40, 0), (7, 7), (100, 101)]
    assert _reached(spark, chain, [3]) == set(range(41))
    star = [(0, i) for i in range(1, 300)] + [(i, 0) for i in range(1, 300)] + [(5, 999)]
    assert _reached(spark, star, [1]) == set(range(300)) | {999}
    assert _reached(spark, [(1, 2), (2, 3), (3, 4)], [1], scope=[2, 4]) == {1, 2}
    assert _reached(spark, [(1, 2)], [9]) == {9}


def test_cycles_end(spark):
    assert _reached(spark, [(1, 2), (2, 3), (3, 1), (3, 4)], [1]) == {1, 2, 3, 4}


def test_deep_sets_take_few_jobs(spark, monkeypatch):
    """A ring, chains into it, and branches between chains: the set of a plain search, in few steps."""
    from webstrata.operators import frontier

    ring = [(i, (i + 1) % 300) for i in range(300)]
    inner = [(1000 + i, 1001 + i) for i in range(150)]          # a chain that ends in a branch
    branch = [(1150, 2000), (1150, 3000), (1150, 1150)]
    outer = [(2000 + i, 2001 + i) for i in range(70)] + [(3000 + i, 3001 + i) for i in range(40)]
    side = [(5000 + i, 1000 + i) for i in range(100)]           # never reached, leads in
    repeated = [(2070, 10), (2070, 10), (3040, 1003), (None, 7), (8, None)]
    edges = ring + inner + branch + outer + side + repeated
    writes, write = [], frontier.cut_lineage
    monkeypatch.setattr(frontier, "cut_lineage", lambda df: writes.append(1) or write(df))
    roots, make = [], frontier.work_path
    monkeypatch.setattr(frontier, "work_path", lambda *a: roots.append(make(*a)) or roots[-1])
    frame = spark.createDataFrame(edges, "src bigint, dst bigint")

    def plain(seeds, allowed=None):
        seen, todo = set(seeds), list(seeds)
        while todo:
            node = todo.pop()
            for src, dst in edges:
                if src == node and dst is not None and dst not in seen and (
                        allowed is None or dst in allowed):
                    seen.add(dst)
                    todo.append(dst)
        return seen

    for seeds in ([1000], [290, 3005], [9999]):
        starts = spark.createDataFrame([(s,) for s in seeds], "node bigint")
        got = [r.node for r in frontier.reachable(frame, starts).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(seeds)
        assert len(os.listdir(roots[-1].removeprefix("file:"))) < 50
    allowed = set(range(1000, 1120))
    scope = spark.createDataFrame([(n,) for n in allowed], "node bigint")
    starts = spark.createDataFrame([(1000,)], "node bigint")
    got = {r.node for r in frontier.reachable(frame, starts, scope).collect()}
    assert got == plain([1000], allowed)
    assert len(writes) < 40
