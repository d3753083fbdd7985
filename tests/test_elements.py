import pytest
from pyspark.sql import functions as F

from webstrata.operators import elements as el
from webstrata.operators import markup
from webstrata.operators.domtree import page_elements
from webstrata.options import CaptureOptions

PAGE = """<!DOCTYPE html><html><head><link href="s.css"><base href="/sub/">
<script>var x = '<a href="/no">';</script><!-- <a href="/hidden"> --></head>
<body onclick="go()"><p>one<a href='q?a=1&amp;b=2'>x</a><a title="> href=/fake">n</a>
<area HREF=/map><input type="submit"><button type="SUBMIT">b</button>
<textarea><a href="/text"></textarea><a data-href="/no">z</a><a href>e</a></body></html>"""


def _pages(spark, *texts):
    return spark.createDataFrame(
        [(i, f"http://h/d/{i}", t) for i, t in enumerate(texts)],
        "page_id bigint, url string, html string")


def test_clickable_elements(spark):
    rows = el.clickable_elements(_pages(spark, PAGE)).orderBy("pos").collect()
    assert [(r.tag, r.href, r.href_abs) for r in rows] == [
        ("base", "/sub/", "http://h/sub/"), ("body", None, None),
        ("a", "q?a=1&b=2", "http://h/sub/q?a=1&b=2"), ("area", "/map", "http://h/map"),
        ("a", "", "http://h/sub/")]


def test_submit_elements(spark):
    pages = _pages(spark, PAGE)
    assert [r.tag for r in el.submit_elements(pages, CaptureOptions(submit_forms=True)).collect()
            ] == ["input"]
    assert el.submit_elements(pages, CaptureOptions()).isEmpty()


def test_both_extractions_agree(spark):
    pages = _pages(spark, PAGE)
    one = el.clickable_elements(pages).select("page_id", "tag", "href", "href_abs")
    two = el.with_ancestor_path(pages).select("page_id", "tag", "href", "href_abs")
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


@pytest.mark.parametrize("text, want", [
    ("a&amp;b", "a&b"), ("&amp;lt;", "&lt;"), ("&#65;&#x42;", "AB"), ("&eacute;&rarr;", "é→"),
    ("&nosuch;x", "&nosuch;x"), ("a&b=c", "a&b=c"), ("&#x1F600;", "😀"), ("&#0;", "�"),
    ("&#xD800;", "�"), ("plain", "plain")])
def test_character_references(spark, text, want):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(markup.decode_references(F.col("v"))).first()[0] == want


def test_long_and_broken_markup(spark):
    long_attribute = "x" * 200_000
    texts = [f'<a title="{long_attribute}" href="/1">', "<a href='/open", "<a " + "b=c " * 50_000
             + "href=/2>", "<!-- never closed <a href=/3>", "<script><a href=/4>"]
    rows = el.clickable_elements(_pages(spark, *texts)).orderBy("page_id").collect()
    assert [(r.page_id, r.href) for r in rows] == [(0, "/1"), (2, "/2")]


@pytest.mark.parametrize("text, want", [
    ("<p>a<p>b<br>c", ["0>1>0>", "0>1>1>", "0>1>1>0>"]),
    ("<ul><li>a<li>b</ul><p>", ["0>1>0>", "0>1>0>0>", "0>1>0>1>", "0>1>1>"]),
    ("<title>t</title><div><img><span>", ["0>0>0>", "0>1>0>", "0>1>0>0>", "0>1>0>1>"]),
    ("<p><b>x<p>y", ["0>1>0>", "0>1>0>0>", "0>1>1>", "0>1>1>0>"]),
    ("<p>t<table><td>x<tr><th>y</table><i>", [
        "0>1>0>", "0>1>1>", "0>1>1>0>", "0>1>1>0>0>", "0>1>1>0>0>0>", "0>1>1>0>1>",
        "0>1>1>0>1>0>", "0>1>2>"]),
    ("<a href=1>x<a href=2>y", ["0>1>0>", "0>1>1>"]),
    ("<svg><path/><g><rect/></g></svg><b>", [
        "0>1>0>", "0>1>0>0>", "0>1>0>1>", "0>1>0>1>0>", "0>1>1>"]),
    ("<select><option>a<option>b</select>", ["0>1>0>", "0>1>0>0>", "0>1>0>1>"]),
    ("<dl><dt>a<dd>b<dt>c</dl>", ["0>1>0>", "0>1>0>0>", "0>1>0>1>", "0>1>0>2>"]),
    ("", [])])
def test_addresses(text, want):
    paths = [e[1] for e in page_elements(text)]
    assert {"0>", "0>0>", "0>1>"} <= set(paths)
    assert [p for p in paths if p not in ("0>", "0>0>", "0>1>")] == want


def test_lookup_path(spark):
    pages = _pages(spark, "<body><div><a href=/x>1</a></div>")
    refs = spark.createDataFrame(
        [(0, "0>1>0>0>"), (0, "7>9>0>0>"), (0, ""), (0, "0>1>"), (0, "0>1>0>5>"), (3, "0>1>")],
        "page_id bigint, path string")
    got = {(r.page_id, r.path): r.found_tag
           for r in el.lookup_path(el.dom_elements(pages), refs).collect()}
    assert got == {(0, "0>1>0>0>"): "a", (0, "7>9>0>0>"): "a", (0, ""): "body",
                   (0, "0>1>"): "body", (0, "0>1>0>5>"): None, (3, "0>1>"): None}


def test_candidates_keep_repeats(spark):
    attribute = el.with_ancestor_path(_pages(spark, "<a href=/x>1</a><input type=submit>"))
    listener = attribute.withColumn("source", F.lit("listener"))
    submit = el.with_ancestor_path(_pages(spark, "<input type=submit>"),
                                   CaptureOptions(submit_forms=True))
    assert el.candidates(listener, attribute, submit, CaptureOptions()).count() == 2
    assert el.candidates(listener, attribute, submit,
                         CaptureOptions(submit_forms=True)).count() == 3


def test_unclosed_formatting_stays_linear():
    found = page_elements("<p><b>x" * 800)
    assert len(found) <= 3 + 5 * 800 and max(len(e[1]) for e in found) < 40
    tags = [e[0] for e in page_elements("<p><b>x<p><b>y<p><b>z<p><b>w<p><b>v")]
    assert tags == ["html", "head", "body", *(
        t for n in range(5) for t in ["p", *["b"] * (min(n, 3) + 1)])]


def test_unequal_formatting_is_kept_apart():
    text = "".join(f"<font color={n}>" for n in range(5)) + "<p>x</p>"
    assert [e[0] for e in page_elements("<p>" + text + "<p>y")][-5:] == ["font"] * 5


def test_formatting_does_not_enter_cells():
    found = page_elements("<b>x<table><tr><td>y<i>z<td>w</table>v")
    cells = [e[1] for e in found if e[0] == "td"]
    inside = [e[0] for e in found if any(e[1] != c and e[1].startswith(c) for c in cells)]
    assert len(cells) == 2 and inside == ["i"]
