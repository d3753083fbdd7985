"""Elements of captured pages: clickable ones, submit controls and DOM addresses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.urls import resolve_href, settle
from webstrata.operators import markup
from webstrata.operators.domtree import page_elements
from webstrata.options import CaptureOptions

ELEMENT_COLUMNS = ("page_id", "url", "pos", "tag", "path", "href", "href_abs", "source")


def _elements(pages: DataFrame, wanted: str, mentioning: str, source: str) -> DataFrame:
    """Elements whose start tag ``t`` meets the SQL condition ``wanted``, links resolved.

    Each step is a projection of its own, so that no costly expression is repeated.
    """
    has_href = f"exists(t.attributes, a -> {markup.named('a', 'href')})"
    base = f"try_element_at(filter(tags, t -> t.name = 'base' AND {has_href}), 1)"
    tags = pages.select("page_id", "url", markup.start_tags(
        F.col("html"), rf"{mentioning}|^<base[\s/]").alias("tags"))
    found = tags.select(
        "page_id", "url", F.expr(f"{base}.attributes").alias("base"),
        F.posexplode(F.expr(f"filter(tags, t -> {wanted})")).alias("pos", "element"))
    raw = found.select(
        "page_id", "url", "pos", F.col("element.name").alias("tag"),
        F.expr(markup.raw_value("base", "href")).alias("base_raw"),
        F.expr(markup.raw_value("element.attributes", "href")).alias("raw_href"))
    return _resolved(raw).select(
        "page_id", "url", "pos", "tag", F.lit(None).cast("string").alias("path"), "href",
        "href_abs", F.lit(source).alias("source"))


def _resolved(raw: DataFrame) -> DataFrame:
    """Decode ``raw_href`` and ``base_raw`` and resolve the link."""
    decoded = settle(raw, href=markup.decode_references(F.col("raw_href")),
                     base_href=markup.decode_references(F.col("base_raw")))
    return settle(decoded, href_abs=resolve_href("url", "base_href", "href"))


def clickable_elements(pages: DataFrame) -> DataFrame:
    """Every element but ``link`` that has an ``onclick`` or ``href`` attribute."""
    return _elements(pages, "t.name != 'link' AND exists(t.attributes, a -> "
                     f"{markup.named('a', 'onclick', 'href')})", "onclick|href", "attribute")


def submit_elements(pages: DataFrame, opts: CaptureOptions) -> DataFrame:
    """Elements whose ``type`` is exactly ``submit``; none unless forms are submitted."""
    found = _elements(pages, markup.raw_value("t.attributes", "type") + " = 'submit'",
                      "submit", "submit")
    return found if opts.submit_forms else found.where(F.lit(False))


def listener_elements(dom_observations: DataFrame) -> DataFrame:
    """Elements a browser reported to have a click listener, in report order."""
    listed = dom_observations.select("url", F.posexplode("listeners").alias("pos", "element"))
    return listed.select(
        F.lit(None).cast("bigint").alias("page_id"), "url", "pos",
        F.lit(None).cast("string").alias("tag"), F.col("element.path").alias("path"),
        F.col("element.href").alias("href"), F.col("element.href").alias("href_abs"),
        F.lit("listener").alias("source"))


_DOM_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("pos", pa.int32()), ("tag", pa.string()),
    ("path", pa.string()), ("raw_href", pa.string()), ("base_raw", pa.string()),
    ("onclick", pa.bool_()), ("type", pa.string())])
_BATCH_ROWS = 20_000


def _walk_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for at in range(batch.num_rows):  # one page at a time: texts may be long
            page_id, url, text = (batch.column(i)[at].as_py() for i in range(3))
            found = page_elements(text or "")
            base = next((e[2] for e in found if e[0] == "base" and e[2] is not None), None)
            rows.extend((page_id, url, pos, tag, path, href, base, onclick, kind)
                        for pos, (tag, path, href, onclick, kind) in enumerate(found))
            if len(rows) >= _BATCH_ROWS:
                yield _to_batch(rows)
                rows = []
        if rows:
            yield _to_batch(rows)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(column, field.type) for column, field in zip(zip(*rows), _DOM_SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=_DOM_SCHEMA)


def dom_elements(pages: DataFrame) -> DataFrame:
    """Every element of every page with its child-index address from the document root."""
    walked = pages.select("page_id", "url", "html").mapInArrow(
        _walk_pages, "page_id bigint, url string, pos int, tag string, path string, "
                     "raw_href string, base_raw string, onclick boolean, type string")
    return _resolved(walked).select("page_id", "url", "pos", "tag", "path", "href", "href_abs",
                                    "onclick", "type")


def with_ancestor_path(pages: DataFrame, opts: CaptureOptions | None = None) -> DataFrame:
    """Clickable elements, and submit controls if forms are submitted, with addresses.

    ``pos`` is the position among all elements of the page. An element that is both
    clickable and a submit control appears once per source.
    """
    opts = opts or CaptureOptions()
    clickable = (F.col("href").isNotNull() | F.col("onclick")) & (F.col("tag") != "link")
    sources = [F.when(clickable, F.lit("attribute"))]
    if opts.submit_forms:
        sources.append(F.when(F.col("type") == "submit", F.lit("submit")))
    tagged = dom_elements(pages).withColumn(
        "source", F.explode(F.array_compact(F.array(*sources))))
    return tagged.select(*ELEMENT_COLUMNS)


def below_body(path: Column | str) -> Column:
    """The part of an address that lookups use: all but its first two indices."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(path, r"^(?:[^>]*>){0,2}+", "")


def lookup_path(elements: DataFrame, refs: DataFrame) -> DataFrame:
    """Element each ``(page_id, path)`` reference leads to; NULL columns if none.

    Addresses resolve below ``body``: the first two indices are not looked at, and an
    address without further ones leads to ``body`` itself.
    """
    targets = elements.where(F.col("path").startswith("0>1>")).select(
        "page_id", below_body("path").alias("_below"), F.col("pos").alias("found_pos"),
        F.col("tag").alias("found_tag"), F.col("path").alias("found_path"))
    return (refs.withColumn("_below", below_body("path"))
            .join(targets, ["page_id", "_below"], "left").drop("_below"))


def candidates(listener: DataFrame | None, attribute: DataFrame, submit: DataFrame | None,
               opts: CaptureOptions) -> DataFrame:
    """All candidates, keeping repeats: an element may be listed by several sources."""
    parts = [part for part in (listener, attribute) if part is not None]
    if submit is not None and opts.submit_forms:
        parts.append(submit)
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united
