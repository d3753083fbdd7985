"""The physical plans scale as intended."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from webstrata.functions import canonical_url, url_host
from webstrata.operators import dedup, filters, frontier, lookups, scope
from webstrata.operators.elements import clickable_elements
from webstrata.sources.calls import CALL_SCHEMA, read_calls

PAGES = "/root/testdata/sf0.001/pages.parquet"


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("calls"))
    spark.createDataFrame([], CALL_SCHEMA).write.mode("overwrite").parquet(path)
    return read_calls(spark, path)


def test_first_calls_read_no_response_bodies(calls):
    text = plan(dedup.first_calls(calls))
    assert "resp_body" not in text and "IsNotNull(status)" in text
    assert "partial_min(struct(ts" in text


def test_bodies_join_by_call_id_without_sorting(calls):
    text = plan(dedup.dedup_calls(calls))
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
    moved = [block for block in re.split(r"\n\n", text)
             if " Exchange\n" in block and "resp_body" in block]
    assert len(moved) == 1 and "hashpartitioning(call_id" in moved[0]


def test_stored_requests_are_dropped_before_bodies_move(calls):
    stored = dedup.with_request_key(calls).select("request_key")
    text = plan(dedup.dedup_calls(calls, stored))
    moved = [block for block in re.split(r"\n\n", text)
             if " Exchange\n" in block and "resp_body" in block]
    assert len(moved) == 1 and "LeftAnti" in text


def test_filters_reach_the_scan(calls):
    text = plan(filters.recordable(calls).select("call_id", "status"))
    assert "PushedFilters: [IsNotNull(status)]" in text
    assert "ReadSchema: struct<call_id:bigint,status:int>" in text


def test_seed_scope_has_one_plan(spark):
    """Hash or merge joins on the host's domains, and one read of the rows."""
    pages = spark.read.parquet(PAGES).select("page_id", url_host("url").alias("host"))
    seeds = spark.read.parquet(PAGES).select(url_host("url").alias("host"))
    text = plan(scope.seed_scope(pages, seeds))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    assert len(re.findall(r"ReadSchema: struct<page_id:bigint,url:string>", text)) == 1


def test_extraction_reads_each_page_once_and_in_the_jvm(spark):
    pages = spark.read.parquet(PAGES)
    hosts = pages.select(url_host("url").alias("host"))
    visited = pages.select(canonical_url("url").alias("url"))
    text = plan(frontier.next_frontier(pages, hosts, visited))
    assert len(re.findall(r"ReadSchema: struct<url:string,html:string>", text)) == 1
    assert "Python" not in text and "NestedLoopJoin" not in text
    assert "Python" not in plan(clickable_elements(pages))


def test_lookup_spreads_hot_keys(calls):
    keyed = dedup.with_request_key(calls).select("call_id", "request_key")
    responses = dedup.with_request_key(calls).select("request_key", "status", "resp_headers",
                                                     "resp_body")
    text = plan(lookups.lookup_responses(keyed, responses))
    assert "_salt" in text and "NestedLoopJoin" not in text


def test_rounds_move_narrow_rows_only(calls):
    text = plan(dedup.politeness_rounds(calls))
    assert "resp_body" not in text and "NestedLoopJoin" not in text
    assert re.search(r"hashpartitioning\(_part", text)


def test_omission_reads_three_columns(calls):
    text = plan(filters.omissions(calls).select(F.col("visit_id"), "uri"))
    assert "ReadSchema: struct<call_id:bigint,uri:string,status:int>" in text
