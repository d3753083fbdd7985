"""Joins of calls, references and navigations with what was stored, omitted or fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.urls import canonical_url
from webstrata.operators.skew import hot_keys, salted_lookup


def lookup_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each request with its stored response, if any, and ``is_hit``.

    ``requests`` needs ``call_id`` and ``request_key``; ``responses`` has one row per
    ``request_key``. A request repeated very often is spread over many tasks.
    """
    stored = responses.select(
        "request_key", F.col("status").alias("stored_status"),
        F.col("resp_headers").alias("stored_headers"),
        F.col("resp_body").alias("stored_body"), F.lit(True).alias("is_hit"))
    joined = salted_lookup(requests, stored, "request_key", ["call_id"])
    return joined.withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))


def uncached_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a stored response; no response columns are read."""
    return salted_lookup(requests, responses.select("request_key"), "request_key",
                         ["call_id"], "left_anti")


def _beside(rows: DataFrame, stored: DataFrame, buckets: int | None) -> DataFrame:
    """Left join of narrow rows with a store; the rows are hashed and the store streams by.

    Where the store lies in buckets of request_key, rows are dealt like them: nothing of the store
    is shuffled or sorted. Left to itself, Spark would rather move the store than fewer tasks.
    """
    dealt = rows.repartition(buckets, "request_key") if buckets else rows
    return dealt.hint("shuffle_hash").join(stored, "request_key", "left")


def absent_keys(rows: DataFrame, stored: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows, at most one per ``request_key``, whose key is not stored."""
    held = stored.select("request_key", F.lit(True).alias("_held"))
    return _beside(rows, held, buckets).where(F.col("_held").isNull()).drop("_held")


def lookup_stored(requests: DataFrame, stored: DataFrame, buckets: int | None) -> DataFrame:
    """`lookup_responses` against a store that lies in ``buckets`` of its ``request_key``.

    Requests go to the bucket of their key, and bodies are read there. Requests of hot keys, below
    `skew.HOT_SHARE` of them, would crowd a bucket: they meet their few stored responses, found
    by a condition on the key that prunes buckets and row groups, in a salted join of their own.
    """
    stored = stored.select(
        "request_key", F.col("status").alias("stored_status"),
        F.col("resp_headers").alias("stored_headers"), F.col("resp_body").alias("stored_body"),
        F.lit(True).alias("is_hit"))
    hot = [row[0] for row in hot_keys(requests, "request_key").select("request_key").collect()]
    is_hot = F.coalesce(F.col("request_key").isin(hot), F.lit(False)) if hot else F.lit(False)
    found = _beside(requests.where(~is_hot), stored, buckets)
    if hot:
        found = found.unionByName(salted_lookup(
            requests.where(is_hot), stored.where(F.col("request_key").isin(hot)), "request_key",
            ["call_id"]))
    return found.withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))


def uncached_stored(requests: DataFrame, stored: DataFrame, buckets: int | None) -> DataFrame:
    """`uncached_requests` against such a store: distinct keys meet it, then the requests theirs."""
    missing = absent_keys(requests.select("request_key").where(
        F.col("request_key").isNotNull()).distinct(), stored, buckets)
    hits = salted_lookup(requests, missing.withColumn("_missing", F.lit(True)), "request_key",
                         ["call_id"])
    return hits.where(F.col("_missing") | F.col("request_key").isNull()).drop("_missing")


def drop_omitted(refs: DataFrame, omissions: DataFrame) -> DataFrame:
    """References whose own raw URL is not in the omission set of their visit."""
    omitted = omissions.select("visit_id", F.col("uri").alias("url")).distinct()
    return refs.join(omitted, ["visit_id", "url"], "left_anti")


def fresh_navigations(navigations: DataFrame, fetched: DataFrame) -> DataFrame:
    """Navigations to a page that was fetched, not served from store, in that very click."""
    loaded = fetched.select("visit_id", "click_no", F.col("url").alias("_loaded")).distinct()
    current = navigations.withColumn("_loaded", canonical_url("current_url"))
    return current.join(loaded, ["visit_id", "click_no", "_loaded"], "left_semi").select(
        *navigations.columns)


def pair_records(records: DataFrame) -> DataFrame:
    """Exchanges from archive records: each response with the request it refers to."""
    requests = records.where(F.col("warc_type") == "request").select(
        F.col("record_id").alias("concurrent_to"), F.col("http_method").alias("method"),
        F.col("http_headers").alias("req_headers"), F.col("payload").alias("req_body"))
    responses = records.where(F.col("warc_type") == "response").select(
        "concurrent_to", "record_id", F.col("date").alias("ts"),
        F.col("target_uri").alias("uri"), F.col("http_status").alias("status"),
        F.col("http_headers").alias("resp_headers"), F.col("payload").alias("resp_body"))
    return responses.join(requests, "concurrent_to").select(
        "record_id", "ts", "method", "uri", "req_headers", "req_body", "status",
        "resp_headers", "resp_body")
