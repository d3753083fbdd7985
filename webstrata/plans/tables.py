"""Working tables derived, whole, from the given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.urls import canonical_url, url_host
from webstrata.operators.dedup import dedup_calls
from webstrata.operators.elements import with_ancestor_path
from webstrata.operators.ordered import lay_out, rank_in_group
from webstrata.operators.skew import salted_lookup
from webstrata.sources.calls import HEADERS

MINUTE, SECOND, DAY = 60_000, 1_000, 86_400_000
START_MS = 1_704_067_200_000  # 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _moment(millis) -> Column:
    return F.timestamp_millis(millis)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page fetches, repeats that differ by fragment only, and posted chat turns."""
    page = pages(spark, sf_dir)
    status = (F.when(F.col("page_id") % 10 == 0, 404).when(F.col("page_id") % 10 == 1, 302)
              .when(F.col("page_id") % 10 == 2, F.lit(None).cast("int")).otherwise(200))
    body = F.encode("html", "UTF-8")
    none = F.lit(None).cast("binary")
    first = page.select(
        (F.col("page_id") * 2).alias("call_id"),
        _moment(START_MS + F.col("page_id") * MINUTE).alias("ts"), F.lit("GET").alias("method"),
        F.col("url").alias("uri"), none.alias("req_body"), status.alias("status"),
        body.alias("resp_body"))
    again = page.select(
        (F.col("page_id") * 2 + 1).alias("call_id"),
        _moment(START_MS + (F.col("page_id") + 60) * MINUTE).alias("ts"),
        F.lit("GET").alias("method"),
        F.concat(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("#again")).alias("uri"),
        none.alias("req_body"), F.lit(200).alias("status"), body.alias("resp_body"))
    posted = table(spark, sf_dir, "conversations").select(
        (F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"),
        _moment(START_MS + DAY + (F.col("conv_id") * 100 + F.col("turn")) * SECOND).alias("ts"),
        F.lit("POST").alias("method"),
        F.concat(F.lit("http://chat.example.com/"), F.col("conv_id")).alias("uri"),
        F.encode("text", "UTF-8").alias("req_body"), F.lit(200).alias("status"),
        F.encode(F.lit("ok"), "UTF-8").alias("resp_body"))
    every = first.union(again).union(posted)

    def header(name: str, value) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    sent = F.array(header("Accept-Encoding", F.lit("gzip")), header("user-agent", F.lit("probe")),
                   header("Accept", F.lit("*/*")))
    received = F.array(header("Content-Type", F.lit("text/html; charset=utf-8")),
                       header("content-length", F.octet_length("resp_body").cast("string")))
    second_type = F.array(header("content-type", F.lit("application/xhtml+xml")))
    return every.select(
        "call_id", "ts", "method", "uri", sent.cast(HEADERS).alias("req_headers"), "req_body",
        "status", F.when(F.col("call_id") % 7 == 0, F.concat(received, second_type))
        .otherwise(received).cast(HEADERS).alias("resp_headers"), "resp_body")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish pages served without encryption: some hosts have one, some have none."""
    return pages(spark, sf_dir).where(F.col("url").rlike("^http://[^/]+/es/")).select(
        F.col("url").alias("seed_url"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored responses of successful page fetches: chat turns and errors are misses."""
    return dedup_calls(calls(spark, sf_dir)).where(
        (F.col("method") == "GET") & (F.col("status") == 200))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ancestor_path(pages(spark, sf_dir))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with their 0-based number on the page, from their address."""
    number = F.get(F.split("path", ">"), F.lit(4)).try_cast("int")
    return elements(spark, sf_dir).withColumn("k", number)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as page states, in event order per user.

    ``event_id`` orders a user's events totally, which is all a sequence needs.
    """
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("html"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page leads to the next one of its host, the last one to the first."""
    hosted = pages(spark, sf_dir).select("page_id", url_host("url").alias("host"))
    ranked = rank_in_group(lay_out(hosted, ["host"], ["page_id"]), ["host"], ["page_id"], "rank")
    sizes = ranked.groupBy("host").agg(F.count("*").alias("n"))
    following = salted_lookup(ranked, sizes, "host", ["page_id"]).select(
        F.col("page_id").alias("src"), "host", (F.col("rank") % F.col("n") + 1).alias("rank"))
    return following.join(ranked, ["host", "rank"]).select(
        "src", F.col("page_id").alias("dst"))


def dom_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first load and the state after one click, per page with links."""
    linked = links(spark, sf_dir).groupBy("page_id", "url").agg(F.sort_array(F.collect_list(
        F.struct("k", "path", F.col("href_abs").alias("href")))).alias("listed"))
    candidates = F.transform("listed", lambda e: F.struct(e["path"].alias("path"),
                                                          e["href"].alias("href")))
    odd = F.transform(F.filter("listed", lambda e: e["k"] % 2 == 1), lambda e: e["path"])
    no_paths = F.array().cast("array<string>")
    common = [F.col("page_id"), F.col("url"), F.col("url").alias("current_url")]
    first = linked.select(
        *common, no_paths.alias("click_path"), candidates.alias("candidates"),
        no_paths.alias("mutated_paths"), F.lit(False).alias("attr_mutated"))
    clicked = linked.select(
        *common, F.array(F.lit("0>1>0>0>0>0>")).alias("click_path"),
        candidates.alias("candidates"),
        F.when(F.col("page_id") % 4 == 0, no_paths).otherwise(odd).alias("mutated_paths"),
        (F.col("page_id") % 3 == 0).alias("attr_mutated"))
    return first.union(clicked)


def navigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select(
        F.col("page_id").alias("visit_id"), F.col("k").alias("click_no"),
        F.col("href_abs").alias("current_url"), "url")


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second click was served from the store, so its page counts as not fetched."""
    return navigations(spark, sf_dir).where(F.col("click_no") % 2 == 0).select(
        "visit_id", "click_no", canonical_url("current_url").alias("url"))
