"""Tables of request/response pairs and the call log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = "array<struct<name:string,value:string>>"
CALL_SCHEMA = (f"call_id bigint, ts timestamp, method string, uri string, req_headers {HEADERS}, "
               f"req_body binary, status int, resp_headers {HEADERS}, resp_body binary")
CALL_COLUMNS = ("call_id", "ts", "method", "uri", "req_headers", "req_body", "status",
                "resp_headers", "resp_body")


def read_calls(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(CALL_SCHEMA).parquet(*paths)


def calls_from_pages(pages: DataFrame, ts: Column | None = None) -> DataFrame:
    """Pages as successful GET calls without headers."""
    moment = F.lit(None).cast("timestamp") if ts is None else ts
    return pages.select(
        F.col("page_id").alias("call_id"), moment.alias("ts"), F.lit("GET").alias("method"),
        F.col("url").alias("uri"), F.array().cast(HEADERS).alias("req_headers"),
        F.lit(None).cast("binary").alias("req_body"), F.lit(200).alias("status"),
        F.array().cast(HEADERS).alias("resp_headers"),
        F.encode("html", "UTF-8").alias("resp_body"))


def call_log(calls: DataFrame) -> DataFrame:
    """One line per call: ``uri <> status``."""
    return calls.select(F.concat(F.col("uri"), F.lit(" <> "),
                                 F.col("status").cast("string")).alias("line"))
