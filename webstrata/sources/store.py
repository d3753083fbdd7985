"""Response store: the first response of each request, in buckets of the request key.

The files are Parquet, bucketed and sorted by ``request_key`` with Spark's own hash, so joins on it
leave the store where it lies. A store is known by its path alone: the number of buckets
stands in ``_layout`` beside the files, and tables of the session's catalog exist only while a
read or write is being set up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.keys import plain_base64
from webstrata.operators.dedup import (dedup_calls, first_places, with_request_key)
from webstrata.operators.late import fetch, has_place
from webstrata.session import cut_lineage
from webstrata.sources.calls import HEADERS

STORE_COLUMNS = ("request_key", "call_id", "ts", "status", "resp_headers", "resp_body")
STORE_SCHEMA = (f"request_key string, call_id bigint, ts timestamp, status int, "
                f"resp_headers {HEADERS}, resp_body binary")
BUCKET_ROWS = 50_000  # responses of a bucket when a store is started
MOST_BUCKETS = 100_000


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(target))


def _table_name(path: str) -> str:
    return f"webstrata_store_{hashlib.md5(path.encode()).hexdigest()}"


def _declare(spark: SparkSession, path: str, buckets: int) -> str:
    """Name of a table over the store's files; dropping it leaves them."""
    name, place = _table_name(path), path.replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({STORE_SCHEMA}) USING parquet "
              f"CLUSTERED BY (request_key) SORTED BY (request_key) INTO {buckets} BUCKETS "
              f"LOCATION '{place}'")
    return name


def _write(responses: DataFrame, path: str, buckets: int, mode: str) -> None:
    """One task and one file per bucket: the bodies are shuffled to their buckets, once."""
    spark = responses.sparkSession
    if mode == "overwrite":
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
    else:
        _declare(spark, path, buckets)
    (responses.repartition(buckets, "request_key").sortWithinPartitions("request_key")
     .write.mode(mode).format("parquet").bucketBy(buckets, "request_key").sortBy("request_key")
     .option("path", path).saveAsTable(_table_name(path)))
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
    if mode == "overwrite":
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode(
            "overwrite").json(f"{path}/_layout")


def store_buckets(spark: SparkSession, path: str) -> int | None:
    """Buckets of the store at ``path``, if its files are laid out in any."""
    if not _exists(spark, f"{path}/_layout"):
        return None
    return spark.read.json(f"{path}/_layout").first()["buckets"]


def save_responses(calls: DataFrame, path: str, clear: bool = True,
                   buckets: int | None = None) -> None:
    """Store the first response of each request key.

    With ``clear`` the store starts empty; otherwise keys it already holds are kept as
    they are, and only new ones are added, in new files of the same buckets. Calls read directly
    from Parquet files are fetched there once they are known to be first, so that bodies move
    only to their bucket. ``buckets`` follows the number of responses unless given; a store that has
    outgrown its buckets is laid out anew by `rebucket`.
    """
    spark = calls.sparkSession
    start = clear or not _exists(spark, path)
    held = None if start else read_responses(spark, path)
    if has_place(calls):
        winners = cut_lineage(first_places(
            calls, held, None if start else store_buckets(spark, path)))
        responses = with_request_key(fetch(calls, winners))
    else:
        responses = winners = dedup_calls(calls, held)
    if start:
        buckets = buckets or _bucket_count(winners.select("request_key").count())
        _write(responses.select(*STORE_COLUMNS), path, buckets, "overwrite")
    else:
        _append(spark, responses.select(*STORE_COLUMNS), path)


def _bucket_count(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def _append(spark: SparkSession, responses: DataFrame, path: str) -> None:
    known = store_buckets(spark, path)
    if known is None:
        responses.write.mode("append").parquet(path)
    else:
        _write(responses, path, known, "append")


def rebucket(spark: SparkSession, path: str, target: str, buckets: int | None = None) -> None:
    """Lay the store at ``path`` out anew at ``target``, one sorted file per bucket."""
    stored = read_responses(spark, path)
    _write(stored, target, buckets or _bucket_count(stored.select("request_key").count()),
           "overwrite")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows; joins with rows dealt into its `store_buckets` leave them in place."""
    buckets = store_buckets(spark, path)
    if buckets is None:
        return spark.read.schema(STORE_SCHEMA).parquet(path).select(*STORE_COLUMNS)
    name = _declare(spark, path, buckets)
    stored = spark.table(name).select(*STORE_COLUMNS)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return stored


def clear_responses(spark: SparkSession, path: str) -> None:
    """Drop all stored responses; the store itself stays readable, in as many buckets."""
    _write(spark.createDataFrame([], STORE_SCHEMA), path, store_buckets(spark, path) or 1,
           "overwrite")


def responses_to_json(responses: DataFrame) -> DataFrame:
    """``request_key, json`` per response; bodies as base64 on one line."""
    return responses.select("request_key", F.to_json(F.struct(
        F.col("status"), F.col("resp_headers").alias("headers"),
        plain_base64("resp_body").alias("contentBytes"))).alias("json"))


def responses_from_json(lines: DataFrame) -> DataFrame:
    """Inverse of `responses_to_json`."""
    parsed = lines.withColumn("r", F.from_json(
        "json", f"status int, headers {HEADERS}, contentBytes string"))
    return parsed.select("request_key", F.col("r.status").alias("status"),
                         F.col("r.headers").alias("resp_headers"),
                         F.unbase64(F.col("r.contentBytes")).alias("resp_body"))
