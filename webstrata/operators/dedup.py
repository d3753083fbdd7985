"""First-wins deduplication, visited filtering and per-host request rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.keys import request_key
from webstrata.functions.urls import url_host
from webstrata.operators.filters import recordable
from webstrata.operators.late import PLACE, fetch, with_place
from webstrata.operators.lookups import absent_keys
from webstrata.operators.ordered import lay_out, rank_in_group


def with_request_key(calls: DataFrame) -> DataFrame:
    return calls.withColumn("request_key", request_key("method", "uri", "req_body"))


def first_calls(calls: DataFrame) -> DataFrame:
    """``request_key, call_id`` of the first recordable call per request key.

    Reads no response bodies. The minimum is taken map-side first, so a request that
    makes up most of the table reaches its reducer as one row per task.
    """
    keyed = with_request_key(recordable(calls)).select("request_key", "ts", "call_id").where(
        F.col("request_key").isNotNull())
    first = keyed.groupBy("request_key").agg(F.min(F.struct("ts", "call_id")).alias("first"))
    return first.select("request_key", F.col("first.call_id").alias("call_id"))


def dedup_calls(calls: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first recordable call of each request, with its ``request_key``.

    Requests whose key is in ``stored`` are left out. Bodies move once, by the unique
    ``call_id`` and hence evenly; the hash join spares sorting them.
    """
    winners = first_calls(calls)
    if stored is not None:
        winners = winners.join(stored.select("request_key"), "request_key", "left_anti")
    return calls.join(winners.hint("shuffle_hash"), "call_id")


def first_places(calls: DataFrame, stored: DataFrame | None = None,
                 buckets: int | None = None) -> DataFrame:
    """``request_key, call_id, file_path, row_index`` of the first recordable call per request key.

    ``calls`` is a direct read of Parquet files. Requests whose key is in ``stored``, a store in so
    many ``buckets``, are left out.
    """
    keyed = with_request_key(recordable(with_place(calls))).select(
        "request_key", "ts", "call_id", *PLACE).where(F.col("request_key").isNotNull())
    first = keyed.groupBy("request_key").agg(F.min(F.struct("ts", "call_id", *PLACE)).alias("first"))
    winners = first.select("request_key", *[F.col(f"first.{c}").alias(c)
                                            for c in ("call_id", *PLACE)])
    if stored is not None:
        winners = absent_keys(winners, stored, buckets)
    return winners


def dedup_call_files(calls: DataFrame, stored: DataFrame | None = None,
                     buckets: int | None = None) -> DataFrame:
    """`dedup_calls` over calls read from Parquet files, without a shuffle of any body.

    Winners are known by their place in the files, where their rows are then read; rows of losers
    are dropped in the scan.
    """
    return with_request_key(fetch(calls, first_places(calls, stored, buckets)))


def unvisited(candidates: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    """Distinct candidate keys that were never visited.

    Candidates are reduced to distinct keys first (map-side, then by key), so a link that
    every page carries weighs one row, and the anti join reuses that partitioning.
    """
    fresh = candidates.select(key).where(F.col(key).isNotNull()).distinct()
    return fresh.join(visited.select(key), key, "left_anti")


def politeness_rounds(requests: DataFrame, uri: str = "uri",
                      one_per_host: bool = True) -> DataFrame:
    """``call_id, host, round``: each round holds at most one request per host.

    Requests of a host are numbered by ``(ts, call_id)``. Only narrow rows move. Without
    ``one_per_host`` all requests may go at once, in round 1.
    """
    narrow = requests.select("call_id", "ts", url_host(uri).alias("host"))
    if not one_per_host:
        return narrow.select("call_id", "host", F.lit(1).cast("bigint").alias("round"))
    laid = lay_out(narrow, ["host"], ["ts", "call_id"])
    return rank_in_group(laid, ["host"], ["ts", "call_id"], "round").select(
        "call_id", "host", "round")
