"""Snapshot stability: the first snapshot that equals its predecessor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.operators.ordered import lay_out, previous_in_group
from webstrata.options import CaptureOptions
from webstrata.session import cut_lineage


def first_stable(snapshots: DataFrame, key: str = "key", order: str = "seq",
                 payload: str = "html",
                 timeout_ms: int | None = CaptureOptions.page_load_timeout_ms) -> DataFrame:
    """``key, outcome, stable_seq`` per key: ``stable`` or ``timed_out``.

    Unless the timeout is None, the stable snapshot must come within it, counted from the first one.
    Payloads are compared by digest: only digests are shuffled, and a key with very many
    snapshots is worked on in parallel.
    """
    digests = snapshots.select(
        F.col(key).alias("key"), F.col(order).alias("seq"), "ts",
        F.sha2(F.col(payload).cast("binary"), 256).alias("digest"))
    return stable_of(digests, timeout_ms)


def stable_of(digests: DataFrame, timeout_ms: int | None) -> DataFrame:
    """`first_stable` of rows ``key, seq, ts, digest``."""
    # Materialised first: the range layout samples its input, and payloads are costly to read.
    laid = lay_out(cut_lineage(digests), ["key"], ["seq"])
    pairs = previous_in_group(laid, ["key"], ["seq"], "digest", "previous")
    repeated = F.when(F.col("digest") == F.col("previous"), F.struct("seq", "ts"))
    per_key = pairs.groupBy("key").agg(F.min(F.struct("seq", "ts")).alias("first"),
                                       F.min(repeated).alias("stable"))
    in_time = F.col("stable").isNotNull()
    if timeout_ms is not None:
        limit = F.col("first.ts") + F.make_dt_interval(secs=F.lit(timeout_ms / 1000))
        in_time = in_time & (F.col("stable.ts") <= limit)
    return per_key.select(
        "key", F.when(in_time, "stable").otherwise("timed_out").alias("outcome"),
        F.when(in_time, F.col("stable.seq")).alias("stable_seq"))


def stable_only(observations: DataFrame, stability: DataFrame, key: str) -> DataFrame:
    """Observations whose page became stable; all others are not expanded."""
    stable = stability.where(F.col("outcome") == "stable").select(F.col("key").alias(key))
    return observations.join(stable, key, "left_semi")
