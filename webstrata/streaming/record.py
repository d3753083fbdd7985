"""Continuous recording: each unique request is stored and recorded once, ever.

`record_files` decides from keyed state: a streaming minimum per request key, combined before its
shuffle, over narrow rows. Bodies are read where they lie once their call is known to be the first,
and no batch reads what earlier ones recorded. `stream_record` takes streams of any source and
decides against the recorded keys instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from webstrata.operators.dedup import first_calls, with_request_key
from webstrata.operators.filters import recordable
from webstrata.operators.late import PLACE, fetch, with_place
from webstrata.options import CaptureOptions
from webstrata.session import cut_lineage
from webstrata.sources.calls import CALL_SCHEMA, read_calls
from webstrata.sources.sinks import CallSink
from webstrata.streaming.stability import ROCKSDB

LOG_SCHEMA = f"request_key string, {CALL_SCHEMA}, batch_id bigint"


def _record_batch(batch: DataFrame, batch_id: int, path: str, sinks: Iterable[CallSink],
                  opts: CaptureOptions, stateful: bool = False) -> None:
    spark = batch.sparkSession
    if stateful:
        # The state store may pick another repeat when asked again: settle its choice.
        batch = cut_lineage(batch)
    folder = f"{path}/batch_id={batch_id}"
    winners = cut_lineage(first_calls(batch))
    # A replayed batch must not meet its own earlier output.
    held = read_recorded(spark, path).where(F.col("batch_id") != batch_id)
    seen = held.select("request_key").join(winners, "request_key", "left_semi")
    fresh = winners.join(seen, "request_key", "left_anti")
    calls = batch.join(fresh.hint("shuffle_hash"), "call_id")
    calls.select("request_key", *batch.columns).write.mode("overwrite").parquet(folder)
    _deliver(folder, batch_id, sinks, opts, held.isEmpty())


def _deliver(folder: str, batch_id: int, sinks: Iterable[CallSink], opts: CaptureOptions,
             first: bool) -> None:
    """The recorded calls of one batch, to each sink."""
    # Only a stream's first batch may clear the store, not the first one of each process.
    own = opts.with_(clear_store_on_init=opts.clear_store_on_init and first)
    spark = SparkSession.active()
    for sink in sinks:
        rows = read_calls(spark, folder)
        if hasattr(sink, "write_batch"):
            sink.write_batch(rows, own, batch_id)
        else:
            sink.write(rows, own)


def finish_record(spark, sinks: Iterable[CallSink], opts: CaptureOptions | None = None) -> None:
    """End of a stream: lets each sink finish, which builds the index of an archive."""
    for sink in sinks:
        sink.close(spark, opts or CaptureOptions())


def read_recorded(spark, path: str) -> DataFrame:
    """All recorded calls with ``request_key`` and ``batch_id``."""
    empty = spark.createDataFrame([], LOG_SCHEMA)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return empty
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def stream_record(calls: DataFrame, path: str, sinks: Iterable[CallSink] = (),
                  watermark: str | None = None,
                  opts: CaptureOptions | None = None) -> DataStreamWriter:
    """A stream writer that records the first call of each request key below ``path``.

    Within a micro-batch the earliest call wins; across batches the recorded keys decide,
    so a request is never recorded twice and no call is lost, however late it comes. A
    batch is written under its number: replaying it overwrites the same folder. Sinks with a
    ``write_batch`` get the number, too, and replace what they wrote for it before. Call
    `finish_record` when the stream has ended.

    ``watermark`` additionally drops repeats in the state store before they reach the
    batch. That saves work where most calls are repeats, but calls later than the
    watermark are then dropped, too.
    """
    opts, sinks = opts or CaptureOptions(), list(sinks)
    if watermark is not None:
        keyed = with_request_key(calls.where(F.col("status").isNotNull()))
        calls = (keyed.withWatermark("ts", watermark)
                 .dropDuplicatesWithinWatermark(["request_key"]).drop("request_key"))
    return calls.writeStream.foreachBatch(
        lambda batch, batch_id: _record_batch(batch, batch_id, path, sinks, opts,
                                              watermark is not None))


def _first_batch(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether this is the first batch that records below ``path``; replayed, it still is."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_first")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        spark.createDataFrame([(json.dumps(batch_id),)], "value string").coalesce(1).write.text(
            f"{path}/_first")
        return True
    return json.loads(spark.read.text(f"{path}/_first").first()[0]) == batch_id


def fresh_calls(calls: DataFrame) -> DataFrame:
    """The first call of each request key that no earlier micro-batch had, with its place.

    ``calls`` is a stream read directly from Parquet files. State holds one narrow row per key: the
    time of the first micro-batch that had it, and its first call there. That time is
    fixed when a micro-batch is planned, so a repeated one decides alike; it comes from the driver's
    clock, which must not go back between micro-batches.
    """
    keyed = with_request_key(recordable(with_place(calls))).where(
        F.col("request_key").isNotNull()).select(
        "request_key", F.current_timestamp().alias("now"), "ts", "call_id", *PLACE)
    seen = keyed.groupBy("request_key").agg(
        F.min(F.struct("now", "ts", "call_id", *PLACE)).alias("first"), F.max("now").alias("now"))
    return seen.where(F.col("first.now") == F.col("now")).select(
        "request_key", *[F.col(f"first.{c}").alias(c) for c in ("call_id", *PLACE)])


def record_files(spark: SparkSession, source: str, path: str, sinks: Iterable[CallSink] = (),
                 opts: CaptureOptions | None = None,
                 max_files: int | None = None) -> DataStreamWriter:
    """A stream writer that records the first call of each request key in the files below ``source``.

    Calls are Parquet files of `CALL_SCHEMA`, added over time; ``max_files`` bounds a micro-batch.
    A micro-batch reads its own files: keys and times first, then the bodies of its first calls.
    Their names, which the file source lists in the driver as well, are the only rows collected.
    Within a micro-batch the earliest call wins, across them the first to come. Other properties
    are those of `stream_record`; streams of other sources can be written to files first.
    """
    opts, sinks = opts or CaptureOptions(), list(sinks)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reader = spark.readStream.schema(CALL_SCHEMA)
    calls = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source)

    def record(batch: DataFrame, batch_id: int) -> None:
        own, folder = batch.sparkSession, f"{path}/batch_id={batch_id}"
        winners = cut_lineage(batch)
        files = [unquote(row[0]) for row in winners.select("file_path").distinct().collect()]
        rows = read_calls(own, *files) if files else own.createDataFrame([], CALL_SCHEMA)
        found = with_request_key(fetch(rows, winners)) if files else with_request_key(rows)
        found.select("request_key", *rows.columns).write.mode("overwrite").parquet(folder)
        _deliver(folder, batch_id, sinks, opts, _first_batch(own, path, batch_id))

    return fresh_calls(calls).writeStream.outputMode("update").foreachBatch(record)
