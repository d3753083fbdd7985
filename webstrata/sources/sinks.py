"""Pluggable recorders: a sink receives a DataFrame of calls and the job options."""

from __future__ import annotations

import importlib
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from webstrata.options import CaptureOptions
from webstrata.sources.calls import call_log
from webstrata.sources.cdx import cdx_index, write_cdx
from webstrata.sources.store import save_responses
from webstrata.sources.warc import read_warc, write_warc


@runtime_checkable
class CallSink(Protocol):
    """Anything that can record calls; ``close`` runs once, after the last batch.

    A sink may offer ``write_batch(calls, opts, batch_id)`` for streams, which must leave the same
    result when a batch comes again.
    """

    def write(self, calls: DataFrame, opts: CaptureOptions) -> None: ...

    def close(self, spark, opts: CaptureOptions) -> None: ...


class WarcSink:
    """Appends shards; the index is built from the finished archive."""

    def write(self, calls: DataFrame, opts: CaptureOptions) -> None:
        if not opts.warc_path or not opts.cdx_path:
            raise ValueError("warc_path and cdx_path must be set")
        write_warc(calls, opts.warc_path)

    def write_batch(self, calls: DataFrame, opts: CaptureOptions, batch_id: int) -> None:
        if not opts.warc_path or not opts.cdx_path:
            raise ValueError("warc_path and cdx_path must be set")
        write_warc(calls, opts.warc_path, job=f"batch{batch_id}")

    def close(self, spark, opts: CaptureOptions) -> None:
        # What cannot be read is left out of the index, as what comes behind it in the shard.
        records = read_warc(spark, opts.warc_path, payload=False, strict=False)
        write_cdx(cdx_index(records), opts.cdx_path)


class LogSink:
    """Writes one text line per call."""

    def __init__(self, path: str | None = None) -> None:
        self.path = path

    def write(self, calls: DataFrame, opts: CaptureOptions) -> None:
        lines = call_log(calls)
        if self.path is None:
            lines.write.format("console").option("truncate", False).save()
        else:
            lines.write.mode("append").text(self.path)

    def write_batch(self, calls: DataFrame, opts: CaptureOptions, batch_id: int) -> None:
        if self.path is None:
            self.write(calls, opts)
        else:
            call_log(calls).write.mode("overwrite").text(f"{self.path}/batch_id={batch_id}")

    def close(self, spark, opts: CaptureOptions) -> None:
        pass


class ResponseStoreSink:
    """Keeps the first response of each request."""

    def __init__(self) -> None:
        self.started = False

    def write(self, calls: DataFrame, opts: CaptureOptions) -> None:
        if not opts.store_path:
            raise ValueError("store_path must be set")
        save_responses(calls, opts.store_path,
                       clear=opts.clear_store_on_init and not self.started)
        self.started = True

    def write_batch(self, calls: DataFrame, opts: CaptureOptions, batch_id: int) -> None:
        # The store keeps the first response of a key: calls that come again change nothing.
        if not opts.store_path:
            raise ValueError("store_path must be set")
        save_responses(calls, opts.store_path, clear=opts.clear_store_on_init)

    def close(self, spark, opts: CaptureOptions) -> None:
        pass


_REGISTERED: dict[str, type] = {"warc": WarcSink, "log": LogSink, "store": ResponseStoreSink}


def register_sink(name: str, factory: type) -> None:
    _REGISTERED[name] = factory


def load_sink(name: str) -> CallSink:
    """A sink by registered name or by ``package.module:Class``."""
    factory = _REGISTERED.get(name)
    if factory is None:
        module, colon, attribute = name.partition(":")
        if not colon:
            raise ValueError(f"unknown sink {name}: known are {', '.join(sorted(_REGISTERED))}")
        factory = getattr(importlib.import_module(module), attribute)
    sink = factory()
    if not isinstance(sink, CallSink):
        raise TypeError(f"{name} is no call sink")
    return sink


def record(calls: DataFrame, opts: CaptureOptions, *names: str) -> None:
    """Send calls through the named sinks, by default those of the options."""
    for name in names or (opts.store, opts.recorder):
        sink = load_sink(name)
        sink.write(calls, opts)
        sink.close(calls.sparkSession, opts)
