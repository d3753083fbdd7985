"""Continuous snapshot stability with per-key state, in sequence whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webstrata.operators.snapshots import stable_of
from webstrata.options import CaptureOptions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key bigint, outcome string, stable_seq bigint"
HELD_ROWS = 10_000  # snapshots of a key that a micro-batch holds beside the state


class StabilityProcessor(StatefulProcessor):
    """Remembers the last digest of a key until two in a row agree or time is up.

    Snapshots whose turn has not come wait in a map by sequence number: until all before them
    are there where numbers are dense (``first_seq``), or until the watermark has passed them
    (``waits``). Dense ones whose turn comes in their own micro-batch need not enter the map.
    """

    def __init__(self, timeout_ms: int, first_seq: int | None, waits: bool,
                 forget_ms: int | None) -> None:
        self.timeout_ms, self.first_seq = timeout_ms, first_seq
        self.waits, self.forget_ms = waits, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState(
            "last", "digest string, first_ms bigint, done boolean, seq bigint")
        self.pending = handle.getMapState("pending", "seq bigint", "digest string, ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        held = self.last.get() if self.last.exists() else (None, None, False, None)
        if held[2]:
            return
        if self.first_seq is None and not self.waits:
            # The snapshots of one key in one micro-batch, digests only.
            turn = sorted((t for frame in rows for t in self._tuples(frame)), key=lambda t: t[0])
            yield from self._walk(key, held, turn, timerValues)
            return
        if self.first_seq is not None:
            yield from self._walk(key, held, self._dense(held, rows), timerValues)
            return
        times = []
        for frame in rows:
            for seq, ms, digest in self._tuples(frame):
                self.pending.updateValue((seq,), (digest, ms))
            times += [int(frame["ms"].min()), int(frame["ms"].max())]
        self.handle.registerTimer(max(times) + 1)
        self.handle.registerTimer(min(times) + self.timeout_ms + 1)
        yield from self._walk(key, held, self._due(held, timerValues), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.last.get() if self.last.exists() else (None, None, False, None)
        if held[2]:
            # The timer of a finished key, or one it left behind: the former is the latest one.
            expired = expiredTimerInfo.getExpiryTimeInMs()
            if self.forget_ms is not None and all(
                    timer <= expired for timer in self.handle.listTimers()):
                self.last.clear()
            return
        yield from self._walk(key, held, self._due(held, timerValues), timerValues)

    def close(self) -> None:
        pass

    @staticmethod
    def _tuples(frame: pd.DataFrame) -> Iterator[tuple]:
        for seq, ms, digest in zip(frame["seq"], frame["ms"], frame["digest"]):
            yield int(seq), int(ms), digest if isinstance(digest, str) else None

    def _dense(self, held: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Snapshots whose turn has come, in sequence; then those of ``rows`` that wait are stored.

        Where the walk ends with an outcome, what has not been stored need not be.
        """
        fresh, stored = {}, self.pending.exists()
        for seq, ms, digest in (t for frame in rows for t in self._tuples(frame)):
            if len(fresh) < HELD_ROWS or seq in fresh:
                fresh[seq] = (digest, ms)
            else:
                self.pending.updateValue((seq,), (digest, ms))
                stored = True
        seq = self.first_seq if held[3] is None else held[3] + 1
        while True:
            if seq in fresh:
                digest, ms = fresh.pop(seq)
                if stored:  # the same number of an earlier micro-batch
                    self.pending.removeKey((seq,))
            elif stored and self.pending.containsKey((seq,)):
                digest, ms = self.pending.getValue((seq,))
                self.pending.removeKey((seq,))
            else:
                break
            yield seq, ms, digest
            seq += 1
        for seq, waiting in fresh.items():
            self.pending.updateValue((seq,), waiting)

    def _due(self, held: tuple, timers) -> Iterator[tuple]:
        """Snapshots whose turn has come, in sequence, taken out of the map."""
        if self.waits:
            passed = timers.getCurrentWatermarkInMs()
            due = sorted((seq, ms, digest) for (seq,), (digest, ms) in self.pending.iterator()
                         if ms <= passed)
            for row in due:
                self.pending.removeKey((row[0],))
                yield row

    def _walk(self, key, held: tuple, turn: Iterable[tuple], timers) -> Iterator[pd.DataFrame]:
        digest, first_ms, done, last_seq = held
        outcome = None
        for seq, ms, current in turn:
            first_ms = ms if first_ms is None else first_ms
            if ms > first_ms + self.timeout_ms:
                outcome = ("timed_out", None)
            elif current is not None and current == digest:
                outcome = ("stable", seq)
            digest, last_seq = current, seq
            if outcome:
                break
        if (outcome is None and self.waits and first_ms is not None
                and timers.getCurrentWatermarkInMs() > first_ms + self.timeout_ms):
            outcome = ("timed_out", None)
        if outcome:
            self.pending.clear()
            self.last.update((None, first_ms, True, last_seq))
            for timer in list(self.handle.listTimers()) if self._timed else []:
                self.handle.deleteTimer(timer)
            if self.forget_ms is not None:
                now = (timers.getCurrentWatermarkInMs() if self.waits
                       else timers.getCurrentProcessingTimeInMs())
                self.handle.registerTimer(now + self.forget_ms)
            frame = pd.DataFrame([(key[0], *outcome)], columns=["key", "outcome", "stable_seq"])
            yield frame.astype({"key": "int64", "outcome": "object", "stable_seq": "Int64"})
        elif last_seq is not None:
            self.last.update((digest, first_ms, False, last_seq))

    @property
    def _timed(self) -> bool:
        return self.waits or self.forget_ms is not None


def stream_stable(snapshots: DataFrame, timeout_ms: int | None = None,
                  lateness: str | None = None, first_seq: int | None = None,
                  forget_ms: int | None = None) -> DataFrame:
    """``key, outcome, stable_seq`` once per key, from a stream of snapshots.

    Needs ``key, seq, ts, html``. Only digests enter the shuffle and the state. A key times out
    when a snapshot past its limit has its turn, or in `finish_stable` when the stream has ended.
    Snapshots of a key may come in any order across micro-batches if their turn can be told:

    * ``first_seq``: a key's snapshots are numbered without gaps from there. Each waits for those
      before it, however long that takes, and none is dropped.
    * ``lateness``: a watermark. Each waits until the watermark has passed its time, later ones
      are dropped, and keys time out without a further snapshot. Times must rise with ``seq``.
    * Neither: micro-batches must have the snapshots of a key in sequence.

    A finished key keeps one narrow row, so that what follows opens it no second time.
    ``forget_ms`` ends that row, so that state does not grow with the stream's age: it must exceed
    the time over which a key's snapshots arrive, in event time with ``lateness`` and in processing
    time otherwise.
    """
    if lateness is not None and first_seq is not None:
        raise ValueError("first_seq and lateness exclude each other")
    spark = snapshots.sparkSession
    # Timers and typed state need this state store; the setting is per session.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timeout = CaptureOptions().page_load_timeout_ms if timeout_ms is None else timeout_ms
    digests = snapshots.select(
        "key", "seq", "ts", F.unix_millis("ts").alias("ms"),
        F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    waits = lateness is not None
    if waits:
        digests = digests.withWatermark("ts", lateness)
    mode = "eventtime" if waits else "processingtime" if forget_ms is not None else "none"
    return digests.groupBy("key").transformWithStateInPandas(
        statefulProcessor=StabilityProcessor(timeout, first_seq, waits, forget_ms),
        outputStructType=OUTPUT, outputMode="append", timeMode=mode)


def finish_stable(spark: SparkSession, checkpoint: str,
                  timeout_ms: int | None = None) -> DataFrame:
    """End of a stream: the rows of all keys that got none while it ran.

    Open keys are read from the state below ``checkpoint`` as the last micro-batch left it; snapshots
    that still wait there have their turn now, in sequence. Rows of the stream and these together
    have each key once, as `first_stable` has. Write them to a folder of their own: readers of a
    file sink see only what its log names.
    """
    timeout = CaptureOptions().page_load_timeout_ms if timeout_ms is None else timeout_ms
    state = spark.read.format("statestore")
    # The last snapshot that had its turn stands for those before it, with the time of the first.
    reached = state.option("stateVarName", "last").load(checkpoint).where(
        ~F.col("value.done")).select("key.key", "value.seq", F.col("value.first_ms").alias("ms"),
                                     "value.digest")
    waiting = state.option("stateVarName", "pending").load(checkpoint).select(
        "key.key", "user_map_key.seq", "user_map_value.ms", "user_map_value.digest")
    left = reached.unionByName(waiting)
    return stable_of(left.select("key", "seq", F.timestamp_millis("ms").alias("ts"), "digest"),
                     timeout)
