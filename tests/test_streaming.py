import datetime
import random

import pytest

from webstrata.operators.dedup import first_calls
from webstrata.operators.snapshots import first_stable
from webstrata.sources.calls import CALL_SCHEMA
from webstrata.sources.sinks import LogSink, ResponseStoreSink, WarcSink
from webstrata.sources.store import read_responses
from webstrata.sources.warc import read_warc
from webstrata.streaming.record import (_record_batch, finish_record, read_recorded,
                                        record_files, stream_record)
from webstrata.streaming.stability import finish_stable, stream_stable
from webstrata.options import CaptureOptions

T0 = datetime.datetime(2024, 1, 1)


def _calls(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + datetime.timedelta(seconds=s), "GET", f"http://h/{u}", [], None, 200, [], b"x")
         for i, s, u in rows], CALL_SCHEMA)


# A repeat in its batch, one in a later batch, and a new call far behind all others.
BATCHES = [[(2, 10, "a#2"), (1, 10, "a"), (3, 20, "b")], [(4, 5000, "a"), (5, 5001, "c")],
           [(6, 9000, "d"), (7, 1, "late"), (8, 9001, "c")]]


class Remember:
    def __init__(self):
        self.ids = []

    def write(self, calls, opts):
        self.ids.append(sorted(r.call_id for r in calls.collect()))

    def close(self, spark, opts):
        pass


def _run(spark, folder, watermark=None):
    source = f"{folder}/in"
    for batch in BATCHES:
        _calls(spark, batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CALL_SCHEMA).parquet(source)
        sink = Remember()
        stream_record(stream, f"{folder}/out", [sink], watermark).option(
            "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(
        ).awaitTermination()
        yield sink.ids


def test_each_request_is_recorded_once(spark, folder):
    assert list(_run(spark, folder)) == [[[1, 3]], [[5]], [[6, 7]]]
    every = _calls(spark, [row for batch in BATCHES for row in batch])
    batch = {r.request_key for r in first_calls(every).collect()}
    assert {r.request_key for r in read_recorded(spark, f"{folder}/out").collect()} == batch


def test_watermark_drops_late_calls(spark, folder):
    ids = [i for batch in _run(spark, folder, "10 seconds") for run in batch for i in run]
    assert 7 not in ids and {3, 5, 6} <= set(ids) and len(ids) == 4


def test_replayed_batch_is_idempotent(spark, folder):
    batch = _calls(spark, BATCHES[0])
    for _ in range(2):
        sink = Remember()
        _record_batch(batch, 0, f"{folder}/out", [sink], CaptureOptions())
        assert sink.ids == [[1, 3]]
    assert read_recorded(spark, f"{folder}/out").count() == 2


@pytest.mark.parametrize("timeout_ms", [3_000, 10 ** 9])
def test_stream_stable_equals_batch(spark, folder, timeout_ms):
    def shots(key, *pages):
        return [(key, i, T0 + datetime.timedelta(seconds=i), p) for i, p in enumerate(pages)]

    rows = shots(1, "a", "a", "b", "b") + shots(2, *"abcdee") + shots(3, "a", "b", "a")
    schema = "key bigint, seq bigint, ts timestamp, html string"
    for part in (rows[:6], rows[6:], [(9, 0, T0 + datetime.timedelta(days=90), "x")],
                 [(9, 1, T0 + datetime.timedelta(days=91), "y")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(
            f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        stream_stable(stream, timeout_ms, "10 seconds").writeStream.format("parquet").option(
            "path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
            availableNow=True).start().awaitTermination()
    got = {r.key: (r.outcome, r.stable_seq)
           for r in spark.read.parquet(f"{folder}/out").collect() if r.key != 9}
    shown = spark.createDataFrame(rows, schema)
    want = {r.key: (r.outcome, r.stable_seq)
            for r in first_stable(shown, timeout_ms=timeout_ms).collect()}
    assert got == want


def test_restart_and_replay_leave_sinks_whole(spark, folder):
    opts = CaptureOptions(warc_path=f"{folder}/warc", cdx_path=f"{folder}/cdx",
                          store_path=f"{folder}/store", clear_store_on_init=True)
    # Each turn has new sinks, as a restarted process has; the last batch comes twice.
    for batch_id, rows in ((0, BATCHES[0]), (1, BATCHES[1]), (1, BATCHES[1])):
        sinks = [WarcSink(), ResponseStoreSink(), LogSink(f"{folder}/log")]
        _record_batch(_calls(spark, rows), batch_id, f"{folder}/out", sinks, opts)
    assert read_recorded(spark, f"{folder}/out").count() == 3
    assert read_responses(spark, f"{folder}/store").count() == 3
    assert read_warc(spark, f"{folder}/warc").where("warc_type = 'response'").count() == 3
    assert spark.read.text(f"{folder}/log").count() == 3
    finish_record(spark, sinks, opts)
    assert spark.read.text(f"{folder}/cdx").count() >= 3


def test_keys_behind_others_lose_nothing(spark, folder):
    schema = "key bigint, seq bigint, ts timestamp, html string"
    early = [(2, i, T0 + datetime.timedelta(seconds=i), p) for i, p in enumerate("abb")]
    ahead = [(1, i, T0 + datetime.timedelta(seconds=1000 + i), p) for i, p in enumerate("xyy")]
    for part in (ahead, early):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        stream_stable(stream, 20_000).writeStream.format("parquet").option(
            "path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
            availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {(1, "stable", 2), (2, "stable", 2)}


def test_open_keys_time_out_when_the_stream_ends(spark, folder):
    def shots(key, first, pages):
        return [(key, first + i, T0 + datetime.timedelta(seconds=first + i), p)
                for i, p in enumerate(pages)]

    # Never stable, a single snapshot, stable in the second batch, past its limit, open over both.
    parts = [shots(1, 0, "abc") + shots(2, 0, "a") + shots(3, 0, "ab") + shots(4, 0, "ab"),
             shots(3, 2, "b") + shots(4, 90, "b") + shots(5, 0, "ab") + shots(1, 3, "d")]
    schema = "key bigint, seq bigint, ts timestamp, html string"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        stream_stable(stream, 20_000).writeStream.format("parquet").option(
            "path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
            availableNow=True).start().awaitTermination()
    rest = finish_stable(spark, f"{folder}/state", 20_000)
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").unionByName(rest).collect()))
    shown = spark.read.schema(schema).parquet(f"{folder}/in")
    want = sorted(map(tuple, first_stable(shown, timeout_ms=20_000).collect()))
    assert got == want and {r.key for r in rest.collect()} == {1, 2, 5}


def _stream_parts(spark, folder, parts, **how):
    """Rows of `stream_stable`, micro-batch by micro-batch, and the state's keys after each."""
    schema, sizes = "key bigint, seq bigint, ts timestamp, html string", []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        stream_stable(stream, **how).writeStream.format("parquet").option(
            "path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
            availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore")
        sizes.append([state.option("stateVarName", name).load(f"{folder}/state").count()
                      for name in ("last", "pending")])
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()], sizes


def _shuffled_shots():
    """Keys that turn stable, never do, do so too late, have one snapshot, or none with a body."""
    pages = {1: "aabb", 2: "abcdee", 3: "aba", 4: "x", 5: "abcdefghijklmnopqrstuvwxyzz", 6: [None] * 3}
    rows = [(key, i, T0 + datetime.timedelta(seconds=i), page)
            for key, shown in pages.items() for i, page in enumerate(shown)]
    random.Random(5).shuffle(rows)
    return rows


def test_numbered_snapshots_in_any_order(spark, folder):
    rows = _shuffled_shots()
    got, sizes = _stream_parts(spark, folder, [rows[i::5] for i in range(5)], timeout_ms=20_000,
                               first_seq=0)
    rest = finish_stable(spark, f"{folder}/state", 20_000)
    shown = spark.createDataFrame(rows, "key bigint, seq bigint, ts timestamp, html string")
    want = sorted(map(tuple, first_stable(shown, timeout_ms=20_000).collect()))
    assert sorted(got + [tuple(r) for r in rest.collect()]) == want
    # All that had its turn has left the map, and finished keys keep one row.
    assert sizes[-1] == [6, 0] and {key for key, *_ in got} == {1, 2, 5}


def test_a_gap_at_the_end_of_the_stream(spark, folder):
    rows = [r for r in _shuffled_shots() if r[:2] not in {(1, 0), (2, 3), (3, 1)}]
    got, sizes = _stream_parts(spark, folder, [rows[::2], rows[1::2]], timeout_ms=20_000,
                               first_seq=0)
    rest = [tuple(r) for r in finish_stable(spark, f"{folder}/state", 20_000).collect()]
    shown = spark.createDataFrame(rows, "key bigint, seq bigint, ts timestamp, html string")
    assert sorted(got + rest) == sorted(map(tuple, first_stable(shown, timeout_ms=20_000).collect()))
    assert sizes[-1][1] > 0


def test_late_snapshots_wait_for_the_watermark_and_state_ends(spark, folder):
    rows = _shuffled_shots()
    later = [[(9, i, T0 + datetime.timedelta(days=30 * i), f"p{i}")] for i in (1, 2, 3)]
    got, sizes = _stream_parts(spark, folder, [rows[::2], rows[1::2], *later], timeout_ms=20_000,
                               lateness="60 seconds", forget_ms=86_400_000)
    shown = spark.createDataFrame(rows, "key bigint, seq bigint, ts timestamp, html string")
    want = sorted(map(tuple, first_stable(shown, timeout_ms=20_000).collect()))
    assert sorted(r for r in got if r[0] != 9) == want
    assert sizes[1][1] > 0 and sum(sizes[-1]) <= 1  # the last snapshot of key 9 alone


def test_files_are_recorded_from_state(spark, folder):
    """Each micro-batch reads its own rows alone, and sinks get the first calls once."""
    opts = CaptureOptions(store_path=f"{folder}/store", clear_store_on_init=True)
    read, ids = [], []
    batches = BATCHES + [[(9, 1, "a"), (10, 2, "e")], [(11, 9100, "a#x"), (12, 9101, "e")]]
    for batch in batches:
        _calls(spark, batch).coalesce(1).write.mode("append").parquet(f"{folder}/in dir")
        sink = Remember()
        query = record_files(spark, f"{folder}/in dir", f"{folder}/out",
                             [sink, ResponseStoreSink()], opts).option(
            "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        read += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        ids += [i for run in sink.ids for i in run]
    # A later batch's earlier call of a known request is no first call.
    assert sorted(ids) == [1, 3, 5, 6, 7, 10]
    assert read == [len(batch) for batch in batches]
    recorded = read_recorded(spark, f"{folder}/out")
    assert sorted(r.call_id for r in recorded.collect()) == [1, 3, 5, 6, 7, 10]
    assert {bytes(r.resp_body) for r in recorded.collect()} == {b"x"}
    assert sorted(r.call_id for r in read_responses(spark, f"{folder}/store").collect()) == [
        1, 3, 5, 6, 7, 10]


def test_many_files_in_one_batch(spark, folder):
    rows = [(i, i % 97, f"p{i % 50}") for i in range(1000)]
    _calls(spark, rows).repartition(7).write.parquet(f"{folder}/in")
    record_files(spark, f"{folder}/in", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    want = {r.call_id for r in first_calls(_calls(spark, rows)).collect()}
    assert {r.call_id for r in read_recorded(spark, f"{folder}/out").collect()} == want
