import datetime
import os

import pytest
from pyspark.sql import functions as F

from webstrata.operators.lookups import pair_records
from webstrata.options import CaptureOptions
from webstrata.sources import cdx, seeds, sinks, store, warc
from webstrata.sources.calls import CALL_SCHEMA, call_log, read_calls

T0 = datetime.datetime(2024, 5, 6, 7, 8, 9, 123000)
EVERY_BYTE = bytes(range(256))


def _cases(spark):
    rows = [
        (1, T0, "GET", "http://h/é?x", [("A", "1"), ("A", "2")], None, 200,
         [("Content-Type", "text/html"), ("Content-Length", "0")], b""),
        (2, T0, "POST", "http://h/p", [("content-type", "x/y")], EVERY_BYTE, 404,
         [("content-type", "a"), ("CONTENT-TYPE", "b; c"), ("Content-Length", "256")],
         EVERY_BYTE),
        (3, T0, "PUT", "http://h/q", [], b"", 301, [("Location", "http://h/z z")], b"WARC/1.0\r\n"),
        (4, T0, "GET", "http://h/none", [], None, None, [], None),
        (5, T0, "GET", "http://h/r", [], b"ignored", 500, [("X", "a\r\nb")], b"\r\n\r\n" * 9)]
    return spark.createDataFrame(rows, CALL_SCHEMA)


def _shards(path):
    return sorted(n for n in os.listdir(path) if n.endswith(".warc"))


def test_warc_round_trip(spark, folder):
    path = f"{folder}/w"
    warc.write_warc(_cases(spark).coalesce(1), path)
    records = warc.read_warc(spark, path)
    assert [r.warc_type for r in records.orderBy("offset").collect()] == [
        "warcinfo", *["request", "response"] * 4]
    got = {r.uri: r for r in pair_records(records).collect()}
    assert set(got) == {"http://h/é?x", "http://h/p", "http://h/q", "http://h/r"}
    posted = got["http://h/p"]
    assert bytes(posted.req_body) == EVERY_BYTE and bytes(posted.resp_body) == EVERY_BYTE
    assert posted.method == "POST" and posted.status == 404 and posted.ts == T0
    assert [tuple(h) for h in posted.resp_headers] == [
        ("content-type", "a"), ("CONTENT-TYPE", "b; c"), ("Content-Length", "256")]
    assert [tuple(h) for h in got["http://h/é?x"].req_headers] == [("A", "1"), ("A", "2")]
    assert bytes(got["http://h/q"].resp_body) == b"WARC/1.0\r\n"
    assert bytes(got["http://h/r"].resp_body) == b"\r\n\r\n" * 9
    assert bytes(got["http://h/r"].req_body) == b""


def test_shards_roll_over_and_overwrite(spark, folder):
    path = f"{folder}/w"
    calls = spark.range(40).select(
        F.col("id").alias("call_id"), F.lit(T0).alias("ts"), F.lit("GET").alias("method"),
        F.concat(F.lit("http://h/"), "id").alias("uri"),
        F.array().cast("array<struct<name:string,value:string>>").alias("req_headers"),
        F.lit(None).cast("binary").alias("req_body"), F.lit(200).alias("status"),
        F.array().cast("array<struct<name:string,value:string>>").alias("resp_headers"),
        F.lit(b"x" * 1000).alias("resp_body")).coalesce(1)
    warc.write_warc(calls, path, shard_bytes=8000)
    assert len(_shards(path)) > 3 and _shards(path) == sorted(os.listdir(path))
    info = warc.read_warc(spark, path).where("warc_type = 'warcinfo'")
    assert info.count() == len(_shards(path)) and info.where("offset > 0").isEmpty()
    index = cdx.cdx_index(warc.read_warc(spark, path, payload=False))
    assert index.count() == 40

    whole = f"{folder}/one"
    warc.write_warc(calls, whole)
    index = cdx.cdx_index(warc.read_warc(spark, whole, payload=False))
    points = warc.split_points(index, split_bytes=9000)
    assert len(points[_shards(whole)[0]]) > 3
    reader = warc.WarcReader(whole, points, True)
    parts = reader.partitions()
    rows = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    assert len(parts) > 4 and len(rows) == 81 and len({r["offset"] for r in rows}) == 81

    warc.write_warc(calls.limit(3), whole, mode="overwrite")
    assert warc.read_warc(spark, whole).where("warc_type = 'response'").count() == 3
    warc.write_warc(calls.limit(2), whole, mode="append")
    assert warc.read_warc(spark, whole).where("warc_type = 'response'").count() == 5


def test_failed_write_leaves_nothing(spark, folder):
    path = f"{folder}/w"
    bad = _cases(spark).coalesce(1).withColumn(
        "method", F.when(F.col("call_id") == 5, F.raise_error(F.lit("no"))).otherwise("GET"))
    with pytest.raises(Exception):
        warc.write_warc(bad, path)
    assert not os.path.exists(path) or _shards(path) == [] or all(
        n.startswith("_") for n in os.listdir(path))
    assert warc.read_warc(spark, path).isEmpty()


def test_cut_off_archive_is_an_error(spark, folder):
    path = f"{folder}/w"
    warc.write_warc(_cases(spark).coalesce(1), path)
    file = f"{path}/{_shards(path)[0]}"
    with open(file, "r+b") as handle:
        handle.truncate(os.path.getsize(file) - 3)
    with pytest.raises(Exception, match="cut off record"):
        warc.read_warc(spark, path).count()


def test_cdx(spark, folder):
    warc.write_warc(_cases(spark), f"{folder}/w")
    records = warc.read_warc(spark, f"{folder}/w", payload=False)
    cdx.write_cdx(cdx.cdx_index(records), f"{folder}/c")
    lines = [r.value for r in spark.read.text(f"{folder}/c").collect()]
    assert lines[0] == cdx.HEADER_LINE and len(lines) == 5
    assert all(len(line.split(" ")) == 11 for line in lines[1:])
    rows = {r.url: r for r in cdx.read_cdx(spark, f"{folder}/c").collect()}
    assert rows["http://h/p"].mime == "b" and rows["http://h/p"].status == "404"
    assert rows["http://h/q"].redirect == "http://h/z%20z" and rows["http://h/q"].mime == "-"
    assert rows["http://h/é?x"].digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    for row in rows.values():
        with open(f"{folder}/w/{row.filename}", "rb") as handle:
            handle.seek(row.offset)
            record = handle.read(row.length)
        assert record.startswith(b"WARC/1.0\r\nWARC-Type: response") and record.endswith(b"\r\n\r\n")


def test_store(spark, folder):
    path = f"{folder}/s"
    calls = _cases(spark)
    store.save_responses(calls.where("call_id < 3"), path)
    assert store.read_responses(spark, path).count() == 2
    changed = calls.withColumn("status", F.lit(299))
    store.save_responses(changed, path, clear=False)
    kept = {r.call_id: r.status for r in store.read_responses(spark, path).collect()}
    assert kept == {1: 200, 2: 404, 3: 299, 4: 299, 5: 299}
    store.save_responses(changed.where("call_id = 5"), path, clear=True)
    assert store.read_responses(spark, path).count() == 1
    store.clear_responses(spark, path)
    assert store.read_responses(spark, path).isEmpty()


def test_json_round_trip(spark):
    stored = _cases(spark).where("status is not null").withColumn(
        "request_key", F.col("call_id").cast("string"))
    lines = store.responses_to_json(stored)
    assert lines.where(F.col("json").contains("\n")).isEmpty()
    back = {r.request_key: r for r in store.responses_from_json(lines).collect()}
    for row in stored.collect():
        assert bytes(back[row.request_key].resp_body) == bytes(row.resp_body)
        assert back[row.request_key].resp_headers == row.resp_headers


def test_seeds(spark, folder):
    with open(f"{folder}/seeds.txt", "w") as handle:
        handle.write("http://A.com/x#f\nhttp://A.com/x#f\nnot a url\n")
    read = seeds.read_seeds(spark, f"{folder}/seeds.txt")
    assert seeds.seed_refs(read).count() == 3
    assert [r.host for r in seeds.seed_hosts(read).collect()] == ["A.com", "A.com"]


class CountingSink:
    seen = []

    def write(self, calls, opts):
        CountingSink.seen.append(calls.count())

    def close(self, spark, opts):
        CountingSink.seen.append("closed")


def test_sinks(spark, folder):
    calls = _cases(spark).where("status is not null")
    sinks.register_sink("counting", CountingSink)
    sinks.record(calls, CaptureOptions(), "counting")
    assert CountingSink.seen == [4, "closed"]
    opts = CaptureOptions(store_path=f"{folder}/s", warc_path=f"{folder}/w", cdx_path=f"{folder}/c")
    sinks.record(calls, opts)
    assert cdx.read_cdx(spark, f"{folder}/c").count() == 4
    with pytest.raises(TypeError):
        sinks.load_sink("collections:Counter")
    with pytest.raises(ValueError):
        sinks.record(calls, CaptureOptions(), "warc")
    assert sorted(r.line for r in call_log(calls).collect())[0] == "http://h/p <> 404"
    calls.write.parquet(f"{folder}/calls")
    assert read_calls(spark, f"{folder}/calls").count() == 4
