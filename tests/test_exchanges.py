"""Exchanges paired where they lie, and archives published by commits."""

import datetime
import gzip
import os
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webstrata.operators.lookups import pair_records
from webstrata.sources import warc
from webstrata.sources.calls import CALL_SCHEMA

T0 = datetime.datetime(2024, 5, 6, 7, 8, 9, 123000)
COLUMNS = ["record_id", "ts", "method", "uri", "req_body", "status", "resp_body"]


@pytest.fixture(scope="module")
def calls(spark):
    rows = [(i, T0, "POST" if i % 9 == 0 else "GET", f"http://h/{i}", [("A", "1")], b"sent",
             200 + i % 7, [("X", "y")], bytes(range(256)) * (i % 23)) for i in range(200)]
    return spark.createDataFrame(rows, CALL_SCHEMA).coalesce(2)


def rows_of(df):
    return Counter(map(tuple, df.select(COLUMNS).collect()))


def record(kind, number, asked=None, body=b"x"):
    first = b"GET /a HTTP/1.1" if kind == "request" else b"HTTP/1.1 200 OK"
    extra = [("WARC-Target-URI", f"http://h/{number}")]
    if asked is not None:
        extra.append(("WARC-Concurrent-To", asked))
    return warc._record(kind, f"<{kind}{number}>", "2024-01-01T00:00:00Z",
                        f"application/http; msgtype={kind}", first + b"\r\n\r\n" + body, extra)


@pytest.mark.parametrize("compress", [False, True])
def test_exchanges_equal_the_join_of_records(spark, calls, folder, compress):
    path, index = f"{folder}/w", f"{folder}/index"
    warc.write_warc(calls, path, compress=compress)
    want = rows_of(pair_records(warc.read_warc(spark, path)))
    assert sum(want.values()) == 200
    assert rows_of(warc.read_exchanges(spark, path)) == want
    warc.write_offsets(warc.read_warc(spark, path, payload=False), index, 1000)
    for split in (700, 5000):  # borders between a request and its response, and within records
        assert rows_of(warc.read_exchanges(spark, path, index, split)) == want


def test_requests_elsewhere(spark, folder, monkeypatch):
    os.makedirs(f"{folder}/w")
    with open(f"{folder}/w/a.warc", "wb") as out:
        out.write(record("response", 1, "<request1>")           # before its request
                  + record("request", 1) + record("request", 2)
                  + record("response", 3, "<request2>") + record("response", 4, "<request2>")
                  + record("response", 5, "<request9>")         # in the other shard
                  + record("response", 6, "<nowhere>") + record("response", 7)
                  + record("request", 8, body=b"late"))
    with open(f"{folder}/w/b.warc", "wb") as out:
        out.write(record("request", 9, body=b"nine") + record("request", 8, body=b"later"))
    got = warc.read_exchanges(spark, f"{folder}/w").collect()
    assert sorted((r.record_id, r.req_body) for r in got) == [
        ("<response1>", b"x"), ("<response3>", b"x"), ("<response4>", b"x"), ("<response5>", b"nine")]
    assert all(r.method == "GET" and r.status == 200 and r.resp_body == b"x" for r in got)
    one = warc.read_exchanges(spark, f"{folder}/w/a.warc").collect()
    assert sorted(r.record_id for r in one) == ["<response1>", "<response3>", "<response4>"]


def test_pending_requests_are_bounded_alike_in_both_walks():
    pending, heads = warc._Pending(), warc._Pending()
    limit = warc.PENDING_BYTES
    for number, size in enumerate([limit // 2, limit // 3, limit // 3, 10, limit * 2, 5]):
        pending.put(f"r{number}", ("fields", b"block"), size)
        heads.put(f"r{number}", ("fields", b""), size)
        held = [k for k in range(6) if pending.get(f"r{k}")]
        assert held == [k for k in range(6) if heads.get(f"r{k}")]
        assert number in held
    assert held == [5]


def test_broken_and_empty_archives(spark, calls, folder):
    path = f"{folder}/w"
    os.makedirs(path)
    assert warc.read_exchanges(spark, path).count() == 0
    warc.write_warc(calls.coalesce(1), path)
    name = f"{path}/{os.listdir(path)[0]}"
    with open(name, "r+b") as handle:
        handle.truncate(os.path.getsize(name) - 3)
    with pytest.raises(Exception, match="cut off record"):
        warc.read_exchanges(spark, path).count()
    assert warc.read_exchanges(spark, path, strict=False).count() == 199


def test_no_body_is_exchanged(spark, calls, folder):
    warc.write_warc(calls, f"{folder}/w")
    df = warc.read_exchanges(spark, f"{folder}/w")
    plan = df._jdf.queryExecution().optimizedPlan()
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "resp_body" in plan.toString()
    blocks = [b for b in text.split("\n\n") if "Exchange" in b.split("\n", 1)[0]]
    assert blocks and not any("body" in b for b in blocks)


def shards(path):
    return [n for n in os.listdir(path) if not n.startswith("_")]


def test_commits_publish_at_once(spark, calls, folder, monkeypatch):
    path = f"{folder}/w"
    warc.write_warc(calls.where("call_id < 50"), path, commits=True)
    warc.write_warc(calls.where("call_id >= 150"), path)  # the archive has commits
    assert warc.read_exchanges(spark, path).count() == 100
    # Files of failed tasks and of a job that ends before its commit are not read.
    with open(f"{path}/part-000000-0000-dead-1-x.warc", "wb") as out:
        out.write(b"WARC/1.0\r\nhalf")
    failing = calls.where("call_id < 90").withColumn("status", F.when(
        F.col("call_id") == 80, F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="lost"):
        warc.write_warc(failing, path, mode="overwrite")
    assert warc.read_warc(spark, path).where("warc_type = 'response'").count() == 100
    # A job written again replaces what it left; others stay.
    warc.write_warc(calls.where("call_id between 50 and 99"), path, job="batch7")
    warc.write_warc(calls.where("call_id between 50 and 59"), path, job="batch7", compress=True)
    assert warc.read_exchanges(spark, path).count() == 110
    before = rows_of(warc.read_exchanges(spark, path))
    assert warc.clean_archive(path) >= 2
    assert rows_of(warc.read_exchanges(spark, path)) == before
    assert len(os.listdir(f"{path}/_commits")) == 1
    warc.write_warc(calls.where("call_id = 5"), path, job="batch7")  # known after cleaning as well
    assert warc.read_exchanges(spark, path).count() == 101
    warc.write_warc(calls.where("call_id < 3"), path, mode="overwrite")
    assert warc.read_exchanges(spark, path).count() == 3
    assert warc.clean_archive(path) >= 3 and warc.clean_archive(path) == 0
    os.remove(f"{path}/{shards(path)[0]}")
    with pytest.raises(Exception, match="missing"):
        warc.read_warc(spark, path).count()


def test_commits_adopt_older_shards(spark, calls, folder):
    path = f"{folder}/w"
    warc.write_warc(calls.where("call_id < 50"), path)
    assert warc.clean_archive(path) == 0
    warc.write_warc(calls.where("call_id >= 50"), path, commits=True)
    assert warc.read_exchanges(spark, path).count() == 200


def test_commit_files_are_whole(folder):
    log = warc._Commits(folder)
    assert log.jobs() is None and not log.exist()
    log.add({"a": ["1"], "b": ["2"]}, alone=False)
    with open(f"{folder}/_commits/_000000000001-x.json", "w") as out:
        out.write('{"alone": tr')  # a writer that died
    log.add({"a": ["3"]}, alone=False)
    assert log.jobs() == {"a": ["3"], "b": ["2"]}
    log.add({"c": []}, alone=True)
    assert log.jobs() == {"c": []}


@pytest.mark.parametrize("compress", [False, True])
def test_small_records_take_little_memory(folder, compress):
    """Of many small records, or requests packed small, a task holds a bounded share."""
    path, n = f"{folder}/w.warc" + ".gz" * compress, 300 if compress else 12000
    sent = [{"name": f"h{k}", "value": str(k)} for k in range(5)]
    with open(path, "wb") as out:
        for i in range(n):
            call = {"call_id": i, "ts": T0, "method": "POST", "uri": f"http://h/{i}", "status": 200,
                    "req_headers": sent, "req_body": b"q" * (300_000 if compress else 9),
                    "resp_headers": sent, "resp_body": b"ok"}
            for one in warc.call_records(call):
                out.write(gzip.compress(one, 1) if compress else one)
    whole = warc._Ranges(path, (0,), os.path.getsize(path))
    assert sum(b.num_rows for b in warc.WarcReader(path, {}, False).read(whole)) == 2 * n  # imports
    for reader, rows in ((warc.ExchangeReader(path, {}, True), n), (warc.WarcReader(path, {}, True), 2 * n),
                         (warc.ExchangeReader(path, {}, True, heads=True), n)):
        got = 0
        tracemalloc.start()
        try:
            for batch in reader.read(whole):
                got += batch.num_rows
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert got == rows
        assert peak < (warc.PENDING_BYTES + (8 << 20) if compress else 24 << 20)
