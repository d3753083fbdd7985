"""Archives in ranges, compressed, and broken."""

import datetime
import gzip
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webstrata.operators.lookups import pair_records
from webstrata.options import CaptureOptions
from webstrata.sources import cdx, warc
from webstrata.sources.calls import CALL_SCHEMA
from webstrata.sources.sinks import WarcSink

T0 = datetime.datetime(2024, 5, 6, 7, 8, 9, 123000)
INNER = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.fixture(scope="module")
def calls(spark):
    rows = [(i, T0, "POST" if i % 9 == 0 else "GET", f"http://h/é{i}", [("A", "1")], b"sent",
             200 + i % 7, [("X", "y")], (INNER if i % 5 == 0 else bytes(range(256))) * (i % 23))
            for i in range(300)]
    return spark.createDataFrame(rows, CALL_SCHEMA)


def pick(records):
    return Counter((r.warc_type, r.record_id, r.concurrent_to, r.target_uri, r.http_method,
                    r.http_status, r.payload, r.payload_digest) for r in records.collect())


@pytest.mark.parametrize("compress", [False, True])
def test_ranges_read_each_record_once(spark, calls, folder, compress):
    path, plain = f"{folder}/a b", f"{folder}/plain"
    warc.write_warc(calls.coalesce(2), path, compress=compress)
    warc.write_warc(calls.coalesce(2), plain)
    whole = warc.read_warc(spark, path)
    names = os.listdir(path)
    assert len(names) == 2 and all(n.endswith(".warc.gz" if compress else ".warc") for n in names)
    calls_only = F.col("warc_type") != "warcinfo"
    assert pick(whole.where(calls_only)) == pick(warc.read_warc(spark, plain).where(calls_only))
    if compress:  # other tools read the shards as gzip files
        with gzip.open(f"{path}/{names[0]}") as shard:
            assert shard.read().count(b"WARC-Type: warcinfo") == 1
    index = f"{folder}/index"
    warc.write_offsets(cdx.cdx_index(warc.read_warc(spark, path, payload=False)), index, 3000)
    for split in (64, 4096, 1 << 20):
        ranges = warc.read_warc(spark, path, index=index, split_bytes=split)
        parts = ranges.rdd.getNumPartitions() if split > 64 else 0
        assert split > 4096 or split == 64 or parts > (10 if compress else 100)
        if split > 64:
            got = ranges.select("filename", "offset", "length", "record_id").collect()
            assert Counter(got) == Counter(whole.select(
                "filename", "offset", "length", "record_id").collect())
    assert pick(warc.read_warc(spark, path, index=index, split_bytes=9000)) == pick(whole)
    assert pair_records(warc.read_warc(spark, path, index=index, split_bytes=5000)).count() == 300
    # A shard the index does not know is walked from its start.
    os.remove(f"{index}/{names[0]}.idx")
    assert pick(warc.read_warc(spark, path, index=index, split_bytes=20_000)) == pick(whole)


@pytest.mark.parametrize("compress", [False, True])
def test_broken_shards(spark, calls, folder, compress):
    path = f"{folder}/w"
    warc.write_warc(calls.coalesce(1), path, compress=compress)
    name = os.listdir(path)[0]
    count = warc.read_warc(spark, path).count()
    with open(f"{path}/{name}", "r+b") as handle:
        handle.truncate(os.path.getsize(f"{path}/{name}") - 3)
    with pytest.raises(Exception, match="cut off record"):
        warc.read_warc(spark, path).count()
    kept = warc.read_warc(spark, path, strict=False)
    assert kept.count() == count
    broken = kept.where(F.col("warc_type") == warc.BROKEN).collect()
    assert len(broken) == 1 and "cut off record" in broken[0].record_id
    # The index of an archive is built from what can be read.
    opts = CaptureOptions(warc_path=path, cdx_path=f"{folder}/cdx")
    WarcSink().close(spark, opts)
    assert cdx.read_cdx(spark, opts.cdx_path).count() == 299
    if not compress:  # bytes of a plain payload are what they are
        return
    with open(f"{path}/{name}", "r+b") as handle:
        handle.seek(os.path.getsize(f"{path}/{name}") // 2)
        handle.write(b"\0" * 700)
    with pytest.raises(Exception, match="record|member"):
        warc.read_warc(spark, path).count()
    assert 0 < warc.read_warc(spark, path, strict=False).count() < count


def test_members_of_several_records_are_refused(spark, folder):
    record = warc._record("warcinfo", "<urn:x>", "2024-01-01T00:00:00Z", "a/b", b"x", [])
    os.makedirs(f"{folder}/w")
    with open(f"{folder}/w/one.warc.gz", "wb") as handle:
        handle.write(gzip.compress(record) + gzip.compress(record + record))
    with pytest.raises(Exception, match="not one record"):
        warc.read_warc(spark, f"{folder}/w").count()
    assert warc.read_warc(spark, f"{folder}/w", strict=False).count() == 2


@pytest.mark.parametrize("compress", [False, True])
def test_small_ranges_share_tasks(spark, calls, folder, compress, monkeypatch):
    path, index = f"{folder}/w", f"{folder}/index"
    warc.write_warc(calls.coalesce(2), path, compress=compress)
    warc.write_offsets(warc.read_warc(spark, path, payload=False), index, 64)
    monkeypatch.setattr(warc, "TASKS", 5)

    def read(kind, split, **options):
        reader = kind(path, {}, True, index, split, **options)
        parts = reader.partitions()
        return parts, [r for part in parts for b in reader.read(part) for r in b.to_pylist()]

    whole = read(warc.WarcReader, 1 << 30)
    for split in (64, 500):
        parts, rows = read(warc.WarcReader, split)
        assert len(parts) <= 8 and sum(len(part.cuts) for part in parts) > 50
        assert sorted(map(str, rows)) == sorted(map(str, whole[1]))
        # Borders between ranges part exchanges within a task as they did between tasks.
        monkeypatch.setattr(warc, "TASKS", 1 << 40)
        own, places = read(warc.ExchangeReader, split, heads=True)
        monkeypatch.setattr(warc, "TASKS", 5)
        assert len(own) > 50 and sorted(map(str, places)) == sorted(map(str, read(
            warc.ExchangeReader, split, heads=True)[1]))
        assert any(r["warc_type"] == "response" for r in places)
    # A broken record ends its range, not its task.
    shard = next(p.path for p in read(warc.WarcReader, 500)[0])
    with open(shard, "r+b") as handle:
        handle.seek(os.path.getsize(shard) // 2)
        handle.write(b"\0" * 700)
    kept = read(warc.WarcReader, 500, strict=False)[1]
    broken = [r for r in kept if r["warc_type"] == warc.BROKEN]
    name = os.path.basename(shard)
    last = max(r["offset"] for r in whole[1] if r["filename"] == name)
    if compress:  # bytes of a plain payload are what they are
        assert broken
    assert any(r["filename"] == name and r["offset"] == last for r in kept)
