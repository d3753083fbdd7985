"""Bodies stay where they lie: rows fetched by place, the store joined in its buckets."""

import contextlib
import datetime
import io
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webstrata.operators import dedup, late, lookups
from webstrata.sources import store
from webstrata.sources.calls import CALL_SCHEMA, read_calls

T0 = datetime.datetime(2024, 1, 1)


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def blocks(text: str, operator: str) -> list[str]:
    return [b for b in text.split("\n\n") if re.match(rf"\n*\(\d+\) \w*{operator}\b", b)]


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(3000):
        out.append((i, T0 + datetime.timedelta(seconds=(i * 37) % 900), "GET",
                    f"http://h/{i % 700 if i % 3 else 0}#f{i}", [], None,
                    None if i % 11 == 0 else 200 + i % 5, [], f"body {i}".encode()))
    return out + [(9000, None, "GET", "mailto:x", [], None, 200, [], b""),
                  (9001, None, "GET", None, [], None, 200, [], b"n"),
                  (9002, None, "POST", "http://h/0", [], b"p", 200, [], None)]


@pytest.fixture(scope="module")
def calls(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("calls"))
    spark.createDataFrame(rows, CALL_SCHEMA).repartition(5).write.mode("overwrite").parquet(path)
    return read_calls(spark, path)


def pick(df):
    return Counter((r.request_key, r.call_id, r.status, r.resp_body) for r in df.select(
        "request_key", "call_id", "status", "resp_body").collect())


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_winners_are_read_in_place(spark, calls, unbroadcast):
    once = dedup.dedup_call_files(calls)
    assert once.columns == dedup.dedup_calls(calls).select(*calls.columns, "request_key").columns
    assert pick(once) == pick(dedup.dedup_calls(calls))
    text = plan(once)
    assert "BroadcastHashJoin" in text
    assert not any("resp_body" in b for b in blocks(text, "Exchange"))


def test_places_in_groups_of_files(spark, calls):
    places = late.with_place(calls).where("call_id % 7 = 3").select(*late.PLACE)
    want = {r.call_id for r in calls.where("call_id % 7 = 3").collect()}
    for size in (4400, 9000, 1 << 30):
        found = late.fetch(calls, places, size)
        assert found.columns == calls.columns
        assert Counter(r.call_id for r in found.collect()) == Counter(want)
    assert late.fetch(calls, places.where("row_index < 0")).isEmpty()
    assert not late.has_place(spark.range(3)) and late.has_place(calls)
    assert not late.has_place(calls.groupBy("call_id").count())


def test_rows_of_long_files(spark, folder):
    spark.range(100_000).coalesce(1).selectExpr("id", "id * 2 AS twice").write.parquet(folder + "/t")
    source = spark.read.parquet(folder + "/t")
    wanted = "id % 1000 = 7 or id in (0, 32767, 32768, 65535, 65536, 99999)"
    places = late.with_place(source).where(wanted).select(*late.PLACE)
    got = [r.id for r in late.fetch(source, places).collect()]
    assert sorted(got) == [r.id for r in source.where(wanted).orderBy("id").collect()]


@pytest.fixture(scope="module")
def stored(spark, calls, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store")) + "/s"
    store.save_responses(calls.where("call_id < 2000"), path, buckets=4)
    return path


def test_store_in_buckets(spark, calls, stored):
    assert pick(store.read_responses(spark, stored)) == pick(
        dedup.dedup_calls(calls.where("call_id < 2000")))
    assert store.store_buckets(spark, stored) == 4
    assert not [t.name for t in spark.catalog.listTables() if "webstrata_store" in t.name]
    files = store.read_responses(spark, stored).select(
        F.spark_partition_id().alias("p"), F.pmod(F.hash("request_key"), F.lit(4)).alias("b")).distinct()
    assert files.count() == 4


@pytest.mark.parametrize("hot", [False, True])
def test_lookup_leaves_the_store_in_place(spark, calls, stored, unbroadcast, hot):
    keyed = dedup.with_request_key(calls).select("call_id", "request_key")
    if not hot:  # page 0 has a third of the requests
        keyed = keyed.dropDuplicates(["request_key"])
    held = store.read_responses(spark, stored)
    found = lookups.lookup_stored(keyed, held, 4)
    plain = lookups.lookup_responses(keyed, held)
    names = ["call_id", "request_key", "is_hit", "stored_status", "stored_body"]
    assert found.columns == plain.columns
    assert Counter(found.select(names).collect()) == Counter(plain.select(names).collect())
    gone = lookups.uncached_stored(keyed, held, 4)
    assert Counter(gone.collect()) == Counter(lookups.uncached_requests(keyed, held).collect())
    if not hot:
        text = plan(found)
        assert "ShuffledHashJoin" in text and "Bucketed: true" in text
        for operator in ("Exchange", "Sort"):
            assert not any("resp_body" in b or "stored_body" in b for b in blocks(text, operator))


def test_append_keeps_the_store_in_place(spark, calls, stored, unbroadcast, folder):
    text = plan(dedup.first_places(calls, store.read_responses(spark, stored), 4))
    assert "Bucketed: true" in text
    scan = re.search(r"\((\d+)\) Scan parquet spark_catalog\S+\nOutput \[\d+\]: \[(request_key#\d+)", text)
    assert scan and not any(f"[{scan.group(2)}]" in b for b in blocks(text, "Exchange") + blocks(text, "Sort"))
    # Appending twice changes nothing the second time; the buckets stay.
    path = f"{folder}/s"
    store.save_responses(calls.where("call_id < 2000"), path, buckets=3)
    for _ in range(2):
        store.save_responses(calls, path, clear=False)
        assert store.store_buckets(spark, path) == 3
        assert store.read_responses(spark, path).count() == first_keys(calls)
    store.rebucket(spark, path, f"{folder}/wide", 7)
    assert pick(store.read_responses(spark, f"{folder}/wide")) == pick(store.read_responses(spark, path))
    store.clear_responses(spark, path)
    assert store.read_responses(spark, path).isEmpty() and store.store_buckets(spark, path) == 3


def first_keys(calls):
    return dedup.first_calls(calls).count()


def test_bodies_move_once_into_the_store(spark, calls, folder, unbroadcast):
    winners = dedup.first_places(calls)
    rows = dedup.with_request_key(late.fetch(calls, winners)).repartition(3, "request_key")
    moved = [b for b in blocks(plan(rows), "Exchange") if "resp_body" in b]
    assert len(moved) == 1
