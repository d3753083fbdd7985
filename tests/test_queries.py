"""Every registered query against its oracle SQL in an independent engine."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from webstrata.plans.oracles import ORACLES
from webstrata.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("pages", "conversations", "events"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = _rows(columns, result.fetchall())
    assert _rows(df.columns, df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["t1_stream_record", "t1_stream_record_any_source",
                                  "t2_stream_shuffled"])
def test_arrivals_come_from_several_tasks(spark, monkeypatch, name):
    """No task writes a whole arrival, and each arrival is still one micro-batch."""
    from webstrata.plans import queries

    roots, make = [], queries.work_path
    monkeypatch.setattr(queries, "work_path",
                        lambda *args: roots.append(make(*args)) or roots[-1])
    merges = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merges, "false")  # tables this small would be written by one task
    try:
        QUERIES[name](spark, "/root/testdata/sf0.01")
    finally:
        spark.conf.set(merges, "true")
    files = spark.read.parquet(f"{roots[0]}/in").select("_metadata.file_path").distinct().count()
    assert files > 4
    commits = spark.read.text(f"{roots[0]}/state/commits").select(
        "_metadata.file_name").distinct().count()
    assert commits == 4
