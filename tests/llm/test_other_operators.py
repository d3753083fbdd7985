"""Vectors, archives, the pipeline and the queries of the folder."""

from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from webstrata.llm import archive, embeddings
from webstrata.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(result.fetchall())
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == want


def test_vectors_against_brute_force(spark):
    random = np.random.default_rng(7)
    centre = random.normal(size=16)
    vectors = [centre + random.normal(size=16) * 0.12 for _ in range(700)]  # several blocks
    vectors += [random.normal(size=16) for _ in range(60)]
    vectors += [vectors[3], vectors[3] * 2]
    rows = [(i, v.tolist(), i % 2 if i < 760 else 1) for i, v in enumerate(vectors)]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [1.0, None], 1), (9003, [float("nan")], 1),
           (9004, vectors[0].tolist(), None), (None, vectors[0].tolist(), 1), (9005, [1.0], 1),
           (9006, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.link_vectors(df).collect()}
    units = np.array([v / np.linalg.norm(v) for v in vectors])
    labels = np.array([r[2] for r in rows])
    near = (units @ units.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    reach = np.arange(len(rows))
    for _ in range(len(rows)):
        after = np.array([min(reach[i], *reach[near[i]]) if near[i].any() else reach[i]
                          for i in range(len(rows))])
        if (after == reach).all():
            break
        reach = after
    assert [got[i]["n_links"] for i in range(len(rows))] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(rows))] == reach.tolist()
    for vec_id, _, _ in odd:
        assert got[vec_id]["n_links"] == 0 and got[vec_id]["kept"]
        assert got[vec_id]["component_id"] == vec_id


def test_archive(spark, folder):
    big, inner = "b" * 1500, "x" * 900 + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello"
    pages = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "u", inner * 3),
             (5, "u", None), (6, "u", ""), (7, "u", "small"), (8, "u", "small"), (9, "u", inner * 3),
             (None, "u", big), (3, "again", big), (10, "u", "é" * 400 + "WARC/1.0\r\n")]
    df = spark.createDataFrame([(*p, "old") for p in pages],
                               "page_id bigint, url string, html string, record_type string")
    archive.write_archive(df.repartition(2), f"file://{folder}/a")
    for size in (64, 700, 1 << 20):
        rows = archive.read_archive(spark, f"file://{folder}/a", range_bytes=size).collect()
        got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"],
                       None if r["payload"] is None else r["payload"].decode()) for r in rows)
        want = Counter()
        for page_id, _, html in pages:
            revisit = {big: 3, inner * 3: 9}.get(html)
            if revisit == page_id:
                revisit = None
            want[(page_id, len((html or "").encode()), "revisit" if revisit else "response", revisit,
                  None if revisit else html or "")] += 1
        assert got == want
    archive.write_archive(df.where("page_id = -1"), f"file://{folder}/none")
    assert archive.read_archive(spark, f"file://{folder}/none").count() == 0


def test_broken_archive_is_an_error(spark, folder):
    df = spark.createDataFrame([(i, "u", "text " * 50) for i in range(20)],
                               "page_id bigint, url string, html string")
    archive.write_archive(df.coalesce(1), f"file://{folder}/a")
    import glob
    part = glob.glob(f"{folder}/a/part-*")[0]
    data = open(part, "rb").read()
    with open(f"{folder}/cut.warc", "wb") as out:
        out.write(data[:-30])
    with pytest.raises(ValueError):
        archive.read_archive(spark, f"file://{folder}/cut.warc")
    kept = archive.read_archive(spark, f"file://{folder}/cut.warc", strict=False)
    assert kept.count() == 19


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SF_DIR).cache()
        assert kept.columns == columns
        if name in ("substrings", "secrets"):
            assert kept.count() == before
        assert kept.where("n_chars <> length(text)").count() == 0
    assert kept.where("text rlike 'token = \"[0-9a-f]{40}'").count() == 0
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert {r[0] for r in rows.select("doc_id").distinct().collect()} == {
        r[0] for r in kept.select("doc_id").collect()}


def test_pipeline_near_copies_with_repeated_and_missing_ids(spark):
    def words(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [(1, words("a")), (1, words("b")), (1, words("a")), (2, words("a") + " more"),
            (None, words("c")), (None, words("c")), (None, words("b")), (None, words("d")),
            (3, None), (3, None), (4, ""), (None, None), (5, words("e")), (5, words("e"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = Counter([(1, words("a")), (1, words("b")), (None, words("c")), (None, words("d")),
                    (3, None), (4, ""), (None, None), (5, words("e"))])
    for given in (docs.repartition(5), docs.orderBy(docs.text.desc()).coalesce(1)):
        kept = corpus_pipeline.drop_near_copies(spark, given, SF_DIR)
        assert Counter(map(tuple, kept.collect())) == want
