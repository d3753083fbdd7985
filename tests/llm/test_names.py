"""Columns of the caller whose names an operator or stage uses inside."""

import pytest

import corpus_pipeline
from webstrata.llm import quality, substrings

NAMES = ["_id", "_hash", "_body", "_doc", "_key", "_spans", "_text", "_words", "_hashes", "_lines",
         "_windows", "_sorted", "_row", "_rank", "rest", "score", "predicted", "spans", "redacted",
         "n_words", "n_removed", "kept_text", "component_id", "kept"]


def _docs(spark, names):
    passage = " ".join(f"w{i}" for i in range(50))
    tail = [" ".join(f"{c}{i}" for i in range(60)) for c in "xy"]
    texts = [f"{passage} {tail[0]}", f"{tail[1]} {passage}", "token = abcdefgh12345678", "", None,
             "one two three four five six", "one two three four five six"]
    rows = [(i, t, len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    schema = ["doc_id bigint", "text string", "n_chars bigint", *[f"`{n}` string" for n in names]]
    return spark.createDataFrame(rows, ", ".join(schema))


def _same(got, names):
    for row in got:
        assert [row[n] for n in names] == [f"{n}{row['doc_id']}" for n in names]


@pytest.mark.parametrize("run, own", [
    (substrings.remove_repeats, {"n_words", "n_removed", "kept_text"}),
    (quality.apply_rules, {"n_words", "kept"})])
def test_operators_keep_other_columns(spark, run, own):
    names = [n for n in NAMES if n not in own]
    got = run(_docs(spark, NAMES)).collect()
    assert len(got) == 7
    _same(got, names)


def test_stages_keep_every_column(spark, folder):
    docs = _docs(spark, NAMES)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {"toxicity": 7, "minhash": 6, "substrings": 7, "secrets": 7}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema
        got = out.collect()
        assert len(got) == left[name]
        _same(got, NAMES)
        for row in got:
            assert row["n_chars"] == len(row["text"] or "")
    assert "abcdefgh" not in next(r["text"] for r in got if r["doc_id"] == 2)
