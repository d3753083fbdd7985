"""Training corpus in five stages, each over all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which `run` writes as Parquet and rereads as the next one's docs. All but the last return
the columns of ``docs``, whatever their names. Work tables go when a stage's result is written, and
that result when the next one's is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm import minhash, packing, secrets, substrings, toxicity
from webstrata.session import cut_lineage, delete_path, temporary_tables, work_path

INPUTS = ("doc_id", "text")


def _wrapped(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text and a struct of the other columns, whose names thus meet no others."""
    others = [F.col(f"`{name}`") for name in docs.columns if name not in INPUTS]
    return docs.select(*INPUTS, F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))


def _unwrapped(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The ``columns`` of a wrapped table again, some of them ``changed``."""
    return df.select(*[
        changed.get(name, F.col(name) if name in INPUTS else F.col("rest").getField(name)).alias(name)
        for name in columns])


def _with_text(df: DataFrame, text: str, changed: Column, columns: list[str]) -> DataFrame:
    """A wrapped table with ``text`` as its text where ``changed``, and n_chars to match."""
    body = F.when(changed, F.col(text)).otherwise(F.col("text"))
    new = {"text": body}
    if "n_chars" in columns:
        new["n_chars"] = F.when(changed, F.length(body).cast("bigint")).otherwise(
            F.col("rest").getField("n_chars"))
    return _unwrapped(df, columns, **new)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unwrapped(toxicity.score(_wrapped(docs), model).where("predicted = 0"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest doc_id.

    Rows are compared one by one, whether doc_ids repeat or are missing. Texts without words
    are no copies of each other, but those of one doc_id are.
    """
    # Written, so that a row has the same key in each pass.
    row = F.monotonically_increasing_id().alias("_row")
    keyed = cut_lineage(_wrapped(docs).select("*", row))
    linked = minhash.link(keyed.select(F.col("_row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("_row"), "component_id", "n_shingles")
    ranked = keyed.select("_row", F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id",
        F.xxhash64(*INPUTS, "rest").alias("tie"), "_row").alias("_rank"))
    wordless = (F.col("n_shingles") == 0) & F.col("_rank.doc_id").isNotNull()
    kept = (linked.join(ranked, "_row")
            .groupBy(wordless.alias("wordless"),
                     F.when(wordless, F.col("_rank.doc_id").cast("bigint")).otherwise(
                         F.col("component_id")).alias("group"))
            .agg(F.min("_rank").alias("_rank")).select("_rank._row"))
    return _unwrapped(keyed.join(kept, "_row", "left_semi"), docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat anywhere are cut out; other texts stay as they are."""
    cut = substrings.remove_repeats(_wrapped(docs))
    return _with_text(cut, "kept_text", F.col("n_removed") > 0, docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    found = secrets.scan(_wrapped(docs), secrets.fit(docs))
    return _with_text(found, "redacted", F.col("spans") != "", docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, placed in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_copies),
    ("substrings", drop_repeats),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]

# SQL cannot express the classifiers and the tokenizer; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
