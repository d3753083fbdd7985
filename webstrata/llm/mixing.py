"""Mixing sources to target weights: Efraimidis-Spirakis sampling within token budgets.

Sources share a total by weight; no target exceeds `MAX_EPOCHS` times its source's size, and what
is cut off goes to the others by weight. A source gives its complete epochs first. The rest
of its budget is a weighted sample: a document's key is exponential, ``-ln(u) / quality``, with
u drawn from its content and the seed, so reruns agree; documents are taken by ascending key
until their sizes fill the budget, the last one as far as the budget reaches.

Size is the number of words `[^\\x20\\x09-\\x0D]+`. Quality is, unless a column names it, the share of
letters in the words times the share of lines that differ, above a floor. A null text has no
words and is taken 0 times; null sources are one source and come last; equal rows have equal
keys, and which of them comes first makes no difference. Equal keys of different rows fall back on
doc_id and content. Empty tables give no rows. Columns of the input that clash with outputs give
way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.frames import others
from webstrata.llm.ordering import running
from webstrata.operators.ordered import lay_out
from webstrata.operators.skew import salted_lookup
from webstrata.session import cut_lineage

SHARE = 1.5
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 2
SEED = 13
FLOOR = 0.05
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def text_quality(text: Column) -> Column:
    """Between `FLOOR` and 1: share of letters in the words, times the share of distinct lines."""
    text = F.coalesce(text, F.lit(""))
    packed = F.regexp_replace(text, _SPACE, "")
    letters = F.length(packed) - F.length(F.regexp_replace(packed, r"\p{L}+", ""))
    lines = F.split(text, "\n", -1)
    return (F.lit(FLOOR) + (1 - FLOOR) * letters / F.greatest(F.length(packed), F.lit(1))
            * F.size(F.array_distinct(lines)) / F.size(lines))


def uniform(parts: list[Column], seed: int) -> Column:
    """A number above 0 and below 1, from the content of ``parts``."""
    shown = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
             for c in (part.cast("string") for part in parts)]
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed};"), *shown)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source_key, source_size) with ``target``.

    Sources of any number: they are numbered over a range layout, and each sharing is one
    aggregate of the narrow table. The level all others get only rises as sources reach their
    cap, so the sharing ends when the set of capped ones stays.
    """
    laid = lay_out(sizes.withColumn("all_sources", F.lit("")), ["all_sources"], ["source_key"])
    numbered = running(laid, "all_sources", ["source_key"], before="number", total="sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]),
                   (F.col("number") % len(weights)).cast("int"))
    shares = cut_lineage(numbered.select(
        "source_key", "source_size", weight.alias("weight"),
        (F.col("source_size") * max_epochs).cast("double").alias("cap")))
    total = shares.agg((F.sum("source_size") * share).cast("double")).first()[0] or 0.0
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        held, left, count = shares.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight"))),
            F.count(F.when(full, 1))).first()
        if count == capped or not left:
            break
        level, capped = (total - held) / left, count
    target = F.least("cap", F.lit(level) * F.col("weight"))
    return shares.select("source_key", "source_size",
                         (F.when(F.lit(bool(left)), target).otherwise(F.col("cap"))).alias("target"))


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS,
        max_epochs: int = MAX_EPOCHS, quality: str | None = None, seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target and taken, the words the mix takes.

    ``taken`` counts repeats: ``size`` per complete epoch, and what the sample takes besides.
    Texts are read once; what is ranked and summed is narrow.
    """
    names = ["size", "source_size", "target", "taken"]
    kept = [c for c in others(docs, names) if c.lower() != "text"]
    text = F.col("text")
    worth = text_quality(text) if quality is None else F.greatest(
        F.coalesce(F.col(quality).cast("double"), F.lit(0.0)), F.lit(1e-9))
    # Null sources come last: "=" and a code point sort before "~".
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))
    digest = F.md5(F.coalesce(text, F.lit("")))
    narrow = docs.select(
        F.struct(*kept).alias("row"), key.alias("source_key"), word_count(text).alias("size"),
        F.col("doc_id").alias("doc_id"), digest.alias("digest"), worth.alias("worth"))
    draw = uniform([F.col("doc_id"), F.col("source_key"), F.col("digest")], seed)
    narrow = cut_lineage(narrow.withColumn("draw", -F.ln(draw) / F.col("worth")).drop("worth"))
    sizes = narrow.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, share, weights, max_epochs)
    order = ["draw", "doc_id", "digest"]
    ranked = running(lay_out(narrow, ["source_key"], order), "source_key", order, "size").drop("total")
    budget = salted_lookup(ranked, targets, "source_key", ["doc_id", "draw"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
                   ).otherwise(0).cast("bigint")
    rest = F.floor(F.col("target") - whole * F.col("source_size")).cast("bigint")
    sampled = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = F.col("size") * whole + sampled
    return budget.select("row.*", "size", "source_size", "target",
                         taken.cast("bigint").alias("taken"))
