"""Quality rules: a threshold table compiled into one projection of native functions.

Words are longest runs of characters other than the space and U+0009-U+000D. Every metric is a
column expression, every rule a comparison; no user function runs. A null text counts as
empty. Repeated rows are judged one by one; ties do not arise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.frames import free_names, others

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Common function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with this be at from or an not by a",
    "der die das und ist nicht von den zu mit sich auf ein eine im dem als auch es an",
    "de la le les et des en un une du que est pour dans qui par sur au pas il",
    "el los las y del se por con para una su al lo como no es un que la de",
)


@dataclass(frozen=True)
class Rule:
    """A text fails if ``metric`` lies outside ``least``..``most``; base rules decide alone."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    base: bool = False


# The threshold table: metrics are expressions over the columns that `measure` adds.
RULES = (
    Rule("words", "n_words", least=20, base=True),
    Rule("repeats", "100 * n_repeat_words - 30 * n_words", most=0, base=True),
    Rule("word_length", "word_chars / nullif(n_words, 0)", least=2, most=14),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", most=0.3),
    Rule("stop_words", "n_stop_words / nullif(n_words, 0)", least=0.01),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", most=0.5),
)


def _window_hashes(hashes: Column, count: Column) -> Column:
    """Hashes of all runs of WINDOW words, a power of two, by joining runs of half the size."""
    width = 1
    while width < WINDOW:
        hashes = F.zip_with(hashes, F.slice(hashes, width + 1, count.cast("int")),
                            lambda x, y: F.xxhash64(x, y))
        width *= 2
    return F.slice(hashes, 1, count.cast("int") - (WINDOW - 1))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the metrics; columns of the same names give way."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
             "n_stop_words", "max_word_chars"]
    stop = sorted({form for line in STOP_WORDS for word in line.split()
                   for form in (word, word.capitalize())})
    whole, words, hashes, lines_, windows, ordered = free_names(
        docs, "_text", "_words", "_hashes", "_lines", "_windows", "_sorted")
    kept = [F.col(f"`{c}`") for c in others(docs, names)]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    split = docs.select(*kept, body.alias(whole),
                        F.array_remove(F.split(body, "[ \\t-\\r]+"), "").alias(words))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    first = split.select(
        *kept, F.transform(words, lambda x: F.xxhash64(x)).alias(hashes),
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.when(F.col(whole).rlike(f"[{SYMBOLS}]"),
               F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")))
        .otherwise(0).cast("bigint").alias("n_symbols"), lines.alias(lines_))
    second = first.select(
        *kept, "n_words", "word_chars", "n_symbols",
        F.size(lines_).cast("bigint").alias("n_lines"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("bigint")
        .alias("n_dup_lines"),
        F.size(F.filter(hashes, lambda x: x.isin([F.xxhash64(F.lit(w)) for w in stop])))
        .cast("bigint").alias("n_stop_words"),
        F.when(F.col("n_words") >= WINDOW, _window_hashes(F.col(hashes), F.col("n_words")))
        .alias(windows))
    # Most texts have no window twice: only the others are sorted.
    third = second.withColumn(ordered, F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    again = F.filter(ordered, lambda x, i: (
        (i > 0) & (F.col(ordered)[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | (
        (i < F.size(ordered) - 1) & (F.col(ordered)[
            F.least(i + 1, F.size(ordered) - 1)]["h"] == x["h"])))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))
    return third.select(*kept, *names[:5],
                        F.when(F.col(ordered).isNull(), F.lit(0).cast("bigint"))
                        .otherwise(covered["n"]).alias("n_repeat_words"), "n_stop_words")


def _fails(rule: Rule) -> Column:
    value = F.expr(rule.metric)
    fails = F.lit(False)
    if rule.least is not None:
        fails = fails | (value < rule.least)
    if rule.most is not None:
        fails = fails | (value > rule.most)
    return F.coalesce(fails, F.lit(False))


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Append metrics, ``failed`` (names of the rules that fail), ``base_failed`` and ``kept``."""
    measured = measure(docs, text)
    judged = measured.select(*[F.col(f"`{c}`") for c in others(
        measured, ["failed", "base_failed", "kept"])],
        F.filter(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]),
                 lambda x: x.isNotNull()).alias("failed"))
    base = [r.name for r in rules if r.base]
    return judged.withColumns({
        "base_failed": F.arrays_overlap("failed", F.array(*map(F.lit, base))),
        "kept": F.size("failed") == 0})
