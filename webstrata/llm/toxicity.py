"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Training uses at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of doc_id, and never those
whose crc32(doc_id as text) is divisible by 5. Lexicon voters are words and word beginnings found
far more often in texts marked toxic; disguised spellings count as the words they hide. Pattern
voters look at form alone: letters set apart, masked letters, stretched words, insults by
address, shouting. A generative model estimates from the agreements of the voters alone how often
each votes in either latent class, and how voters correlate within the classes, which share their
weight. The annotator is no voter: labels give the balance of the classes and say which latent
class is the toxic one. The posteriors train a logistic classifier over the voters, which alone
scores all texts.

A null text counts as empty and gets the score of a text without features. A null doc_id is held
in the scored table and never held out. Repeated rows get equal scores; extra columns are kept unless
an output column has their name. Several labels of a doc_id count by their largest, and of several
texts the smallest trains. Without labelled rows of both classes, the score is the share of toxic
labels, or 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.frames import add_columns
from webstrata.llm.text import slices
from webstrata.llm.workers import by_batches
from webstrata.session import cut_lineage

TRAIN_ROWS = 12_000
VOTERS = 400
LEAST_TEXTS = 5
LEAST_EVIDENCE = 6.0  # log odds times the root of the toxic texts that have the feature
PREFIXES = (4, 5, 6)
CHUNK_BYTES = 1 << 20
LONGEST_KNOWN = 64
_WORD = re.compile(r"[^\W_]+")

# What a text looks like, whatever its words.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W_])")
_MASKED = re.compile(r"[^\W\d_][@$!|*0134578]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_ADDRESS = re.compile(r"\b(?:you|u|du|ihr|tu|vous|tú|usted|ustedes)(?:\s+|')"
                      r"(?:are|re|r|bist|seid|es|êtes|eres|son)\s+"
                      r"(?:(?:an?|so|such|all|just|eine?|so|une?|una)\s+)?[^\W\d_]+\s*[!.]")
_SHOUTED = re.compile(r"(?:\b[^\W\d_a-z]{3,}\b[ ,]*){3,}!")
# What a text must hold somewhere before the pattern itself is worth a search.
_MAYBE_SPACED = re.compile(r"[ .*_-](?:[^\W\d_][ .*_-]){2}")
_MAYBE_MASKED = re.compile(r"[@$!|*0134578]")
_MAYBE_STRETCHED = re.compile(r"(.)\1\1")
PATTERNS = ("spaced", "masked", "stretched", "address", "shouted")
HITS = 3
# Letters that digits and signs stand for.
_STANDS_FOR = str.maketrans("@$!|013457", "asiloieast")
_REACH = 24


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features_of(word: str) -> list[str]:
    """A word and its beginnings; beginnings end with a star."""
    return [word, *(word[:size] + "*" for size in PREFIXES if len(word) > size)]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _around(text: str, begin: int, end: int) -> str:
    """The unbroken run around a place, as far as a word may reach."""
    left = text[max(0, begin - _REACH):begin].split()
    right = text[end:end + _REACH].split()
    before = left[-1] if left and not text[begin - 1].isspace() else ""
    after = right[0] if right and not text[end].isspace() else ""
    return before + text[begin:end] + after


def looks_of(text: str | None) -> tuple[list[int], set[str]]:
    """Numbers of the patterns a text has, and the words its disguised spellings stand for."""
    text = text or ""
    low = text.lower()
    seen, hidden = set(), set()
    for found in _SPACED.finditer(low) if _MAYBE_SPACED.search(low) else ():
        seen.add(0)
        hidden.add("".join(_WORD.findall(found.group()))[:LONGEST_KNOWN])
    for found in _MASKED.finditer(low) if _MAYBE_MASKED.search(low) else ():
        seen.add(1)
        word = _around(low, *found.span()).rstrip("!|")
        hidden.update(_WORD.findall(word.translate(_STANDS_FOR)))
    for found in _STRETCHED.finditer(low) if _MAYBE_STRETCHED.search(low) else ():
        seen.add(2)
        word = _around(low, *found.span())
        for kept in (r"\1", r"\1\1"):
            hidden.update(_WORD.findall(_STRETCHED.sub(kept, word)))
    if _ADDRESS.search(low):
        seen.add(3)
    if "!" in text and _SHOUTED.search(text):
        seen.add(4)
    return sorted(seen), hidden


@dataclass
class Model:
    """Weights of the lexicon by feature, of one to three hits, of the patterns, and the bias."""

    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(HITS + len(PATTERNS)))
    bias: float = -30.0
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def _features(self, word: str) -> tuple[int, ...]:
        return tuple(self.lexicon[f] for f in features_of(word) if f in self.lexicon)

    def hits(self, words: set[str]) -> tuple[set[int], int]:
        """Lexicon features of words, and how many of the words have one."""
        found: set[int] = set()
        count = 0
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for word in words:
            own = known.get(word)
            if own is None:
                own = self._features(word)
                if len(word) <= LONGEST_KNOWN:
                    known[word] = own
            if own:
                found.update(own)
                count += 1
        return found, count

    def row(self, text: str | None) -> list[int]:
        """Active feature numbers: lexicon features, one to three hits, patterns."""
        looks, hidden = looks_of(text)
        found, count = self.hits(words_of(text) | hidden)
        width = len(self.lexicon)
        return [*sorted(found), *(width + k for k in range(min(count, HITS))),
                *(width + HITS + k for k in looks)]

    def score(self, text: str | None) -> float:
        total = self.bias + float(self.weights[self.row(text)].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def label_model(votes: np.ndarray, hits: np.ndarray, balance: float,
                rounds: int = 60) -> np.ndarray:
    """Posterior of the latent class that the voters vote for, per row, from the votes alone.

    ``votes`` are 0/1 per voter, and a silent voter abstains. Starting from the number of lexicon hits,
    vote probabilities per class and posteriors are estimated in turn. A voter that correlates with
    others within the classes, as the beginnings of one word do, shares its weight with them, while
    the votes cast keep their total weight. The mean posterior is held at ``balance``.
    """
    votes = votes.astype(np.float64)
    posterior = np.array([0.02, 0.2, 0.5, 0.9])[np.minimum(hits, 3)]
    for _ in range(rounds):
        on = (posterior @ votes + 0.1) / (posterior.sum() + 1)
        off = ((1 - posterior) @ votes + 0.1) / ((1 - posterior).sum() + 1)
        rest = votes - posterior[:, None] * on - (1 - posterior)[:, None] * off
        spread = np.sqrt((rest * rest).mean(axis=0)) + 1e-9
        related = np.abs((rest.T @ rest) / len(rest) / np.outer(spread, spread))
        np.fill_diagonal(related, 0)
        weight = 1 / (1 + np.where(related > 0.05, related, 0).sum(axis=1))
        weight *= max(votes.sum(), 1) / max((votes @ weight).sum(), 1e-9)
        after = _balanced(votes @ (weight * (np.log(on) - np.log(off))), balance)
        done = np.abs(after - posterior).max() < 1e-4
        posterior = after
        if done:
            break
    return posterior


def _balanced(evidence: np.ndarray, balance: float) -> np.ndarray:
    """Posteriors of log odds ``evidence`` plus the prior for which their mean is ``balance``."""
    low, high = -40 - evidence.max(), 40 - evidence.min()
    for _ in range(60):
        prior = (low + high) / 2
        posterior = 1 / (1 + np.exp(-np.clip(evidence + prior, -30, 30)))
        low, high = (prior, high) if posterior.mean() < balance else (low, prior)
    return posterior


def toxic_side(posterior: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The posterior of the latent class that holds the larger share of toxic labels."""
    other = 1 - posterior
    share = (posterior @ labels) / max(posterior.sum(), 1e-9)
    other_share = (other @ labels) / max(other.sum(), 1e-9)
    return posterior if share >= other_share else other


def logistic(rows: np.ndarray, targets: np.ndarray, ridge: float = 0.3,
             rounds: int = 12) -> np.ndarray:
    """Weights and bias fitted to soft targets by Newton steps."""
    data = np.hstack([rows, np.ones((len(rows), 1))])
    weights = np.zeros(data.shape[1])
    penalty = np.full(data.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        mean = 1 / (1 + np.exp(-np.clip(data @ weights, -30, 30)))
        slope = data.T @ (targets - mean) - penalty * weights
        curve = (data * (mean * (1 - mean) + 1e-6)[:, None]).T @ data + np.diag(penalty)
        weights = weights + np.clip(np.linalg.solve(curve, slope), -4, 4)
    return weights


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS,
        voters: int = VOTERS) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out."""
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                           & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
              .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    # At most train_rows ids: small enough to broadcast.
    sample = cut_lineage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                     F.col("text").cast("string").alias("text"))
                         .join(F.broadcast(chosen), "doc_id")
                         .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                clean: Counter[str] = Counter()
                toxic: Counter[str] = Counter()
                for text, label in zip(part.column("text").to_pylist(),
                                       part.column("toxic").to_pylist()):
                    words = words_of(text) | looks_of(text)[1]
                    (toxic if label else clean).update(
                        {f for word in words for f in features_of(word)})
                names = list(clean.keys() | toxic.keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
                     pa.array([clean[n] for n in names], pa.int64())],
                    names=["feature", "toxic", "clean"])

    totals = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(bias=30.0 if n_toxic else -30.0)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log(
        (F.col("clean") + 0.5) / (n_clean + 1.0))
    found = (sample.mapInArrow(by_batches(count), "feature string, toxic bigint, clean bigint")
             .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where((F.col("toxic") >= LEAST_TEXTS) & (odds * F.sqrt("toxic") > LEAST_EVIDENCE))
             .orderBy((odds * F.sqrt("toxic")).desc(), "feature").limit(voters).collect())
    lexicon = {row["feature"]: at for at, row in enumerate(found)}
    model = Model(lexicon)
    width = len(lexicon) + HITS + len(PATTERNS)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.row(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))],
                names=["toxic", "active"])

    seen = sample.orderBy("doc_id").mapInArrow(by_batches(active), "toxic int, active array<int>").collect()
    rows = np.zeros((len(seen), width))
    for at, row in enumerate(seen):
        rows[at, row["active"]] = 1
    given = np.array([row["toxic"] for row in seen], np.float64)
    hits = rows[:, len(lexicon):len(lexicon) + HITS].sum(axis=1).astype(np.int64)
    voted = np.delete(rows, np.s_[len(lexicon):len(lexicon) + HITS], axis=1)
    posterior = toxic_side(label_model(voted, hits, float(given.mean())), given)
    weights = logistic(rows, posterior)
    model.weights, model.bias = weights[:-1], float(weights[-1])
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` and ``predicted``; the model has at most ``VOTERS`` features."""
    lexicon, weights, bias = model.lexicon, model.weights, model.bias

    def compute(batches: Iterator[pa.RecordBatch]):
        own = Model(lexicon, weights, bias)
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                scores = [own.score(text) for text in part.column("text").to_pylist()]
                yield part, [pa.array(scores, pa.float64()),
                             pa.array([int(s >= 0.5) for s in scores], pa.int32())]

    return add_columns(docs, "score double, predicted int", compute, keep)
