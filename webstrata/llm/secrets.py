"""Secret scans: fixed patterns, and a character network over every candidate.

Base spans come from the patterns below. Candidates are all longest runs of 12 or more token
characters, with or without digits, but for those that one base span covers whole: a run that
goes on beside a base span is read whole. A small convolutional network in numpy reads each
candidate with its context. It is trained on findings in at most ``SAMPLE_DOCS`` documents, chosen
by a hash of doc_id, of at most ``SAMPLE_WINDOWS`` different windows, chosen by a hash too, and
on drawn secrets and look-alikes. What base patterns mark is a secret; other runs are not, unless
they look random: such may be keys of other formats and get no label.
Findings kept aside are parted: Platt scaling on one part calibrates the network, and the threshold
is the highest that keeps the required recall on the other. Candidates longer than the network's
window are read in windows.

A null text is empty and has no spans. Repeated rows have equal spans; columns whose names clash
with the outputs give way. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.frames import add_columns
from webstrata.llm.text import slices, text_bytes
from webstrata.llm.workers import by_batches

# The base patterns, in order of kind, and the least length of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "cnn")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_PIECE = re.compile(r"[A-Za-z0-9]{12,}")

SAMPLE_DOCS = 4000
SAMPLE_WINDOWS = 20_000
DRAWN = 8000
RECALL = 0.985
LEFT, INSIDE, RIGHT = 24, 48, 8
_WIDTH = LEFT + INSIDE + RIGHT
CHUNK_BYTES = 1 << 20

Span = tuple[int, int, str]


def _run_mask() -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-."]] = True
    return mask


_IN_RUN = _run_mask()


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and non-overlapping for each kind."""
    spans: list[Span] = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
                  if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)
              if m.end() - m.start() >= LEAST_HEX]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Runs that may be secrets and lie in no span; spans are in order of their begins."""
    begins = [begin for begin, _, _ in spans]
    furthest = list(accumulate((end for _, end, _ in spans), max))
    out = []
    for match in _RUN.finditer(text):
        begin, end = match.span()
        before = bisect_right(begins, begin)  # that many spans begin no later than the run
        if not before or furthest[before - 1] < end:
            out.append((begin, end))
    return out


def looks_random(run: str) -> bool:
    """Whether a run has a long piece of changing kinds of characters, or almost without vowels."""
    for piece in _PIECE.findall(run):
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in piece]
        changes = sum(a != b for a, b in zip(kinds[1:], kinds[2:]))
        letters = [c for c in piece.lower() if not c.isdigit()]
        vowels = sum(c in "aeiouy" for c in letters)
        if 6 * changes >= len(piece) or (len(letters) >= 10 and 5 * vowels < len(letters)):
            return True
    return False


def windows(text: str, begin: int, end: int) -> list[np.ndarray]:
    """Codes of a candidate in its context, one window for each ``INSIDE`` characters."""
    out = []
    for at in range(begin, end, INSIDE):
        stop = min(at + INSIDE, end)
        codes = np.zeros(_WIDTH, np.uint8)
        before = text[max(0, at - LEFT):at].encode("ascii", "replace")
        inside = text[at:stop].encode("ascii", "replace")
        after = text[stop:stop + RIGHT].encode("ascii", "replace")
        codes[LEFT - len(before):LEFT] = np.frombuffer(before, np.uint8)
        codes[LEFT:LEFT + len(inside)] = np.frombuffer(inside, np.uint8) | 128
        codes[LEFT + INSIDE:LEFT + INSIDE + len(after)] = np.frombuffer(after, np.uint8)
        out.append(codes)
    return out


@dataclass
class Network:
    """Embedding, one convolution with ReLU, maximum and mean over positions, logistic output."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    @classmethod
    def fresh(cls, random: np.random.Generator, size: int = 8, filters: int = 24,
              width: int = 5) -> "Network":
        return cls(random.normal(0, 0.5, (256, size)).astype(np.float32),
                   random.normal(0, 0.2, (width * size, filters)).astype(np.float32),
                   np.zeros(filters, np.float32),
                   random.normal(0, 0.1, 2 * filters).astype(np.float32), 0.0)

    def _forward(self, codes: np.ndarray) -> tuple:
        vectors = self.embed[codes]
        size = vectors.shape[2]
        width = len(self.kernel) // size
        patches = np.lib.stride_tricks.sliding_window_view(vectors, width, axis=1)
        patches = patches.transpose(0, 1, 3, 2).reshape(len(codes), -1, width * size)
        active = np.maximum(patches @ self.kernel + self.shift, 0)
        most = active.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(active, most[:, None], 1)[:, 0],
                                 active.mean(axis=1)], axis=1)
        return patches, active, most, pooled, pooled @ self.out + self.bias

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[at:at + 256])[-1]
                               for at in range(0, len(codes), 256)] or [np.empty(0)])

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.offset, -30, 30)))

    def learn(self, codes: np.ndarray, labels: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the logistic loss."""
        patches, active, most, pooled, logits = self._forward(codes)
        error = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) / len(labels)).astype(
            np.float32)
        filters = len(self.shift)
        back = error[:, None] * self.out
        grown = np.repeat(back[:, None, filters:] / active.shape[1], active.shape[1], axis=1)
        np.put_along_axis(grown, most[:, None], np.take_along_axis(grown, most[:, None], 1)
                          + back[:, None, :filters], 1)
        grown *= active > 0
        flat, values = grown.reshape(-1, filters), patches.reshape(-1, patches.shape[2])
        to_patches = grown @ self.kernel.T
        size = self.embed.shape[1]
        update = np.empty_like(self.embed)
        positions = active.shape[1]
        spread = np.zeros((*codes.shape, size), np.float32)
        for place in range(len(self.kernel) // size):
            spread[:, place:place + positions] += to_patches[:, :, place * size:(place + 1) * size]
        for part in range(size):
            update[:, part] = np.bincount(codes.ravel(), spread[:, :, part].ravel(), 256)
        self.kernel -= rate * (values.T @ flat)
        self.shift -= rate * flat.sum(axis=0)
        self.out -= rate * (error @ pooled)
        self.bias -= rate * float(error.sum())
        self.embed -= rate * update


def _drawn(random: np.random.Generator, count: int) -> list[tuple[str, int, int, int]]:
    """Secrets and look-alikes as (text, begin, end, label)."""
    alphabets = ("0123456789abcdef", "0123456789ABCDEF",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
                 "abcdefghijklmnopqrstuvwxyz0123456789")
    leads = ("key = ", "token: ", "auth ", "Bearer ", "secret=", "export KEY=", "and the ", "")
    syllables = ("an", "the", "ver", "ion", "que", "ment", "lich", "ado", "re", "st", "ung", "al")

    def pick(options, size=None):
        chosen = random.choice(len(options), size)
        return options[int(chosen)] if size is None else "".join(options[i] for i in chosen)

    out = []
    for turn in range(count):
        lead = pick(syllables, 6) + " " + pick(leads)
        if turn % 2:
            size = int(random.integers(12, 18) if turn % 4 == 1 else random.integers(16, 60))
            lower = "abcdefghijklmnopqrstuvwxyz"
            prefix = pick(("sk-", "ghp_", "xoxb-", "AKIA", "", "", "", "", pick(lower, int(
                random.integers(2, 7))) + pick(("-", "_"))))
            body = prefix + pick(alphabets[turn // 2 % len(alphabets)], size)
            label = 1
        else:
            label, kind = 0, turn // 2 % 7
            word = pick(syllables, int(random.integers(4, 9)))
            number = str(int(random.integers(1900, 2030)))
            body = (f"{word}-{number}-{pick(syllables, 4)}", f"{number}-11-05/{word}/{number}",
                    f"{word}_{pick(syllables, 3)}_{number}", f"{word.capitalize()}{number}",
                    pick("0123456789", 4) + "-" + pick("0123456789", 6) + "-" + pick(
                        "0123456789", 6), word + pick(syllables, 3),
                    (word + pick(syllables, 3)).upper())[kind]
            body = body if len(body) >= 16 else body + "-" + pick(syllables, 8)
        text = lead + body + " " + pick(syllables, 5)
        out.append((text, len(lead), len(lead) + len(body), label))
    return out


def _labelled(text: str | None) -> tuple[list[np.ndarray], list[int]]:
    """Findings of one text: what base patterns mark is a secret, other candidates are not.

    Left out are runs of digits alone, which may be any number, and others that look random or
    hold a base span.
    """
    codes, labels = [], []
    spans = base_spans(text or "")
    for begin, end, kind in spans:
        body = ASSIGN.match(text, begin, end) if kind == "assign" else None
        begin = body.start(2) if body else begin
        if not text[begin:end].isdigit():
            found = windows(text, begin, end)
            codes += found
            labels += [1] * len(found)
    for begin, end in candidates(text or "", spans):
        if not (text[begin:end].isdigit() or looks_random(text[begin:end])
                or any(b < end and begin < e for b, e, _ in spans)):
            found = windows(text, begin, end)
            codes += found
            labels += [0] * len(found)
    return codes, labels


def train(codes: np.ndarray, labels: np.ndarray, recall: float = RECALL, seed: int = 5,
          epochs: int = 16) -> Network:
    """Fit, calibrate and set the threshold, on three, one and one of five parts of the findings."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(codes))
    aside, kept = order[::5], order[1::5]
    used = np.concatenate([order[2::5], order[3::5], order[4::5]])
    network = Network.fresh(random)
    for epoch in range(epochs):
        random.shuffle(used)
        for at in range(0, len(used), 64):
            part = used[at:at + 64]
            network.learn(codes[part], labels[part], 0.5 * 0.85 ** epoch)
    logits, truth = network.logits(codes[aside]), labels[aside]
    slope, offset = 1.0, 0.0
    for _ in range(300):  # Platt scaling
        error = 1 / (1 + np.exp(-np.clip(slope * logits + offset, -30, 30))) - truth
        slope -= 0.05 * float((error * logits).mean() + 1e-3 * slope)
        offset -= 0.05 * float(error.mean())
    network.slope, network.offset = slope, offset
    hits = np.sort(network.probabilities(codes[kept])[labels[kept] > 0])
    network.threshold = float(hits[int((1 - recall) * len(hits))]) if len(hits) else 1.1
    return network


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, recall: float = RECALL) -> Network:
    """Train on the findings of a bounded sample of documents and on drawn ones."""
    chosen = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                codes, labels = [], []
                for text in part.column("text").to_pylist():
                    more, marks = _labelled(text)
                    codes += [c.tobytes() for c in more]
                    labels += marks
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes, pa.binary()), pa.array(labels, pa.int32())],
                    names=["codes", "label"])

    rows = sample.mapInArrow(by_batches(find), "codes binary, label int").groupBy("codes").agg(
        F.max("label").alias("label")).orderBy(F.xxhash64("codes"), "codes").limit(
        SAMPLE_WINDOWS).collect()
    codes = [np.frombuffer(row["codes"], np.uint8) for row in rows]
    labels = [row["label"] for row in rows]
    for text, begin, end, label in _drawn(np.random.default_rng(11), DRAWN):
        for window in windows(text, begin, end):
            codes.append(window)
            labels.append(label)
    return train(np.array(codes), np.array(labels), recall)


def find_all(texts: list[str], touched: np.ndarray, network: Network) -> list[list[Span]]:
    """All spans of each text; only those of ``touched`` can have a long run."""
    found: list[list[Span]] = [[] for _ in texts]
    codes, owners = [], []
    for row in np.flatnonzero(touched).tolist():
        found[row] = base_spans(texts[row])
        for begin, end in candidates(texts[row], found[row]):
            for window in windows(texts[row], begin, end):
                codes.append(window)
                owners.append((row, begin, end))
    if codes:
        likely = network.probabilities(np.array(codes)) >= network.threshold
        for row, begin, end in dict.fromkeys(o for o, k in zip(owners, likely.tolist()) if k):
            found[row].append((begin, end, "cnn"))
    return [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) for spans in found]


def _touched(column: pa.Array) -> np.ndarray:
    """Texts with a run of at least 12 token characters: no others can hold a span."""
    data, offsets = text_bytes(column)
    inside = np.concatenate([[False], _IN_RUN[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    long_ends = ends[ends - begins >= LEAST_ASSIGN]
    # A run may cross the border of two texts here; that only touches one text too many.
    rows = np.searchsorted(offsets, long_ends - 1, "right") - 1
    firsts = np.searchsorted(offsets, begins[ends - begins >= LEAST_ASSIGN], "right") - 1
    touched = np.zeros(len(offsets) - 1, bool)
    for first, last in zip(firsts.tolist(), rows.tolist()):
        touched[first:last + 1] = True
    return touched


def _line(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each maximal stretch of spans replaced by ``mark``."""
    parts, at, stop = [], 0, -1
    for begin, end, _ in spans:
        if begin >= stop:
            parts += [text[at:begin], mark]
        stop = max(stop, end)
        at = stop
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, network: Network, keep: list[str] | None = None) -> DataFrame:
    """Append n_assign, n_access, n_hex, base_sha256, spans and redacted, the text without them."""
    def compute(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = find_all(texts, _touched(part.column("text")), network)
                base = [[s for s in spans if s[2] != "cnn"] for spans in found]
                counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base],
                                   pa.int64()) for kind in KINDS[:3]]
                yield part, [
                    *counts,
                    pa.array([hashlib.sha256(_line(s).encode()).hexdigest() for s in base]),
                    pa.array([_line(s) for s in found]),
                    pa.array([redact(t, s) for t, s in zip(texts, found)])]

    return add_columns(docs, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                             "spans string, redacted string", compute, keep)
