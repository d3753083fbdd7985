"""Alignment of two tokenizations of one text by galloping intersection of their token ends.

Both tokenizers cover the same bytes, a space and the text, so each gives an ascending list of byte
ends. The shorter list drives: each of its ends gallops through the longer one, with doubling steps
from a place known to lie before it and a binary search in the bracket found. Ends in both
lists cut the tokens into groups; the rank an end has in the other list tells which of its
tokens a token overlaps, its links.

How often a pair of ids is linked is counted over all documents, once per chunk of documents and then
over chunks. Chunks keep the distinct pairs of each document as places in the chunk's sorted pair
list, and get the corpus-wide counts of that list back: a pair that every document holds is one row
per chunk, and no count table is broadcast.

A text that is null or empty, or whose tokens' joined bytes differ from a space and the text (one
with U+2581, for instance), has no tokens. Texts of any length are aligned whole. Repeated rows and
ids are aligned each. Columns that clash with outputs give way, as does the text. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.encoder import Known, byte_letters
from webstrata.llm.frames import others
from webstrata.llm.text import slices
from webstrata.llm.workers import by_batches, cache, enter, give_back
from webstrata.session import work_path

PART_BYTES = 1 << 20     # texts encoded and aligned at a time
CHUNK_PAIRS = 2 << 20    # distinct pairs, summed over documents, held for one chunk
LISTED = 1 << 15         # pairs of a chunk's list in one row
UNBROKEN = 2000          # longest run without white space that ranks encode
STRIDE = 64
JOINED = 1 << 18         # tokens of a document whose group text is built at a time
# Fixed value: the split pattern of byte-level vocabularies.
BYTE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                r"|\s+(?!\S)|\s+")

_models: dict[tuple[str, str], tuple] = cache()


def _search(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First place in ``long`` not below each value, from places that are not behind it."""
    low, reach = start.copy(), np.zeros(len(short), np.int64)
    last = len(long) - 1
    moving, step = np.arange(len(short)), 1
    while len(moving):  # exponential: long[low - 1] stays below the value
        probe = np.minimum(low[moving] + step - 1, last)
        below = (long[probe] < short[moving]) & (probe < last)
        reach[moving[~below]] = probe[~below]
        moving, probe = moving[below], probe[below]
        low[moving] = probe + 1
        step *= 2
    while True:  # binary: the place lies from low to reach
        open_ = np.flatnonzero(low < reach)
        if not len(open_):
            return low
        middle = (low[open_] + reach[open_]) >> 1
        below = long[middle] < short[open_]
        low[open_[below]] = middle[below] + 1
        reach[open_[~below]] = middle[~below]


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of an ascending list, the first place in ``long`` not below it.

    The last value of ``long`` is at least that of ``short``. Every `STRIDE`-th value is found first;
    those between start from it, all at once.
    """
    if len(short) <= STRIDE:
        return _search(short, long, np.zeros(len(short), np.int64))
    anchors = gallop(short[::STRIDE], long)
    return _search(short, long, np.repeat(anchors, STRIDE)[:len(short)])


def overlaps(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, common) per token of the shorter list: the range of tokens of the longer one that
    overlap it, and whether both end together."""
    place = gallop(short, long)
    common = long[place] == short
    first = np.zeros(len(short), np.int64)
    first[1:] = place[:-1] + common[:-1]
    return first, place, common


class ByteLevel:
    """A byte-level vocabulary file whose merges are in the order of their ids.

    Such a vocabulary is a table of ranks by bytes, which encodes whole texts at once. Special
    tokens' strings are plain text.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        parts = json.loads(Tokenizer.from_file(path).to_str())
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary, first = parts["model"]["vocab"], len(byte_of)
        special = {token["content"] for token in parts["added_tokens"]}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in parts["model"]["merges"]]
        if parts["normalizer"] or parts["pre_tokenizer"]["type"] != "ByteLevel" or any(
                vocabulary[piece] != first + rank for rank, piece in enumerate(merged)):
            raise ValueError(f"not a byte-level vocabulary in the order of its merges: {path}")
        ranks = {bytes(map(byte_of.__getitem__, piece)): number
                 for piece, number in vocabulary.items() if piece not in special}
        self._ranks = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks,
                                        special_tokens={})
        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        self._library.no_truncation()
        self.shown = [b""] * (max(ranks.values()) + 1)
        for piece, number in ranks.items():
            self.shown[number] = piece

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text; an empty text has none."""
        out = []
        for text in texts:
            if max(map(len, text.split()), default=0) > UNBROKEN:  # ranks take its square in time
                ids = self._library.encode(" " + text, add_special_tokens=False).ids
            else:
                ids = self._ranks.encode_ordinary(" " + text) if text else []
            out.append(np.array(ids, np.int64))
        return out


class Pieces:
    """A SentencePiece model file that puts a space before each text.

    Where no piece runs on into the marker of the next word, words are encoded once per process and
    remembered; a newline that is no part of a piece ends a word as well.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        plain = [piece for i, piece in enumerate(pieces) if not self._model.is_byte(i)]
        self._splits = not any("▁" in piece.lstrip("▁") or "\n" in piece for piece in plain)
        self.shown = [bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else
                      piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)]
        # A line's first word has no marker: it goes with the newline before it.
        line = self._model.encode("\n")
        self._splits = self._splits and self._model.encode("\na")[:len(line)] == line
        self._known = Known(lambda _, word: self._all([word])[0])

    def _all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each behind a space; of words that begin with a newline, without it."""
        return [array("I", ids[1:] if text[0] == "\n" else ids).tobytes()
                for text, ids in zip(texts, self._model.encode(texts, num_threads=1))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text; an empty text has none."""
        self._known.settle()
        words = [text.replace("\n", " \n").split(" ") for text in texts]
        # Spaces in a row may share a piece with a word: such texts are encoded whole.
        plain = [self._splits and "" not in each for each in words]
        found = [list(map(self._known.get, each)) if fits else []
                 for each, fits in zip(words, plain)]
        new = [at for at, ids in enumerate(found) if None in ids]
        self._known.learn({word for at in new for word, ids in zip(words[at], found[at])
                           if ids is None}, self._all)
        for at in new:
            found[at] = list(map(self._known.get, words[at]))
        out = []
        for text, ids, fits in zip(texts, found, plain):
            if fits:
                data = b"".join(ids)
            else:
                data = array("I", self._model.encode(text)).tobytes()
            out.append(np.frombuffer(data, "<u4").astype(np.int64))
        return out


class _Side:
    """The tokens of a batch of texts by one tokenizer: ids, byte ends, first token of each text."""

    def __init__(self, ids: list[np.ndarray], shown: list[bytes]) -> None:
        self.counts = np.array([len(i) for i in ids], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        self.sizes = np.array([len(b) for b in shown], np.int64)
        self.ends = np.cumsum(self.sizes[self.ids])
        self.doc = np.repeat(np.arange(len(ids)), self.counts)

    def wrong(self, texts: list[bytes], shown: list[bytes]) -> np.ndarray:
        """Texts whose tokens' joined bytes differ from them."""
        edges = np.concatenate([[0], self.ends])[self.starts]
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.diff(edges) != sizes
        if out.any():  # rare: each text for itself
            for at in np.flatnonzero(~out):
                ids = self.ids[self.starts[at]:self.starts[at + 1]]
                out[at] = b"".join(map(shown.__getitem__, ids.tolist())) != texts[at]
            return out
        table = np.frombuffer(b"".join(shown), np.uint8)
        begins = (np.cumsum(self.sizes) - self.sizes)[self.ids]
        lengths = self.sizes[self.ids]
        flat = table[np.arange(edges[-1]) + np.repeat(begins - (self.ends - lengths), lengths)]
        differ = np.flatnonzero(flat != np.frombuffer(b"".join(texts), np.uint8))
        out[np.searchsorted(edges, differ, "right") - 1] = True
        return out


def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """The process's tokenizers A, a byte-level file, and B, a SentencePiece model."""
    if (path_a, path_b) not in _models:
        _models[path_a, path_b] = ByteLevel(path_a), Pieces(path_b)
    return _models[path_a, path_b]


def _names(shown: list[bytes], last: str) -> list[str]:
    """How each id is written inside a group, and as the last of its side."""
    return [f"{i}," for i in range(len(shown))] + [f"{i}{last}" for i in range(len(shown))]


class Aligned:
    """The alignment of a batch of texts, as one run of tokens on each side."""

    def __init__(self, texts: list[str | None], a: ByteLevel, b: Pieces) -> None:
        none = np.empty(0, np.int64)
        ids = [side.encode([t or "" for t in texts]) for side in (a, b)]
        whole = [(" " + t).encode() if t else b"" for t in texts]
        sides_ = [_Side(i, side.shown) for i, side in zip(ids, (a, b))]
        bad = sides_[0].wrong(whole, a.shown) | sides_[1].wrong(whole, b.shown)
        if bad.any():
            sides_ = [_Side([none if bad[k] else one for k, one in enumerate(i)], side.shown)
                      for i, side in zip(ids, (a, b))]
        self.a, self.b = sides_
        # Texts follow each other, so that the ends of the batch ascend on both sides; per text the
        # shorter list drives.
        few = self.a.counts <= self.b.counts
        links, commons = [], []
        for short, long, chosen, turn in ((self.a, self.b, few, 1), (self.b, self.a, ~few, -1)):
            at, to = np.flatnonzero(chosen[short.doc]), np.flatnonzero(chosen[long.doc])
            if not len(at):
                continue
            first, last, common = overlaps(short.ends[at], long.ends[to])
            count = last - first + 1
            far = to[np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)]
            links.append((np.repeat(at, count), far)[::turn])
            commons.append((at[common], to[last[common]])[::turn])
        self.link_a = np.concatenate([x for x, _ in links] or [none])
        self.link_b = np.concatenate([y for _, y in links] or [none])
        self.link_doc = self.a.doc[self.link_a]
        # Last token of each group, on both sides, in order.
        self.last_a = np.sort(np.concatenate([x for x, _ in commons] or [none]))
        self.last_b = np.sort(np.concatenate([y for _, y in commons] or [none]))
        self.group_doc = self.a.doc[self.last_a]

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens in the order their groups are written, as places in the names of both
        vocabularies, and each text's first."""
        in_a, in_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        # Per group its A tokens, then its B tokens: a token's place follows from what precedes.
        place_a = np.arange(len(self.a.ids)) + np.repeat(np.cumsum(in_b) - in_b, in_a)
        place_b = np.arange(len(self.b.ids)) + np.repeat(np.cumsum(in_a), in_b)
        own_a, own_b = self.a.ids.copy(), self.b.ids.copy()
        own_a[self.last_a] += len(self.a.sizes)
        own_b[self.last_b] += len(self.b.sizes)
        out = np.empty(len(place_a) + len(place_b), np.int64)
        out[place_a], out[place_b] = own_a, own_b + 2 * len(self.a.sizes)
        return out, self.a.starts + self.b.starts

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair code, times), each distinct pair of each document once, in order."""
        codes = (self.a.ids[self.link_a] << 32) | self.b.ids[self.link_b]
        order = np.lexsort((codes, self.link_doc))
        doc, codes = self.link_doc[order], codes[order]
        new = np.ones(len(codes), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (codes[1:] != codes[:-1])
        at = np.flatnonzero(new)
        return doc[at], codes[at], np.diff(np.append(at, len(codes)))


def _pack(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _digest(pieces: Iterator[str]) -> str:
    """Hex digest of the joined pieces less their last character; '' if there are none."""
    digest, held = hashlib.sha256(), ""
    for piece in pieces:
        digest.update(held.encode())
        digest.update(piece[:-1].encode())
        held = piece[-1]
    return digest.hexdigest() if held else ""


def align(docs: DataFrame, path_a: str, path_b: str, groups: str = "digest",
          keep: list[str] | None = None) -> DataFrame:
    """Rows with n_a, n_b, n_groups, n_links, n_best, count_sum and their groups.

    ``path_a`` is a byte-level vocabulary file, ``path_b`` a SentencePiece model. ``groups`` says how
    groups are shown: ``digest`` gives groups_sha256 ('' without tokens), ``text`` gives ``groups``.
    ``count_sum`` adds up, over the links of a row, how often its pair of ids is linked corpus-wide;
    ``n_best`` counts the links whose pair is the most frequent one of its B id.
    """
    spark = docs.sparkSession
    shown = {"digest": "groups_sha256", "text": "groups"}[groups]
    names = ["n_a", "n_b", "n_groups", "n_links", shown, "n_best", "count_sum"]
    kept = [c for c in others(docs, names) if c.lower() != "text"] if keep is None else keep
    whole = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in kept])),
                          T.StructField("text", T.StringType())])
    taken = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row") if kept else F.struct(
        F.lit(0).alias("none")).alias("row"), F.col("text").cast("string").alias("text"))
    counted = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, shown string"
    row_type = taken.schema["row"].dataType
    schema = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("chunk", T.LongType()),
         T.StructField("row", row_type)] + T.StructType.fromDDL(counted).fields
        + T.StructType.fromDDL("places binary, times binary, base bigint, "
                               "codes array<bigint>, counts array<bigint>").fields)

    numbers_type = pa.list_(pa.int64())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = sides(path_a, path_b)
        names = _names(a.shown, "|") + _names(b.shown, ";")
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                aligned = Aligned(part.column("text").to_pylist(), a, b)
                n = part.num_rows
                doc, codes, times = aligned.pairs()
                order, starts = aligned.written()
                texts = []
                for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    pieces = ("".join(map(names.__getitem__, order[at:min(at + JOINED, y)].tolist()))
                              for at in range(x, y, JOINED))
                    if groups == "text":
                        texts.append("".join(pieces)[:-1])
                    else:
                        texts.append(_digest(pieces))
                held.append((part.column("row"), [
                    aligned.a.counts, aligned.b.counts,
                    np.bincount(aligned.group_doc, minlength=n),
                    np.bincount(aligned.link_doc, minlength=n)], texts,
                    np.searchsorted(doc, np.arange(n + 1)), codes, times.astype(np.uint32)))
                size += len(codes)
                if size >= CHUNK_PAIRS:
                    yield from _chunk(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from _chunk(chunk, held)

    def _chunk(chunk: int, held: list) -> Iterator[pa.RecordBatch]:
        """A chunk's documents, and its pair list with counts as a row of its own."""
        listed, inverse = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([h[5] for h in held]).astype(np.float64),
                             minlength=len(listed)).astype(np.int64)
        at = 0
        for rows, numbers, texts, bounds, codes, times in held:
            places = inverse[at:at + len(codes)]
            at += len(codes)
            packed = [(_pack(np.diff(places[x:y], prepend=0)), _pack(times[x:y]))
                      for x, y in zip(bounds[:-1], bounds[1:])]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["document"] * n), pa.array([chunk] * n, pa.int64()), rows,
                 *(pa.array(v, pa.int64()) for v in numbers), pa.array(texts, pa.string()),
                 pa.array([p for p, _ in packed], pa.binary()),
                 pa.array([t for _, t in packed], pa.binary()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, numbers_type), pa.nulls(n, numbers_type)],
                names=schema.names)
        none = pa.nulls(1, pa.int64())
        for base in range(0, len(listed), LISTED):
            codes, counts = (pa.array([v[base:base + LISTED].tolist()], numbers_type)
                             for v in (listed, totals))
            yield pa.RecordBatch.from_arrays(
                [pa.array(["pairs"]), pa.array([chunk], pa.int64()), pa.nulls(1, held[0][0].type),
                 none, none, none, none, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()),
                 pa.nulls(1, pa.binary()), pa.array([base], pa.int64()), codes, counts],
                names=schema.names)

    path = work_path(spark, "alignment")
    taken.mapInArrow(by_batches(measure), schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path).where("kind = 'document'").drop("kind", "base", "codes", "counts")
    listed = spark.read.schema(schema).parquet(path).where("kind = 'pairs'").select(
        "chunk", "base", F.posexplode(F.arrays_zip("codes", "counts")).alias("at", "pair")).select(
        "chunk", (F.col("base") + F.col("at")).alias("place"), F.col("pair.codes").alias("code"),
        F.col("pair.counts").alias("n"))

    pairs = listed.groupBy("code").agg(F.sum("n").alias("pair_count"))
    # At most one row per id of A for each id of B.
    most = pairs.groupBy((F.col("code").bitwiseAND(0xFFFFFFFF)).alias("b")).agg(
        F.max("pair_count").alias("most"))
    judged = pairs.withColumn("b", F.col("code").bitwiseAND(0xFFFFFFFF)).join(most, "b").select(
        "code", "pair_count", (F.col("pair_count") == F.col("most")).alias("best"))
    answers = listed.select("chunk", "place", "code").join(judged, "code").select(
        "chunk", "place", "pair_count", "best")
    out = T.StructType([T.StructField("row", row_type)] + T.StructType.fromDDL(
        counted + ", n_best bigint, count_sum bigint").fields)

    def total(table: pa.Table, answer: pa.Table) -> pa.Table:
        enter(__name__)
        known = np.zeros(answer.num_rows, np.int64)
        best = np.zeros(answer.num_rows, bool)
        place = answer.column("place").to_numpy()
        known[place] = answer.column("pair_count").to_numpy()
        best[place] = answer.column("best").to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for places, times in zip(table.column("places"), table.column("times")):
            at, n = np.cumsum(_unpack(places.as_py())), _unpack(times.as_py())
            sums.append(int((known[at] * n).sum()))
            bests.append(int(n[best[at]].sum()))
        kept_columns = table.select(["row", "n_a", "n_b", "n_groups", "n_links", "shown"])
        give_back()
        return kept_columns.append_column("n_best", pa.array(bests, pa.int64())).append_column(
            "count_sum", pa.array(sums, pa.int64()))

    done = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(total, out)
    fields = [F.col(f"row.{c}").alias(c) for c in kept]
    return done.select(*fields, *[F.col("shown").alias(n) if n == shown else F.col(n) for n in names])
