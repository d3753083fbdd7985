"""Packing of token sequences: first-fit decreasing over a tournament tree of capacities.

A document's ids, with an end id, are cut into pieces of the capacity and a rest. Documents are
dealt into random groups; each group is packed alone, largest piece first into the leftmost
sequence that has room. The tree holds the largest room below each node, so a piece finds its
place in logarithmic time.

A null text is empty (its end id alone is packed); null and repeated doc_ids are kept as they
are; ties between pieces of a length are broken by document and start. Empty tables give no
pieces. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.encoder import encoder
from webstrata.llm.text import slices
from webstrata.llm.workers import by_batches, by_group

CAPACITY = 4096
GROUP_DOCS = 2048
END_ID = 2
SEED = 20
PART_BYTES = 1 << 20


class Tournament:
    """Rooms of sequences; finds the leftmost with room for a piece."""

    def __init__(self, sequences: int, capacity: int) -> None:
        self._width = 1 << max(0, (sequences - 1).bit_length())
        self._room = [capacity] * (2 * self._width)

    def place(self, length: int) -> int:
        """Index of the sequence that takes the piece."""
        room, node = self._room, 1
        while node < self._width:
            node *= 2
            if room[node] < length:
                node += 1
        room[node] -= length
        leaf = node - self._width
        while node > 1:
            node //= 2
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
        return leaf


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; no piece exceeds the capacity."""
    sequences = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    tree, used = Tournament(max(1, len(lengths)), capacity), [0] * len(lengths)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        at = tree.place(length)
        sequences[piece], offsets[piece] = at, used[at]
        used[at] += length
    return sequences, offsets


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
               with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, _group[, ids]) of all documents."""
    schema = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "_group bigint" + (", ids binary" if with_ids else ""))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, specials=True)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                rows: list[tuple] = []
                texts = [text or "" for text in part.column("text").to_pylist()]
                for doc_id, group, raw in zip(part.column("doc_id").to_pylist(),
                                              part.column("_group").to_pylist(),
                                              encode.encode(texts)):
                    ids = np.concatenate([np.frombuffer(raw, encode.dtype).astype("<u4"), end])
                    for start in range(0, len(ids), capacity):
                        piece = ids[start:start + capacity].tobytes()
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), len(ids),
                                     group, piece)[:6 + with_ids])
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_group",
                           "ids"][:6 + with_ids])

    return docs.mapInArrow(by_batches(cut), schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY,
         group_docs: int = GROUP_DOCS, end_id: int = END_ID, with_ids: bool = False,
         seed: int = SEED) -> DataFrame:
    """Pieces with their place: sequence_id, offset, and the sequence's and padded lengths.

    Group numbers are random, so no document or source can crowd one group; their count follows
    the number of documents, so groups keep their size as the input grows. A sequence is padded
    to the capacity unless its length is a power of two.
    """
    groups = max(1, -(-docs.count() // group_docs))
    dealt = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.floor(F.rand(seed) * groups).cast("bigint").alias("_group"))
    pieces = cut_pieces(dealt, vocabulary, capacity, end_id, with_ids)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              + "ids binary, " * with_ids
              + "sequence_id bigint, offset bigint, sequence_length bigint, padded_length bigint")

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"),
                               ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        sequences, offsets = first_fit_decreasing(lengths, capacity)
        used = np.bincount(sequences, lengths).astype(np.int64)
        padded = np.where(used & (used - 1), capacity, used)
        group = table.column("_group")[0].as_py()
        out = table.select(names)
        for name, values in (("sequence_id", sequences + (group << 32)), ("offset", offsets),
                             ("sequence_length", used[sequences]),
                             ("padded_length", padded[sequences])):
            out = out.append_column(name, pa.array(values))
        return out

    return pieces.groupBy("_group").applyInArrow(by_group(place), schema)
