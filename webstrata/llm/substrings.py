"""Substring dedup: Rabin-Karp hashes of all word windows, counted by Spark in hash buckets.

Every window of ``window`` words gets a 64-bit polynomial hash. Tasks take texts in chunks: a
chunk sends each of its distinct hashes once, as blobs by hash bucket, and a note of its own that
names the bucket of each window. A bucket holds the same range of hashes from all chunks; it is
sorted, and repeated hashes are answered as bits to the chunks that sent them. A chunk's note
and answers then give the windows that repeat, and these merge into maximal intervals of words.

A hash is compared on 56 bits within its bucket. A bucket holds some million windows whatever
the input, so the chance that a window is taken for another stays below 1e-9. A passage that many
texts share reaches its bucket once per chunk, never once per text.

Null and empty texts have no words. Rows with the same doc_id and text are copies like any others;
they share one answer. Ties do not arise. Other columns are kept, unless an output column has
their name. The input must give the same rows when read again, as a stored table does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.frames import add_columns, free_names, text_total
from webstrata.llm.text import Words, slices, text_bytes
from webstrata.llm.workers import by_batches, by_group

WINDOW = 35
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
MOST_BUCKET_BYTES = 128 << 20
FEW_BUCKETS = 4096
_SENT = "bucket bigint, chunk bigint, kind bigint, blob binary"


def bucket_count(total: int) -> int:
    """Buckets for a corpus of ``total`` bytes: more, then larger ones, then more again."""
    size = max(BUCKET_BYTES, min(MOST_BUCKET_BYTES, total // FEW_BUCKETS))
    return max(1, -(-total // size))


def _code(buckets: int) -> np.dtype:
    return np.dtype("<u1" if buckets <= 1 << 8 else "<u2" if buckets <= 1 << 16 else "<u4")


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _rest(hashes: np.ndarray) -> np.ndarray:
    """The lower 7 bytes of each hash, as an (n, 7) array."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(values), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def _firsts(values: np.ndarray) -> np.ndarray:
    """Which values occur for the first time."""
    flags = np.zeros(len(values), bool)
    flags[np.unique(values, return_index=True)[1]] = True
    return flags


def _note(doc_ids: pa.Array, keys: np.ndarray, words: np.ndarray, known: np.ndarray,
          sent: np.ndarray, codes: np.ndarray) -> bytes:
    """What a chunk must remember: its rows, and of each window what was known and sent."""
    nulls = np.asarray(doc_ids.is_null())
    parts = [doc_ids.fill_null(0).to_numpy().astype("<i8"), nulls.astype("<u1"),
             keys.astype("<i8"), words.astype("<i8"), np.packbits(known), np.packbits(sent), codes]
    head = np.array([len(words), len(known), len(codes)], "<i8")
    return head.tobytes() + b"".join(part.tobytes() for part in parts)


def _read_note(blob: bytes, code: np.dtype) -> list[np.ndarray]:
    rows, windows, codes = np.frombuffer(blob, "<i8", 3).tolist()
    at, out = 24, []
    for kind, count in (("<i8", rows), ("<u1", rows), ("<i8", rows), ("<i8", rows),
                        ("<u1", -(-windows // 8)), ("<u1", -(-windows // 8)), (code, codes)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    out[4], out[5] = (np.unpackbits(x, count=windows).astype(bool) for x in out[4:6])
    return out


def _send(docs: DataFrame, window: int, buckets: int, chunk_bytes: int) -> DataFrame:
    code = _code(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "_text", chunk_bytes):
                words = Words(*text_bytes(part.column("_text")))
                _, hashes = words.windows(window)
                sent, known = _firsts(hashes), _repeated(hashes)
                own = hashes[sent]
                home = _bucket_of(own, buckets).astype(np.int64)
                order = np.argsort(home, kind="stable")
                rest = np.ascontiguousarray(_rest(own[order]))
                filled, begins = np.unique(home[order], return_index=True)
                ends = np.append(begins[1:], len(order))
                blobs = [rest[b:e].tobytes() for b, e in zip(begins.tolist(), ends.tolist())]
                note = _note(part.column("_doc"), part.column("_key").to_numpy(), words.counts,
                             known, sent, home.astype(code))
                # Notes travel beside the blobs, dealt like them.
                places = np.append(filled, buckets + chunk % buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places), pa.array(np.full(len(places), chunk)),
                     pa.array(np.append(np.zeros(len(filled), np.int64), 1)),
                     pa.array([*blobs, note], pa.binary())],
                    names=["bucket", "chunk", "kind", "blob"])
                chunk += 1

    return docs.mapInArrow(by_batches(run), _SENT)


def _answer(table: pa.Table) -> pa.Table:
    """Bits per blob of one bucket: which of its hashes another blob holds too; notes pass."""
    kinds = table.column("kind").to_numpy()
    if not len(kinds) or kinds[0]:
        return table
    blobs = table.column("blob").to_pylist()
    sizes = [len(blob) // 7 for blob in blobs]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :7] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 7)
    flags = _repeated(wide.view("<u8").ravel())
    cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    bits = [np.packbits(flags[b:e]).tobytes() for b, e in zip(cuts, cuts[1:])]
    return table.set_column(3, "blob", pa.array(bits, pa.binary()))


def _intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Windows at sorted word positions, merged: rows of (begin, end)."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    fresh = np.append(True, starts[1:] > starts[:-1] + window)
    ends = np.append(starts[:-1][fresh[1:]], starts[-1]) + window
    return np.stack([starts[fresh], ends], axis=1)


def repeated_intervals(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
                       buckets: int | None = None) -> DataFrame:
    """(_doc, _key, _spans) of the rows (_doc, _key, _text) that hold a repeated window.

    ``_spans`` are pairs of word positions, begin and end, as little-endian 64-bit integers.
    """
    buckets = buckets or bucket_count(text_total(docs, "_text"))
    code = _code(buckets)

    def gather(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        note = table.column("blob")[int(np.flatnonzero(kinds)[0])].as_py()
        ids, nulls, keys, counts, known, sent, home = _read_note(note, code)
        repeated = np.zeros(len(home), bool)
        order = np.argsort(home, kind="stable")
        filled, begins = np.unique(home[order], return_index=True)
        ends = dict(zip(filled.tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(order)])))
        for bucket, kind, bits in zip(table.column("bucket").to_pylist(), kinds,
                                      table.column("blob").to_pylist()):
            if not kind:
                begin, end = ends[bucket]
                repeated[order[begin:end]] = np.unpackbits(
                    np.frombuffer(bits, np.uint8), count=end - begin).astype(bool)
        flags = known.copy()
        flags[np.flatnonzero(sent)[repeated]] = True
        windows = np.maximum(counts - (window - 1), 0)
        firsts = np.concatenate([[0], np.cumsum(windows)])
        rows = []
        for row in np.flatnonzero(np.add.reduceat(
                np.append(flags, False), firsts[:-1]) * (windows > 0)) if len(windows) else []:
            starts = np.flatnonzero(flags[firsts[row]:firsts[row + 1]])
            rows.append((None if nulls[row] else int(ids[row]), int(keys[row]),
                         _intervals(starts, window).astype("<i8").tobytes()))
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.binary())], names=["_doc", "_key", "_spans"])

    sent = _send(docs, window, buckets, chunk_bytes)
    answers = sent.groupBy("bucket").applyInArrow(by_group(_answer), _SENT)
    return answers.groupBy("chunk").applyInArrow(
        by_group(gather), "_doc bigint, _key bigint, _spans binary")


def _cut(part: pa.RecordBatch, text: str, intervals: str) -> list[pa.Array]:
    data, offsets = text_bytes(part.column(text))
    words = Words(data, offsets, hashed=False)
    raw, kept_texts, removed = data.tobytes(), [], []
    for row, spans in enumerate(part.column(intervals).to_pylist()):
        first, last = int(words.first[row]), int(words.first[row + 1])
        keep = np.ones(last - first, bool)
        for begin, end in np.frombuffer(spans or b"", "<i8").reshape(-1, 2).tolist():
            keep[begin:end] = False
        removed.append(int(len(keep) - keep.sum()))
        text = raw[offsets[row]:offsets[row + 1]]
        parts = text.split()  # bytes part at the space and 0x09-0x0D, and nowhere else
        if removed[-1]:
            parts = [parts[i] for i in np.flatnonzero(keep).tolist()]
        kept_texts.append(b" ".join(parts))
    return [pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(kept_texts, pa.binary()).cast(pa.string())]


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
                   buckets: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text, the words no repeated window covers.

    All copies of a passage go, its first included. Columns of these names are replaced.
    """
    doc, key, body, home, print_, intervals = free_names(
        docs, "_doc", "_key", "_body", "_id", "_hash", "_spans")
    hashed = F.xxhash64(F.col("text").cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), hashed.alias("_key"),
                         text.alias("_text"))
    spans = repeated_intervals(narrow, window, chunk_bytes, buckets).groupBy(
        F.col("_doc").alias(doc), F.col("_key").alias(key)).agg(
        F.first("_spans").alias(intervals))  # equal rows have equal answers
    kept = [F.col(f"`{name}`") for name in docs.columns]
    left = docs.select(*kept, F.col("doc_id").cast("bigint").alias(home), hashed.alias(print_),
                       text.alias(body))
    joined = left.join(spans, left[home].eqNullSafe(spans[doc])
                       & (left[print_] == spans[key]), "left").drop(doc, key)

    def compute(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, body, chunk_bytes):
                yield part, _cut(part, body, intervals)

    return add_columns(joined, "n_words bigint, n_removed bigint, kept_text string", compute,
                       [c for c in docs.columns
                        if c.lower() not in ("n_words", "n_removed", "kept_text")])
