"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries.

A shard holds documents in ascending doc_id order::

    magic "WSIDS1\\n\\0" | ids, little-endian, 2 or 4 bytes | boundaries | doc ids | footer
    footer: JSON {ids, width, docs, nulls, first, boundaries: [at, bytes], doc_ids: [at, bytes]}
    | footer length, 4 bytes | magic

Boundaries are the ends of the documents within the shard, doc ids the distances from ``first``;
both are Elias-Fano sequences: low bits packed, high bits in unary, with a 4-byte select sample
every 256 ones. ``select(i)`` reads one sample and a few bytes; no table of 64-bit offsets exists.

A null doc_id sorts first, a null text is empty, repeated rows are written each, equal doc_ids
keep an arbitrary but fixed order, other columns are left out. Empty tables give no shard.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.encoder import encoder
from webstrata.llm.files import open_input, open_output
from webstrata.llm.text import slices
from webstrata.llm.workers import by_batches
from webstrata.session import cut_lineage

MAGIC = b"WSIDS1\n\0"
END_ID = 2
SAMPLE = 256
PART_BYTES = 1 << 20
_ONES = np.array([bin(byte).count("1") for byte in range(256)], np.uint8)


class EliasFano:
    """A sorted sequence of non-negative integers in about 2 + log2(largest / count) bits each."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray,
                 samples: np.ndarray) -> None:
        self.count, self.low_bits = count, low_bits
        self._low, self._high, self._samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        count = len(values)
        largest = int(values[-1]) if count else 0
        bits = max(0, (largest // count).bit_length() - 1) if count else 0
        places = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(),
                          bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(count)
        flags = np.zeros(int(ones[-1]) + 1 if count else 0, np.uint8)
        flags[ones] = 1
        return cls(count, bits, low, np.packbits(flags, bitorder="little"),
                   ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.count, self.low_bits, len(self._low), len(self._high)], "<u8")
        return (head.tobytes() + self._low.tobytes() + self._high.tobytes()
                + self._samples.tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        count, bits, low, high = np.frombuffer(data, "<u8", 4).tolist()
        body = np.frombuffer(data, np.uint8, offset=32)
        return cls(count, bits, body[:low], body[low:low + high],
                   np.frombuffer(data, "<u4", offset=32 + low + high))

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        begin, end = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self._low[begin // 8:-(-end // 8)], bitorder="little")
        bits = bits[begin % 8:begin % 8 + end - begin].reshape(-1, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(
            1, dtype=np.uint64)

    def _one(self, index: int) -> int:
        """Place of the one with this index, from the nearest sample before it."""
        place = int(self._samples[index // SAMPLE])
        left, byte = index % SAMPLE, place // 8
        ones = int(self._high[byte]) >> (place % 8) << (place % 8)
        while _ONES[ones] <= left:
            left -= int(_ONES[ones])
            byte += 1
            ones = int(self._high[byte])
        for place in range(8):
            if ones >> place & 1:
                if not left:
                    return byte * 8 + place
                left -= 1
        raise IndexError(index)

    def select(self, index: int) -> int:
        """The value with this index."""
        if not 0 <= index < self.count:
            raise IndexError(index)
        return ((self._one(index) - index) << self.low_bits) | int(self._lows(index, index + 1)[0])

    def values(self, first: int, last: int) -> np.ndarray:
        """Values ``first``..``last`` - 1, from one select and a scan."""
        if first >= last:
            return np.empty(0, np.uint64)
        begin, end = self._one(first), self._one(last - 1)
        flags = np.unpackbits(self._high[begin // 8:end // 8 + 1], bitorder="little")
        flags[:begin % 8] = 0
        ones = np.flatnonzero(flags)[:last - first] + begin // 8 * 8
        high = (ones - np.arange(first, last)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(first, last)


def write_token_files(docs: DataFrame, path: str, vocabulary: str,
                      end_id: int = END_ID) -> DataFrame:
    """Write shards below ``path``; returns their manifest (shard, file, docs, ids), written too.

    Shard files carry their task attempt; only files of the manifest count, so a repeated task
    does no harm.
    """
    spark = docs.sparkSession
    spread = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    keys = ["doc_id", "_tie", "_row"]
    ordered = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, encode = TaskContext.get(), encoder(vocabulary, specials=True)
        end = np.array([end_id], encode.dtype).tobytes()
        name = f"{path}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.ids"
        stream, lengths, doc_ids, at = None, [], [], len(MAGIC)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                if stream is None:
                    stream = open_output(name)
                    stream.write(MAGIC)
                doc_ids.extend(part.column("doc_id").to_pylist())
                for ids in encode.encode([t or "" for t in part.column("text").to_pylist()]):
                    lengths.append(len(ids) // encode.dtype.itemsize + 1)
                    at += stream.write(ids) + stream.write(end)
        if stream is None:
            return
        nulls = sum(doc_id is None for doc_id in doc_ids)
        first = doc_ids[nulls] if nulls < len(doc_ids) else 0
        ends = EliasFano.encode(np.cumsum(lengths)).to_bytes()
        named = EliasFano.encode(np.array(
            [doc_id - first for doc_id in doc_ids[nulls:]], np.uint64)).to_bytes()
        footer = json.dumps({
            "ids": sum(lengths), "width": encode.dtype.itemsize, "docs": len(lengths),
            "nulls": nulls, "first": first, "boundaries": [at, len(ends)],
            "doc_ids": [at + len(ends), len(named)]}).encode()
        stream.write(ends + named + footer + len(footer).to_bytes(4, "little") + MAGIC)
        stream.close()
        yield pa.RecordBatch.from_pydict({
            "shard": [context.partitionId()], "file": [name], "docs": [len(lengths)],
            "ids": [sum(lengths)]})

    manifest = ordered.mapInArrow(by_batches(write), "shard bigint, file string, docs bigint, ids bigint")
    written = cut_lineage(manifest)
    written.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


class Shard:
    """An opened shard: documents by index, through the select structures."""

    def __init__(self, name: str) -> None:
        self._stream = open_input(name)
        size = self._stream.size()
        tail = self._stream.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"not a token file: {name}")
        length = int.from_bytes(tail[:4], "little")
        self.footer = json.loads(self._stream.read_at(length, size - 12 - length))
        self._ends = self._sequence("boundaries")
        self._named = self._sequence("doc_ids")
        self._dtype = np.dtype("<u2" if self.footer["width"] == 2 else "<u4")

    def _sequence(self, name: str) -> EliasFano:
        at, length = self.footer[name]
        return EliasFano.from_bytes(self._stream.read_at(length, at))

    def close(self) -> None:
        self._stream.close()

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Starts of documents ``first``..``last`` - 1, and the end of the last one."""
        before = [self._ends.select(first - 1)] if first else [0]
        return np.concatenate([np.array(before, np.int64),
                               self._ends.values(first, last).astype(np.int64)])

    def ids(self, begin: int, end: int) -> np.ndarray:
        width = self._dtype.itemsize
        data = self._stream.read_at((end - begin) * width, len(MAGIC) + begin * width)
        return np.frombuffer(data, self._dtype).astype("<u4")

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        nulls = self.footer["nulls"]
        out: list[int | None] = [None] * max(0, min(last, nulls) - first)
        values = self._named.values(max(first - nulls, 0), max(last - nulls, 0))
        return out + [int(value) + self.footer["first"] for value in values]


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) of the shards listed under ``path``.

    The manifest has one row per shard; those rows alone pass through the driver.
    """
    shards = sorted((tuple(r) for r in spark.read.parquet(f"{path}/_manifest").select(
        "shard", "file", "docs", "ids").collect()))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (
        ", ids binary" if with_ids else "")
    rows, before = [], 0
    for _, name, count, ids in shards:
        rows.append((name, before, count))
        before += ids
    listed = spark.createDataFrame(rows, "file string, before bigint, docs bigint")
    listed = listed.repartition(max(1, len(rows)), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"])
                step = max(1, math.ceil(row["docs"] * PART_BYTES / max(
                    PART_BYTES, shard.footer["ids"] * 4)))
                for first in range(0, row["docs"], step):
                    last = min(first + step, row["docs"])
                    bounds = shard.bounds(first, last)
                    pieces = [shard.ids(b, e).tobytes() for b, e in zip(
                        bounds[:-1].tolist(), bounds[1:].tolist())] if with_ids else None
                    if pieces is None:
                        whole = memoryview(shard.ids(int(bounds[0]), int(bounds[-1])).tobytes())
                        cuts = ((bounds - bounds[0]) * 4).tolist()
                        pieces = [whole[b:e] for b, e in zip(cuts[:-1], cuts[1:])]
                    arrays = [pa.array(shard.doc_ids(first, last), pa.int64()),
                              pa.array(bounds[:-1] + row["before"]), pa.array(np.diff(bounds)),
                              pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                    if with_ids:
                        arrays.append(pa.array(pieces, pa.binary()))
                    yield pa.RecordBatch.from_arrays(
                        arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][
                            :len(arrays)])
                shard.close()

    return listed.mapInArrow(by_batches(read), schema)
