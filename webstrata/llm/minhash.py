"""b-bit MinHash near-dedup over word shingles, with exact confirmation.

Per text, the minima of ``BANDS * ROWS`` hash functions over its shingles give band keys, which
find candidates, and a packed signature that keeps the low ``BITS`` bits of each minimum. The
signature is stored as bit planes, so the agreeing minima of two texts are counted by xor, or
and bit counts, and the similarity follows after correcting for chance collisions. Candidates
that the estimate does not rule out, six deviations below the threshold, are confirmed on their
full shingle sets.

Texts with equal sets form one class, and only its smallest id goes on. No pairs
of a bucket are listed: each class is first tried with the smallest id it shares a bucket with.
Classes that may still link outside their component then meet in their bucket, in blocks, with
their full sets; a block returns one edge per class to what it links with there.

A null or empty text has no shingles and links with nothing; a text with fewer words than a
shingle is one shingle. A row without doc_id links with nothing and stays. Rows that share a
doc_id are one document: if its texts differ, the links of all count. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.frames import components, in_cells
from webstrata.llm.text import Words, mix, range_hashes, slices, text_bytes
from webstrata.llm.workers import by_batches, by_group
from webstrata.session import cut_lineage, temporary_tables

SHINGLE_WORDS = 5
PERCENT = 80
BANDS, ROWS = 24, 4
BITS = 4
BLOCK = 1024
CHUNK_BYTES = 1 << 20
_HASHES = BANDS * ROWS
_PLANE_BYTES = -(-_HASHES // 64) * 8
_SEEDS = mix(np.arange(1, 2 * _HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _SEEDS[:_HASHES] | np.uint64(1), _SEEDS[_HASHES:]
_SHORT = np.uint64(0xA0761D6478BD642F)
_OTHER = np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and their ends per text."""
    _, hashes = words.windows(size)
    counts = np.maximum(words.counts - (size - 1), 0)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        own = mix(range_hashes(words.hashes, words.first[short], words.first[short + 1])
                  ^ (_SHORT * words.counts[short].astype(np.uint64)))
        hashes = np.insert(hashes, np.concatenate([[0], np.cumsum(counts)])[short], own)
        counts[short] = 1
    ends = np.cumsum(counts)
    sets = [np.unique(hashes[e - n:e]) for n, e in zip(counts.tolist(), ends.tolist())]
    return (np.concatenate(sets) if sets else hashes), np.cumsum([len(s) for s in sets])


def signatures(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts, BANDS) and bit planes (texts, BITS, _PLANE_BYTES) of non-empty sets."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    minima = np.empty((len(ends), _HASHES), np.uint64)
    for k in range(_HASHES):
        minima[:, k] = np.minimum.reduceat(hashes * _FACTORS[k] + _SHIFTS[k], begins)
    minima = mix(minima)
    keys = np.zeros((len(ends), BANDS), np.uint64)
    for row in range(ROWS):
        keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + minima[:, row::ROWS])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    planes = np.zeros((len(ends), BITS, _PLANE_BYTES), np.uint8)
    for bit in range(BITS):
        packed = np.packbits(((minima >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=1)
        planes[:, bit, :packed.shape[1]] = packed
    return keys, planes


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures: agreeing minima, corrected for chance agreement.

    ``left`` and ``right`` are 64-bit words (..., BITS, words) that broadcast.
    """
    differ = np.bitwise_or.reduce(left ^ right, axis=-2)
    agree = 1 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) / _HASHES
    chance = 2.0 ** -BITS
    return (agree - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    share = percent / 100
    return share - 6 * (share * (1 - share) / _HASHES) ** 0.5 / (1 - 2.0 ** -BITS)


def sign(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, f1, f2, planes, bands): size, fingerprint and signature of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                sets, ends = shingle_sets(
                    Words(*text_bytes(part.column("text")), fold_case=True), size)
                sizes = np.diff(ends, prepend=0).astype(np.int64)
                full = sizes > 0
                prints = np.zeros((len(sizes), 2), np.int64)
                bands: list = [None] * len(sizes)
                packed: list = [None] * len(sizes)
                if full.any():
                    begins = ends[full] - sizes[full]
                    prints[full, 0] = np.add.reduceat(mix(sets), begins).view(np.int64)
                    prints[full, 1] = np.add.reduceat(mix(sets ^ _OTHER), begins).view(np.int64)
                    keys, planes = signatures(sets, ends[full])
                    for at, row in enumerate(np.flatnonzero(full).tolist()):
                        bands[row] = keys[at].view(np.int64)
                        packed[row] = planes[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pa.array(prints[:, 0]),
                     pa.array(prints[:, 1]), pa.array(packed, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "f1", "f2", "planes", "bands"])

    return docs.mapInArrow(by_batches(run), "doc_id bigint, n bigint, f1 bigint, f2 bigint, planes binary, "
                                "bands array<bigint>")


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, n, shingles) of the wanted ids; texts cross the shuffle compressed."""
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                texts = [pack.compress(t.encode()) if t else None
                         for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.binary())], names=["id", "body"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = pa.array([unpack.decompress(b) if b else b"" for b in
                                  part.column("body").to_pylist()], pa.binary()).cast(pa.string())
                sets, ends = shingle_sets(Words(*text_bytes(texts), fold_case=True), size)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64).tolist()
                blobs = [sets[b:e].tobytes() for b, e in zip(begins, ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(blobs, pa.binary())], names=["id", "shingles"])

    squeezed = docs.where(F.col("doc_id").isNotNull()).mapInArrow(by_batches(squeeze), "id bigint, body binary")
    return squeezed.join(wanted, "id", "left_semi").mapInArrow(by_batches(build), "id bigint, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keep = []
                for one, other in zip(part.column("_a").to_pylist(), part.column("_b").to_pylist()):
                    x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared > 0
                                and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "_a", "_b").mapInArrow(by_batches(run), "a bigint, b bigint")


def _open_pairs(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a cell with later rows of other components that the estimate does not rule out.

    A pair belongs to the first band where its texts meet.
    """
    least = least_estimate(percent)
    parts, sizes, blocks = (table.column(c).to_numpy() for c in ("component", "n", "_block"))
    band = table.column("band")[0].as_py()
    words = np.frombuffer(b"".join(table.column("planes").to_pylist()), np.uint64).reshape(
        len(parts), BITS, -1)
    earlier = table.column("bands").combine_chunks().flatten().to_numpy().reshape(
        len(parts), -1)[:, :band]
    same_cell = table.column("_left")[0].as_py() == table.column("_right")[0].as_py()
    for row in range(len(parts) - 1):
        fits = (parts[row + 1:] != parts[row]) & (
            100 * np.minimum(sizes[row + 1:], sizes[row])
            >= percent * np.maximum(sizes[row + 1:], sizes[row]))
        if not same_cell:
            fits &= blocks[row + 1:] != blocks[row]
        others = np.flatnonzero(fits) + row + 1
        if len(others):
            others = others[estimate(words[row], words[others]) >= least]
            others = others[(earlier[others] != earlier[row]).all(axis=1)]
        if len(others):
            yield row, others


def _open_rows(table: pa.Table, percent: int) -> pa.Table:
    """The rows of a cell that have a pair to confirm there."""
    wanted = np.zeros(table.num_rows, bool)
    for row, others in _open_pairs(table, percent):
        wanted[row] = True
        wanted[others] = True
    return table.filter(pa.array(wanted))


def _settle(table: pa.Table, percent: int) -> pa.Table:
    """Edges (a, b) that join the members of a cell linked by a confirmed pair."""
    table = table.combine_chunks()
    ids = table.column("id").to_numpy()
    blobs = table.column("shingles").to_pylist()
    sizes = np.array([len(blob) // 8 for blob in blobs])
    codes = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    marked = np.zeros(int(codes.max()) + 1, bool)
    label = np.arange(len(ids))
    for row, others in _open_pairs(table, percent):
        others = others[label[others] != label[row]]  # not those joined in this cell meanwhile
        if not len(others):
            continue
        marked[codes[begins[row]:ends[row]]] = True
        if len(others) * 2 > len(ids):
            sums = np.concatenate([[0], np.cumsum(marked[codes])])
            shared = sums[ends[others]] - sums[begins[others]]
        else:
            shared = np.array([marked[codes[begins[o]:ends[o]]].sum() for o in others.tolist()])
        marked[codes[begins[row]:ends[row]]] = False
        alike = others[100 * shared >= percent * (sizes[row] + sizes[others] - shared)]
        if len(alike):
            joined = np.unique(np.append(label[alike], label[row]))
            label[np.isin(label, joined)] = joined[0]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table({"a": ids[moved], "b": ids[label[moved]]})


def _links_outside(members: DataFrame, heads: DataFrame, sets: DataFrame, parts: DataFrame,
                   percent: int) -> DataFrame:
    """Edges for all confirmed pairs between different components, found bucket by bucket."""
    placed = members.join(parts, "id", "left").select(
        "h", "band", "id", "n", F.coalesce("component_id", "id").alias("component"))
    mixed = placed.groupBy("h", "band").agg(
        F.min("component").alias("_x"), F.max("component").alias("_y"), F.count("*").alias("_n"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("_s"),
        F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("_t")).where("_x < _y")
    # Of buckets with the same members, the first band's holds all their pairs.
    once = mixed.groupBy("_n", "_s", "_t").agg(F.min(F.struct("band", "h")).alias("_b")).select(
        "_b.h")
    cells = in_cells(placed.join(once, "h", "left_semi"), ["h"], "id", BLOCK, "n").join(
        heads.select("id", "planes", "bands"), "id").select(
        "h", "_left", "_right", "_block", "band", "id", "component", "n", "planes", "bands")
    opened = cut_lineage(cells.groupBy("h", "_left", "_right").applyInArrow(
        by_group(lambda table: _open_rows(table, percent)), cells.schema))
    return opened.join(sets, "id").groupBy("h", "_left", "_right").applyInArrow(
        by_group(lambda table: _settle(table, percent)), "a bigint, b bigint")


def link(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of ``docs``.

    They are written to the shared folder; the tables made on the way are deleted.
    """
    with temporary_tables(docs.sparkSession):
        return cut_lineage(_link(docs, size, percent), outlive=True)


def _link(docs: DataFrame, size: int, percent: int) -> DataFrame:
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    signed = cut_lineage(sign(narrow, size))
    sized = signed.where("n > 0 and doc_id is not null")
    classes = sized.groupBy("f1", "f2").agg(F.min("doc_id").alias("class_id"))
    heads = (sized.join(classes.select("f1", "f2", F.col("class_id").alias("doc_id")),
                        ["doc_id", "f1", "f2"], "left_semi")
             .select(F.col("doc_id").alias("id"), "n", "planes", "bands"))
    keyed = heads.select("id", "n", F.posexplode("bands").alias("band", "h"))
    buckets = keyed.groupBy("h").agg(F.count("*").alias("_n"), F.min("id").alias("least")).where(
        "_n > 1").select("h", "least")
    members = cut_lineage(keyed.join(buckets, "h"))
    sets = cut_lineage(_sets_of(narrow, members.select("id").distinct(), size))

    # Each member with the smallest id it shares a bucket with.
    first = members.where("id <> least").groupBy("id").agg(F.min("least").alias("b")).select(
        F.col("id").alias("a"), "b")
    links = cut_lineage(confirm(first, sets, percent))
    links = links.union(cut_lineage(_links_outside(
        members, heads, sets, components(links), percent)))
    # Rows of one doc_id with different sets belong together.
    aliases = sized.join(classes, ["f1", "f2"]).where("doc_id <> class_id").select(
        F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    parts = components(links.union(aliases))
    return signed.join(parts, signed["doc_id"] == parts["id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias(
            "kept"))
