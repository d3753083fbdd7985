"""Near-dedup of vectors: Euclidean p-stable hashing, then exact cosines.

Unit vectors are projected on Gaussian directions, shifted and cut into steps of ``STEP``; the
step numbers of ``depth`` projections form the bucket key of one table. ``depth`` follows the
largest label's size, so buckets of unrelated vectors stay small, and the number of tables
follows ``depth``, so a pair at the threshold is missed in all of them with probability ``MISS``.

Equal vectors of a label form one class with a weight. Buckets with one class are dropped, and of
buckets with the same members the first table's alone is kept. Tasks compare blocks of a bucket;
they return, per vector, the weight of its links and one edge to its component in the block, never
pairs. A pair counts in the first table where it meets.

A vector that is null, zero, or holds null or non-finite components, or whose label or id is null,
links with nothing: n_links 0, component_id its own id, kept. Only vectors of equal length can
link. Rows that share a vec_id count as one vector with the links of all. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.frames import components, in_cells
from webstrata.llm.text import mix
from webstrata.llm.workers import by_batches, by_group
from webstrata.session import cut_lineage

COSINE = 0.98
STEP = 8.0  # in distances at the threshold
MISS = 1e-4
BLOCK = 512
SEED = 3


def _collide(ratio: float) -> float:
    """Chance that two points meet in one projection; ``ratio`` is step over distance."""
    return (1 - math.erfc(ratio / math.sqrt(2))
            - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2)))


def table_plan(largest: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int, float]:
    """Projections per table, tables, and step, for labels of up to ``largest`` vectors."""
    near = math.sqrt(2 - 2 * cosine)
    step = STEP * near
    far = _collide(step / math.sqrt(2))
    depth = max(4, math.ceil(math.log(10 * max(1, largest)) / -math.log(far)))
    tables = math.ceil(math.log(miss) / math.log(1 - _collide(STEP) ** depth))
    return depth, tables, step


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares cannot overflow
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def bucket_keys(units: np.ndarray, labels: np.ndarray, depth: int, tables: int,
                step: float) -> np.ndarray:
    """64-bit bucket keys (vectors, tables); label, length and table are part of them."""
    size = units.shape[1]
    random = np.random.default_rng([SEED, size])
    keys = np.empty((len(units), tables), np.uint64)
    start = mix(labels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                + np.uint64(size))
    for table in range(tables):
        directions = random.standard_normal((size, depth))
        shifts = random.uniform(0, step, depth)
        steps = np.floor((units @ directions + shifts) / step).astype(np.int64).view(np.uint64)
        key = start + np.uint64(table)
        for place in range(depth):
            key = mix(key * np.uint64(0x2545F4914F6CDD1D) + steps[:, place])
        keys[:, table] = key
    return keys


def _rows(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors, by length."""
    sizes = np.asarray(lists.value_lengths())
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), size)


def _hashed(heads: DataFrame, depth: int, tables: int, step: float) -> DataFrame:
    """Append ``keys``, the vector's bucket keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            keys = np.empty((batch.num_rows, tables), np.uint64)
            for rows, vectors in _rows(batch.column("vector")):
                keys[rows] = bucket_keys(unit_rows(vectors), labels[rows], depth, tables, step)
            listed = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()),
                pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed],
                                             names=[*batch.schema.names, "keys"])

    return heads.mapInArrow(by_batches(run), "id bigint, label bigint, weight bigint, vector array<double>, "
                                 "keys array<bigint>")


def _least_labels(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, by row number."""
    labels = np.arange(count)
    while True:
        before = labels.copy()
        least = np.minimum(labels[left], labels[right])
        np.minimum.at(labels, left, least)
        np.minimum.at(labels, right, least)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def _compare(table: pa.Table, cosine: float) -> pa.Table:
    """Links within one cell of one bucket: rows (id, other, links)."""
    table = table.combine_chunks().sort_by("id")
    ids, weights, blocks, at = (table.column(c).to_numpy()
                                for c in ("id", "weight", "_block", "_table"))
    count, place = len(ids), int(at[0])
    units = unit_rows(table.column("vector").combine_chunks().flatten().to_numpy().reshape(
        count, -1))
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(count, -1)[:, :place]
    one, other = table.column("_left")[0].as_py(), table.column("_right")[0].as_py()
    first, second = np.flatnonzero(blocks == one), np.flatnonzero(blocks == other)
    links, lefts, rights = np.zeros(count, np.int64), [], []
    for start in range(0, len(first), 128):
        part = first[start:start + 128]
        x, y = np.nonzero(units[part] @ units[second].T >= cosine)
        left, right = part[x], second[y]
        if one == other:
            left, right = left[left < right], right[left < right]
        lefts.append(left)
        rights.append(right)
        new = np.ones(len(left), bool)
        for row in range(place):  # pairs that met in an earlier table were counted there
            new &= keys[left, row] != keys[right, row]
        np.add.at(links, left[new], weights[right[new]])
        np.add.at(links, right[new], weights[left[new]])
    left, right = np.concatenate(lefts or [first[:0]]), np.concatenate(rights or [first[:0]])
    labels = _least_labels(count, left, right)
    told = (links > 0) | (labels != np.arange(count))
    return pa.table({"id": ids[told], "other": ids[labels[told]], "links": links[told]})


def link_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of (vec_id, embedding, label)."""
    values = F.col("embedding").cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & values.isNotNull()
            & ~F.coalesce(bad, F.lit(True))
            & F.coalesce(F.exists(values, lambda x: x != 0), F.lit(False)))
    rows = cut_lineage(vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), good.alias("_good"),
        F.when(good, F.col("label").cast("bigint")).alias("label"),
        F.when(good, values).alias("vector"),
        F.when(good, F.xxhash64("label", values)).alias("f1"),
        F.when(good, F.xxhash64(values, F.lit(7))).alias("f2")))
    classes = cut_lineage(rows.where("_good").groupBy("f1", "f2").agg(
        F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("weight"),
        F.first("label").alias("label"), F.first("vector").alias("vector")))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth, tables, step = table_plan(largest, cosine, miss)
    hashed = cut_lineage(_hashed(classes.select("id", "label", "weight", "vector"),
                                 depth, tables, step))
    keyed = hashed.select("id", F.posexplode("keys").alias("_table", "h"))
    buckets = (keyed.groupBy("h").agg(
        F.min("_table").alias("_table"), F.count("*").alias("_n"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("_s"),
        F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("_t")).where("_n > 1")
        .groupBy("_n", "_s", "_t").agg(F.min(F.struct("_table", "h")).alias("_b"))
        .select("_b._table", "_b.h"))
    members = cut_lineage(keyed.select("id", "h").join(buckets, "h"))
    cells = in_cells(members, ["h"], "id", BLOCK).join(
        hashed.select("id", "weight", "vector", "keys"), "id")
    found = cut_lineage(cells.groupBy("h", "_left", "_right").applyInArrow(
        by_group(lambda table: _compare(table, cosine)), "id bigint, other bigint, links bigint"))
    counts = found.groupBy("id").agg(F.sum("links").alias("_links"))
    aliases = rows.where("_good").join(classes.select("f1", "f2", "id"), ["f1", "f2"]).where(
        "vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    parts = components(found.select(F.col("id").alias("a"), F.col("other").alias("b"))
                       .union(aliases)).select(F.col("id").alias("vec_id"), "component_id")
    linked = classes.select("f1", "f2", "id", "weight").join(counts, "id", "left").select(
        "f1", "f2", (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("_links"))
    return rows.join(linked, ["f1", "f2"], "left").join(parts, "vec_id", "left").select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias(
            "kept"))
