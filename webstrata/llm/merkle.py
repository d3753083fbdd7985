"""Merkle manifest of a dataset: a content-addressed store of digest-to-children records.

Each row is a leaf. The leaves of a tree (a source) ascend by their order column; runs of three
consecutive nodes become the digest of their digests until one is left, and the trees' roots,
ordered by tree, become the root of all in the same way. Digests are SHA-256 of concatenated
lower-case hex digests.

The store keeps records (digest, children). Those of up to `LEVELS` levels below a digest lie in one
row, a segment, found by that digest alone. Leaf requests descend from the root: the digits
of a leaf's rank pick one child of each record, the other children are its siblings. Requests of
one segment descend together, so each segment is looked up once however many leaves ask for it,
and a proof takes one join per segment on its way. Read from the leaf up, the path reversed is the
proof.

Ranks come from a range layout, so a tree that holds most rows is spread like any other. Null
trees come first, null orders first; rows equal in tree and order are ordered by leaf
digest. A null field counts as ``-`` and differs from an empty one. An empty table has no root and
no proofs. Columns other than those of the leaves are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.ordering import running
from webstrata.llm.workers import by_batches
from webstrata.operators.ordered import lay_out
from webstrata.session import cut_lineage

FAN = 3
LEVELS = 6  # of one segment
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_RECORDS = "array<struct<digest: binary, children: array<binary>>>"
_STEPS = "array<struct<digit: int, siblings: array<binary>>>"
_RECORD_TYPE = pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))]))
_STEP_TYPE = pa.list_(pa.struct([("digit", pa.int32()), ("siblings", pa.list_(pa.binary()))]))


def leaf_digest(columns: list[Column]) -> Column:
    """Hex digest of a row's fields: each its UTF-8 length, a colon and its text; null is ``-``."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"),
                                  c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*fields), 256)


def combine(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _height(nodes: int, levels: int) -> int:
    """Levels a segment has above its base, of a tree with so many nodes there."""
    height = 0
    while nodes > 1 and height < levels:
        nodes, height = -(-nodes // FAN), height + 1
    return height


def _segment(digests: list[bytes], height: int) -> tuple[bytes, list[tuple[bytes, list[bytes]]]]:
    """The digest on top of a segment and the records below it."""
    records = []
    for _ in range(height):
        runs = [digests[at:at + FAN] for at in range(0, len(digests), FAN)]
        digests = [combine(run) for run in runs]
        records += zip(digests, runs)
    return digests[0], records


@dataclass
class Manifest:
    """``leaves``: (tree, segment, size, items[place, digest, ...]) by segment of a tree;
    ``trees``: (tree, number, size, rounds, digest); ``store``: (digest, records)."""

    leaves: DataFrame
    trees: DataFrame
    store: DataFrame
    root: str | None
    rounds: int
    top_rounds: int
    levels: int


def _rounds(size: Column, levels: int) -> Column:
    """Segments between a leaf and the root of a tree of this size."""
    wide = FAN ** levels
    reaches = [wide ** n for n in range(1, 64) if wide ** n < 1 << 62]
    return sum(((size > reach).cast("int") for reach in reaches), F.lit(1))


def _in_segments(nodes: DataFrame, carried: list[str], levels: int) -> DataFrame:
    """Nodes (tree, place, size, digest, ...) gathered by segment, in order."""
    wide = FAN ** levels
    return nodes.groupBy("tree", F.floor(F.col("place") / wide).cast(
        "bigint").alias("segment")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct(
            (F.col("place") % wide).cast("int").alias("place"), "digest", *carried))).alias("items"))


def _build(segments: DataFrame, levels: int) -> DataFrame:
    """Rows (tree, segment, size, digest, records) of gathered nodes."""
    schema = f"tree string, segment bigint, size bigint, digest binary, records {_RECORDS}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            tops, kept = [], []
            for items, size in zip(batch.column("digests"), sizes):
                top, records = _segment(items.as_py(), _height(size, levels))
                tops.append(top)
                kept.append([{"digest": d, "children": c} for d, c in records])
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("segment"), batch.column("size"),
                 pa.array(tops, pa.binary()), pa.array(kept, _RECORD_TYPE)],
                names=["tree", "segment", "size", "digest", "records"])

    narrow = segments.select("tree", "segment", "size", F.col("items.digest").alias("digests"))
    return cut_lineage(narrow.mapInArrow(by_batches(build), schema))


def _grow(segments: DataFrame, rounds: int, levels: int) -> list[DataFrame]:
    """Built segments of each round, from the leaves up."""
    wide = FAN ** levels
    built = [_build(segments, levels)]
    while len(built) < rounds:
        below = built[-1].where(F.col("size") > wide)
        nodes = below.select("tree", F.col("segment").alias("place"), F.ceil(
            F.col("size") / wide).cast("bigint").alias("size"), "digest")
        built.append(_build(_in_segments(nodes, [], levels), levels))
    return built


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def build_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tree: str = "source",
                   order: str = "doc_id", carry: dict[str, Column] | None = None,
                   levels: int = LEVELS) -> Manifest:
    """The manifest of all rows of ``docs``.

    ``carry`` names values kept beside each leaf, from the same scan of the rows.
    """
    carry = carry or {}
    carried = ["_order", *carry]
    # Nulls first, and never a null key: "" sorts before "=".
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    leaves = cut_lineage(docs.select(
        key.alias("tree"), F.col(order).alias("_order"),
        F.unhex(leaf_digest([F.col(c) for c in columns])).alias("digest"),
        *[value.alias(name) for name, value in carry.items()]))
    by = ["_order", "digest"]
    ranked = running(lay_out(leaves, ["tree"], by), "tree", by, before="place", total="size")
    segments = cut_lineage(_in_segments(ranked, carried, levels))
    sizes = segments.groupBy("tree").agg(F.max("size").alias("size"))
    numbered = running(lay_out(sizes.withColumn("forest", F.lit("")), ["forest"], ["tree"]), "forest",
                       ["tree"], before="number", total="trees").drop("forest")
    numbered = cut_lineage(numbered.withColumn("rounds", _rounds(F.col("size"), levels)))
    rounds, count = numbered.agg(F.max("rounds"), F.count("*")).first()
    if not count:
        return Manifest(segments, numbered, _build(segments, levels).select(
            "digest", "records"), None, 0, 0, levels)

    built = _grow(segments, rounds, levels)
    # A tree ends with the one segment of its last round.
    tops = _union([level.where(F.col("size") <= FAN ** levels).select("tree", "digest")
                   for level in built])
    trees = cut_lineage(numbered.join(tops, "tree"))
    top_rounds = 1
    while FAN ** (levels * top_rounds) < count:
        top_rounds += 1
    forest = trees.select(F.lit("").alias("tree"), F.col("number").alias("place"),
                          F.col("trees").alias("size"), "digest")
    crown = _grow(_in_segments(forest, [], levels), top_rounds, levels)
    root = crown[-1].select(F.hex("digest")).first()[0].lower()
    # One row per digest. A single node is a tree of its own digest without records, which may
    # be a larger tree's digest as well: the row with records serves both.
    store = _union([level.select("digest", "records") for level in [*built, *crown]])
    store = cut_lineage(store.groupBy("digest").agg(
        F.max_by("records", F.size("records")).alias("records")))
    return Manifest(segments, trees, store, root, rounds, top_rounds, levels)


def _walk(records: dict[bytes, list[bytes]], top: bytes, place: int,
          height: int) -> tuple[bytes, list[tuple[int, list[bytes]]]]:
    """Descend by the digits of ``place``: the node reached and (digit, siblings) from the top."""
    node, steps = top, []
    for level in range(height - 1, -1, -1):
        digit = place // FAN ** level % FAN
        children = records[node]
        steps.append((digit, children[:digit] + children[digit + 1:]))
        node = children[digit]
    return node, steps


def _descend(met: DataFrame, levels: int) -> DataFrame:
    """From (tree, segment, size, places, top, above, records) to each requested node below."""
    schema = f"tree string, place bigint, digest binary, above {_STEPS}"

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                records = {r["digest"]: r["children"] for r in one["records"]}
                height, out = _height(one["size"], levels), []
                for place in one["places"]:
                    node, steps = _walk(records, one["top"], place, height)
                    out.append((one["segment"] * FAN ** levels + place, node, one["above"] + [
                        {"digit": d, "siblings": s} for d, s in steps]))
                places, nodes, above = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["tree"]] * len(out)), pa.array(places, pa.int64()),
                     pa.array(nodes, pa.binary()), pa.array(above, _STEP_TYPE)],
                    names=["tree", "place", "digest", "above"])

    return met.mapInArrow(by_batches(descend), schema)


def _requests(leaves: DataFrame, rounds: int, levels: int) -> list[DataFrame]:
    """Per round, from the leaves up: (tree, segment, size, places) of the segments asked for."""
    wide = FAN ** levels
    asked = [leaves.select("tree", "segment", "size", F.col("items.place").alias("places"))]
    while len(asked) < rounds:
        below = asked[-1].where(F.col("size") > wide).select(
            "tree", F.floor(F.col("segment") / wide).cast("bigint").alias("segment"),
            F.ceil(F.col("size") / wide).cast("bigint").alias("size"),
            (F.col("segment") % wide).cast("int").alias("place"))
        asked.append(below.groupBy("tree", "segment").agg(
            F.max("size").alias("size"), F.collect_set("place").alias("places")))
    return asked


def _meet(asked: DataFrame, frontier: DataFrame, store: DataFrame) -> DataFrame:
    """Requests with the digest their segment was reached by, and the records it names."""
    reached = frontier.select("tree", F.col("place").alias("segment"), F.col("digest").alias("top"),
                              "above", *[c for c in ("subroot",) if c in frontier.columns])
    return asked.join(reached, ["tree", "segment"]).join(
        store.select(F.col("digest").alias("top"), "records"), "top")


def prove(manifest: Manifest, leaves: DataFrame | None = None, shown: str | None = None,
          with_siblings: bool = False) -> DataFrame:
    """A proof per requested leaf, by descent from the root.

    Rows (order, carried columns, leaf, subroot, root, proof_sha256, folded_root, verified) and,
    if asked, ``siblings``, from the leaf up. ``leaves`` are those rows of ``manifest.leaves`` that
    are asked for, all by default; their items may be thinned out. The folded root starts from
    the carried hex digest ``shown`` where it is not null, else from the leaf.
    """
    leaves = manifest.leaves if leaves is None else leaves
    item = leaves.schema["items"].dataType.elementType
    names = [f.name for f in item.fields if f.name not in ("place", "digest")]
    fields = [T.StructField("order" if n == "_order" else n, item[n].dataType) for n in names]
    hexes = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType(fields + [T.StructField(n, T.StringType()) for n in hexes]
                          + [T.StructField("verified", T.BooleanType())]
                          + [T.StructField("siblings", T.ArrayType(T.StringType()))] * with_siblings)
    if manifest.root is None:
        return leaves.sparkSession.createDataFrame([], schema)
    root, store, levels = manifest.root, manifest.store, manifest.levels

    asked = _requests(leaves, manifest.rounds, levels)
    wanted = leaves.select("tree").distinct().join(manifest.trees, "tree")
    forest = wanted.select(F.lit("").alias("tree"), F.col("number").alias("place"),
                           F.col("trees").alias("size"), F.lit(b"").alias("digest"))
    frontier = manifest.store.sparkSession.createDataFrame(
        [("", 0, bytes.fromhex(root), [])], f"tree string, place bigint, digest binary, above {_STEPS}")
    for request in reversed(_requests(_in_segments(forest, [], levels), manifest.top_rounds,
                                      levels)):
        frontier = _descend(_meet(request, frontier, store), levels)
    reached = frontier.select(F.col("place").alias("number"), "digest", "above")
    frontier = cut_lineage(wanted.drop("digest").join(reached, "number").select(
        "tree", F.lit(0).cast("bigint").alias("place"), "digest", "above", "rounds"))
    roots = frontier.select("tree", F.col("digest").alias("subroot"))
    # A tree joins in at the round of its own root segment.
    entering, frontier = frontier, None
    for number in range(manifest.rounds, 1, -1):
        here = entering.where(F.col("rounds") == number).drop("rounds")
        frontier = here if frontier is None else frontier.union(here)
        frontier = cut_lineage(_descend(_meet(asked[number - 1], frontier, store), levels))
    last = entering.where(F.col("rounds") == 1).drop("rounds")
    frontier = last if frontier is None else frontier.union(last)
    frontier = frontier.join(roots, "tree")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _finished(batch.slice(row, 1))

    def _finished(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = batch.column("items").flatten()
        places, own = items.field("place").to_pylist(), items.field("digest").to_pylist()
        given = items.field(shown).to_pylist() if shown else [None] * len(own)
        one = {n: batch.column(n)[0].as_py() for n in ("size", "top", "above", "subroot", "records")}
        records = {r["digest"]: r["children"] for r in one["records"]}
        height = _height(one["size"], levels)
        # What all requests of the segment share: the steps above it, nearest first.
        upper = [(s["digit"], [d.hex() for d in s["siblings"]]) for s in reversed(one["above"])]
        proofs, folds, lists = [], [], []
        for place, digest, seen in zip(places, own, given):
            node, steps = _walk(records, one["top"], place, height)
            if node != digest:
                raise ValueError(f"the store leads to {node.hex()}, not to leaf {digest.hex()}")
            path = [(d, [s.hex() for s in siblings]) for d, siblings in reversed(steps)] + upper
            siblings = [s for _, level in path for s in level]
            proofs.append(hashlib.sha256("".join(siblings).encode()).hexdigest())
            fold = seen or digest.hex()
            for digit, level in path:
                fold = hashlib.sha256("".join(
                    [*level[:digit], fold, *level[digit:]]).encode()).hexdigest()
            folds.append(fold)
            lists.append(siblings)
        arrays = [items.field(n) for n in names] + [
            pa.array([d.hex() for d in own]), pa.array([one["subroot"].hex()] * len(own)),
            pa.array([root] * len(own)), pa.array(proofs), pa.array(folds),
            pa.array([fold == root for fold in folds])]
        arrays += [pa.array(lists, pa.list_(pa.string()))] * with_siblings
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    met = _meet(leaves.select("tree", "segment", "size", "items"), frontier, store)
    return met.mapInArrow(by_batches(finish), schema)
