"""Shared pieces of the operators: added columns, blocks of large groups, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.workers import by_batches
from webstrata.session import cut_lineage


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def others(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` whose names do not clash with ``names``, in any case."""
    taken = {name.lower() for name in names}
    return [column for column in df.columns if column.lower() not in taken]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with as many leading underscores as it takes to clash with no column."""
    taken = {column.lower() for column in df.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        free.append(name)
    return free


def add_columns(df: DataFrame, ddl: str,
                compute: Callable[[Iterator[pa.RecordBatch]],
                                  Iterator[tuple[pa.RecordBatch, list[pa.Array]]]],
                keep: list[str] | None = None) -> DataFrame:
    """Append columns that ``compute`` derives; it yields each batch, or part, with its arrays.

    Columns of ``df`` with the same names give way. ``keep`` lists those that stay.
    """
    added = schema_of(ddl)
    kept = others(df, added.names) if keep is None else keep
    schema = T.StructType([df.schema[name] for name in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, arrays in compute(batches):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), *arrays], names=schema.names)

    return df.mapInArrow(by_batches(run, compute.__module__), schema)


def text_total(df: DataFrame, column: str) -> int:
    """Bytes of all texts: sizes bucket and group counts."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("bigint"))).first()[0] or 0)


def in_cells(df: DataFrame, key: list[str], spread: str, block: int, weight: str | None = None,
             heaviest: int = 1 << 20) -> DataFrame:
    """Deal the rows of each key into cells such that any two of them share a cell.

    Keys of up to ``block`` rows have one cell. Larger ones are cut into blocks by a hash of
    ``spread``, with a cell for each two blocks, so no cell holds much over two blocks. Adds
    ``_left`` and ``_right``, the blocks of the cell, and ``_block``, that of the row: compare
    rows of different blocks only where ``_left`` and ``_right`` differ. Keys of one row go. With a
    ``weight`` column, blocks also hold about ``heaviest`` of it at most.
    """
    load = F.sum(weight) / heaviest if weight else F.lit(0)
    sizes = (df.groupBy(*key).agg(F.count("*").alias("_size"), load.alias("_load"))
             .where(F.col("_size") > 1)
             .select(*key, F.ceil(F.greatest(F.col("_size") / block, "_load")).cast("int")
                     .alias("_blocks")))
    own = F.pmod(F.xxhash64(F.col(spread), F.lit(29)), F.col("_blocks")).cast("int")
    dealt = df.join(sizes, key).withColumn("_block", own)
    mate = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (dealt.withColumn("_mate", mate)
            .withColumn("_left", F.least("_block", "_mate"))
            .withColumn("_right", F.greatest("_block", "_mate")).drop("_mate", "_blocks"))


def _print(pairs: DataFrame) -> tuple:
    """Count and hash sum of a set of pairs."""
    return pairs.agg(F.count("*"),
                     F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each id of ``edges`` (a, b): rows (id, component_id).

    Alternates large-star and small-star steps; each writes its edges to the shared folder,
    and they end when no edge changes. Stars need a map-side minimum per id only, so ids with
    very many edges do no harm.
    """
    pairs = cut_lineage(edges.select(F.col("a").cast("bigint").alias("a"),
                                     F.col("b").cast("bigint").alias("b"))
                        .where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                F.least("a", "b").alias("b")).distinct())
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: larger neighbours move to the smallest neighbour.
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        large = cut_lineage(large.distinct())
        # Small star: an id and its smaller neighbours move to the smallest of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(
            F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")
        ).where("a <> b")
        after = cut_lineage(small.distinct())
        done = _print(after) == _print(pairs)
        pairs = after
        if done:
            break
    centres = pairs.groupBy("a").agg(F.min("b").alias("b"))
    return centres.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        centres.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
