"""Rows of files by their place: wide columns are read where they lie and never shuffled.

A decision over narrow columns carries (file_path, row_index) of the rows it picks. `fetch` then
scans the files once more and keeps the picked rows, by bitmaps of 32,768 rows each. The bitmaps are
broadcast, in groups of files whose bitmaps stay below `MARK_BYTES`: more rows make more groups, each
of which scans its own files only, so no broadcast grows with the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.session import cut_lineage

STRETCH = 1 << 15            # rows of one bitmap, as bitmap_construct_agg makes them
MARK_BYTES = 128 << 20
_PER_MARK = STRETCH // 8 + 256
PLACE = ("file_path", "row_index")


def with_place(df: DataFrame) -> DataFrame:
    """A direct read of Parquet files with the place of each row."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.row_index").alias("row_index"))


def has_place(df: DataFrame) -> bool:
    """Whether rows of ``df`` have a place, as direct reads of Parquet files do."""
    from pyspark.errors import AnalysisException

    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def _marked(bitmap: str, place: Column) -> Column:
    """Whether the bit of a row is set in the bitmap of its stretch."""
    offset = F.pmod(place, F.lit(STRETCH)).cast("int")
    byte = F.substring(bitmap, (F.floor(offset / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), offset % 8) == 1


def fetch(source: DataFrame, places: DataFrame, mark_bytes: int = MARK_BYTES) -> DataFrame:
    """The rows of ``source``, a direct read of Parquet files, at ``places``.

    ``places`` has file_path and row_index; it is evaluated once, in narrow rows.
    """
    marks = cut_lineage(places.groupBy(
        "file_path", F.floor(F.col("row_index") / STRETCH).alias("_stretch")).agg(
        F.bitmap_construct_agg(F.pmod("row_index", F.lit(STRETCH))).alias("_bitmap")))
    groups = max(1, -(-marks.count() * _PER_MARK // mark_bytes))
    columns, found = source.columns, []
    for group in range(groups):
        rows, own = with_place(source), marks
        if groups > 1:
            # A condition on the path alone leaves the other groups' files unread.
            number = F.pmod(F.xxhash64("file_path"), F.lit(groups))
            rows = source.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(groups)) == group)
            rows, own = with_place(rows), marks.where(number == group)
        met = rows.withColumn("_stretch", F.floor(F.col("row_index") / STRETCH)).join(
            F.broadcast(own), ["file_path", "_stretch"])
        found.append(met.where(_marked("_bitmap", F.col("row_index"))).select(*columns))
    return reduce(DataFrame.union, found)
