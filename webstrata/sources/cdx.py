"""CDX capture index: 11 space-separated fields, one line per response record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.headers import content_type
from webstrata.functions.urls import surt_key
from webstrata.session import cut_lineage

HEADER_LINE = " CDX N b a m s k r M S V g"
FIELDS = ("urlkey", "ts", "url", "mime", "status", "digest", "redirect", "meta", "length",
          "offset", "filename")


def index_fields(url: Column, ts: Column, status: Column, headers: Column) -> list[Column]:
    """The fields that do not depend on where the record lies."""
    mime = F.trim(F.split_part(content_type(headers), F.lit(";"), F.lit(1)))
    moved = F.filter(headers, lambda h: F.lower(h["name"]) == "location")
    location = F.when(status.between(300, 399), F.try_element_at(moved, F.lit(1))["value"])
    return [
        surt_key(url).alias("urlkey"), F.date_format(
            F.to_utc_timestamp(ts, F.current_timezone()), "yyyyMMddHHmmss").alias("ts"),
        url.alias("url"),
        F.coalesce(F.when(mime != "", F.replace(mime, F.lit(" "), F.lit("%20"))), F.lit("-")
                   ).alias("mime"),
        F.coalesce(status.cast("string"), F.lit("-")).alias("status"),
        F.coalesce(F.replace(location, F.lit(" "), F.lit("%20")), F.lit("-")).alias("redirect")]


def cdx_index(records: DataFrame) -> DataFrame:
    """Index rows of the response records, in no particular order."""
    responses = records.where(F.col("warc_type") == "response")
    return responses.select(
        *index_fields(F.col("target_uri"), F.col("date"), F.col("http_status"),
                      F.col("http_headers")),
        F.coalesce("payload_digest", F.lit("-")).alias("digest"), F.lit("-").alias("meta"),
        "length", "offset", "filename").select(*FIELDS)


def write_cdx(cdx: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sorted text lines; the header is the first line of the first part file.

    The parts in name order form one valid index: the header sorts before any key. The
    rows are materialised before sorting, which samples its input: otherwise the archive
    would be read twice.
    """
    spark = cdx.sparkSession
    cdx = cut_lineage(cdx)
    header = spark.range(1).select(F.lit("").alias("urlkey"), F.lit("").alias("ts"),
                                   F.lit(HEADER_LINE).alias("line"))
    lines = cdx.select("urlkey", "ts", F.concat_ws(" ", *[F.col(f).cast("string")
                                                          for f in FIELDS]).alias("line"))
    (header.unionByName(lines).orderBy("urlkey", "ts", "line").select("line")
     .write.mode(mode).text(path))


def read_cdx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an index as written by `write_cdx`."""
    parts = spark.read.text(path).where(~F.col("value").startswith(" CDX")).select(
        F.split("value", " ").alias("p"))
    columns = [F.col("p")[i].alias(name) for i, name in enumerate(FIELDS)]
    return parts.select(*columns).withColumns(
        {"length": F.col("length").cast("bigint"), "offset": F.col("offset").cast("bigint")})
