"""WARC archives: a native writer with revisits, a reader that verifies record chains.

Writing is one projection and Spark's text sink with the record terminator as its line
separator, so shards are committed like any table. Reading cannot trust the magic line, which a
payload may hold as well. Tasks scan byte ranges and emit each candidate with its successor's
offset; within a range they contract chains to the first offset beyond it. Pointer jumping from
offset 0 then doubles the hops until every range has its true entry, and only chains from
those entries are parsed.

A null payload counts as empty, a null page id as smaller than any other. Rows that share the
largest page id of equal payloads are all responses. Empty tables give empty archives. Other
columns are not archived.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.files import open_input
from webstrata.llm.workers import by_batches
from webstrata.session import cut_lineage

REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
_HEAD_STEP = 1 << 16
_BATCH_BYTES = 8 << 20
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.I)
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "path string, offset bigint, length bigint, record_type string, record_id string, "
    "page_id bigint, target_uri string, payload_bytes bigint, payload_digest string, "
    "refers_to bigint, payload binary")


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Columns page_id, url, body, digest, bytes, revisits (page id of the response, or null)."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("body"), F.sha1(body).alias("digest"),
        F.octet_length(body).cast("bigint").alias("bytes"))
    groups = (rows.where(F.col("bytes") >= least).groupBy("digest", "bytes")
              .agg(F.max("page_id").alias("_first"), F.count("*").alias("_copies"))
              .where("_copies > 1").select(F.col("digest").alias("_digest"), "_first"))
    # Written first, its size is known when the join is planned: Spark broadcasts it below its
    # threshold and shuffles the pages above it, where adaptive execution splits a hot payload.
    groups = cut_lineage(groups)
    return rows.join(groups, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "body", "digest", "bytes",
        F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("revisits"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                  least: int = REVISIT_BYTES) -> None:
    """Write one record per page below ``path``; equal payloads of ``least`` bytes revisit one."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    revisit = F.col("revisits").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    target = F.coalesce(F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20"), F.lit("urn:none"))
    extra = F.when(revisit, F.concat(
        F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"),
        F.col("revisits"), F.lit(">"))).otherwise(F.lit(""))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(
            F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(f">\r\nWARC-Date: {date}"),
        F.lit("\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), extra,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size,
        F.lit("\r\n\r\n"), block)
    (plan_records(pages, least).select(record.alias("value")).write
     .option("lineSep", "\r\n\r\n").text(path))


def _successors(path: str, size: int, start: int, end: int) -> list[tuple[int, int, int]]:
    """Candidates that begin in [start, end): offset, successor, first offset beyond the range.

    The last is the file size where the chain ends there, and -1 where it breaks.
    """
    with open_input(path) as stream:
        data = stream.read_at(min(end + 16, size) - start, start)
        nexts = {}
        for match in _MAGIC.finditer(data):
            offset = start + match.start()
            if offset >= end:
                break
            head_at, head = match.start(), data
            close = head.find(b"\r\n\r\n", head_at)
            step, seen = _HEAD_STEP, start + len(data)
            while close < 0 and seen < size:  # the header runs on past what was read
                head, head_at = stream.read_at(min(step, size - offset), offset), 0
                close, step, seen = head.find(b"\r\n\r\n"), step * 2, offset + len(head)
            length = _LENGTH.search(head, head_at, close + 2) if close >= 0 else None
            if length:
                nexts[offset] = offset + close + 4 - head_at + int(length[1]) + 4
    exits: dict[int, int] = {}
    for offset in sorted(nexts, reverse=True):
        after = nexts[offset]
        if after < end and after < size:
            exits[offset] = exits.get(after, -1)
        else:
            exits[offset] = after if after <= size else -1
    return [(offset, nexts[offset], exits[offset]) for offset in sorted(nexts)]


def candidates(ranges: DataFrame) -> DataFrame:
    """(path, size, offset, successor, exit) of every candidate of (path, size, start, end)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = _successors(row["path"], row["size"], row["start"], row["end"])
                if found:
                    offsets, nexts, exits = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["path"]] * len(found)),
                         pa.array([row["size"]] * len(found), pa.int64()),
                         pa.array(offsets, pa.int64()), pa.array(nexts, pa.int64()),
                         pa.array(exits, pa.int64())],
                        names=["path", "size", "offset", "successor", "exit"])

    return ranges.mapInArrow(
        by_batches(scan), "path string, size bigint, offset bigint, successor bigint, exit bigint")


def entries(found: DataFrame, hops: int) -> DataFrame:
    """(path, size, offset, exit): where the chain of each file enters each of its ranges.

    Pointer jumping: after k rounds all entries within 2**k hops of offset 0 are known.
    """
    targets = found.where("exit >= 0 and exit < size").select(
        "path", F.col("exit").alias("offset")).distinct()
    names = ["path", "size", "offset", "exit"]
    jump = cut_lineage(found.join(targets, ["path", "offset"], "left_semi").select(*names)
                       .union(found.where("offset = 0").select(*names)))
    nodes, reached = jump, jump.where("offset = 0").select("path", "offset").distinct()
    for _ in range(max(0, math.ceil(math.log2(max(1, hops))))):
        landed = reached.join(jump, ["path", "offset"]).where("exit >= 0").select(
            "path", F.col("exit").alias("offset"))
        reached = cut_lineage(reached.union(landed).distinct())
        far = jump.select("path", F.col("offset").alias("exit"), F.col("exit").alias("_far"))
        jump = cut_lineage(jump.join(far, ["path", "exit"], "left").select(
            "path", "size", "offset", F.coalesce("_far", "exit").alias("exit")))
    return nodes.distinct().join(reached, ["path", "offset"], "left_semi")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip()
            for name, _, value in (line.partition(":") for line in lines)}


def _page(text: str | None) -> int | None:
    match = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(match[1]) if match else None


def _parse(data: bytes, keep_payload: bool) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = block[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload)
    if kind == "revisit":
        size, payload = int(_fields(http)["content-length"]), None
    elif digest != hashlib.sha1(payload).hexdigest():
        raise ValueError(f"payload digest differs: {fields.get('warc-record-id')}")
    return (kind, fields.get("warc-record-id"), _page(fields.get("warc-record-id")),
            fields.get("warc-target-uri"), size, digest, _page(fields.get("warc-refers-to")),
            payload if keep_payload else None)


def read_archive(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES,
                 payload: bool = True, strict: bool = True) -> DataFrame:
    """Records of the archives below ``path``; with ``strict``, a broken chain is an error."""
    files = spark.read.format("binaryFile").load(path).select(
        "path", F.col("length").alias("size")).where("size > 0")
    count, largest, total = files.agg(F.count("*"), F.max("size"), F.sum("size")).first()
    width = max(1, min((total or 0) // range_bytes + 1, 100_000))
    cuts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1,
                                F.lit(range_bytes).cast("bigint")))
    ranges = files.select("path", "size", cuts.alias("start")).withColumn(
        "end", F.least(F.col("start") + range_bytes, "size"))
    found = cut_lineage(candidates(ranges.repartition(width, "path", "start")))
    entered = entries(found, math.ceil((largest or 0) / range_bytes))
    if strict:
        whole = entered.where("exit = size").select("path").distinct().count()
        if whole != count:
            raise ValueError(f"{count - whole} archives under {path} have a broken record chain")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                            ("record_type", pa.string()), ("record_id", pa.string()),
                            ("page_id", pa.int64()), ("target_uri", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for entry in batch.to_pylist():
                end = (entry["offset"] // range_bytes + 1) * range_bytes
                chain = [r for r in _successors(entry["path"], entry["size"], entry["offset"],
                                                min(end, entry["size"]))]
                follow = {offset: after for offset, after, _ in chain}
                at = entry["offset"]
                with open_input(entry["path"]) as stream:
                    while at in follow and follow[at] <= entry["size"]:
                        data = stream.read_at(follow[at] - at, at)
                        rows.append((entry["path"], at, len(data), *_parse(data, payload)))
                        held += len(data) if payload else 512
                        at = follow[at]
                        if held >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(
                                [dict(zip(schema.names, r)) for r in rows], schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    spread = entered.select("path", "size", "offset").repartition(width, "path", "offset")
    return spread.mapInArrow(by_batches(parse), RECORD_SCHEMA)
