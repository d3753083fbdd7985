"""WARC archives as a Spark data source: sharded writer, streaming reader.

Registered as format ``warc``. The writer takes calls and writes, per task, shards of a
bounded size that start with their own warcinfo record; compressed ones have one gzip member per
record. The reader yields one row per record, with its file, offset and length in the file.

Shards are read whole, or in byte ranges planned from their sizes alone. A range reads the records
that begin in it. Small ranges that lie side by side share a task, which finds the first record from
a sparse index, a small file per shard of the offsets of some records, and walks on from there.
Neither the driver nor an option holds offsets.

An archive may be published by commits: shards keep the names of their attempts, and a job counts
from the moment its one commit file appears (`_Commits`). `read_exchanges` pairs requests and
responses where they lie.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader,
                                    InputPartition, WriterCommitMessage)

HEADER_TYPE = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
RECORD_SCHEMA = (
    "filename string, offset bigint, length bigint, warc_type string, record_id string, "
    "concurrent_to string, target_uri string, date timestamp, http_method string, "
    "http_status int, http_headers array<struct<name:string,value:string>>, payload binary, "
    "payload_digest string")
_ARROW_SCHEMA = pa.schema([
    ("filename", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()),
    ("target_uri", pa.string()), ("date", pa.timestamp("us", "UTC")),
    ("http_method", pa.string()), ("http_status", pa.int32()), ("http_headers", HEADER_TYPE),
    ("payload", pa.binary()), ("payload_digest", pa.string())])
EXCHANGE_SCHEMA = (
    "record_id string, ts timestamp, method string, uri string, "
    "req_headers array<struct<name:string,value:string>>, req_body binary, status int, "
    "resp_headers array<struct<name:string,value:string>>, resp_body binary")
_EXCHANGES = pa.schema([
    ("record_id", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("method", pa.string()),
    ("uri", pa.string()), ("req_headers", HEADER_TYPE), ("req_body", pa.binary()),
    ("status", pa.int32()), ("resp_headers", HEADER_TYPE), ("resp_body", pa.binary())])
PLACE_SCHEMA = "warc_type string, request_id string, filename string, offset bigint"
_PLACES = pa.schema([("warc_type", pa.string()), ("request_id", pa.string()),
                     ("filename", pa.string()), ("offset", pa.int64())])

SHARD_BYTES = 1 << 30
SPLIT_BYTES = 256 << 20
TASK_BYTES = 16 << 20  # neighbouring ranges that one task reads, unless they are larger
TASKS = 256  # an archive is dealt into as many tasks at least, if it has the ranges
INDEX_BYTES = 64 << 10  # stretches with one offset each in a sparse index
BATCH_BYTES = 4 << 20  # of a batch's rows as Python objects
ROW_BYTES, HEADER_BYTES = 512, 384  # what a row and one of its headers take besides their contents
PENDING_BYTES = 32 << 20  # requests held beside the records a range streams by
BROKEN = "broken"  # type of the row that tells where a shard could not be read on
SOFTWARE = "webstrata"
_ID_SPACE = uuid.UUID("6f4a3a0e-52c4-5e0e-9a0b-0c5f6a1d7b11")
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:", "", path)


def _millis(moment: datetime.datetime | None) -> str:
    moment = moment or _EPOCH
    if moment.tzinfo is not None:
        moment = moment.astimezone(datetime.timezone.utc)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def _one_line(text: str) -> str:
    return re.sub(r"[\r\n]+", " ", text)


def _header_lines(pairs) -> bytes:
    return "".join(f"{_one_line(name)}: {_one_line(value or '')}\r\n"
                   for name, value in pairs).encode("utf-8")


def _record(kind: str, record_id: str, date: str, content_type: str, block: bytes,
            extra: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *extra,
            ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + _header_lines(head) + b"\r\n" + block + b"\r\n\r\n"


def _http_headers(headers: list[dict] | None, body: bytes | None) -> bytes:
    """Headers as recorded: one content-length, telling the size of a body that follows."""
    pairs, seen = [], False
    for header in headers or []:
        if header["name"].lower() == "content-length":
            if not seen:
                pairs.append((header["name"],
                              header["value"] if body is None else str(len(body))))
            seen = True
        else:
            pairs.append((header["name"], header["value"]))
    if body is not None and not seen:
        pairs.append(("Content-Length", str(len(body))))
    return _header_lines(pairs)


def call_records(call: dict) -> list[bytes]:
    """The request record and the response record of one call, sharing their date."""
    date, uri = _millis(call["ts"]), call["uri"]
    ids = [f"<urn:uuid:{uuid.uuid5(_ID_SPACE, repr((part, call['call_id'], date, uri)))}>"
           for part in ("request", "response")]
    body = (call["req_body"] or b"") if call["method"] in ("POST", "PUT") else None
    request = (f"{call['method']} {_one_line(uri)} HTTP/1.1\r\n".encode("utf-8")
               + _http_headers(call["req_headers"], body) + b"\r\n" + (body or b""))
    payload = call["resp_body"] or b""
    response = (f"HTTP/1.1 {call['status']} \r\n".encode("ascii")
                + _http_headers(call["resp_headers"], payload) + b"\r\n" + payload)
    target = ("WARC-Target-URI", uri)
    return [_record("request", ids[0], date, "application/http; msgtype=request", request,
                    [target]),
            _record("response", ids[1], date, "application/http; msgtype=response", response,
                    [target, ("WARC-Concurrent-To", ids[0])])]


class _Commits:
    """The commits of an archive, a small file each, which name the shards that count.

    A file is created whole and never changed, so an archive changes at once or not at all. In the
    order of their names each sets the shards of its jobs, anew where a job comes again, and
    may leave out all that came before.
    """

    FOLDER = "_commits"

    def __init__(self, path: str) -> None:
        self._system, root = _file_system(path)
        self._root = f"{root}/{self.FOLDER}"

    def _files(self) -> list[pyarrow.fs.FileInfo]:
        found = self._system.get_file_info(
            pyarrow.fs.FileSelector(self._root, allow_not_found=True))
        return sorted((f for f in found if f.base_name.endswith(".json")
                       and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)

    def exist(self) -> bool:
        return bool(self._files())

    def jobs(self) -> dict[str, list[str]] | None:
        """Names of the shards that count, by job; None where the archive has no commits."""
        files, jobs = self._files(), {}
        for info in files:
            with self._system.open_input_file(info.path) as stream:
                commit = json.loads(stream.read())
            if commit["alone"]:
                jobs = {}
            jobs.update(commit["jobs"])
        return jobs if files else None

    def add(self, jobs: dict[str, list[str]], alone: bool) -> None:
        files = self._files()
        number = int(files[-1].base_name.split("-")[0]) + 1 if files else 0
        name = f"{number:012d}-{uuid.uuid4().hex}.json"
        self._system.create_dir(self._root, recursive=True)
        with self._system.open_output_stream(f"{self._root}/_{name}") as stream:
            stream.write(json.dumps({"alone": alone, "jobs": jobs}).encode())
        self._system.move(f"{self._root}/_{name}", f"{self._root}/{name}")

    def compact(self) -> None:
        """Replace all commits by one of the same shards."""
        files, jobs = self._files(), self.jobs()
        if len(files) > 1:
            self.add(jobs, alone=True)
            for info in files:
                self._system.delete_file(info.path)


@dataclass
class _Shards(WriterCommitMessage):
    moves: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Writes shards under attempt-specific names; the commit gives them their final ones.

    With ``commits`` they keep those names, and a commit file makes them count.
    """

    def __init__(self, path: str, shard_bytes: int, overwrite: bool, job: str | None,
                 compress: bool = False, commits: bool = False) -> None:
        self.path, self.shard_bytes, self.overwrite = path, shard_bytes, overwrite
        self.suffix = ".warc.gz" if compress else ".warc"
        self.packed = (lambda record: gzip.compress(record, mtime=0)) if compress else bytes
        self.job, self.named = job or uuid.uuid4().hex[:12], job is not None
        self.commits = commits or _Commits(path).exist()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        moves, stream, size = [], None, 0
        try:
            for batch in iterator:
                for at in range(batch.num_rows):
                    # One call at a time: bodies are large.
                    call = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                    if call["status"] is None:
                        continue
                    if stream is None or size >= self.shard_bytes:
                        if stream is not None:
                            stream.close()
                        name = f"part-{context.partitionId():06d}-{len(moves):04d}-{self.job}"
                        if self.commits:
                            # Unlike in a replay by another application, too.
                            name += f"-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                        name += self.suffix
                        temporary = f"{root}/{name}" if self.commits else (
                            f"{root}/_{name}.{context.taskAttemptId()}")
                        moves.append((temporary, f"{root}/{name}"))
                        stream, size = system.open_output_stream(temporary, compression=None), 0
                        info = f"software: {SOFTWARE}\r\n".encode()
                        size += stream.write(self.packed(_record(
                            "warcinfo", f"<urn:uuid:{uuid.uuid5(_ID_SPACE, name)}>",
                            _millis(call["ts"]), "application/warc-fields", info, [])))
                    for record in call_records(call):
                        size += stream.write(self.packed(record))
        finally:
            if stream is not None:
                stream.close()
        return _Shards(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _file_system(self.path)
        if self.commits:
            log = _Commits(self.path)
            jobs = {self.job: [final.rsplit("/", 1)[-1] for message in messages
                               for _, final in (message.moves if message else [])]}
            if not self.overwrite and not log.exist():
                # Shards of before count on; this job's, of none yet, wait for its commit.
                jobs = {"": [info.base_name for info in _shard_files(self.path)
                             if f"-{self.job}-" not in info.base_name], **jobs}
            log.add(jobs, alone=self.overwrite)
            return
        old = [info for info in _shard_files(self.path) if self.overwrite or (
            self.named and info.base_name.endswith((f"-{self.job}.warc", f"-{self.job}.warc.gz")))]
        new = {final.rsplit("/", 1)[-1] for message in messages
               for _, final in (message.moves if message else [])}
        for message in messages:
            for temporary, final in (message.moves if message else []):
                system.move(temporary, final)
        for info in old:
            if info.base_name not in new:
                system.delete_file(info.path)
        system.create_dir(root, recursive=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _file_system(self.path)
        for message in messages:
            for temporary, _final in (message.moves if message else []):
                if system.get_file_info(temporary).type == pyarrow.fs.FileType.File:
                    system.delete_file(temporary)


def _shard_files(path: str) -> list[pyarrow.fs.FileInfo]:
    system, root = _file_system(path)
    info = system.get_file_info(root)
    if info.type == pyarrow.fs.FileType.File:
        return [info]
    found = system.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    shards = sorted((f for f in found if f.type == pyarrow.fs.FileType.File
                     and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
    if not any(f.base_name == _Commits.FOLDER for f in found):
        return shards
    jobs = _Commits(path).jobs()
    if jobs is None:
        return shards
    listed = {name for names in jobs.values() for name in names}
    missing = listed - {f.base_name for f in shards}
    if missing:
        raise FileNotFoundError(f"{path}: shards of a commit are missing: {sorted(missing)[:5]}")
    return [f for f in shards if f.base_name in listed]


def clean_archive(path: str) -> int:
    """Delete shards that no commit names, of failed or replaced jobs; the count of them.

    For archives published by commits, while no job writes to or reads from them. Their commits
    become one.
    """
    log = _Commits(path)
    if not log.exist():
        return 0
    system, root = _file_system(path)
    kept = {info.path for info in _shard_files(path)}
    found = system.get_file_info(pyarrow.fs.FileSelector(root))
    gone = [f.path for f in found if f.type == pyarrow.fs.FileType.File
            and f.base_name.endswith((".warc", ".warc.gz")) and f.path not in kept]
    log.compact()
    for file in gone:
        system.delete_file(file)
    return len(gone)


@dataclass
class _Ranges(InputPartition):
    """Ranges of a shard, side by side, that one task reads: from each cut to the next or ``end``."""

    path: str
    cuts: Sequence[int]
    end: int

    def each(self) -> Iterator[tuple[int, int]]:
        for at, start in enumerate(self.cuts):
            yield start, self.cuts[at + 1] if at + 1 < len(self.cuts) else self.end


def _deal(path: str, cuts: Sequence[int], size: int, task_bytes: int) -> Iterator[_Ranges]:
    """The ranges of a shard, as many neighbours to a task as begin within ``task_bytes``."""
    first = 0
    while first < len(cuts):
        last = max(first + 1, bisect_left(cuts, cuts[first] + task_bytes))
        yield _Ranges(path, cuts[first:last], cuts[last] if last < len(cuts) else size)
        first = last


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    pairs: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and pairs:
            pairs[-1] = (pairs[-1][0], f"{pairs[-1][1]} {text.strip()}")
        elif ":" in text:
            name, value = text.split(":", 1)
            pairs.append((name.strip(), value.strip()))
    return pairs


def _parse_http(kind: str, block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    words = first.decode("utf-8", "replace").split(" ")
    headers = [{"name": n, "value": v} for n, v in _fields(lines)]
    if kind == "request":
        return words[0], None, headers, payload
    status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
    return None, status, headers, payload


def _is_http(fields: dict) -> bool:
    return fields.get("content-type", "").startswith("application/http")


def _parse_record(kind: str, http: bool, block: bytes) -> tuple:
    """Method, status, headers and payload of a record; none unless it holds an HTTP message."""
    if kind in ("request", "response") and http:
        return _parse_http(kind, block)
    return None, None, None, None


def _row_bytes(row: tuple) -> int:
    """About what a row's objects take until its batch is made: small records are mostly headers."""
    size = ROW_BYTES
    for value in row:
        if isinstance(value, (bytes, str)):
            size += len(value)
        elif isinstance(value, list):
            size += sum(HEADER_BYTES + len(h["name"]) + len(h["value"]) for h in value)
    return size


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def _parse_date(text: str | None) -> datetime.datetime | None:
    if not text:
        return None
    return datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))


class _Plain:
    """Records of an uncompressed shard, from an offset on."""

    def __init__(self, raw, name: str, offset: int, ahead: int) -> None:
        self._size = raw.size()
        raw.seek(offset)
        self._stream, self._name, self.offset = io.BufferedReader(raw, ahead), name, offset

    def next(self) -> tuple[dict, bytes, int] | None:
        """Fields, block and length of the record at ``offset``; the next one is then there."""
        found = _read_record(self._stream, self._name, self.offset)
        if found is not None:
            self.offset += found[2]
        return found

    def head(self) -> tuple[dict, int] | None:
        """Fields and length of that record; its block is not read."""
        head = _read_head(self._stream, self._name, self.offset)
        if head is None:
            return None
        length = head[1] + int(head[0]["content-length"]) + 4
        if self.offset + length > self._size:
            raise ValueError(f"{self._name}: cut off record at {self.offset}")
        self.offset += length
        self._stream.seek(self.offset)
        return head[0], length


class _Members:
    """Records of a shard of gzip members, one each, from the offset of a member on."""

    def __init__(self, raw, name: str, offset: int, ahead: int) -> None:
        raw.seek(offset)
        self._raw, self._name, self.offset, self._held = raw, name, offset, b""
        self._ahead = min(ahead, 1 << 18)

    def _member(self) -> tuple[bytes, int] | None:
        parts, used, unpack = [], 0, zlib.decompressobj(31)
        while not unpack.eof:
            data = self._held or self._raw.read(self._ahead)
            if not data:
                if not used:
                    return None
                raise ValueError(f"{self._name}: cut off record at {self.offset}")
            try:
                parts.append(unpack.decompress(data))
            except zlib.error as error:
                raise ValueError(f"{self._name}: broken member at {self.offset}: {error}") from error
            used += len(data) - len(unpack.unused_data)
            self._held = unpack.unused_data
        return b"".join(parts), used

    def next(self) -> tuple[dict, bytes, int] | None:
        member = self._member()
        if member is None:
            return None
        data, length = member
        found = _read_record(io.BytesIO(data), self._name, self.offset)
        if found is None or found[2] != len(data):
            raise ValueError(f"{self._name}: not one record in the member at {self.offset}")
        self.offset += length
        return found[0], found[1], length

    def head(self) -> tuple[dict, int] | None:
        member = self._member()
        if member is None:
            return None
        found = _read_head(io.BytesIO(member[0]), self._name, self.offset)
        self.offset += member[1]
        return found[0], member[1]


def _records(raw, name: str, offset: int, ahead: int = 1 << 20) -> _Plain | _Members:
    """Records from ``offset`` on, read ``ahead`` bytes at a time."""
    return (_Members if name.endswith(".gz") else _Plain)(raw, name, offset, ahead)


def _read_head(stream, name: str, offset: int) -> tuple[dict, int] | None:
    """Fields of the record that begins here, names in lower case, and the length of its head."""
    head = [stream.readline()]
    if not head[0]:
        return None
    if not head[0].startswith(b"WARC/"):
        raise ValueError(f"{name}: no record at {offset}")
    while head[-1] not in (b"\r\n", b""):
        head.append(stream.readline())
    lines = [line.rstrip(b"\r\n") for line in head[1:-1]]
    fields = {key.lower(): value for key, value in _fields(lines)}
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise ValueError(f"{name}: cut off record at {offset}")
    return fields, sum(map(len, head))


def _read_record(stream, name: str, offset: int) -> tuple[dict, bytes, int] | None:
    head = _read_head(stream, name, offset)
    if head is None:
        return None
    size = int(head[0]["content-length"])
    block = stream.read(size)
    if len(block) != size or stream.read(4) != b"\r\n\r\n":
        raise ValueError(f"{name}: cut off record at {offset}")
    return head[0], block, head[1] + size + 4


class WarcReader(DataSourceReader):
    def __init__(self, path: str, ranges: dict[str, list[int]], keep_payload: bool,
                 index: str | None = None, split_bytes: int = SPLIT_BYTES,
                 strict: bool = True) -> None:
        self.path, self.ranges, self.keep_payload = path, ranges, keep_payload
        self.index, self.split_bytes, self.strict = index, split_bytes, strict

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        shards = _shard_files(self.path)
        task_bytes = min(TASK_BYTES, sum(info.size for info in shards) // TASKS)
        for info in shards:
            cuts: Sequence[int] = range(0, info.size, self.split_bytes)
            if self.index is None:
                cuts = [0, *(c for c in self.ranges.get(info.base_name, []) if 0 < c < info.size)]
            parts.extend(_deal(info.path, cuts, info.size, task_bytes))
        return parts or [_Ranges("", (), 0)]

    def _open(self, partition: _Ranges, start: int, opened: ExitStack) -> _Plain | _Members:
        """Records of a task's shard from one on that does not lie behind ``start``."""
        name = partition.path.rsplit("/", 1)[-1]
        system, _ = _file_system(self.path)
        raw = opened.enter_context(system.open_input_file(partition.path))
        return _records(raw, name, self._known_start(name, start))

    def _known_start(self, name: str, start: int) -> int:
        """The last indexed offset of a shard that does not lie behind ``start``."""
        if self.index is None or not start:
            return start
        system, root = _file_system(self.index)
        file = f"{root}/{name}.idx"
        if system.get_file_info(file).type != pyarrow.fs.FileType.File:
            return 0
        with system.open_input_file(file) as stream:
            offsets = np.frombuffer(stream.read(), "<i8")
        at = int(np.searchsorted(offsets, start, "right"))
        return int(offsets[at - 1]) if at else 0

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        name = partition.path.rsplit("/", 1)[-1]
        rows, held, records = [], 0, None
        with ExitStack() as opened:
            for start, end in partition.each():
                if records is None:
                    records = self._open(partition, start, opened)
                try:
                    while records.offset < start and records.head():
                        pass  # records of the ranges before
                    while start <= records.offset < end:
                        offset, found = records.offset, records.next()
                        if found is None:
                            break
                        rows.append(self._row(name, offset, *found))
                        held += _row_bytes(rows[-1])
                        if held >= BATCH_BYTES:
                            batch, rows, held = _batch(rows, _ARROW_SCHEMA), [], 0
                            yield batch
                except ValueError as error:
                    if self.strict:
                        raise
                    if records.offset >= start:
                        rows.append((name, records.offset, None, BROKEN, str(error), *[None] * 8))
                    records = None  # the next range has a start of its own
                    opened.close()
        if rows:
            yield _batch(rows, _ARROW_SCHEMA)

    def _row(self, name: str, offset: int, fields: dict, block: bytes, length: int) -> tuple:
        kind = fields["warc-type"]
        method, status, headers, payload = _parse_record(kind, _is_http(fields), block)
        digest = _digest(payload) if kind == "response" and payload is not None else None
        return (name, offset, length, kind, fields.get("warc-record-id"),
                fields.get("warc-concurrent-to"), fields.get("warc-target-uri"),
                _parse_date(fields.get("warc-date")), method, status, headers,
                payload if self.keep_payload else None, digest)


def _exchange(request: tuple[bool, bytes], response: tuple[dict, bytes]) -> tuple:
    """A row of `EXCHANGE_SCHEMA` from a request, whether it is HTTP and its block, and a response."""
    (http, block), (fields, answer) = request, response
    method, _, req_headers, req_body = _parse_record("request", http, block)
    _, status, resp_headers, resp_body = _parse_record("response", _is_http(fields), answer)
    return (fields.get("warc-record-id"), _parse_date(fields.get("warc-date")), method,
            fields.get("warc-target-uri"), req_headers, req_body, status, resp_headers, resp_body)


class _Pending:
    """The latest requests of a range, of bounded size, that responses may refer to.

    What is held depends on heads alone, so a walk over heads tells which responses find none.
    Sizes are those of blocks as they are held, unpacked.
    """

    def __init__(self) -> None:
        self._held: dict[str, tuple[object, int]] = {}
        self._bytes = 0

    def put(self, record_id: str, request, size: int) -> None:
        self._bytes += size - self._held.pop(record_id, (None, 0))[1]
        self._held[record_id] = (request, size)
        while self._bytes > PENDING_BYTES and len(self._held) > 1:
            self._bytes -= self._held.pop(next(iter(self._held)))[1]

    def get(self, record_id: str):
        return self._held.get(record_id, (None, 0))[0]


class ExchangeReader(WarcReader):
    """Reads exchanges whose request comes before its response in one range.

    With ``heads``, reads no blocks and yields where the other responses lie, and all requests.
    """

    def __init__(self, *args, heads: bool = False) -> None:
        super().__init__(*args)
        self.heads = heads

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        name = partition.path.rsplit("/", 1)[-1]
        schema = _PLACES if self.heads else _EXCHANGES
        rows, held, records = [], 0, None
        with ExitStack() as opened:
            for start, end in partition.each():
                if records is None:
                    records = self._open(partition, start, opened)
                pending = _Pending()  # a range pairs its own records only
                try:
                    while records.offset < start and records.head():
                        pass  # records of the ranges before
                    while start <= records.offset < end:
                        offset = records.offset
                        found = records.head() if self.heads else records.next()
                        if found is None:
                            break
                        fields, block = found[0], b"" if self.heads else found[1]
                        kind, own = fields["warc-type"], fields.get("warc-record-id")
                        asked = fields.get("warc-concurrent-to")
                        if kind == "request" and own:
                            pending.put(own, (_is_http(fields), block),
                                        int(fields["content-length"]) + ROW_BYTES)
                            row = (kind, own, name, offset) if self.heads else None
                        elif kind == "response" and asked:
                            request = pending.get(asked)
                            if self.heads:
                                row = (kind, asked, name, offset) if request is None else None
                            else:
                                row = request and _exchange(request, (fields, block))
                        else:
                            row = None
                        if row is not None:
                            rows.append(row)
                            held += _row_bytes(row)
                        if held >= BATCH_BYTES:
                            batch, rows, held = _batch(rows, schema), [], 0
                            yield batch
                except ValueError:
                    if self.strict:
                        raise
                    records = None  # the next range has a start of its own
                    opened.close()
        if rows:
            yield _batch(rows, schema)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return {"exchanges": EXCHANGE_SCHEMA, "places": PLACE_SCHEMA}.get(
            self.options.get("rows"), RECORD_SCHEMA)

    def reader(self, schema) -> DataSourceReader:
        rows = self.options.get("rows", "records")
        kind = WarcReader if rows == "records" else partial(ExchangeReader, heads=rows == "places")
        return kind(self.options["path"], json.loads(self.options.get("ranges", "{}")),
                          self.options.get("payload", "true").lower() == "true",
                          self.options.get("index"),
                          int(self.options.get("splitbytes", SPLIT_BYTES)),
                          self.options.get("strict", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"],
                          int(self.options.get("shardbytes", SHARD_BYTES)), overwrite,
                          self.options.get("job"),
                          self.options.get("compress", "false").lower() == "true",
                          self.options.get("commits", "false").lower() == "true")


def register_warc(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def write_warc(calls: DataFrame, path: str, mode: str = "append",
               shard_bytes: int = SHARD_BYTES, job: str | None = None,
               compress: bool = False, commits: bool = False) -> None:
    """Write calls that got a response as WARC shards below ``path``.

    Shards of a named ``job`` replace those it left before. With ``compress`` each record is a gzip
    member of a ``.warc.gz`` shard. With ``commits``, or where the archive has some, shards count
    from the moment one commit file appears: until then readers see the archive of before, and no
    file is renamed or deleted (`clean_archive` deletes what no commit names).
    """
    from webstrata.sources.calls import CALL_COLUMNS

    register_warc(calls.sparkSession)
    writer = (calls.where(F.col("status").isNotNull()).select(*CALL_COLUMNS).write.format("warc")
              .mode(mode).option("shardBytes", str(shard_bytes))
              .option("compress", str(compress).lower()).option("commits", str(commits).lower()))
    (writer.option("job", job) if job else writer).save(path)


def write_offsets(records: DataFrame, index: str, block_bytes: int = INDEX_BYTES) -> None:
    """A sparse index of shards: a file each, below ``index``, of offsets in ascending order.

    ``records`` needs filename and offset: records as read, or a CDX. The first offset of each
    stretch of ``block_bytes`` is kept, so that a shard's file is a few thousandths of a percent of it.
    """
    from webstrata.session import cut_lineage

    stretches = records.where(F.col("offset").isNotNull()).groupBy(
        "filename", F.floor(F.col("offset") / block_bytes).alias("stretch")).agg(
        F.min("offset").alias("offset"))
    shards = stretches.groupBy("filename").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _file_system(index)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, offsets in zip(batch.column("filename").to_pylist(),
                                     batch.column("offsets").to_pylist()):
                own = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(own) as stream:
                    stream.write(np.array(offsets, "<i8").tobytes())
                system.move(own, f"{root}/{name}.idx")  # whole or not at all
            yield pa.RecordBatch.from_arrays([batch.column("filename")], names=["filename"])

    cut_lineage(shards.mapInArrow(write, "filename string"))


def read_warc(spark: SparkSession, path: str, cdx: DataFrame | None = None,
              payload: bool = True, split_bytes: int = SPLIT_BYTES, index: str | None = None,
              strict: bool = True) -> DataFrame:
    """Records of the shards below ``path``, or of one file, plain or compressed.

    With ``index``, the folder of a sparse index made by `write_offsets`, shards are read in ranges
    of ``split_bytes``; a ``cdx`` of the same files is such an index, made first. Without
    ``payload`` the payload column is NULL. Unless ``strict``, a record that cannot be read ends
    its range with a row of type `BROKEN` that tells where and why.
    """
    from webstrata.session import work_path

    register_warc(spark)
    reader = (spark.read.format("warc").option("payload", str(payload).lower())
              .option("strict", str(strict).lower()).option("splitBytes", str(split_bytes)))
    if cdx is not None and index is None:
        index = work_path(spark, "offsets")
        write_offsets(cdx, index, min(INDEX_BYTES, split_bytes))
    return (reader.option("index", index) if index else reader).load(path)


def read_exchanges(spark: SparkSession, path: str, index: str | None = None,
                   split_bytes: int = SPLIT_BYTES, strict: bool = True) -> DataFrame:
    """Exchanges of an archive, rows of `EXCHANGE_SCHEMA`: responses with the request they name.

    A range pairs records as they stream by, so bodies of neighbours never leave their task. A walk
    over heads alone finds the responses whose request lies elsewhere: behind them, in another
    range or shard, or too far ahead. Their places, narrow rows, are joined, and both
    records are read there. A response gets one row at most: of requests of one id, the latest
    before it in its range, else the first by file and offset. Unless ``strict``, records behind
    a broken one in its range are left out.
    """
    from webstrata.session import cut_lineage

    register_warc(spark)

    def rows_of(kind: str) -> DataFrame:
        reader = (spark.read.format("warc").option("rows", kind)
                  .option("strict", str(strict).lower()).option("splitBytes", str(split_bytes)))
        return (reader.option("index", index) if index else reader).load(path)

    places = cut_lineage(rows_of("places"))
    apart = places.where("warc_type = 'response'").drop("warc_type")
    requests = places.where("warc_type = 'request'").select(
        "request_id", F.struct("filename", "offset").alias("request"))
    both = apart.join(requests, "request_id").groupBy("filename", "offset").agg(
        F.min("request").alias("request"))
    located = both.select("filename", "offset", F.col("request.filename").alias("req_filename"),
                          F.col("request.offset").alias("req_offset"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(path)
        alone = system.get_file_info(root).type == pyarrow.fs.FileType.File

        def record(name: str, offset: int) -> tuple[dict, bytes]:
            with system.open_input_file(root if alone else f"{root}/{name}") as raw:
                return _records(raw, name, offset, 1 << 14).next()[:2]

        for batch in batches:
            rows, held = [], 0
            for name, offset, req_name, req_offset in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    (sent, block), response = record(req_name, req_offset), record(name, offset)
                except ValueError:
                    if strict:
                        raise
                    continue
                rows.append(_exchange((_is_http(sent), block), response))
                held += _row_bytes(rows[-1])
                if held >= BATCH_BYTES:
                    made, rows, held = _batch(rows, _EXCHANGES), [], 0
                    yield made
            if rows:
                yield _batch(rows, _EXCHANGES)

    return rows_of("exchanges").unionByName(located.mapInArrow(fetch, EXCHANGE_SCHEMA))


def split_points(cdx: DataFrame, split_bytes: int = SPLIT_BYTES) -> dict[str, list[int]]:
    """First record offset in each stretch of ``split_bytes``: a few numbers per file."""
    stretches = cdx.groupBy(
        "filename", F.floor(F.col("offset") / split_bytes).alias("stretch")).agg(
        F.min("offset").alias("cut")).where(F.col("stretch") > 0)
    points: dict[str, list[int]] = {}
    for row in stretches.select("filename", "cut").orderBy("filename", "cut").toLocalIterator():
        points.setdefault(row["filename"], []).append(row["cut"])
    return points
