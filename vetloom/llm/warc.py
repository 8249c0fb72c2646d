"""WARC archives of pages, and a normaliser for monolithic gzip files.

:func:`write` deals pages into shards of about :data:`SHARD_BYTES` and gives a
row for each archive: its WARC records in one gzip stream.  Of records with
equal payloads one is a response; the others are revisits that refer to it.
:func:`save` puts the archives into a folder, as files.  :func:`normalise`
inflates such a file once, as a stream, rewrites each record as a gzip member of
its own and writes the sidecar index of offsets beside it, so that :func:`read`
can inflate any record alone.  A task holds one record at a time, not a file.

Files are written by the tasks, in a folder that all of them reach, through
Arrow's file systems (local and shared disks, HDFS, S3, GCS).  A file gets its
name when it is whole, and the same name if a task is run again.

Contract: null html is the empty payload, a null url gives no target header.
The largest page_id of equal payloads of at least ``min_bytes`` is the
response; rows that repeat it (same id and payload) are responses, too.  Rows
with a null id are revisits of a page with an id, if there is one.  Smaller
payloads are all responses.  An empty table gives no archive.  Archives from
elsewhere are read as well: a record of another kind or name has no page id,
and one that cannot be understood, or a file that cannot, is a row of nulls with
its ``error``.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

SHARD_BYTES = 8 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INFLATE = 1 << 20
_END = b"\r\n\r\n"
INDEX = "offset\tlength\trecord"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", name or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One record.  A revisit has the HTTP headers alone, which tell the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _END
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def _writer(tables: pa.Table, revisits: pa.Table) -> pa.Table:
    if not tables.num_rows:
        return pa.table({"name": pa.array([], pa.string()), "content": pa.array([], pa.binary())})
    again = {(i, s): r for i, s, r in zip(*(revisits[c].to_pylist() for c in ("_page", "_key", "_refers")), strict=True)}
    out = zlib.compressobj(LEVEL, wbits=31)
    parts = []
    for page_id, url, sha, payload in zip(*(tables[c].to_pylist() for c in ("_id", "_url", "_sha", "_payload")), strict=True):
        key = (page_id, sha)
        parts.append(out.compress(record(page_id, url, payload, key in again, again.get(key))))
    parts.append(out.flush())
    shard = tables["_shard"][0].as_py()
    return pa.table({"name": [f"pages-{shard:06d}.warc.gz"], "content": pa.array([b"".join(parts)], pa.binary())})


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """A row for each archive: ``name`` and ``content``, one gzip stream."""
    total = frames.text_bytes(pages, html_col)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.sha1(payload).alias("_sha"), payload.alias("_payload"))
    rows = rows.withColumn("_shard", frames.spread(F.col("_id"), F.col("_sha"), frames.parts(total, SHARD_BYTES)))
    sums = rows.filter(F.octet_length("_payload") >= min_bytes).select("_id", "_sha", "_shard")
    # written first, so that the join's sides are plain shuffles, and Spark can split those of a payload that very many pages share
    most = frames.checkpointed(sums.groupBy("_sha").agg(F.max("_id").alias("_refers"), F.count("*").alias("_n")).filter("_n > 1 and _refers is not null").drop("_n"))
    revisits = sums.join(most, "_sha").filter("_id is null or _id < _refers").select(F.col("_shard").alias("_at"), F.col("_id").alias("_page"), F.col("_sha").alias("_key"), "_refers").distinct()
    tasks = frames.tasks(pages.sparkSession, total, SHARD_BYTES // 2)
    return rows.repartition(tasks, "_shard").groupBy("_shard").cogroup(revisits.repartition(tasks, "_at").groupBy("_at")).applyInArrow(_writer, "name string, content binary")


class Files:
    """Files below folders that all tasks reach."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        if folder.startswith("file:"):
            folder = "/" + folder.removeprefix("file:").lstrip("/")
        self.fs, self.root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @contextlib.contextmanager
    def writing(self, *names: str) -> Iterator[list]:
        """Streams to files, which get their names when all are whole."""
        self.fs.create_dir(self.root, recursive=True)
        parts = [self.path(f".{name}.{uuid.uuid4().hex}") for name in names]
        try:
            with contextlib.ExitStack() as stack:
                yield [stack.enter_context(self.fs.open_output_stream(p)) for p in parts]
        except BaseException:
            for part in parts:
                self.fs.delete_file(part)
            raise
        for part, name in zip(parts, names, strict=True):
            self.fs.move(part, self.path(name))

    def open(self, name: str):
        return self.fs.open_input_file(self.path(name))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``folder`` and ``name`` of the archives in a folder; their bytes are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.lit(folder).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


SAVED = "folder string, name string, bytes long"


def save(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file; a row for each: ``folder``, ``name`` and ``bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.writing(row["name"]) as (out,):
                    out.write(row["content"])
                yield pa.RecordBatch.from_pylist([{"folder": folder, "name": row["name"], "bytes": len(row["content"])}])

    return frames.stored(archives.select("name", "content").mapInArrow(run, SAVED))


def _inflated(file: BinaryIO) -> Iterator[bytes]:
    """The bytes of all members of a gzip file, some at a time."""
    part = file.read(_INFLATE)
    while part:
        inflate = zlib.decompressobj(wbits=31)
        while not inflate.eof:
            if not part:
                raise ValueError("a gzip member is cut off")
            yield inflate.decompress(part, 4 * _INFLATE)
            part = inflate.unconsumed_tail or (b"" if inflate.eof else file.read(_INFLATE))
        part = inflate.unused_data or file.read(_INFLATE)


def _headers(lines: list[str]) -> dict[str, str]:
    """Headers by lower-case name; a line that starts with white space goes on from the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def split_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, block and all bytes of each record of a gzip file."""
    buffer, at, parts = b"", 0, _inflated(file)

    def fill(size: int) -> bool:
        nonlocal buffer, at
        if len(buffer) - at < size:
            held, n = [buffer[at:]], len(buffer) - at
            while n < size:
                part = next(parts, None)
                if part is None:
                    break
                held.append(part)
                n += len(part)
            buffer, at = b"".join(held), 0
        return len(buffer) - at >= size

    while fill(1):
        if buffer[at : at + 1] in (b"\r", b"\n"):  # more blank lines than two between records
            at += 1
            continue
        while (end := buffer.find(_END, at)) < 0:
            if not fill(len(buffer) - at + 1):
                raise ValueError("a record's headers are cut off")
        lines = buffer[at:end].decode(errors="replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = _headers(lines[1:])
        if not headers.get("content-length", "").isdigit():
            raise ValueError("a record without its length")
        head = end + 4 - at
        size = head + int(headers["content-length"])
        if not fill(size):
            raise ValueError("a record's block is cut off")
        whole = buffer[at : at + size] + _END
        yield headers, whole[head:size], whole
        at += size
        fill(4)
        at += 4 if buffer[at : at + 4] == _END else 0


def normalised(file: BinaryIO, members: BinaryIO, index: BinaryIO) -> int:
    """Writes a member for each record, and the index; the number of records."""
    index.write(f"{INDEX}\n".encode())
    n = offset = 0
    for headers, _, whole in split_records(file):
        member = zlib.compress(whole, LEVEL, wbits=31)
        members.write(member)
        index.write(f"{offset}\t{len(member)}\t{headers.get('warc-record-id', '-')}\n".encode())
        offset += len(member)
        n += 1
    return n


NORMALISED = "folder string, name string, records long, error string"


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Of files (``folder``, ``name``) writes ``name`` with a member for each record and ``name.idx`` into a folder; a row for each: ``folder``, ``name``, ``records`` and ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = Files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                told = {"folder": folder, "name": row["name"], "records": None, "error": None}
                try:
                    with Files(row["folder"]).open(row["name"]) as file, target.writing(row["name"], row["name"] + ".idx") as (members, index):
                        told["records"] = normalised(file, members, index)
                except (ValueError, zlib.error) as error:  # a broken file is a result of its own; lost disks fail the task
                    told["error"] = str(error)
                yield pa.RecordBatch.from_pylist([told], pa.schema([("folder", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("error", pa.string())]))

    return frames.stored(files.select("folder", "name").mapInArrow(run, NORMALISED))


ROW = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string(), "error": pa.string(), "payload": pa.binary()}


def _row(member: bytes) -> dict:
    """A record as a row.  What its headers tell of a payload is checked where the payload is there."""
    headers, block, _ = next(split_records(io.BytesIO(member)))
    kind, name = headers.get("warc-type"), headers.get("warc-record-id")
    told = headers.get("warc-payload-digest", "").partition("sha1:")[2].upper()
    told = told if len(told) == 32 else None  # base32
    payload, size = block, None
    if "application/http" in headers.get("content-type", ""):
        http, _, payload = block.partition(_END)
        size = _headers(http.decode(errors="replace").split("\r\n")[1:]).get("content-length")
        size = int(size) if (size or "").isdigit() else None
    out = {"page_id": _id(name), "record_type": kind, "refers_to": _id(headers.get("warc-refers-to")), "record_id": name}
    if kind == "revisit":
        return out | {"payload_bytes": size, "payload_digest": told}
    true = digest(payload)
    if kind == "response" and (told not in (None, true) or size not in (None, len(payload))):
        raise ValueError("a payload differs from its headers")
    return out | {"payload_bytes": len(payload), "payload_digest": true, "payload": payload}


def _lines(file: BinaryIO) -> Iterator[str]:
    """The lines of an index but the first."""
    rest, first = b"", True
    while part := file.read(_INFLATE):
        *lines, rest = (rest + part).split(b"\n")
        for line in lines[first:]:
            yield line.decode()
        first = first and not lines


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Of normalised files a row for each line of their indexes: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, error and the payload (null for a revisit)."""
    kinds = {k: v for k, v in ROW.items() if payloads or k != "payload"}
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, error string" + ", payload binary" * payloads

    def rows(file: dict) -> Iterator[dict]:
        if file["error"] is not None:
            yield {"error": file["error"]}
            return
        source = Files(file["folder"])
        with source.open(file["name"] + ".idx") as index, source.open(file["name"]) as archive:
            for line in _lines(index):
                offset, length, name = line.split("\t")
                archive.seek(int(offset))
                try:
                    yield _row(archive.read(int(length)))
                except (ValueError, zlib.error) as error:
                    yield {"record_id": name, "page_id": _id(name), "error": str(error)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                held, size = [], 0
                for row in rows(file):
                    held.append(row)
                    size += 200 + (row.get("payload_bytes") or 0)
                    if size > SHARD_BYTES:
                        yield _batch(held, kinds)
                        held, size = [], 0
                if held:
                    yield _batch(held, kinds)

    return files.select("folder", "name", "error").mapInArrow(run, schema)


def _batch(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], list(kinds))
