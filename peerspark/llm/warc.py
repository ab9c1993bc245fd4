"""WARC archives as a Spark data source, and payload-revisit archiving of pages.

``df.write.format("warc").save(path)`` and ``spark.read.format("warc").load(path)`` after ``register(spark)``.
Each record is a gzip member of its own whose extra field holds the member's size, so that a reader inflates
a record's header, decides, and jumps over a payload that nobody asked for. Archives written elsewhere, plain
or gzipped per record, are read too. Spark keeps pushed predicates with the loaded DataFrame, so load anew for each
different filter.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
                                    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

from .staging import shared_path

SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, "
          "payload_length long, content_length long, headers map<string,string>, payload binary")
# fixed values of the format
_NAMES = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
          "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTH = "X-Payload-Length"  # a revisit has no payload; this keeps the length of the one it stands for
_MANIFEST = "_archives.json"
_HEAD = 16 << 10


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _member(record: bytes) -> bytes:
    """A gzip member with its own size in extra field "WL"."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 24 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"WL", 8, size) + body
            + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


def _record(row: dict) -> bytes:
    """A record whose block is an HTTP response: head and payload, or the head alone for a revisit."""
    payload = row.get("payload") or b""
    length = len(payload) if row.get("payload_length") is None else row["payload_length"]
    revisit = row["record_type"] == "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (b"" if revisit else payload)
    named = {name: row.get(key) for key, name in _NAMES.items()}
    named |= {_LENGTH: str(length), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if revisit:
        named["WARC-Profile"] = _IDENTICAL
    clean = lambda v: "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in v)  # noqa: E731  a header is one line
    head = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in named.items() if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes files of its own; the manifest written at the end names those that count."""

    def __init__(self, path: str, max_bytes: int, overwrite: bool):
        self.path, self.max_bytes = path, max_bytes
        store, at = _store(path)
        if not overwrite and store.get_file_info(f"{at}/{_MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        done, out, size, name = [], None, 0, ""
        for batch in iterator:
            for k in range(0, batch.num_rows, 64):
                for row in batch.slice(k, 64).to_pylist():
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{at}/{name}", compression=None)
                    size += out.write(_member(_record(row)))
                    if size >= self.max_bytes:
                        out.close()
                        done.append((name, size))
                        out = None
        if out is not None:
            out.close()
            done.append((name, size))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{_MANIFEST}") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            store.delete_file(f"{at}/{name}")


class _Window:
    """Random access with read-ahead."""

    def __init__(self, file, ahead: int = 1 << 20):
        self.file, self.ahead, self.at, self.data = file, ahead, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, self.ahead))
        return self.data[at - self.at:at - self.at + n]


def _inflate(window: _Window, at: int, limit: int | None, end: bytes = b"") -> tuple[bytes, int | None]:
    """Bytes of the member at ``at``: all, or at least ``limit`` or up to ``end``; where the next one starts if known."""
    unpack = zlib.decompressobj(31)
    out, place = [], at
    while not unpack.eof:
        raw = window.get(place, 8 << 10 if limit else 1 << 16)
        if not raw:
            raise EOFError("gzip member is cut off")
        out.append(unpack.decompress(raw))
        place += len(raw)
        if limit and (sum(map(len, out)) >= limit or end in b"".join(out)):
            break
    return b"".join(out), place - len(unpack.unused_data) if unpack.eof else None


def _parse(head: bytes) -> tuple[dict[str, str], int]:
    """Named fields and the length of the header."""
    stop = head.find(b"\r\n\r\n")
    if stop < 0 or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    last = None
    for line in head[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            fields[last] = value.strip()
    return fields, stop + 4


def _columns(fields: dict[str, str]) -> dict:
    lower = {k.lower(): v for k, v in fields.items()}
    row = {key: lower.get(name.lower()) for key, name in _NAMES.items()}
    number = lambda v: int(v) if v and v.isdigit() else None
    return row | {"payload_length": number(lower.get(_LENGTH.lower())), "content_length": number(lower.get("content-length")), "headers": fields}


def _test(f) -> Callable[[dict], bool | None] | None:
    """Three-valued check of one pushed filter on the header's columns; None if it can't be pushed."""
    if isinstance(f, Not):
        inner = _test(f.child)
        return inner and (lambda row: None if (x := inner(row)) is None else not x)
    name = f.attribute[0]
    if len(f.attribute) > 1 or name in ("headers", "payload"):
        return None
    compare = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
               LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringContains: lambda a, b: b in a,
               StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b)}.get(type(f))
    if compare:
        return lambda row: None if row[name] is None or f.value is None else compare(row[name], f.value)
    if isinstance(f, In):
        return lambda row: None if row[name] is None else row[name] in f.value or (None if None in f.value else False)
    return {IsNull: lambda row: row[name] is None, IsNotNull: lambda row: row[name] is not None,
            EqualNullSafe: lambda row: row[name] == f.value}.get(type(f))


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    """Plans files into partitions of bounded size; evaluates pushed predicates on record headers."""

    def __init__(self, path: str, partition_bytes: int, payload: bool):
        self.path, self.partition_bytes, self.payload, self.filters = path, partition_bytes, payload, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, at = _store(self.path)
        if store.get_file_info(at).type == fs.FileType.File:
            return [Files([at])]
        if store.get_file_info(f"{at}/{_MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{at}/{_MANIFEST}") as f:
                found = [(f"{at}/{name}", size) for name, size in json.loads(f.read())]
        else:
            found = [(i.path, i.size) for i in store.get_file_info(fs.FileSelector(at, recursive=True))
                     if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        plan, size = [], self.partition_bytes
        for name, n in sorted(found):
            if size + n > self.partition_bytes:
                plan.append(Files([]))
                size = 0
            plan[-1].names.append(name)
            size += n
        return plan or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        tests = [_test(f) for f in self.filters]
        store, _ = _store(self.path)
        rows, size = [], 0
        for name in partition.names:
            with store.open_input_file(name) as file:
                for row in self._records(_Window(file), file.size(), tests):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 1024 or size >= 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        yield _batch(rows)

    def _records(self, window: _Window, total: int, tests: list) -> Iterator[dict]:
        at = 0
        while at < total:
            if window.get(at, 2) == b"\x1f\x8b":
                start = window.get(at, 24)
                sized = len(start) == 24 and start[3] & 4 and start[12:14] == b"WL"
                if not sized:  # where such a member ends, and how many records it holds, is known when it is decoded
                    data, at = _inflate(window, at, None)
                    yield from self._member(data, tests)
                    continue
                following = at + struct.unpack("<Q", start[16:24])[0]
                head, ended = _inflate(window, at, _HEAD, b"\r\n\r\n")
                while b"\r\n\r\n" not in head and ended is None:
                    head, ended = _inflate(window, at, 2 * len(head), b"\r\n\r\n")
                fields, n = _parse(head)
                row = _columns(fields)
                wanted = all(t(row) is True for t in tests)
                block = b""
                if wanted and self.payload:
                    head, ended = _inflate(window, at, None) if ended is None else (head, ended)
                    block = head[n:n + (row["content_length"] or 0)]
            else:
                head = window.get(at, _HEAD)
                while b"\r\n\r\n" not in head and at + len(head) < total:
                    head = window.get(at, 2 * len(head))
                fields, n = _parse(head)
                row = _columns(fields)
                length = row["content_length"] or 0
                wanted = all(t(row) is True for t in tests)
                block = window.get(at + n, length) if wanted and self.payload else b""
                following = at + n + length + 4
            if wanted:
                yield self._with_payload(row, block)
            at = following

    def _member(self, data: bytes, tests: list) -> Iterator[dict]:
        """The records of a decoded gzip member, one after the other."""
        at = 0
        while data[at:].strip(b"\r\n"):
            fields, n = _parse(data[at:at + _HEAD] if b"\r\n\r\n" in data[at:at + _HEAD] else data[at:])
            row = _columns(fields)
            end = at + n + (row["content_length"] or 0)
            if all(t(row) is True for t in tests):
                yield self._with_payload(row, data[at + n:end])
            at = end + 4

    def _with_payload(self, row: dict, block: bytes) -> dict:
        kind = next((v for k, v in row["headers"].items() if k.lower() == "content-type"), None) or ""
        if kind.lower().startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        row["payload"] = block if self.payload and row["record_type"] != "revisit" else None
        return row


_ARROW = pa.schema([*[(n, pa.string()) for n in _NAMES], ("payload_length", pa.int64()), ("content_length", pa.int64()),
                    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    rows = [row | {"headers": list(row["headers"].items())} for row in rows]
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcSource(DataSource):
    """Options: path; partition_bytes (16 MB of archive), payload (false skips all payloads), max_bytes per file written."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("partition_bytes", 16 << 20)), self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("max_bytes", 128 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row and return the archives' records.

    Of rows with equal payloads of at least ``least_bytes``, the one with the smallest id is a response and
    the others are revisits of it. Groups are found over (digest, length); a task combines its copies before
    they are shuffled. The verdict travels on the id, which spreads a payload that many rows share. A null
    html is an empty payload. A null id is written as ``<urn:page:>`` and never wins over an id; rows that
    repeat an id with the same payload are all responses. Other columns are ignored; an empty table gives
    an archive without records.
    """
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.col("n") >= least_bytes).select("id", "digest")
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and first is not null")
    again = (large.join(first.select("digest", "first"), "digest").filter(~F.col("id").eqNullSafe(F.col("first")))
             .select("id", "digest", "first").distinct())
    told = rows.alias("r").join(again.alias("a"), F.col("r.id").eqNullSafe(F.col("a.id")) & (F.col("r.digest") == F.col("a.digest")), "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    records = told.select(
        name("r.id").alias("record_id"), F.when(F.col("a.first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("r.url").alias("target_uri"), F.lit(date).alias("date"), F.concat(F.lit("sha256:"), F.col("r.digest")).alias("payload_digest"),
        F.when(F.col("a.first").isNotNull(), name("a.first")).alias("refers_to"), F.col("r.n").alias("payload_length"),
        F.when(F.col("a.first").isNull(), F.col("r.payload")).alias("payload"))
    records.write.format("warc").mode("append").save(path)
    return spark.read.format("warc").load(path)


def archived_pages(pages: DataFrame) -> DataFrame:
    """``archive_pages`` in a new folder of the shared space, read back by two loads: responses with their payloads, and
    all other records by their headers alone."""
    spark, path = pages.sparkSession, shared_path(pages.sparkSession, "warc")
    archive_pages(pages, path)
    whole = spark.read.format("warc").load(path).filter("record_type = 'response'")
    told = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'")
    return whole.unionByName(told)
