"""WARC archives as a Python data source: ``read(spark, path, where)``, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Spark keeps the pushed filters of a Python source with the loaded relation, not with the scan, so
the filters of one use of a frame would hold for its other uses too. Filters are therefore pushed only
with the option ``pushdown``, which ``read`` sets for a relation of its own.

Reading: the driver lists the archives and packs them into partitions by size. A task parses
each record's headers first and tests them against the pushed filters (record type and any other header
column); only a record that passes, and only if payloads are wanted, has its block decoded. In a
compressed archive every record is a gzip member whose header names its compressed length (the
format's ``sl`` skip-length field), so an unwanted record is passed over with one seek; members
without it, or with more than one record, are inflated piece by piece and dropped. Plain archives are
passed over by Content-Length. Archives are read in chunks, each once.

Writing: each task writes archives of about ``maxFileBytes`` under a hidden name; committing the
job renames them, so a lost or repeated task leaves nothing behind that a reader sees.

Columns: record_id, record_type, target_uri, date, refers_to, content_type, content_length,
payload_length, payload_digest (lower-case hex SHA-1: of the decoded payload where there is one,
else from the header), payload. Options: ``payload`` (true; false decodes payloads for their length
and digest only; ``skip`` decodes none), ``pathFilter``, ``maxPartitionBytes``, ``pushdown`` (false), ``corrupt`` (fail: an
archive that is cut, damaged or no archive ends the query with an error that names it; keep: its records
before the fault are returned).

Nulls and edge cases: a null payload is written as an empty one; null header values leave their
line out; line ends inside header values are percent-encoded; an empty folder, table or file reads as no rows;
a payload of any length is one value, held whole by its task; a head of over 1 MiB is damage.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, content_type string, content_length long, payload_length long, payload_digest string, payload binary"
_HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
_CHUNK = 1 << 16
_HEAD = 1 << 20


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---------------------------------------------------------------- records


def _value(text: object) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", str(text))


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, length: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """A record's bytes: named headers, an HTTP response head, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_value(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_value(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_value(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member that names its own length in an ``sl`` extra field, where 32 bits hold it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 14 + len(body) + 8
    if max(size, len(data)) < 1 << 32:
        return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + tail
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail


def parse_head(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch("[0-9]{1,18}", text) else None


class _Raw:
    """An archive's bytes, read once in chunks however small its records are."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.at, self.chunk, self.off = 0, b"", 0
        file.seek(0)

    def read(self, n: int) -> bytes:
        if self.off == len(self.chunk):
            self.chunk, self.off = self.file.read(max(n, _CHUNK)), 0
        out = self.chunk[self.off : self.off + n]
        self.off += len(out)
        self.at += len(out)
        return out

    def up_to(self, n: int) -> bytes:
        out = b""
        while len(out) < n and (more := self.read(n - len(out))):
            out += more
        return out

    def seek(self, at: int) -> None:
        if at > self.size:
            raise ValueError(f"the archive is cut: it has {self.size} bytes, a record needs {at}")
        off = self.off + at - self.at
        if 0 <= off <= len(self.chunk):
            self.off = off
        else:
            self.file.seek(at)
            self.chunk, self.off = b"", 0
        self.at = at


class _Plain:
    """Records of an uncompressed archive. What was read too far waits in ``ahead``."""

    def __init__(self, raw: _Raw):
        self.raw, self.ahead = raw, b""

    def read(self, n: int) -> bytes:
        """At most n bytes; none at the end of the archive."""
        return self.raw.read(n)

    def started(self, blank: bool) -> None:
        """More bytes of a head were read; ``blank`` if they are its first."""

    def head(self) -> bytes | None:
        """The next record's head without the line ends around it; None at the end of the archive."""
        data = self.ahead.lstrip(b"\r\n")
        while (cut := data.find(b"\r\n\r\n")) < 0:
            if len(data) > _HEAD:
                raise ValueError(f"a record's head has more than {_HEAD} bytes")
            more = self.read(1 << 11)
            if not more:
                if data:
                    raise ValueError("the archive ends inside a record's head")
                return None
            self.started(not data)
            data = (data + more).lstrip(b"\r\n")
        self.ahead = data[cut + 4 :]
        return data[:cut]

    def block(self, n: int) -> bytes:
        """The record's block of n bytes."""
        out = bytearray(self.ahead[:n])
        self.ahead = self.ahead[n:]
        while len(out) < n:
            more = self.read(min(1 << 20, n - len(out)))
            if not more:
                raise ValueError(f"the archive ends inside a record's block, after {len(out)} of {n} bytes")
            out += more
        return bytes(out)

    def finish(self, head: int, n: int) -> None:
        """Check what can be checked before the record is handed out; other damage shows at the next record."""

    def skip(self, head: int, n: int) -> None:
        """Pass over the block of n bytes that follows a head of ``head`` bytes."""
        past = min(n, len(self.ahead))
        self.ahead = self.ahead[past:]
        if n > past:
            self.raw.seek(self.raw.at + n - past)


class _Member(_Plain):
    """Records of a compressed archive; nothing is inflated before it is read. A member may hold many records."""

    def __init__(self, raw: _Raw):
        super().__init__(raw)
        self.inflate, self.feed, self.opened, self.seen = None, b"", 0, 0
        #: Does the present record start with its member, and does it, if lengths agree, fill it?
        self.whole = False

    def _open(self) -> bool:
        """Start on the next member, if there is one; zeros may follow the last."""
        raw = self.raw
        self.start = raw.at
        first = raw.up_to(12)
        if first[:2] != b"\x1f\x8b":
            while first and not first.strip(b"\0"):
                first = raw.read(_CHUNK)
            if first:
                raise ValueError(f"no gzip member at byte {self.start}")
            return False
        self.packed = self.length = 0
        if len(first) == 12 and first[3] & 4:
            extra = raw.up_to(struct.unpack("<H", first[10:])[0])
            while len(extra) >= 4:
                size = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and size >= 8 and len(extra) >= 12:
                    self.packed, self.length = struct.unpack("<II", extra[4:12])
                extra = extra[4 + size :]
        raw.seek(self.start)
        self.inflate, self.feed = zlib.decompressobj(31), b""
        self.opened += 1
        return True

    def head(self) -> bytes | None:
        self.whole, self.seen = False, self.opened
        return super().head()

    def _inflated(self, n: int) -> bytes:
        """At most n bytes of the present member; none at its end, where its check sum was right."""
        while self.inflate is not None:
            self.feed = self.feed or self.raw.read(1 << 14)
            fed = len(self.feed)
            out = self.inflate.decompress(self.feed, n)
            self.feed = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw.seek(self.raw.at - len(self.inflate.unused_data))
                self.inflate = None
            elif not out and not fed:
                raise ValueError(f"the archive ends inside the gzip member at byte {self.start}")
            if out:
                return out
        return b""

    def read(self, n: int) -> bytes:
        while not (out := self._inflated(n)) and self._open():
            pass
        return out

    def started(self, blank: bool) -> None:
        self.whole = blank if self.opened != self.seen else self.whole and not blank
        self.seen = self.opened

    def _fills(self, head: int, n: int) -> bool:
        """Has the member this record alone?"""
        return self.whole and self.packed > 0 and self.length == head + 4 + n + 4

    def finish(self, head: int, n: int) -> None:
        while self._fills(head, n) and (more := self._inflated(_CHUNK)):
            self.ahead += more

    def skip(self, head: int, n: int) -> None:
        if self._fills(head, n):
            self.raw.seek(self.start + self.packed)
            self.inflate, self.ahead = None, b""
            return
        while n > 0:
            more = self.ahead or self.read(min(_CHUNK, n))
            if not more:
                raise ValueError("the archive ends inside a record's block")
            self.ahead = more[n:]
            n -= len(more)


def records(file: pa.NativeFile, wanted, payload: str) -> Iterator[tuple]:
    """Rows of an archive whose headers pass ``wanted``; ValueError or zlib.error where it is cut or no archive."""
    raw = _Raw(file)
    source = _Member(raw) if raw.read(2) == b"\x1f\x8b" else _Plain(raw)
    raw.seek(0)
    while (top := source.head()) is not None:
        head = parse_head(top)
        length = _number(head.get("content-length"))
        if not top.startswith(b"WARC/") or length is None:
            raise ValueError(f"no record starts with {top[:40]!r}" if length is not None else "a record has no Content-Length")
        row = {name: head.get(h) for name, h in _HEADERS.items()}
        for name in ("record_id", "refers_to"):
            row[name] = row[name].strip("<>") if row[name] else row[name]
        if not wanted(row):
            source.skip(len(top), length)
            continue
        digest = head.get("warc-payload-digest", "")
        digest = base64.b32decode(digest[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", digest) else digest.removeprefix("sha1:") or None
        body, n = None, None
        if payload == "skip":
            source.skip(len(top), length)
        else:
            block = source.block(length)
            source.finish(len(top), length)
            split = 0
            if "http" in (row["content_type"] or ""):  # a message without a blank line is all head
                split = block.find(b"\r\n\r\n") + 4
                split = len(block) if split < 4 else split
            body = block[split:]
            n = len(body)
            if row["record_type"] == "revisit":  # the payload is in the record it refers to
                n = _number(parse_head(block[:split]).get("content-length", "0"))
                body = None
            else:
                digest = hashlib.sha1(body).hexdigest()
        yield (*row.values(), length, n, digest, body if payload == "true" else None)


# ---------------------------------------------------------------- reader


def _test(f: Filter):
    """A filter as a predicate on a header row, or None if it can't be decided on headers."""
    if isinstance(f, Not):
        inner = _test(f.child)
        return None if inner is None or isinstance(f.child, Not) else (lambda r: r[f.child.attribute[0]] is not None and not inner(r))
    name = getattr(f, "attribute", ("",))[0]
    if name not in _HEADERS or len(f.attribute) != 1:
        return None
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return lambda r: r[name] == f.value
    if isinstance(f, In):
        return lambda r: r[name] in f.value
    if isinstance(f, IsNull):
        return lambda r: r[name] is None
    if isinstance(f, IsNotNull):
        return lambda r: r[name] is not None
    for kind, method in ((StringStartsWith, "startswith"), (StringEndsWith, "endswith"), (StringContains, "__contains__")):
        if isinstance(f, kind):
            return lambda r: r[name] is not None and getattr(r[name], method)(f.value)
    return None


class Archives(InputPartition):
    def __init__(self, files: list[str]):
        self.value = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        push = self.options.get("pushdown", "false") == "true"
        for f in filters:
            if not push or _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[InputPartition]:
        store, root = open_fs(self.options["path"])
        pattern = re.compile(self.options.get("pathfilter", r".*\.warc(\.gz)?$"))
        most = int(self.options.get("maxpartitionbytes", 64 << 20))
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")) and pattern.match(i.path)), key=lambda i: i.path)
        parts: list[list[str]] = []
        room = 0
        for i in files:
            if i.size > room or not parts:
                parts.append([])
                room = most
            parts[-1].append(i.path)
            room -= i.size
        return [Archives(p) for p in parts] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[tuple]:
        store, _ = open_fs(self.options["path"])
        tests = [_test(f) for f in self.filters]
        for path in partition.value:
            with store.open_input_file(path) as file:
                try:
                    yield from records(file, lambda r: all(t(r) for t in tests), self.options.get("payload", "true"))
                except (ValueError, zlib.error) as e:
                    if self.options.get("corrupt", "fail") != "keep":
                        raise ValueError(f"{path}: {e}") from e


# ---------------------------------------------------------------- writer


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Writes columns record_id, record_type, target_uri, date, refers_to, payload_length, payload_digest, payload."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_fs(self.options["path"])
        most = int(self.options.get("maxfilebytes", 32 << 20))
        plain = self.options.get("compression", "gzip") == "none"
        level = int(self.options.get("level", 4))
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        files: list[str] = []
        out, size = None, 0
        try:
            for batch in batches:
                rows = batch.to_pylist()
                for r in rows:
                    data = record(r["record_type"], r["record_id"], r["target_uri"], r["date"], r["payload_digest"], r["payload_length"], r["payload"], r["refers_to"])
                    if out is None:
                        name = f"part-{context.partitionId():05d}-{len(files):04d}-{self.job}"
                        files.append(f"{root}/.{context.taskAttemptId()}~{name}.warc{'' if plain else '.gz'}")
                        out = store.open_output_stream(files[-1], compression=None)
                    data = data if plain else member(data, level)
                    out.write(data)
                    size += len(data)
                    if size >= most:
                        out.close()
                        out, size = None, 0
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_fs(self.options["path"])
        if self.overwrite:
            for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if i.type == fs.FileType.File and self.job not in i.base_name:
                    store.delete_file(i.path)
        for path in (f for m in messages if m for f in m.files):
            folder, name = path.rsplit("/", 1)
            store.move(path, f"{folder}/{name.split('~', 1)[1]}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        store, root = open_fs(self.options["path"])
        for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if i.base_name.startswith(".") and self.job in i.base_name:
                store.delete_file(i.path)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, where: Column | None = None, **options: str) -> DataFrame:
    """Records of the archives that pass ``where``, whose tests of header columns the reader makes before it decodes a block.

    The frame may be used and filtered any number of times: its columns pass through an expression that no filter is
    moved below, so the reader sees ``where`` alone.
    """
    register(spark)
    rows = spark.read.format("warc").options(**options, pushdown="true").load(path)
    rows = rows if where is None else rows.filter(where)
    return rows.select(*(F.when(F.monotonically_increasing_id() >= 0, F.col(c)).alias(c) for c in rows.columns))


#: Up to so many repeated digests (about 64 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000


def archive_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int, prefix: str, date: str) -> DataFrame:
    """A row to write for every page: of equal payloads of ``least_bytes`` or more, the largest id's is a response and the others revisit it.

    Ids go into record ids as ``prefix`` + id; a null id gives ``prefix`` alone.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    large = rows.filter(F.col("payload_length") >= least_bytes).groupBy("payload_digest").agg(F.max("id").alias("kept"), F.count("*").alias("c")).filter("c > 1").drop("c")
    rows = rows.join(F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large, "payload_digest", "left")
    again = F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept"))
    name = lambda c: F.concat(F.lit(prefix), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(
        name("id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(again, name("kept")).alias("refers_to"),
        "payload_length",
        "payload_digest",
        F.when(~again, F.col("payload")).alias("payload"),
    )
