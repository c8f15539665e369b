"""A data source of named JSON files, batch and stream: whole generations appear at once, the versions before stay.

Format ``sidecarfiles``, option ``path`` (a folder that driver and executors share, mounted). Each write puts its files (columns
name, value) into a folder of its own, every one written beside its place, synced and renamed; the commit then puts one
small manifest in place, the list of folders with the next number, which is linked and therefore never overwrites another one. A job that is killed
before leaves the files as they were; a task that runs twice writes the same files. Of a name in several folders the newest counts; a null value
deletes it. Mode overwrite begins a new list. version() and the option ``version`` name earlier states.

Reading gives (name, value, error): error says why a file is no JSON document, so that good files and bad ones are told apart in one
pass; parted() puts both aside in one write. Tasks list the folders themselves, each for its share of the
names. A stream reads the folders of each new manifest, and a stream that writes notes its batch, so that none is added twice.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "sidecarfiles"
SCHEMA = "name string, value string, error string"
ENDING = ".json"
SHARES = 16
#: Bytes of files that go to Spark at once, and files that a writing task takes at once.
BATCH_BYTES, BATCH_FILES = 8 << 20, 64
_NAME = re.compile(r"[^/\0]+(?:/[^/\0]+)*")


def local(path: str) -> str:
    """The folder that a path names; only mounted ones can be linked and synced."""
    found = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    if not found:
        raise ValueError(f"{FORMAT} needs a mounted folder, not {path}")
    return found[1].rstrip("/")


# ---------------------------------------------------------------- manifests


def _place(root: str, version: int) -> str:
    return f"{root}/_versions/{version:012d}.json"


def versions(root: str) -> list[int]:
    try:
        names = os.listdir(f"{root}/_versions")
    except FileNotFoundError:
        return []
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n))


def version(path: str) -> int:
    return max(versions(local(path)), default=0)


def manifest(root: str, at: int) -> dict:
    """{"folders": oldest first, "batches": {writer: last batch}} of a version."""
    if not at:
        return {"folders": [], "batches": {}}
    with open(_place(root, at), encoding="utf-8") as f:
        return json.load(f)


def _durable(path: str, data: bytes) -> None:
    """Writes a file beside its place, syncs it, renames it."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(draft, "xb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)


def commit(root: str, folders: list[str], overwrite: bool, writer: str | None = None, batch: int | None = None) -> int:
    """Puts folders on the list; another commit meanwhile is no conflict, as the later one's files count."""
    os.makedirs(f"{root}/_versions", exist_ok=True)
    while True:
        base = max(versions(root), default=0)
        now = manifest(root, base)
        if batch is not None:
            if now["batches"].get(writer, -1) >= batch:
                return base
            now["batches"][writer] = batch
        now["folders"] = folders if overwrite else [*now["folders"], *folders]
        draft = f"{root}/_versions/.{uuid.uuid4().hex}"
        with open(draft, "xb") as f:
            f.write(json.dumps(now).encode())
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, _place(root, base + 1))
            return base + 1
        except FileExistsError:
            continue
        finally:
            os.unlink(draft)


# ---------------------------------------------------------------- reading


class Share(InputPartition):
    def __init__(self, folders: list[str], share: int, shares: int):
        self.folders, self.share, self.shares = folders, share, shares


def _names(folder: str) -> Iterator[str]:
    for at, _, files in os.walk(folder):
        for f in files:
            if f.endswith(ENDING):
                yield os.path.relpath(f"{at}/{f}", folder)[: -len(ENDING)]


def read_share(root: str, p: Share) -> Iterator[tuple]:
    """(name, value, error) of the newest files of a share of the names."""
    seen: set[str] = set()
    for folder in reversed(p.folders):
        for name in _names(f"{root}/{folder}"):
            if zlib.crc32(name.encode()) % p.shares != p.share or name in seen:
                continue
            seen.add(name)
            with open(f"{root}/{folder}/{name}{ENDING}", "rb") as f:
                data = f.read()
            if not data:
                continue  # deleted
            try:
                value, error = data.decode(), None
                if not isinstance(json.loads(value), dict):
                    error = "no JSON object"
            except UnicodeDecodeError as e:
                value, error = data.decode("utf-8", "replace"), f"not UTF-8: {e.reason}"
            except ValueError as e:
                error = f"not JSON: {e}"
            yield name, value, error


def batches(rows: Iterator[tuple]) -> Iterator:
    """Arrow batches of (name, value, error), cut by their bytes, as Spark cuts by a number of rows only."""
    import pyarrow as pa

    held, size = [], 0
    of = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], ["name", "value", "error"])
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield of()
            held, size = [], 0
    if held:
        yield of()


class Reader(DataSourceReader):
    def __init__(self, root: str, at: int | None, shares: int):
        self.root, self.at, self.shares = root, at, shares

    def partitions(self) -> list[InputPartition]:
        at = max(versions(self.root), default=0) if self.at is None else self.at
        folders = manifest(self.root, at)["folders"]
        return [Share(folders, i, self.shares) for i in range(self.shares)]

    def read(self, partition: Share) -> Iterator:
        return batches(read_share(self.root, partition))


class StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, shares: int):
        self.root, self.shares = root, shares

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": max(versions(self.root), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before = set(manifest(self.root, start["version"])["folders"])
        new = [f for f in manifest(self.root, end["version"])["folders"] if f not in before]
        return [Share(new, i, self.shares) for i in range(self.shares)] if new else []

    def read(self, partition: Share) -> Iterator:
        return batches(read_share(self.root, partition))


# ---------------------------------------------------------------- writing


class Done(WriterCommitMessage):
    def __init__(self, folder: str, files: int):
        self.folder, self.files = folder, files


def write_rows(root: str, folder: str, rows: Iterator) -> Done:
    """Files of rows (name, value). A name that leaves its folder is an error, one that comes twice in a task too."""
    written: set[str] = set()
    for row in rows:
        name = row["name"]
        if not name or not _NAME.fullmatch(name) or any(part in (".", "..") or part.startswith("_") for part in name.split("/")):
            raise ValueError(f"bad file name {name!r}")
        if name in written:
            raise ValueError(f"two files named {name!r}")
        written.add(name)
        path = f"{root}/{folder}/{name}{ENDING}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        _durable(path, (row["value"] or "").encode())
    return Done(folder, len(written))


class Writer(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.folder = root, overwrite, f"files-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Done:
        return write_rows(self.root, self.folder, iterator)

    def commit(self, messages: list[Done]) -> None:
        os.makedirs(f"{self.root}/{self.folder}", exist_ok=True)
        commit(self.root, [self.folder], self.overwrite)

    def abort(self, messages: list[Done]) -> None:
        """No manifest names the folder; clean() deletes it."""


class StreamWriter(DataSourceStreamWriter):
    def __init__(self, root: str, writer: str):
        self.root, self.writer = root, writer

    def write(self, iterator: Iterator) -> Done:
        # A task has a folder of its own; the commit names those of the tasks that count.
        return write_rows(self.root, f"files-{uuid.uuid4().hex}", iterator)

    def commit(self, messages: list[Done], batchId: int) -> None:
        commit(self.root, [m.folder for m in messages if m and m.files], False, self.writer, batchId)

    def abort(self, messages: list[Done], batchId: int) -> None:
        """No manifest names the folders; clean() deletes them."""


class SidecarFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _root(self) -> str:
        return local(self.options["path"])

    def _shares(self) -> int:
        return int(self.options.get("shares", SHARES))

    def reader(self, schema) -> Reader:
        at = self.options.get("version")
        return Reader(self._root(), None if at is None else int(at), self._shares())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self._root(), self._shares())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self._root(), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self._root(), self.options.get("writer", "stream"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SidecarFiles)


# ---------------------------------------------------------------- tables


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """(name, value, error) of the newest files, or of those of a version."""
    reader = spark.read.format(FORMAT).option("path", path)
    return (reader if at is None else reader.option("version", str(at))).load()


def write(rows: DataFrame, path: str, overwrite: bool = False) -> int:
    """Adds files (name, value), or begins anew with them; the new version."""
    conf, batch = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(batch)
    conf.set(batch, str(BATCH_FILES))
    try:
        rows.select("name", "value").write.format(FORMAT).option("path", path).mode("overwrite" if overwrite else "append").save()
    finally:
        conf.set(batch, before)
    return version(path)


def files(rows: DataFrame) -> DataFrame:
    """Rows as the readers of sidecars take them: (fingerprint, file, value)."""
    last = F.element_at(F.split("name", "/"), -1)
    return rows.select(F.regexp_extract(last, r"^([^.]*)", 1).alias("fingerprint"), F.concat(last, F.lit(ENDING)).alias("file"), "value")


def parted(spark: SparkSession, path: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) files, read once and put aside in one write under ``target``; bad ones keep their reason."""
    read(spark, path).withColumn("bad", F.col("error").isNotNull()).write.partitionBy("bad").parquet(target)
    both = spark.read.schema(SCHEMA + ", bad boolean").parquet(target)
    return both.filter("not bad").drop("bad", "error"), both.filter("bad").drop("bad")


def quarantine(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Moves files that are no JSON out of the way: (name, value, error), kept under ``target``; the files themselves are deleted by a new version."""
    _, bad = parted(spark, path, target)
    if bad.limit(1).count():
        write(bad.select("name", F.lit(None).cast("string").alias("value")), path)
    return bad


def clean(path: str, keep: int = 2) -> list[str]:
    """Deletes manifests older than the newest ``keep`` and the folders that none of those names; not while a write is under way."""
    import shutil

    root, all_ = local(path), versions(local(path))
    named = {f for v in all_[-keep:] for f in manifest(root, v)["folders"]}
    for v in all_[:-keep]:
        os.unlink(_place(root, v))
    gone = [top for top in sorted(os.listdir(root)) if top.startswith("files-") and top not in named]
    for top in gone:
        shutil.rmtree(f"{root}/{top}")
    return gone
