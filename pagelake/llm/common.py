"""Shared pieces: scratch tables in the cluster's shared folder, tokens, shingle hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a regular expression class.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_REGEX = rf"[^{SPACE_CLASS}]+"


#: Settings while a table is written: its shuffle files go when the job ends, and Python gets small batches of texts.
_WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only on a local master without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; the master is {master}")
        folder = "file://" + tempfile.mkdtemp(prefix="pagelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables, written once to the shared folder and read back.

    Writing cuts the lineage: losing an executor costs only the tasks that are running,
    and a table that is used twice is computed once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, tuple[str, DataFrame]] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, records: int | None = None) -> DataFrame:
        """df, written and read back; Python gets at most ``records`` rows at once."""
        path = self.path(name)
        settings = _WHILE_SAVING | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(records)} if records else {})
        was = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in was.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(saved)] = (path, saved)
        return saved

    def drop(self, *frames: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(df))[0])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def free_shuffles(self) -> None:
        """Let Spark remove the shuffle files of finished jobs now rather than at some later collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Gives memory that Python and Arrow no longer use back to the system.

    Python workers stay for the next stages, beside a JVM that may need the room.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries don't have it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """run, a function of a task's batches, that gives memory back when the task ends."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def quoted(name: str) -> str:
    """A column's name for functions that parse names."""
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, lengthened until no column has it (Spark ignores case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def bounded(ids: DataFrame, rows: int) -> DataFrame:
    """ids, marked for broadcast if there are at most ``rows`` of them (counted here); else it joins by shuffle."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def words_column(text: Column) -> Column:
    """array<string>: words of a text with A-Z lower-cased; null and blank give an empty array."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(lowered, rf"[{SPACE_CLASS}]+")
    return F.filter(parts, lambda w: w != "")


def words_bytes(text: str | None) -> list[bytes]:
    """The same words as UTF-8 bytes: bytes.lower and bytes.split know exactly A-Z and the six separators."""
    return (text or "").encode().lower().split()


# ---------------------------------------------------------------- hashed shingles

_RNG = np.random.default_rng(20240229)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes of a word that are mixed eight at a time; longer words get a cryptographic hash.
_LANES = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts, offsets of each text's words).

    A word's hash takes in eight bytes at a time, each time mixed with all before: words of up to eight bytes have different hashes if they are equally long,
    and no rule makes longer ones collide, as it does where a hash is a sum over places.
    """
    parts = [(t or "").encode().lower() for t in texts]
    raw = b"\n".join(parts) + b"\n"
    buf = np.frombuffer(raw, dtype=np.uint8)
    space = _IS_SPACE[buf]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.cumsum(np.array([len(p) + 1 for p in parts], dtype=np.int64)) if parts else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.searchsorted(first, ends))).astype(np.int64)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), offsets
    length = np.flatnonzero(space & np.concatenate(([False], ~space[:-1]))) - first
    eight = np.ndarray(len(buf), "<u8", raw + b"\0" * 8, 0, (1,))  # the eight bytes from each place on
    state = mix64(length.astype(np.uint64) * _STEP[63])
    state = mix64(state ^ (eight[first] & _MASK[np.minimum(length, 8)]))
    more = np.flatnonzero((length > 8) & (length <= _LANES))
    for at in range(8, _LANES, 8):
        more = more[length[more] > at]
        if not len(more):
            break
        state[more] = mix64((state[more] * _STEP[62]) ^ (eight[first[more] + at] & _MASK[np.minimum(length[more] - at, 8)]))
    for i in np.flatnonzero(length > _LANES).tolist():
        state[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : first[i] + length[i]], digest_size=8).digest(), "little")
    return state, offsets


def shingle_sets(texts: list[str | None], k: int = 5, block_chars: int = 300_000) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct hashes of k-word shingles (one of the whole text if it has fewer words)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < block_chars):
            size += len(texts[end] or "")
            end += 1
        hashes, offsets = word_hashes(texts[at:end])
        n = max(0, len(hashes) - k + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(k if n else 0):
            rolled += hashes[j : j + n] * _STEP[j]
        rolled = mix64(rolled)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = hashes[a:b] * _STEP[: b - a]
                yield mix64(np.add.reduce(short, keepdims=True) + _STEP[50 + b - a])
            else:
                yield np.zeros(0, dtype=np.uint64)
        at = end


def text_blocks(texts: Iterable[str | None], block_chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about block_chars characters each."""
    start = size = 0
    i = -1
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= block_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if i + 1 > start:
        yield start, i + 1


# ---------------------------------------------------------------- connected components


def components(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node in links; component is the smallest node reachable.

    Every round gives each node the smallest label among its own and its neighbours', then
    follows the label once more (pointer jumping), so chains shorten by half. Each round's
    labels are written to the shared folder; only the number of changed labels reaches the driver.
    Minima are taken with partial aggregation, so a node with very many links is no single task's load.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = scratch.save(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        hop = labels.join(near, labels.node == near.u, "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("now"))
        hop = scratch.save(hop, "hop")
        old = labels
        to = hop.select(F.col("node").alias("at"), F.col("now").alias("then"))
        new = hop.join(to, hop.now == to["at"], "left").select("node", "was", F.least("now", F.coalesce("then", "now")).alias("label"))
        new = scratch.save(new, "labels")
        changed = new.filter("was <> label").limit(1).count()
        scratch.drop(old, hop)
        if not changed:
            return new.select("node", F.col("label").alias("component"))
        labels = new
