"""Filter interaction audit: what each filter removes alone, after the others, and on average over all orders.

Documents are range-sorted by a fingerprint of their text, the text itself and their id. Each task
compares a document with its predecessor, so that equal texts are found by comparing whole texts and not by
hashes, and a text that is a third of the table is spread over many tasks by its ids. A group that goes on in the next task
is mended afterwards: every task tells the groups of its last fingerprint, one small row each, and only rows of a
task's first fingerprint look there for a smaller id.

A document's failures are a bit mask. Masks are counted per part, so all orders of the filters follow from at
most 2^filters counters of a part: what a step removes are the masks that hold its bit and none of the bits before.

Nulls and edge cases: a null text is the empty one, a null part the empty string; a row without an id fails no
duplicate test and has no labels, but others are not its duplicates either; rows with equal id and text are not
duplicates of each other, as neither id is smaller; labels of one id are taken together (any of
them); other columns are ignored; very long texts are compared and split whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import Scratch, bounded

_CAPITALS = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")


class Facts:
    """What the filters ask of a text; words are maximal runs without ASCII white space."""

    def __init__(self, text: bytes):
        words = text.split()
        self.words, self.distinct = len(words), len(set(words))
        self.chars = len(text.decode())
        self.capitals = len(text) - len(text.translate(None, _CAPITALS))
        self.marked = _MARKS.search(text) is not None


#: Filters by letter, the duplicate filter (None) among them.
FILTERS: dict[str, Callable[[Facts], bool] | None] = {
    "A": lambda t: t.words < 50,
    "B": lambda t: 100 * t.distinct < 65 * t.words,
    "C": lambda t: 100 * t.capitals > 5 * t.chars,
    "D": lambda t: t.marked,
    "E": None,
}
#: Up to so many rows (two for each task) are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
_EDGE = -1
SORTED = "part string, doc_id long, mask int, first long, key string"


def _compared(filters: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    tests = [(1 << i, f) for i, f in enumerate(filters.values()) if f]
    names = [c.split()[0] for c in SORTED.split(", ")]

    def failed(text: bytes) -> int:
        facts = Facts(text)
        return sum(bit for bit, f in tests if f(facts))

    def digest(text: bytes) -> str:
        return hashlib.sha256(text).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = prints = text = first = mask = None
        key: str | None = None
        ends: list[tuple[str, int | None]] = []  # earlier groups of the last fingerprint
        for batch in batches:
            part, ids, marks, texts = (batch.column(i) for i in range(4))
            out: list[tuple] = []
            for name, doc_id, mark, raw in zip(part.to_pylist(), ids.to_pylist(), marks.to_pylist(), texts, strict=True):
                now = raw.as_py()
                if text is None or mark != prints or now != text:
                    if text is not None:
                        ends = [*ends, (digest(text), first)] if mark == prints else []
                    opening = mark if text is None else opening
                    prints, text, first, mask = mark, now, doc_id, failed(now)
                    key = digest(now) if mark == opening else None
                out.append((name, doc_id, mask, first, key))
            yield _batch(out, names)
        if text is not None:
            yield _batch([(None, None, _EDGE, least, k) for k, least in (*ends, (digest(text), first))], names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def failures(docs: DataFrame, part: Column, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, doc_id, mask of every row: bit i is set if the i-th filter rejects the document."""
    scratch = Scratch(docs.sparkSession, "filter-audit")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))
    nulls_last = F.asc_nulls_last("doc_id")
    ranged = rows.repartitionByRange("mark", nulls_last).sortWithinPartitions("mark", "text", nulls_last)
    found = scratch.save(ranged.mapInArrow(_compared(filters), SORTED), "sorted", records=1000)
    ends = found.filter(F.col("mask") == _EDGE).groupBy("key").agg(F.min("first").alias("least"))
    inside = found.filter((F.col("mask") != _EDGE) & F.col("key").isNull()).withColumn("least", F.lit(None).cast("long"))
    opening = found.filter((F.col("mask") != _EDGE) & F.col("key").isNotNull()).join(bounded(ends, BROADCAST_ROWS), "key", "left")
    every = inside.unionByName(opening.select(inside.columns))
    bit = sum(1 << i for i, f in enumerate(filters.values()) if f is None)
    again = F.col("doc_id") > F.least("first", "least")
    return every.select("part", "doc_id", (F.col("mask") + F.when(again, bit).otherwise(0)).alias("mask"))


def counters(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents of a part with a mask, and how many of them are labelled so."""
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.filter(f"{id_col} is not null").groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic")).filter("good + toxic > 0")
    none = F.lit(0).cast("long")
    total = failed.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
    asked = failed.filter("doc_id is not null").groupBy("doc_id", "part", "mask").agg(F.count("*").alias("rows"))
    told = asked.join(known, "doc_id").groupBy("part", "mask").agg(none.alias("n"), F.sum(F.col("rows") * F.col("good")).alias("good"), F.sum(F.col("rows") * F.col("toxic")).alias("toxic"))
    return total.unionByName(told).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(counted: DataFrame, letters: str = "".join(FILTERS)) -> DataFrame:
    """A row for each part, order of the filters and step, from the part's counters."""
    orders = ["".join(p) for p in permutations(letters)]
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^filters of a part
    steps = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.array(*map(F.lit, range(1, len(letters) + 1)))))
    bits = lambda text: sum((F.when(F.contains(text, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    steps = steps.withColumns({"bit": bits(F.substr("filter_order", F.col("step"), F.lit(1))), "before": bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))})
    bit, before = F.col("bit"), F.col("before")
    fails = lambda c: c.mask.bitwiseAND(bit) != 0
    gone = lambda c: c.mask.bitwiseAND(before) != 0

    def total(which: Callable[[Column], Column], what: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda s, c: s + what(c))

    removed = lambda c: fails(c) & ~gone(c)
    n = lambda c: c.n
    # A mask of k bits is removed by each of its filters in the same number of orders.
    share = lambda c: (c.n * len(orders) / F.bit_count(c.mask)).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~fails(c) & ~gone(c), n).alias("kept"),
        total(removed, n).alias("removed"),
        total(lambda c: fails(c) & gone(c), n).alias("redundant"),
        total(lambda c: c.mask == bit, n).alias("unique_fails"),
        total(removed, lambda c: c.good).alias("good_lost"),
        total(removed, lambda c: c.toxic).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, part: Column, filters: dict = FILTERS) -> DataFrame:
    """The audit of all orders of the filters, per part."""
    scratch = Scratch(docs.sparkSession, "filter-counters")
    return audit(scratch.save(counters(failures(docs, part, filters), labels), "counters"), "".join(filters))
