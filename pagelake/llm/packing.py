"""Order-preserving packing of token streams by dynamic programming.

Each task reads its documents in order as one stream of token ids (every document ends with
``end_id``) and cuts it into sequences of at most ``capacity`` ids. Cuts may stand at ends of
documents (free) or of sentences (``sentence_cost``), or where a window that began at one of
these is full (``broken_cost``). A sequence is padded to the capacity unless its length is a power of two. Shorter
sequences than the capacity that need no padding cost ``short_cost``, so a stream isn't cut to crumbs.
Powers of two count from a sixteenth of the capacity on. The least sum of padding and costs solves

    f(j) = cut(j) + min(capacity - j + min over i in [j - capacity, j) of (f(i) + i), short + min over k of f(j - 2^k))

whose first inner minimum a monotone queue keeps, so a cut costs amortised constant time.
The stream is solved in stretches of about ``horizon`` ids; the last windows of a stretch go over
to the next one, so memory is bounded whatever a document's length is in windows. What is left at
the end of a task is cut at powers of two where padding would cost more than the cuts.

Nulls and edge cases: a null or empty text is the single id ``end_id``; a null doc_id stays null;
repeated rows are packed each; other columns are ignored; an empty table gives no pieces. Sequence
ids are unique: the task's number in the high bits, the sequence's in the low ones.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from math import inf

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import lean

#: Sequences shorter than this part of the capacity are made only at the end of a task.
SHORTEST = 16
#: GPT-2's split of a text into words, and the same without its lookahead, which regular expressions match in one pass.
LOOKAHEAD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ONE_PASS = LOOKAHEAD.replace(r"\s+(?!\S)|", "")
#: Unicode's White_Space, as ``\s`` is there; Python's own adds four controls.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where the two differ: a run of white space before other characters leaves its last one to what follows.
RUN = re.compile(f"[{WHITE}](?=[{WHITE}][^{WHITE}])")
#: Texts with more runs than one in so many characters are split with the lookahead.
RUN_CHARS = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Byte-level BPE ids as the tokenizer file gives them; the ranks file holds the same vocabulary for a faster library.

    Words end before the last character of each run of white space, so a text cut there has the same words, and its parts
    need no lookahead. This holds for GPT-2's pattern; others are matched as they are.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.one_pass = tiktoken.Encoding("ranks", pat_str=ONE_PASS, mergeable_ranks=ranks, special_tokens={}) if pattern == LOOKAHEAD else None
        stops = np.zeros(max(ranks.values()) + 2, dtype=bool)
        for token, i in ranks.items():
            stops[i] = token.rstrip(b" \"')")[-1:] in (b".", b"!", b"?", b"\n")
        self.stops = stops

    def __call__(self, text: str) -> np.ndarray:
        if any(t in text for t in self.special):
            ids = self.plain.encode(text, add_special_tokens=False).ids
        else:
            try:
                ids = self.words(text)
            except ValueError:  # the fast library's regular expressions give up on very long runs of spaces
                ids = self.plain.encode(text, add_special_tokens=False).ids
        return np.array(array("I", ids), dtype="<u4")

    def words(self, text: str) -> list[int]:
        if not self.one_pass:
            return self.fast.encode_ordinary(text)
        cuts = [m.end() for m in RUN.finditer(text)]
        if not cuts:
            return self.one_pass.encode_ordinary(text)
        if len(cuts) * RUN_CHARS > len(text):
            return self.fast.encode_ordinary(text)
        return [i for a, b in pairwise([0, *cuts, len(text)]) for i in self.one_pass.encode_ordinary(text[a:b])]


@cache
def encoder(tokenizer_path: str, ranks_path: str, pattern: str) -> Encoder:
    return Encoder(tokenizer_path, ranks_path, pattern)


def best_cuts(ends: np.ndarray, sentences: np.ndarray, total: int, capacity: int, sentence_cost: float, broken_cost: float, short_cost: float) -> list[int]:
    """Positions of the best cuts of a stream of ``total`` ids; the last is total.

    ends and sentences are positions after which a document or a sentence is complete.
    """
    cost = np.full(total + 1, float(broken_cost))
    cost[sentences] = sentence_cost
    cost[ends] = 0
    cost[[0, total]] = 0
    soft = np.zeros(total + 1, dtype=bool)
    soft[ends] = soft[sentences] = soft[[0, total]] = True
    begin = np.flatnonzero(soft)
    gaps = np.diff(begin)
    soft[capacity:] |= soft[: max(0, total + 1 - capacity)].copy()
    for a, g in zip(begin[:-1][gaps > capacity].tolist(), gaps[gaps > capacity].tolist(), strict=True):
        soft[a + capacity : a + g : capacity] = True
    at = np.flatnonzero(soft)
    # pairs of indices whose distance needs no padding, by the later one
    later, earlier = [], []
    k = max(1, capacity // SHORTEST)
    while k < capacity:
        j = np.flatnonzero(soft[np.maximum(at - k, 0)] & (at >= k))
        later.append(j)
        earlier.append(np.searchsorted(at, at[j] - k))
        k *= 2
    m = len(at)
    js = np.concatenate([*later, [m]]).astype(np.int64)
    order = np.argsort(js, kind="stable")
    pairs = zip(js[order].tolist(), np.concatenate([*earlier, [0]]).astype(np.int64)[order].tolist(), strict=True)
    late, early = next(pairs)
    pos = at.tolist()
    f, back = [0.0] * m, [0] * m
    # indices of the queue and their f + position; -inf is what left the window, so that popping ends there
    queue, least, head = [-1, 0], [-inf, 0.0], 1
    for j, p, floor, extra in zip(range(1, m), pos[1:], (at[1:] - capacity).tolist(), cost[at[1:]].tolist(), strict=True):
        i = queue[head]
        while pos[i] < floor:
            least[head] = -inf
            head += 1
            i = queue[head]
        best = least[head] - floor
        while late == j:
            if f[early] + short_cost < best:
                best, i = f[early] + short_cost, early
            late, early = next(pairs)
        back[j] = i
        f[j] = best = best + extra
        best += p
        while least[-1] >= best:
            least.pop()
            queue.pop()
        queue.append(j)
        least.append(best)
    out, j = [], m - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def last_cuts(start: int, end: int, capacity: int, broken_cost: float, short_cost: float) -> list[int]:
    """Cuts of a stream's last sequence: powers of two where that beats padding."""
    length = end - start
    bits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    if length == capacity or capacity - length <= len(bits) * short_cost + (len(bits) - 1) * broken_cost:
        return [end]
    return np.cumsum([start, *bits])[1:].tolist()


class Packer:
    """A task's stream: documents go in, pieces come out."""

    def __init__(self, first_sequence: int, capacity: int, costs: tuple[float, float, float], horizon: int):
        self.sequence, self.capacity, self.costs, self.horizon = first_sequence, capacity, costs, horizon
        self.ids = np.zeros(0, dtype="<u4")
        self.stops = np.zeros(0, dtype=bool)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        #: (doc_id, ids of the document before the buffer, its ids in the buffer, its ids in all)
        self.docs: list[tuple[int | None, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray, stops: np.ndarray) -> Iterator[tuple]:
        self.parts.append((ids, stops))
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.held += len(ids)
        if self.held >= self.horizon:
            yield from self.cut(False)

    def cut(self, final: bool) -> Iterator[tuple]:
        ids = np.concatenate([self.ids, *(p[0] for p in self.parts)])
        stops = np.concatenate([self.stops, *(p[1] for p in self.parts)])
        self.parts = []
        if not len(ids):
            return
        ends = np.cumsum([d[2] for d in self.docs])
        cuts = best_cuts(ends, np.flatnonzero(stops) + 1, len(ids), self.capacity, *self.costs)
        if final:
            cuts[-1:] = last_cuts(cuts[-2] if len(cuts) > 1 else 0, cuts[-1], self.capacity, *self.costs[1:])
        else:  # the last windows may still change
            cuts = cuts[: max(1, bisect_right(cuts, len(ids) - 8 * self.capacity))]
        raw = memoryview(ids.tobytes())
        bounds, doc, at = ends.tolist(), 0, 0
        for stop in cuts:
            offset = 0
            while at < stop:
                name, before, size, whole = self.docs[doc]
                start = bounds[doc] - size
                to = min(stop, bounds[doc])
                yield name, before + at - start, to - at, zlib.crc32(raw[4 * at : 4 * to]), whole, self.sequence, offset
                offset += to - at
                at = to
                doc += at == bounds[doc]
            self.sequence += 1
        rest = self.docs[doc:]
        if rest:
            name, before, size, whole = rest[0]
            start = bounds[doc] - size
            rest[0] = (name, before + at - start, size - (at - start), whole)
        self.docs, self.ids, self.stops, self.held = rest, ids[at:], stops[at:], len(ids) - at


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str,
    pattern: str,
    capacity: int = 1024,
    end_id: int = 0,
    sentence_cost: float = 2,
    broken_cost: float = 8,
    short_cost: float = 24,
    horizon: int = 1 << 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path, pattern)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, (sentence_cost, broken_cost, short_cost), horizon)
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([end_id], dtype="<u4")).astype("<u4", copy=False)
                stops = encode.stops[np.minimum(ids, len(encode.stops) - 1)]
                rows.extend(packer.add(doc_id, ids, stops))
                if len(rows) > 20_000:
                    yield made(rows)
                    rows = []
        rows.extend(packer.cut(True))
        if rows:
            yield made(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)
