"""SentencePiece encoding and decoding by streaming Viterbi; the library only reads the vocabulary file.

The vocabulary file is a byte-pair model (another kind of model, or one with a normaliser, is an error): ids are right when they equal the result of its merges
in score order. A sequence of pieces is that result exactly if every two neighbours are what the
merges leave of their concatenation, so each prefix of a text has one last piece that can follow the path of
the prefix before it. The trellis therefore scores paths by possibility: position i takes the
piece that ends there and is compatible with the path at its start. Only the last
``longest piece`` positions can still be a start, so the window holds these; as soon as all their
backpointer paths run through one boundary, the ids before it are committed and forgotten.
Between a character and a following space mark every path has a boundary, as no piece spans one:
text is committed word by word, and words that repeat are looked up.

Characters without a piece become their UTF-8 byte pieces. Nulls and edge cases: a null text has
no ids, like the empty one; decoding maps ids to bytes, replaces invalid UTF-8 and takes off the
space that encoding puts in front; a text that holds the space mark itself (U+2581) decodes to spaces;
repeated rows are encoded each; a very long text takes time in proportion to it, also one without any space, of which only the window
and the ids are held; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A word: space marks and what follows them.
WORD = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
CACHED = 400_000
LONG = 64


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + size]
            at += size


def require_byte_pairs(model: bytes) -> None:
    """ValueError unless the file's ids are those of merges over the text as it is, with a space mark in front."""
    # Fixed values of the public file format: message and field numbers, and their defaults.
    trainer_spec, normalizer_spec = 2, 3
    model_type, byte_pairs = 3, 2
    suffix = 24
    charsmap, dummy_prefix, remove_spaces, escape_spaces = 2, 3, 4, 5
    parts = dict(fields(model))
    trainer, normaliser = dict(fields(parts.get(trainer_spec, b""))), dict(fields(parts.get(normalizer_spec, b"")))
    if trainer.get(model_type, 1) != byte_pairs or trainer.get(suffix, 0):
        raise ValueError(f"a byte-pair model is needed, the file has model type {trainer.get(model_type, 1)}")
    if normaliser.get(charsmap) or not normaliser.get(dummy_prefix, 1) or normaliser.get(remove_spaces, 1) or not normaliser.get(escape_spaces, 1):
        raise ValueError("the file's normaliser changes texts, which this encoder does not")


class Model:
    """Vocabulary, ranks and merge tree of a byte-pair SentencePiece file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        require_byte_pairs(sp.serialized_model_proto())
        n = sp.get_piece_size()
        if n > 65536:
            raise ValueError(f"at most 65536 pieces are supported, the file has {n}")
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        #: id -> bytes that it decodes to.
        self.plain = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        own = [i for i in range(n) if not special[i]]
        #: Tokens are numbered in merge order: single characters, then pieces by falling score.
        order = sorted(own, key=lambda i: (len(self.pieces[i]) > 1, -sp.get_score(i), i))
        self.packed = [i.to_bytes(4, "little") for i in order]
        self.token = {self.pieces[i]: t for t, i in enumerate(order)}
        self.longest = max(map(len, self.token))
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.join: dict[tuple[int, int], int] = {}
        reachable = dict(self.token)
        for t, i in enumerate(order):
            piece = self.pieces[i]
            if len(piece) > 1:
                parts = self._merged(piece, t)
                if len(parts) == 2:
                    self.left[t], self.right[t] = parts
                    self.join[parts[0], parts[1]] = t
                else:
                    del reachable[piece]
        self.usable = reachable
        self.good: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _merged(self, text: str, below: int) -> list[int]:
        """Tokens that merges of rank under ``below`` leave of a text."""
        parts = [self.token.get(c, -1) for c in text]
        names = list(text)
        while len(parts) > 1:
            best = min((self.token.get(a + b, below), k) for k, (a, b) in enumerate(zip(names, names[1:], strict=False)))
            if best[0] >= below:
                break
            k = best[1]
            names[k : k + 2] = [names[k] + names[k + 1]]
            parts[k : k + 2] = [best[0]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Do the merges keep the boundary between neighbours a and b? Merges are undone next to it, latest first, looking for an earlier one across it."""
        key = a * 65536 + b
        if (known := self.good.get(key)) is not None:
            return known
        if len(self.good) > 2_000_000:
            self.good.clear()
        x, y, limit, join = a, b, 1 << 60, self.join
        answer = True
        while True:
            made = join.get((x, y))
            if made is not None and made < limit:
                answer = False
                break
            if x > y:
                limit, x = x, self.right[x]
                if x == limit:
                    limit, y = y + 1, self.left[y]
                    if y + 1 == limit:
                        break
            else:
                limit, y = y + 1, self.left[y]
                if y + 1 == limit:
                    limit, x = x, self.right[x]
                    if x == limit:
                        break
        self.good[key] = answer
        return answer

    # ------------------------------------------------------------ encoding

    def _path(self, text: str) -> Iterator[int]:
        """Token ids of a text without inner word boundaries; unknown characters are -1 - code point. Holds a window of positions only."""
        usable, longest, good, compatible = self.usable, self.longest, self.good, self.compatible
        last: dict[int, int] = {}  # position -> token that ends there
        begin: dict[int, int] = {}  # position -> where that token starts
        done, n = 0, len(text)
        for i in range(1, n + 1):
            for j in range(i - 1, (i - longest if i - longest > done else done) - 1, -1):
                t = usable.get(text[j:i])
                if t is not None:
                    if j == 0:
                        break
                    before = last.get(j)
                    if before is not None:
                        if before < 0:
                            break
                        fits = good.get(before * 65536 + t)
                        if fits or fits is None and compatible(before, t):
                            break
            else:
                j, t = i - 1, -1 - ord(text[i - 1])
            last[i], begin[i] = t, j
            if i == n:
                common = n
            elif i % LONG:
                continue
            else:  # the boundary that all paths of positions in the window share
                ends = set(range(max(done + 1, i - longest + 1), i + 1))
                while len(ends) > 1:
                    top = max(ends)
                    ends.remove(top)
                    ends.add(begin.get(top, done))
                (common,) = ends
            out = []
            p = common
            while p > done:
                out.append(last[p])
                p = begin[p]
            yield from reversed(out)
            if i < n:
                for p in range(done, common):
                    last.pop(p, None)
                    begin.pop(p, None)
                done = common

    def word(self, text: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit bytes."""
        packed, fallback = self.packed, self._fallback
        return b"".join([packed[t] if t >= 0 else fallback(chr(-1 - t)) for t in self._path(text)])

    def _fallback(self, char: str) -> bytes:
        return b"".join([self.bytes.get(b, self.unknown).to_bytes(4, "little") for b in char.encode("utf-8", "surrogatepass")])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        young, old = self.young, self.old
        out = []
        for w in WORD.findall(MARK + text.replace(" ", MARK)):
            hit = young.get(w)
            if hit is None:
                hit = old.get(w)
                if hit is None:
                    hit = self.word(w)
                if len(w) <= LONG:
                    young[w] = hit
                    if len(young) >= CACHED:
                        self.old = old = young
                        self.young = young = {}
            out.append(hit)
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        plain = self.plain
        return b"".join([plain[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


@cache
def model(path: str) -> Model:
    return Model(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids, ids_crc32 (of the little-endian 32-bit ids), round_trip (decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                raw, same = [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    ids = m.encode(text)
                    raw.append(ids)
                    same.append(m.decode(np.frombuffer(ids, dtype="<u4").tolist()) == text)
                flat = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)
                n = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), flat)
                crc = pa.array([zlib.crc32(r) for r in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists, crc, pa.array(same)], names=["doc_id", "n_ids", "ids", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, ids_crc32 long, round_trip boolean")


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: texts of id arrays; a null array gives an empty text, null ids are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(i for i in ids or () if i is not None) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
