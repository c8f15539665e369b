"""Language-model scores from a weighted backoff automaton that is as large as the corpus makes it.

Every word, pair and triple of the training texts counts; nothing is cut. States are the root, the
words and the pairs. The arc of a token w out of a state h holds the probability
(c(h w) + ``prior`` p(w | h')) / (c(h) + ``prior``), h' being h without its first word; the failure arc
to h' holds prior / (c(h) + prior), which is what the same formula gives where c(h w) is 0. So each
state's probabilities sum to one. The lowest order is the add-``alpha`` unigram model, which gives every
training word its count and an unknown word the rest. A text is read from left to right by the automaton: while its
state has no arc for a token it goes along failure arcs, then it takes the arc, adds the weights and is in
the state of the last two tokens, or of the last one or the root where training texts don't have these.

The model is never in one place. Texts lie in chunks of about ``chunk_bytes``; a chunk is one row with its distinct
words as 64-bit hashes and its tokens as numbers of these. A chunk asks for each of its distinct n-grams
once: sorted hashes are cut into parts by their leading bits, and each part travels as one block of hashes and
one of the chunk's own training counts. A part, of bounded size, sums the counts of all chunks, and each chunk gets
back a block of totals in the order in which it asked. An n-gram has one entry a chunk at most, so no key
is hot, and there are as many parts as the number of tokens calls for. The hashes are asked in ``passes`` ranges,
one after the other, so that only one range is on disk at a time. With the totals a chunk builds the states and arcs that its own
texts can reach, and walks through them.

Tokens are words with A-Z lower-cased, then one end. Texts are held out when the CRC-32 of their
id, as text, is divisible by ``folds``. Nulls and edge cases: a null or empty text is one end
token; a null id counts as the empty text (held out); repeated rows train and score each; a very long text is a
chunk of its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import _STEP, Scratch, give_back, lean, mix64, text_blocks, word_hashes

#: Weight of the next lower order, in occurrences of the state.
PRIOR = 32.0
END = -0x61C8864680B583EB
#: Kinds of blocks.
WORD, GRAM = 0, 1
#: Entries of a part, about.
PART_KEYS = 2_000_000
CODED = "chunk long, doc_id array<long>, held_out array<boolean>, sizes array<int>, words binary, tokens binary"
CODED_TYPES = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary())])
ASKED = "kind int, part int, chunk long, keys binary, counts binary"
ASKED_TYPES = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERED = "kind int, part int, chunk long, totals binary, size int, distinct long"
ANSWERED_TYPES = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("totals", pa.binary()), ("size", pa.int32()), ("distinct", pa.int64())])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(id_col: str, folds: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def coded(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """The texts of rows (doc_id, held_out, text) as chunks, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        ids: list = []
        held: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def made() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            row = [[chunk], [ids], [held], [np.concatenate(sizes).tolist()], [words.tobytes()], [narrow(tokens)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, CODED_TYPES, strict=True)], schema=CODED_TYPES)

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_blocks(texts, min(1_000_000, chunk_bytes)):
                hashes, offsets = word_hashes(texts[a:b])
                parts.append(np.insert(hashes.view(np.int64), offsets[1:], END))
                sizes.append(np.diff(offsets) + 1)
                ids += batch.column(0).slice(a, b - a).to_pylist()
                held += batch.column(1).slice(a, b - a).to_pylist()
                size += sum(map(len, texts[a:b]))
                if size >= chunk_bytes:
                    yield made()
                    chunk, size = chunk + 1, 0
                    ids, held, parts, sizes = [], [], [], []
        if parts:
            yield made()

    return rows.select("doc_id", "held_out", "text").mapInArrow(lean(run), CODED)


class Chunk:
    """A chunk's tokens: number of the word, text, and whether a pair or a triple ends there."""

    def __init__(self, sizes: list[int], words: bytes, tokens: bytes):
        self.sizes = np.array(sizes, dtype=np.int64)
        self.words = np.frombuffer(words, dtype=np.int64)
        self.word = widened(tokens, int(self.sizes.sum()))
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.second, self.third = np.zeros(len(self.text), bool), np.zeros(len(self.text), bool)
        self.second[1:] = self.text[1:] == self.text[:-1]
        self.third[2:] = self.text[2:] == self.text[:-2]

    def grams(self) -> np.ndarray:
        """Hashes of all pairs, then of all triples."""
        w = self.words.view(np.uint64)[self.word]
        pair = mix64(w[:-1] * _STEP[0] + w[1:] * _STEP[1] + _STEP[2])[self.second[1:]]
        triple = mix64(w[:-2] * _STEP[3] + w[1:-1] * _STEP[4] + w[2:] * _STEP[5] + _STEP[6])[self.third[2:]]
        return np.concatenate([pair, triple])

    def at_grams(self, of_token: np.ndarray) -> np.ndarray:
        return np.concatenate([of_token[self.second], of_token[self.third]])


class Automaton:
    """The part of the model that a chunk's texts can reach: states, weighted arcs, failure arcs.

    A pair's state has the number of the pair, a word's state that of the word. The arc of a word out of a pair's state has the
    number of the triple, out of a word's state that of the pair, out of the root that of the word; a positive weight says that there is none.
    An arc leads to the state of the last pair, from the root to that of the word. A failure arc leads from a pair's state
    to its last word's, from there to the root.
    """

    NO_ARC = 1.0
    #: Tokens whose arcs are looked up at once.
    SLICE = 1 << 16

    def __init__(self, chunk: Chunk, first: np.ndarray, at: np.ndarray, of_word: np.ndarray, of_gram: np.ndarray, base: np.ndarray, prior: float):
        n, pairs = len(chunk.word), int(chunk.second.sum())
        pair, triple = np.zeros(n, np.int32), np.zeros(n, np.int32)
        pair[chunk.second], triple[chunk.third] = at[:pairs], at[pairs:]
        place = np.concatenate([np.flatnonzero(chunk.second), np.flatnonzero(chunk.third)])[first] if len(first) else first
        longer = first >= pairs
        # Of a pair its own count, of a triple its last pair's.
        own = np.where(longer, of_gram[pair[place]], of_gram) if len(first) else of_gram
        p = (own + prior * base[chunk.word[place]]) / (of_word[chunk.word[place - 1]] + prior)
        del own
        if len(first):
            higher = place[longer]
            p[longer] = (of_gram[longer] + prior * p[longer]) / (of_gram[pair[higher - 1]] + prior)
        self.arc = np.where(of_gram > 0, np.log10(p), self.NO_ARC)
        self.fail_pair = np.log10(prior / (of_gram + prior))
        self.root_arc = np.log10(base)
        self.known = of_word > 0
        self.fail_word = np.log10(prior / (of_word + prior))
        self.goes_on, self.word, self.pair, self.triple = chunk.second, chunk.word, pair, triple

    def steps(self) -> Iterator[tuple]:
        """For each token: whether it goes on a text, its arcs' weights out of a pair's state, a word's and the root, and the failure arcs of the pair's and the word's state that it may lead to, and whether the latter is there."""
        for at in range(0, len(self.word), self.SLICE):
            word, pair, triple = (x[at : at + self.SLICE] for x in (self.word, self.pair, self.triple))
            tables = (self.goes_on[at : at + self.SLICE], *((t[i] if len(t) else np.zeros(len(i))) for t, i in ((self.arc, triple), (self.arc, pair), (self.root_arc, word), (self.fail_pair, pair), (self.fail_word, word), (self.known, word))))
            yield from zip(*(t.tolist() for t in tables), strict=True)

    def scores(self) -> list[float]:
        """The log10 probability of each text: one walk from left to right that carries the state, its order and its failure arcs."""
        out: list[float] = []
        total, order, down, root = 0.0, 0, 0.0, 0.0
        for goes_on, of_pair, of_word, of_root, pair_fails, word_fails, known in self.steps():
            if not goes_on:
                out.append(total)
                total, order = 0.0, 0
            if order == 2:
                if of_pair <= 0:
                    total += of_pair
                    down, root = pair_fails, word_fails
                    continue
                total += down
                order = 1
            if order == 1:
                if of_word <= 0:
                    total += of_word
                    order, down, root = 2, pair_fails, word_fails
                    continue
                total += root
            total += of_root
            order, root = int(known), word_fails
        return [*out, total][1:]


def asked(chunks: DataFrame, bits: int, word_bits: int, passes: int, turn: int) -> DataFrame:
    """Blocks of distinct n-grams in range ``turn`` of the hashes, with the chunk's own training counts; words come with the first."""

    def blocks(kind: int, chunk: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple]:
        part = (keys >> np.uint64(64 - bits)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield kind, int(part[a]), chunk, keys[a:b].tobytes(), narrow(counts[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row["sizes"], row["words"], row["tokens"])
                train = ~np.array(row["held_out"], bool)[c.text]
                out = []
                if turn == 0:
                    words = c.words.view(np.uint64)
                    order = np.argsort(words)
                    out += blocks(WORD, row["chunk"], words[order], np.bincount(c.word, train, len(words))[order], word_bits)
                grams = c.grams()
                mine = (grams >> np.uint64(32)) * np.uint64(passes) >> np.uint64(32) == turn
                keys, at = np.unique(grams[mine], return_inverse=True)
                out += blocks(GRAM, row["chunk"], keys, np.bincount(at, c.at_grams(train)[mine], len(keys)), bits)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True) if out else [[]] * 5, ASKED_TYPES, strict=True)], schema=ASKED_TYPES)

    return chunks.select("chunk", "held_out", "sizes", "words", "tokens").mapInArrow(lean(run), ASKED)


def answered(blocks: DataFrame) -> DataFrame:
    """Totals over all chunks for each block, in the block's order; one row of a part has its number of keys that training texts hold."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, dtype=np.uint64) for k in table["keys"].to_pylist()]
        counts = [widened(c, len(k)) for c, k in zip(table["counts"].to_pylist(), keys, strict=True)]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts), len(known)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        totals = [narrow(x) for x in np.split(sums[at], ends[:-1])]
        distinct = [int((sums > 0).sum())] + [0] * (len(keys) - 1)
        del known, at, sums
        give_back()
        return pa.table([table["kind"], table["part"], table["chunk"], pa.array(totals, pa.binary()), pa.array([len(k) for k in keys], pa.int32()), pa.array(distinct, pa.int64())], schema=ANSWERED_TYPES)

    return blocks.groupBy("kind", "part").applyInArrow(run, ANSWERED)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, alpha: float = 0.1, prior: float = PRIOR, chunk_bytes: int = 4_000_000, passes: int = 3, part_keys: int = PART_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out(id_col, folds).alias("held_out"))
    chunks = scratch.save(coded(rows, chunk_bytes), "chunks")
    sizes = F.aggregate(F.zip_with("sizes", "held_out", lambda n, out: F.when(out, 0).otherwise(n).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n)
    every = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + n)
    total, tokens = chunks.agg(F.coalesce(F.sum(sizes), F.lit(0)), F.coalesce(F.sum(every), F.lit(0))).first()
    bits = max(5, ceil(log2(max(1, 2 * tokens / part_keys))))
    ranges = [scratch.save(answered(asked(chunks, bits, max(3, bits - 4), passes, turn)), f"answers-{turn}", records=4).withColumn("turn", F.lit(turn)) for turn in range(passes)]
    answers = reduce(DataFrame.unionByName, ranges)
    distinct = ranges[0].filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    scale = total + alpha * (distinct + 1)

    def score(of: pa.Table, back: pa.Table) -> pa.Table:
        (row,) = of.to_pylist()
        c = Chunk(row["sizes"], row["words"], row["tokens"])
        found = {}
        for kind in (WORD, GRAM):
            # A part that two ranges meet in has a block of each.
            mine = sorted(x[1:] for x in zip(*(back[x].to_pylist() for x in ("kind", "part", "turn", "totals", "size")), strict=True) if x[0] == kind)
            found[kind] = np.concatenate([np.zeros(0, np.int64), *(widened(totals, n) for _, _, totals, n in mine)])
        of_word = np.empty(len(c.words), np.int64)
        of_word[np.argsort(c.words.view(np.uint64))] = found[WORD]
        _, first, at = np.unique(c.grams(), return_index=True, return_inverse=True)
        base = (of_word + alpha) / scale
        machine = Automaton(c, first, at, of_word, found.pop(GRAM), base, prior)
        del first, at
        give_back()
        n = len(c.sizes)
        of_text = lambda values: np.bincount(c.text, values, n)
        return pa.table({
            "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": c.sizes, "n_known": of_text(of_word[c.word] > 0).astype(np.int64),
            "base_score": of_text(np.log10(base)[c.word]), "score": np.array(machine.scores()),
        })

    scored = chunks.groupBy("chunk").cogroup(answers.select("chunk", "kind", "part", "turn", "totals", "size").groupBy("chunk")).applyInArrow(score, SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
