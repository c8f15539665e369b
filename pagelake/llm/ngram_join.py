"""Near-duplicate join on word shingles with token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at
least num/den. The join is exact; every stage is a shuffle on an evenly spread key:

1. Each text becomes its sorted distinct 64-bit shingle hashes. Documents with equal sets form
   one node (its smallest doc_id), so copies meet in one partial aggregation and not in pairs.
2. A set with n hashes can lose at most tau = n - ceil(t n) of them to a partner. Hashes are
   counted over every set's extended prefix (its smallest tau + 1 + SLACK + n / 12 hashes); those
   in more than ``rare`` nodes are the frequent class, and the order of all hashes is rare ones
   first. A set whose extended prefix holds tau + 1 rare hashes indexes them alone. Any other is
   read again as a whole: it indexes its first tau + 1 rare hashes, or, if it has too few, all of
   them and combinations of c hashes of its first frequent ones, which are split into m classes by
   hash: as many as make tau + 1 + (c - 1) m hashes in all. If two linked sets shared no rare hash and at
   most c - 1 frequent hashes in each class, the prefix that ends first would hold tau + 1 hashes
   that the partner lacks, which is impossible: so linked sets meet in an index entry, while
   sets that share only a common passage do not. m depends on a band of set sizes; sizes of linked
   sets differ by 1/t at most, so a set indexes its own band and the next. Combinations grow
   linearly with a set.
3. Every candidate pair is tested by size and by parity bitmaps first: a set's bitmap has, at each
   position, the parity of its hashes there, so the bits in which two bitmaps differ are at most
   the hashes in which the sets differ, and no linked pair is lost. What passes is verified on whole texts.
4. Entries are compared with their smallest node first, and the links give components. Only pairs
   whose nodes still lie in different components matter after that: a long entry gets another hub,
   and what stays open is compared in full: short entries as pairs, long ones inside tasks that
   take two blocks of a family (nodes joined by long entries) and give back only pairs whose bitmaps
   allow a link. A group of thousands of near copies thus makes about one row a member, and no
   link between components is lost.

Nulls and edge cases: a null or blank text has an empty set, links with nothing and is its own
component; fewer than five words make one shingle of the whole sequence; rows with equal doc_id
are one node of the result and each row is returned; rows with a null doc_id have a null
component and link with nothing; a very long text is shingled whole; shingles are compared as 64-bit hashes that mix all bytes of their words; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import bounded, components, lean, mix64, Scratch, shingle_sets

SHINGLE = 5
#: A hash in the extended prefixes of at most so many nodes is rare.
RARE = 16
#: Hashes beyond tau + 1 in an extended prefix, besides a twelfth of the set.
SLACK = 24
#: Hashes in a combination, where a set's prefix has room for it; a class holds about PER_CLASS hashes.
COMBINED = 3
PER_CLASS = 8
#: An entry with more nodes than this gets another hub before its pairs are compared.
LONG = 32
#: Nodes of a family in a block.
BLOCK = 512
#: Up to so many hashes or ids (8 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000
HUB_ROUNDS = 1


class Bands:
    """Set sizes in bands: a set and a linked one lie in the same band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]

    def tau(self, n: int) -> int:
        return n - -(-self.num * n // self.den)

    def _reach(self, band: int) -> None:
        while len(self.edges) <= band + 1:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)

    def band(self, n: int) -> int:
        while self.edges[-1] <= n:
            self._reach(len(self.edges))
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def classes(self, band: int) -> tuple[int, int]:
        """(m, c): classes, and hashes in a combination. All sets of this band and the one below have (c - 1) m hashes beyond tau + 1."""
        self._reach(band)
        most, least = self.tau(self.edges[band + 1] - 1) + 1, self.edges[max(0, band - 1)]
        m = max(1, ceil(most / (PER_CLASS - COMBINED + 1)))
        room = least - self.tau(least) - 1
        return (m, COMBINED) if (COMBINED - 1) * m <= room else (1, 2)

    def extended(self, n: int) -> int:
        return min(n, self.tau(n) + 1 + SLACK + n // 12)


def parity_bits(s: np.ndarray) -> bytes:
    """A set's parity bitmap; its length is a power of two, so a longer one folds onto a shorter one."""
    size = max(64, 1 << int(len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two parity bitmaps differ: a lower bound of the sets' symmetric difference."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    m, n = len(a), len(b)
    while m > n:
        m //= 2
        x = (x >> 8 * m) ^ (x & ((1 << 8 * m) - 1))
    while n > m:
        n //= 2
        y = (y >> 8 * n) ^ (y & ((1 << 8 * n) - 1))
    return (x ^ y).bit_count()


def most_different(na: int, nb: int, num: int, den: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return na + nb - 2 * -(-num * (na + nb) // (num + den))


def shingled(docs: DataFrame, num: int, den: int, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n, s1, s2, bits, prefix): set size, 128-bit hash of the set, parity bitmap, prefix hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, len(whole), 512)):
            sets = list(shingle_sets(batch.column(1).to_pylist(), k))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            s1 = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], dtype=np.uint64)
            s2 = np.array([np.add.reduce(mix64(s)) if len(s) else 0 for s in sets], dtype=np.uint64)
            heads = [s[: bands.extended(len(s))] if len(s) > 1 else s[:0] for s in sets]
            flat = np.concatenate(heads).view(np.int64) if heads else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([parity_bits(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, flat)],
                names=["doc_id", "n", "s1", "s2", "bits", "prefix"],
            )

    return docs.mapInArrow(lean(run), "doc_id long, n long, s1 long, s2 long, bits binary, prefix array<long>")


@cache
def chosen(n: int, c: int) -> np.ndarray:
    """All ways to choose c of n positions, one a row."""
    return np.array(list(itertools.combinations(range(n), c)), dtype=np.int64).reshape(-1, c)


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, token): every hash of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k), strict=True):
                for at in range(0, len(s), 100_000):
                    part = s[at : at + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), doc)), pa.array(np.full(len(part), len(s))), pa.array(part)], names=["doc_id", "n", "token"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, token long")


def full_prefixes(gathered: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, doc) from (doc_id, n, rare, frequent): single rare hashes, and combinations where those are too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)

        def made(sigs: list, docs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(docs))], names=["sig", "doc"])

        for batch in batches:
            sigs, docs = [], []
            for doc, n, rare, frequent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                need = bands.tau(n) + 1
                alone = np.sort(np.array(rare, dtype=np.int64).view(np.uint64))[:need]
                sigs.append(alone)
                docs.append(np.full(len(alone), doc, dtype=np.int64))
                common = np.sort(np.array(frequent, dtype=np.int64).view(np.uint64))
                for band in (bands.band(n), bands.band(n) + 1) if len(alone) < need else ():
                    m, c = bands.classes(band)
                    t = common[: need - len(alone) + (c - 1) * m]
                    kind = t % np.uint64(m)
                    order = np.argsort(kind, kind="stable")
                    for group in np.split(t[order], np.flatnonzero(np.diff(kind[order])) + 1):
                        picks = chosen(len(group), c)
                        if len(picks):
                            sig = np.full(len(picks), band, dtype=np.uint64)
                            for column in picks.T:
                                sig = mix64(sig * np.uint64(3) + group[column])
                            sigs.append(sig)
                            docs.append(np.full(len(sig), doc, dtype=np.int64))
                if sum(map(len, sigs)) > 500_000:
                    yield made(sigs, docs)
                    sigs, docs = [], []
            if sigs:
                yield made(sigs, docs)

    return gathered.mapInArrow(lean(run), "sig long, doc long")


def entries(nodes: DataFrame, docs: DataFrame, num: int, den: int, k: int, rare: int, scratch: Scratch) -> DataFrame:
    """(sig, doc): the index. An entry with one node only can't give a link."""
    tokens = nodes.select("doc_id", "n", F.explode("prefix").alias("token"))
    counts = scratch.save(tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    frequent = counts.filter(F.col("c") > rare).select("token")
    held = bounded(frequent, BROADCAST_ROWS)
    tau = F.col("n") - F.floor((F.col("n") * num + den - 1) / den).cast("long")
    size = F.size("prefix").alias("size")
    heavy = tokens.join(held, "token", "left_semi").groupBy("doc_id", "n").agg(F.count("*").alias("h"))
    heavy = heavy.join(nodes.select("doc_id", "n", size), ["doc_id", "n"]).filter(F.col("size") - F.col("h") < tau + 1).select("doc_id").distinct()
    heavy = scratch.save(heavy, "heavy")
    whole = whole_sets(docs.join(bounded(heavy, BROADCAST_ROWS), "doc_id", "left_semi"), k).filter("n > 1")
    flagged = whole.join(held.withColumn("f", F.lit(True)), "token", "left")
    is_rare = F.col("f").isNull()
    gathered = flagged.groupBy("doc_id", "n").agg(F.collect_list(F.when(is_rare, F.col("token"))).alias("rare"), F.collect_list(F.when(~is_rare, F.col("token"))).alias("frequent"))
    full = scratch.save(full_prefixes(gathered, num, den), "full")
    keys = counts.filter(F.col("c") <= rare).select("token").unionByName(full.select(F.col("sig").alias("token")).distinct()).distinct()
    single = tokens.join(bounded(heavy, BROADCAST_ROWS), "doc_id", "left_anti").join(keys, "token").join(held, "token", "left_anti")
    return single.select(F.col("token").alias("sig"), F.col("doc_id").alias("doc")).unionByName(full)


def possible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of (a, b, na, nb, bits_a, bits_b) whose sizes and bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(batch)) if differing(x[i], y[i]) <= most_different(na[i], nb[i], num, den)]
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    fit = pairs.filter(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    return fit.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(lean(run), "a long, b long")


def family_pairs(scratch: Scratch, long_: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of (sig, doc, label) that share a long entry, differ in label and may be linked."""
    hubs = long_.groupBy("sig").agg(F.min("doc").alias("a"))
    family = components(scratch, long_.join(hubs, "sig").select("a", F.col("doc").alias("b")))
    members = long_.groupBy("doc").agg(F.min("label").alias("label"), F.collect_set("sig").alias("sigs"))
    members = members.join(family, members.doc == family.node).join(sizes, members.doc == sizes.doc_id).select("doc", "label", "sigs", F.col("component").alias("family"), "n", "bits")
    members = scratch.save(members, "family-members")
    parts = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = members.join(parts, "family").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    placed = placed.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "label", "sigs", "n", "bits")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        left, right = rows[rows["own"] == i], rows[rows["own"] == j]
        code: dict[int, int] = {}
        cells = [[(r, code.setdefault(s, len(code))) for r, sigs in enumerate(side["sigs"]) for s in sigs] for side in (left, right)]
        held = []
        for side, cell in zip((left, right), cells, strict=True):
            m = np.zeros((len(side), len(code)), dtype=np.float32)
            m[tuple(np.array(cell).T)] = 1
            held.append(m)
        meet = held[0] @ held[1].T > 0
        meet &= left["label"].to_numpy()[:, None] != right["label"].to_numpy()[None, :]
        na, nb = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
        meet &= den * np.minimum(na, nb) >= num * np.maximum(na, nb)
        if i == j:
            meet = np.triu(meet, 1)
        x, y = left["bits"].to_list(), right["bits"].to_list()
        na, nb = left["n"].to_list(), right["n"].to_list()
        good = [(r, c) for r, c in np.argwhere(meet).tolist() if differing(x[r], y[c]) <= most_different(na[r], nb[c], num, den)]
        a, b = left["doc"].to_numpy(), right["doc"].to_numpy()
        return pd.DataFrame({"a": [a[r] for r, _ in good], "b": [b[c] for _, c in good]}, dtype="int64")

    return placed.groupBy("family", "i", "j").applyInPandas(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, num: int, den: int, k: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, len(batch), 64):
                a, b, ta, tb = (c.to_pylist() for c in batch.slice(at, 64).columns)
                own = dict(zip(a + b, ta + tb, strict=True))
                sets = dict(zip(own, shingle_sets(list(own.values()), k), strict=True))
                for i, (x, y) in enumerate(zip(a, b, strict=True)):
                    x, y = sets[x], sets[y]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if den * common >= num * (len(x) + len(y) - common) > 0:
                        keep.append(at + i)
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, k: int = SHINGLE, rare: int = RARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (see the module's text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = scratch.save(shingled(docs, num, den, k), "sets")
    heads = scratch.save(sets.select("doc_id", "n", "s1", "s2"), "heads")
    classes = scratch.save(heads.filter("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "classes")
    first = bounded(classes.select(F.col("node").alias("doc_id")).distinct(), BROADCAST_ROWS)
    nodes = sets.filter("n > 1").join(first, "doc_id", "left_semi").select("doc_id", "n", "bits", "prefix")
    index = scratch.save(entries(nodes, docs, num, den, k, rare, scratch), "entries")
    sizes = scratch.save(nodes.select("doc_id", "n", "bits"), "sizes")
    scratch.drop(sets)
    links = _link(scratch, index, sizes, docs, num, den, k)
    # Rows that share a doc_id but not a text hold different classes together.
    both = heads.filter("n > 0 and doc_id is not null").select("doc_id", "s1", "s2").join(classes, ["s1", "s2"]).select("doc_id", "node")
    member = scratch.save(both, "members")
    twice = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all")).filter("a <> b")
    links = links.unionByName(twice.select("a", F.explode("all").alias("b")))
    found = components(scratch, links)
    of = member.groupBy("doc_id").agg(F.min("node").alias("node"))
    of = of.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    out = heads.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _link(scratch: Scratch, index: DataFrame, sizes: DataFrame, docs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Links (a, b) that join exactly the nodes whose components the join must join."""
    needed = index.select(F.col("doc").alias("doc_id")).distinct()
    needed = bounded(scratch.save(needed, "needed"), BROADCAST_ROWS)
    texts = scratch.save(docs.join(needed, "doc_id", "left_semi"), "texts")
    small = sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    large = sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.save(pairs, f"{name}-possible")
        return scratch.save(verified(pairs, texts, num, den, k), name)

    def check(pairs: DataFrame, name: str) -> DataFrame:
        return linked(possible(ordered(pairs).join(small, "a").join(large, "b"), num, den), name)

    hubs = index.groupBy("sig").agg(F.min("doc").alias("a"))
    links = check(index.join(hubs, "sig").select("a", F.col("doc").alias("b")), "links")
    left = index
    for turn in range(HUB_ROUNDS + 1):
        found = components(scratch, links)
        named = left.select("sig", "doc").join(found, left.doc == found.node, "left").select("sig", "doc", F.coalesce("component", "doc").alias("label"))
        named = scratch.save(named, "named")
        open_ = named.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
        left = scratch.save(named.join(open_, "sig"), "open")
        scratch.drop(named)
        long_ = left.filter(F.col("size") > LONG)
        if turn < HUB_ROUNDS and long_.limit(1).count():
            # Another hub for each long entry: its largest-labelled component's first node in this turn's order.
            order = F.xxhash64("doc", F.lit(turn))
            best = long_.filter("label <> lo").groupBy("sig").agg(F.min(order).alias("o"))
            hub = long_.filter("label <> lo").join(best, "sig").filter(order == F.col("o")).select("sig", F.col("doc").alias("a"), F.col("label").alias("hub_label"))
            more = long_.join(hub, "sig").filter("label <> hub_label").select("a", F.col("doc").alias("b"))
            links = scratch.save(links.unionByName(check(more, "hub-links")), "links")
            continue
        short = left.filter(F.col("size") <= LONG)
        x, y = short.select("sig", F.col("doc").alias("a"), F.col("label").alias("la")), short.select("sig", F.col("doc").alias("b"), F.col("label").alias("lb"))
        links = links.unionByName(check(x.join(y, "sig").filter("a < b and la <> lb").select("a", "b"), "rest"))
        if long_.limit(1).count():
            links = links.unionByName(linked(ordered(family_pairs(scratch, long_, sizes, num, den)), "family-links"))
        return links
    raise AssertionError("the last turn returns")
