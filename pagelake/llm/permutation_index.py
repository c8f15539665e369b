"""Nearest vectors by largest inner product with a permutation index.

Every vector is represented by the order of its ``prefix`` nearest pivots. Pivots come from a
bounded sample: the ``sample`` vectors with the smallest hash of their id, of which the first
``pivots`` are the pivots. Vectors of unequal norm are lifted by one coordinate to the largest
norm, so that nearest means largest inner product. A vector meets those with its own number of
components; the sample is of the commonest number. All vectors are indexed, in blocks of about ``block``; a block posts
(vector, rank) in its pivots' inverted files. A query walks the files of its own nearest pivots;
the footrule distance of two prefixes (absent pivots at rank ``prefix``) is a constant less
2 (prefix - max of both ranks) for every pivot they share, so what the files add up ranks a block
by footrule. The best share of each block is ranked again by the exact inner product of
the original vectors in double precision. How large a share is measured on the sample: ``PROBES`` of its vectors are searched in a block made
of it, exactly and by footrule, and the share is what keeps ``target`` of the nearest, as many of them as a block of the table holds on average. Where vectors have
many components or no structure it grows, up to the whole block; ``keep`` sets it, and ``keep`` = 1 is the exact search. Blocks of other numbers of components are ranked as a whole. Queries meet all blocks in blocks of their own, so a task holds
one block of each; blocks are dealt by hash, so equal vectors don't meet in one of them.

Nulls and edge cases: vectors that are null, zero, or hold null or
non-finite components, and rows without an id, take no part; ties go to the smaller id; rows with
equal ids are candidates and queries each, a row is not its own candidate; other columns are
ignored; an empty table gives an empty result; with fewer than ``k`` candidates all are returned.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import Scratch, bounded

#: Up to so many numbers of components (three integers each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000


def valid(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def lifted(pivots: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([pivots, np.sqrt(np.maximum(0.0, longest**2 - np.einsum("ij,ij->i", pivots, pivots)))[:, None]])


def prefixes(x: np.ndarray, pivots: np.ndarray, longest: float, prefix: int, lift: bool) -> np.ndarray:
    """The nearest pivots of each row, nearest first. pivots are lifted; queries have lift 0."""
    squares = np.einsum("ij,ij->i", x, x)
    extra = np.sqrt(np.maximum(0.0, longest**2 - squares)) if lift else np.zeros(len(x))
    near = x @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1][None, :]
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


class Block:
    """Inverted files over a block of vectors."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, longest: float, prefix: int):
        self.x, self.prefix, self.n = x, prefix, len(x)
        order = prefixes(x, pivots, longest, prefix, True)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.row = by // order.shape[1]
        self.rank = by % order.shape[1]
        self.start = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def gains(self, order: np.ndarray) -> np.ndarray:
        """What each row's footrule distance to a query's prefix is less than the largest one."""
        spans = [slice(self.start[p], self.start[p + 1]) for p in order]
        rows = np.concatenate([self.row[s] for s in spans])
        gain = np.concatenate([self.prefix - np.maximum(self.rank[s], r) for r, s in enumerate(spans)])
        return np.bincount(rows, gain, self.n)

    def search(self, order: np.ndarray, keep: int) -> np.ndarray:
        """Rows of the ``keep`` smallest footrule distances to a query's prefix."""
        return np.arange(self.n) if keep >= self.n else np.argpartition(-self.gains(order), keep - 1)[:keep]


#: Vectors of the sample that are searched to measure the share.
PROBES = 128


def measured_share(x: np.ndarray, pivots: np.ndarray, longest: float, prefix: int, k: int, target: float) -> float:
    """The least share of a block, best by footrule first, that holds ``target`` of the k nearest of its probes."""
    if len(x) <= k + 1:
        return 1.0
    index = Block(x, pivots, longest, prefix)
    asked = np.arange(len(x))[-PROBES:]
    places = []
    for i, order in zip(asked, prefixes(x[asked], pivots, longest, prefix, False), strict=True):
        rank = np.empty(len(x), np.int64)
        rank[np.argsort(-index.gains(order), kind="stable")] = np.arange(len(x))
        score = x @ x[i]
        score[i] = -np.inf
        places.append(rank[np.argpartition(-score, k - 1)[:k]])
    return float(np.quantile(np.concatenate(places) + 1, target, method="higher") / len(x))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, pivots: int = 256, prefix: int = 32, keep: float | None = None, target: float = 0.97, sample: int = 4096, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. ``queries`` is a condition on the column vec_id."""
    scratch = Scratch(vectors.sparkSession, "permutation-index")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & valid("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = scratch.save(rows.withColumns({"d": F.size("v"), "uid": F.monotonically_increasing_id()}), "vectors")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("asked"), F.max(norm).alias("squares"))
    sizes = scratch.save(sizes.select("d", "n", "squares", parts(F.col("n")).alias("blocks"), parts(F.col("asked")).alias("teams")), "sizes")
    common = sizes.orderBy(F.desc("n"), "d").first()
    d, longest = (common["d"], float(np.sqrt(common["squares"]))) if common else (1, 1.0)
    picked = rows.filter(F.col("d") == d).orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(sample).select("v").collect()  # at most ``sample`` vectors
    drawn = np.array([r["v"] for r in picked], dtype=np.float64).reshape(-1, d)
    centres = lifted(drawn[:pivots], longest)
    held = max(1, ceil(k * min(1.0, len(drawn) / common["n"]))) if common else k
    share = keep if keep is not None else measured_share(drawn, centres, longest, min(prefix, len(centres)), held, target)
    pivot_data = vectors.sparkSession.sparkContext.broadcast(centres)
    dealt = rows.join(bounded(sizes.select("d", "blocks", "teams"), BROADCAST_ROWS), "d")
    deal = lambda parts, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = lambda: [F.col(c).alias(c) for c in ("uid", "vec_id", "v", "d")]  # noqa: E731 - columns of each side's own, as both come from one table
    left = dealt.filter(queries).select(*own(), deal("teams", 1).alias("team"), every("blocks").alias("block"))
    right = dealt.select(*own(), deal("blocks", 2).alias("block"), every("teams").alias("team"))

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_uid", "query_id", "vec_id", "uid", "score"]
        if not len(q) or not len(x):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in columns})
        x = x.sort_values(["vec_id", "uid"])  # so that equal footrule distances are cut alike in every run
        data, asked_data = np.stack(x["v"].to_numpy()).astype(np.float64), np.stack(q["v"].to_numpy()).astype(np.float64)
        ids, uids = x["vec_id"].to_numpy(), x["uid"].to_numpy()
        # The best of a block, and enough of them to lose none of the k to the query itself.
        most = max(k + 1, ceil(share * len(x))) if data.shape[1] == d else len(x)
        if most < len(x):
            width = min(prefix, len(pivot_data.value))
            index = Block(data, pivot_data.value, longest, width)
            orders = prefixes(asked_data, pivot_data.value, longest, width, False)
        else:
            index, orders = None, asked_data
        out = []
        for uid, name, v, order in zip(q["uid"].to_numpy(), q["vec_id"].to_numpy(), asked_data, orders, strict=True):
            rows_ = index.search(order, most) if index else np.arange(len(x))
            rows_ = rows_[uids[rows_] != uid]
            score = np.einsum("ij,j->i", data[rows_], v)
            best = np.lexsort((ids[rows_], -score))[:k]
            out.append((np.full(len(best), uid), np.full(len(best), name), ids[rows_][best], uids[rows_][best], score[best]))
        return pd.DataFrame(dict(zip(columns, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    found = left.groupBy("d", "block", "team").cogroup(right.groupBy("d", "block", "team")).applyInPandas(run, "query_uid long, query_id long, vec_id long, uid long, score double")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
