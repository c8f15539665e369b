"""Hard-negative mining: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels whose score lies in a window below.

Vectors are whole numbers (components times ``scale``, rounded down), so scores are exact. Candidates
are range-sorted by falling norm and packed in blocks of about ``block`` rows, one row each. Anchors are dealt
in teams. A task holds one team and reads blocks one after another, longest vectors first. No score exceeds the product
of both norms (Cauchy-Schwarz): an anchor leaves out blocks whose bound lies below its running ``k``-th
score, and a window leaves out those whose bound lies below its lower limit or its running ``k``-th score. Blocks below the limits of all windows of a team are
left out before the shuffle. A team's blocks are dealt in lanes of about ``lane`` blocks,
so that a long scan is shared by several tasks; the best of all lanes are merged.

Nulls and edge cases: rows without id, label or vector, or with a null or non-finite component (times
``scale``) take no part. Rows with equal ids count once, as the one with the smallest label, then vector. Vectors
meet those with their own number of components. Zero and empty vectors score 0. Ties go to the smaller id. Scores beyond
2^53 are computed with whole numbers of any size; one that a long doesn't hold is an error. Other columns
are ignored; there are no texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import Scratch, bounded

#: Up to so many rows of a few numbers (repeated ids, numbers of components, teams) are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Doubles hold whole numbers up to here; a bound is raised by rounding errors of the norms.
EXACT, SLACK = 2.0**53, 1 + 1e-9
PACK = "d int, pack long, top double, ids binary, labels binary, matrix binary, small boolean"
FOUND = "team int, d int, anchor_id long, positive_id long, positive_score long, found_id long, score long"

# ---------------------------------------------------------------- rows and blocks


def whole_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, q (whole numbers as doubles), d, norm of the rows that take part."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: v * float(scale))
    whole = lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = out.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    out = out.select("vec_id", "label", F.transform("x", whole).alias("q"))
    return out.withColumns({"d": F.size("q"), "norm": F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v))})


def once(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """One row an id."""
    twice = scratch.save(rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"), "repeated")
    few = bounded(twice, BROADCAST_ROWS)
    kept = rows.join(few, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "q", "d", "norm")).alias("v")).select("vec_id", "v.*")
    return rows.join(few, "vec_id", "left_anti").select(kept.columns).unionByName(kept)


def _packed(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, top: float, pack: int) -> tuple:
    """A row of PACK, its vectors ordered by id: the first of equal scores is then the one with the smaller id."""
    order = np.argsort(ids, kind="stable")
    small = not vectors.size or float(np.abs(vectors).max()) < 2**15
    data = vectors[order].astype("<i2" if small else "<f8")
    return vectors.shape[1], pack, top, ids[order].astype("<i8").tobytes(), labels[order].astype("<i8").tobytes(), data.tobytes(), small


def _matrix(raw: bytes, small: bool, n: int, d: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if small else "<f8").astype(np.float64).reshape(n, d)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed by falling norm, blocks of one number of components each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pack, rest = TaskContext.get().partitionId() << 32, None
        names = [c.split()[0] for c in PACK.split(", ")]

        def made(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal pack
            pack += 1
            q = np.stack(part["q"].to_numpy()) if part["d"].iloc[0] else np.zeros((len(part), 0))
            return pd.DataFrame([_packed(part["vec_id"].to_numpy(), part["label"].to_numpy(), q, float(part["norm"].max()), pack)], columns=names)

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest):
                same = int((rest["d"] == rest["d"].iloc[0]).to_numpy().argmin()) or len(rest)
                if same == len(rest) and same < size:
                    break
                yield made(rest.iloc[: min(same, size)])
                rest = rest.iloc[min(same, size) :]
        if rest is not None and len(rest):
            yield made(rest)

    order = ["d", F.desc("norm"), "vec_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, PACK)


def teams(asked: DataFrame) -> DataFrame:
    """Anchors of a team in one row."""
    names = ["team", *(c.split()[0] for c in PACK.split(", "))]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(part["q"].to_numpy()) if part["d"].iloc[0] else np.zeros((len(part), 0))
        row = _packed(part["vec_id"].to_numpy(), part["label"].to_numpy(), q, float(part["norm"].max()), int(part["team"].iloc[0]))
        return pd.DataFrame([(row[1], *row)], columns=names)

    return asked.groupBy("d", "team").applyInPandas(run, "team int, " + PACK)


# ---------------------------------------------------------------- scanning


def scores(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Inner products of the rows of a and b, exact: as doubles, or as Python's whole numbers where these are too long."""
    if longest * SLACK < EXACT:
        return a @ b.T
    big = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    return big(a) @ big(b).T if a.shape[1] else np.zeros((len(a), len(b)))


class Team:
    """Anchors, and for every ask (an anchor and a window of scores) the best rows so far."""

    def __init__(self, row: dict, asks: list[tuple[int, int, float, float, int]] | None, same: bool, k: int):
        self.d, self.same, self.k = row["d"], same, k
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.vectors = _matrix(row["matrix"], row["small"], len(self.ids), self.d)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors)) * SLACK
        if asks is None:
            self.asks = [(int(i), None, None) for i in self.ids]
            self.of, low = np.arange(len(self.ids)), np.full(len(self.ids), -np.inf)
            self.high = np.full(len(self.ids), np.inf, dtype=object)
        else:
            self.asks = [(i, p, s) for i, p, s, _, _ in asks]
            self.of = np.searchsorted(self.ids, [a[0] for a in asks])
            low, self.high = np.array([a[3] for a in asks], dtype=object), np.array([a[4] for a in asks], dtype=object)
        self.low = np.array(low, dtype=object)
        n = len(self.asks)
        self.best = np.full((n, k), -np.inf, dtype=object)
        self.found = np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """The least score that still counts for each ask; at equal scores a smaller id may."""
        return np.maximum(self.low, self.best[:, -1])

    def bounded_out(self, top: float) -> np.ndarray:
        """Asks that no vector of this length can serve."""
        return self.norms[self.of] * top < self.floor().astype(np.float64) * (1 - 1e-9) - 1e-9

    def meet(self, row: dict) -> None:
        live = np.flatnonzero(~self.bounded_out(row["top"] * SLACK))
        if not len(live):
            return
        ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        block = _matrix(row["matrix"], row["small"], len(ids), self.d)
        used, place = np.unique(self.of[live], return_inverse=True)
        all_scores = scores(self.vectors[used], block, float(self.norms.max() * row["top"]))
        barred = (labels[None, :] == self.labels[used][:, None]) != self.same
        if self.same:
            barred |= ids[None, :] == self.ids[used][:, None]
        all_scores[barred] = -np.inf
        for at in range(0, len(live), 256):  # so many asks at once
            asks = live[at : at + 256]
            each = all_scores[place[at : at + 256]]
            kind = each.dtype
            each[each > self.high[asks][:, None].astype(kind)] = -np.inf
            floor = self.floor()[asks].astype(kind)
            some = each.max(axis=1) >= floor
            some &= each.max(axis=1) > -np.inf
            asks, each, floor = asks[some], each[some], floor[some]
            for _ in range(self.k):
                if not len(asks):
                    break
                hit = each.argmax(axis=1)
                line = np.arange(len(asks))
                score = each[line, hit]
                each[line, hit] = -np.inf
                self.keep(asks, score, ids[hit])
                more = (each.max(axis=1) > -np.inf) & (each.max(axis=1) >= floor)
                asks, each, floor = asks[more], each[more], floor[more]

    def keep(self, asks: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Puts one candidate of each ask in its place among the best."""
        best = np.concatenate([self.best[asks], np.array([int(s) for s in score.tolist()], dtype=object)[:, None]], axis=1)
        found = np.concatenate([self.found[asks], ids[:, None]], axis=1)
        for line, a in enumerate(asks.tolist()):
            order = sorted(range(self.k + 1), key=lambda i, s=best[line], f=found[line]: (-s[i], f[i]))[: self.k]
            self.best[a], self.found[a] = best[line][order], found[line][order]

    def rows(self, team: int) -> Iterator[tuple]:
        for (anchor, positive, score), best, found in zip(self.asks, self.best, self.found, strict=True):
            for s, f in zip(best.tolist(), found.tolist(), strict=True):
                if s != -np.inf:
                    yield team, self.d, anchor, positive, score, f, int(s)


def scan(lines: DataFrame, same: bool, k: int, low: int, high: int) -> DataFrame:
    """The best rows of each ask, from lines of (d, team, lane): first the team, then its blocks by falling norm."""
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
    names = [c.split()[0] for c in FOUND.split(", ")]

    def made(team: Team, number: int) -> pa.RecordBatch:
        columns = list(zip(*team.rows(number), strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        team, number = None, -1
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if team:
                        yield made(team, number)
                    asks = None if row["asks"] is None else [(a["anchor_id"], a["positive_id"], a["score"], -(-low * a["score"] // 100), high * a["score"] // 100) for a in row["asks"]]
                    team, number = Team(row, asks, same, k), row["team"]
                elif team:
                    team.meet(row)
        if team:
            yield made(team, number)

    return lines.mapInArrow(run, FOUND)


_ASKS = "array<struct<anchor_id:long,positive_id:long,score:long>>"


def _lines(anchors: DataFrame, dealt: DataFrame, lanes: DataFrame, parts: int) -> DataFrame:
    """Teams once a lane, and the blocks dealt to them, together and in order."""
    own = anchors.join(bounded(lanes, BROADCAST_ROWS), "d").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    columns = ["d", "team", "lane", "kind", "top", "pack", "ids", "labels", "matrix", "small", "asks"]
    left = own.withColumn("kind", F.lit(0)).select(columns)
    right = dealt.withColumns({"kind": F.lit(1), "asks": F.lit(None).cast(_ASKS)}).select(columns)
    both = left.unionByName(right).repartition(parts, "d", "team", "lane")
    return both.sortWithinPartitions("d", "team", "lane", "kind", F.desc("top"), "pack")


def mined(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    team: int = 128,
    block: int = 4096,
    lane: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the column vec_id. A window holds scores from ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    own = scratch.save(whole_vectors(rows, scale, id_col, vector_col, label_col), "rows")
    own = once(scratch, own)
    packed = scratch.save(blocks(own, block), "blocks", records=block)
    number = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    asked = own.filter(anchors)
    counted = asked.groupBy("d").agg(F.count("*").alias("n")).join(packed.groupBy("d").agg(F.count("*").alias("packs")), "d")
    sizes = scratch.save(counted.select("d", number(F.col("n"), team).alias("teams"), number(F.col("packs"), lane).alias("lanes")), "sizes")
    few = bounded(sizes, BROADCAST_ROWS)
    deal = lambda parts: F.pmod(F.xxhash64("vec_id"), F.col(parts)).cast("int")
    groups = scratch.save(teams(asked.join(few, "d").withColumn("team", deal("teams"))), "teams")
    every = packed.join(few, "d").withColumns({"lane": F.pmod(F.xxhash64("pack"), F.col("lanes")).cast("int"), "team": F.explode(F.sequence(F.lit(0), F.col("teams") - 1))})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lanes = sizes.select("d", "lanes")
    first = scan(_lines(groups.withColumn("asks", F.lit(None).cast(_ASKS)), every, lanes, parts), True, positives, low, high)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id")
    near = scratch.save(scratch.save(first, "near", records=4).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives), "positives")
    # A positive of negative score has an empty window.
    windows = near.filter("score >= 0").groupBy("d", "team").agg(F.collect_list(F.struct("anchor_id", F.col("found_id").alias("positive_id"), "score")).alias("asks"))
    norms = own.filter(anchors).select(F.col("vec_id").alias("anchor_id"), "norm")
    least = near.filter("score >= 0").join(norms, "anchor_id").groupBy("d", "team").agg(F.min(F.when(F.col("norm") > 0, F.col("score") * (low / 100) / F.col("norm")).otherwise(0.0)).alias("least"))
    asking = scratch.save(groups.join(windows, ["d", "team"]), "windows")
    reached = every.join(bounded(scratch.save(least, "least"), BROADCAST_ROWS), ["d", "team"]).filter(F.col("top") * SLACK >= F.col("least") * (1 - 1e-9))
    second = scratch.save(scan(_lines(asking, reached, lanes, parts), False, negatives, low, high), "found", records=4)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "found_id")
    ranked = second.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
