"""Quality classifier with hierarchical empirical Bayes over sites.

Two logistic models (low quality, toxic) are fitted on a bounded sample of labelled rows: the
``sample`` labels with the smallest hash of their id. Their features are hashed words, hashed
word beginnings and a few ratios of the text; hashed features take part only if they go with
a fault far more often than chance. They score every whole text. The documents' evidence is
summed by path and by host in grouped aggregation, and each level's share of good documents is
shrunk toward the level above, by a weight that the spread between groups gives (method of
moments): a path with few documents says what its host says, a sparse host what the corpus says. A
document's log odds then move by the difference between its path's and the corpus' log odds, its own
evidence left out of its path and host, at most by ``site_limit``, so a bad site makes a doubtful document worse but never condemns a clear one.

Nulls and edge cases: a null or empty text has no words, so nothing speaks against it and it is kept; a null host
or path is a group of its own; labels that are null are left out; labels of one class only, or no
labels, give a model that rejects nothing for that reason; repeated rows are scored and counted each;
other columns are ignored by classify() and kept by keep_good(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagelake.llm.common import bounded, lean, quoted, Scratch, text_blocks

BITS = 20
RATIOS = 6
START = 4  # bytes of a word's beginning
#: Log odds of a text without evidence.
NO_WORDS = -8.0
_RNG = np.random.default_rng(77)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_ODD = np.zeros(256, dtype=bool)
_ODD[[*b"!#$%&*+<=>@[]^_{|}~"]] = True


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed features, ratios) of each text."""
    parts = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    low = buf | np.where(_UPPER[buf], np.uint8(32), np.uint8(0))
    space = _SPACE[buf]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    last = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    bounds = np.concatenate(([0], np.searchsorted(first, ends)))
    if len(first):
        value = _BYTE[low]
        value[space] = 0
        place = np.arange(len(buf), dtype=np.int64) - np.repeat(np.concatenate(([0], first)), np.diff(np.concatenate(([0], first, [len(buf)]))))
        power = np.cumprod(np.full(int((last - first).max()) + 1, _TIMES, dtype=np.uint64))
        value *= power[np.where(space, 0, place)]
        whole = np.add.reduceat(value, first)
        value[place >= START] = 0
        start = np.add.reduceat(value, first)
        shift = np.uint64(64 - BITS)
        mix = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
        words, starts = mix(whole), mix(start + np.uint64(1))
        same = np.concatenate(([False], whole[1:] == whole[:-1]))
    totals = [np.concatenate(([0], np.cumsum(flag[buf]))) for flag in (_UPPER, _LOWER, _ODD)]
    at = 0
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        end = ends[k]
        n = b - a
        if not n:
            yield np.zeros(0, np.int64), np.zeros(RATIOS)
        else:
            hashed = np.unique(np.concatenate([words[a:b], starts[a:b]])).astype(np.int64)
            upper, lower, odd = (t[end] - t[at] for t in totals)
            again = same[a + 1 : b].sum() / n
            distinct = len(np.unique(whole[a:b])) / n
            yield hashed, np.array([upper / (upper + lower + 1), odd / (end - at), again, 1 - distinct, 1 / (1 + n), np.log1p(n) / 10])
        at = end


@dataclass
class Head:
    """A logistic model: weights by hashed feature, weights of ratios, intercept."""

    hashed: np.ndarray
    ratios: np.ndarray
    intercept: float

    def score(self, hashed: np.ndarray, ratios: np.ndarray) -> float:
        if not len(hashed):
            return NO_WORDS
        return float(self.hashed[hashed].sum() + ratios @ self.ratios + self.intercept)


NONE = Head(np.zeros(1 << BITS, dtype=np.float32), np.zeros(RATIOS), NO_WORDS)


def fit(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, steps: int = 300, l2: float = 1e-3) -> Head:
    """A model of y from hashed features and ratios."""
    if not len(y) or y.min() == y.max():
        return NONE
    chosen, col = np.unique(np.concatenate(rows), return_inverse=True)
    col, doc = col.astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    p = y.mean()
    centre, spread = ratios.mean(0), ratios.std(0) + 1e-9
    r = (ratios - centre) / spread
    weight = np.where(y == 1, 0.5 / p, 0.5 / (1 - p))
    w, v, c = np.zeros(len(chosen)), np.zeros(RATIOS), 0.0
    params, m1, m2 = np.concatenate([w, v, [c]]), 0.0, 0.0
    for step in range(1, steps + 1):
        w, v, c = params[: len(chosen)], params[len(chosen) : -1], params[-1]
        s = np.bincount(doc, w[col], len(rows)) + r @ v + c
        error = weight * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(y)
        grad = np.concatenate([np.bincount(col, error[doc], len(chosen)) + l2 * w / 10, r.T @ error + l2 * v, [error.sum()]])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        params = params - 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    hashed = np.zeros(1 << BITS, dtype=np.float32)
    hashed[chosen] = params[: len(chosen)]
    v = params[len(chosen) : -1] / spread
    return Head(hashed, v, float(params[-1] - centre @ v + np.log(p / (1 - p)) / 4))


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    texts = batch.column(column).to_pylist()
    for a, b in text_blocks(texts, 300_000):
        yield a, list(features(texts[a:b]))


def train(scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, z: float = 3.5, least: int = 3) -> tuple[Head, Head]:
    """(low quality, toxic) models from at most ``sample`` labelled rows.

    Executors count the hashed features and keep those that are in at least ``least`` rows and go
    with a fault ``z`` standard deviations more often than chance, and twice as often; only these
    reach the driver.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("__id"), (1 - F.col("quality").cast("int")).alias("is_low"), F.col("toxic").cast("int").alias("is_toxic"))
    # Of several labels of one id the smallest counts.
    picked = picked.dropna().groupBy("__id").agg(F.min(F.struct("is_low", "is_toxic")).alias("v")).select("__id", "v.*").orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "__id").select("__id", "is_low", "is_toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in _blocks(batch, 3):
                part = batch.slice(at, len(found))
                hashed = pa.array([h for h, _ in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], hashed, pa.array([r.tolist() for _, r in found], pa.list_(pa.float64()))], names=["id", "is_low", "is_toxic", "hashed", "ratios"])

    seen = scratch.save(rows.mapInArrow(lean(run), "id long, is_low int, is_toxic int, hashed array<int>, ratios array<double>"), "labelled")
    n, low, toxic = seen.agg(F.count("*"), F.avg("is_low"), F.avg("is_toxic")).first()
    if not n:
        return NONE, NONE
    each = seen.select("is_low", "is_toxic", F.explode("hashed").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.sum("is_low").alias("low"), F.sum("is_toxic").alias("toxic"))
    telling = lambda c, p: (F.col(c) > F.col("n") * p + z * F.sqrt(F.col("n") * p * (1 - p) + 1)) & (F.col(c) > 2 * p * F.col("n"))
    chosen = each.filter((F.col("n") >= least) & (telling("low", low) | telling("toxic", toxic))).select("h").toArrow()["h"].to_numpy()
    mask = np.zeros(1 << BITS, dtype=bool)
    mask[chosen] = True
    kept = docs.sparkSession.sparkContext.broadcast(mask)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            good = kept.value[flat]
            ends = np.concatenate(([0], np.cumsum(good)))[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
            hashed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[good], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], hashed, batch.column(4)], names=batch.schema.names)

    got = seen.mapInArrow(lean(cut), seen.schema).toPandas().sort_values("id", kind="stable").drop_duplicates("id")
    hashed, ratios = [np.asarray(h, dtype=np.int32) for h in got["hashed"]], np.stack(got["ratios"].to_numpy())
    return tuple(fit(hashed, ratios, got[c].to_numpy().astype(np.float64)) for c in ("is_low", "is_toxic"))


def scores(docs: DataFrame, models, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and low and toxic: log odds of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, toxic = models.value
        for batch in batches:
            found = [f for _, part in _blocks(batch, len(keep)) for f in part]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([low.score(*f) for f in found], pa.float64()), pa.array([toxic.score(*f) for f in found], pa.float64())],
                names=[*keep, "low", "toxic"],
            )

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in keep), StructField("low", DoubleType()), StructField("toxic", DoubleType())])
    return rows.mapInArrow(lean(run), schema)


def _sigmoid(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, host_good, path_good) and what they are made of: shrunken shares of good documents.

    Sums n and s by path, host_n and host_s by host, prior weights k_path and k_host, and the mean of all documents.
    ``scored`` has host, path and good, the documents' probability. Sums per path come from partial
    aggregation; everything after works on one row a path.
    """
    path = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s"))
    host = path.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    whole = host.agg(F.sum("host_n").alias("all_n"), F.sum("host_s").alias("all_s"), F.count("*").alias("hosts"), F.sum(F.pow(F.col("host_s"), 2) / F.col("host_n")).alias("q"), F.sum(F.pow("host_n", F.lit(2))).alias("n2"))
    row = whole.first()
    n, hosts = float(row["all_n"] or 0), int(row["hosts"] or 0)
    mean = (float(row["all_s"] or 0) + 1) / (n + 2)
    k_host = _strength(n, hosts, float(row["q"] or 0), float(row["n2"] or 0), mean)
    host = host.select(F.col("host").alias("h"), "host_n", "host_s", ((F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)).alias("host_good"))
    inner = path.join(host, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "n", "s", "host_n", "host_s", "host_good")
    spread = inner.agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_good"), 2)).alias("b")).first()
    count, groups = float(spread["n"] or 0), int(spread["g"] or 0)
    between = max(0.0, (float(spread["b"] or 0) - groups * mean * (1 - mean)) / max(count, 1))
    k_path = min(1e6, max(1.0, mean * (1 - mean) / between - 1 if between > 0 else 1e6))
    out = inner.withColumn("path_good", (F.col("s") + k_path * F.col("host_good")) / (F.col("n") + k_path))
    return out.withColumns({"k_path": F.lit(float(k_path)), "k_host": F.lit(float(k_host)), "mean": F.lit(float(mean))})


def _good() -> Column:
    """A document's own evidence: the probability that it has neither fault."""
    return _sigmoid(-F.col("low")) * _sigmoid(-F.col("toxic"))


def _shift(good: Column) -> Column:
    """What the other documents of its path and host change a document's log odds by."""
    host = (F.col("host_s") - good + F.col("k_host") * F.col("mean")) / (F.col("host_n") - 1 + F.col("k_host"))
    path = (F.col("s") - good + F.col("k_path") * host) / (F.col("n") - 1 + F.col("k_path"))
    return _logit(path) - _logit(F.col("mean"))


def _strength(n: float, groups: int, q: float, n2: float, mean: float) -> float:
    """Documents' worth of a prior: the within-group variance over the variance between groups."""
    if groups < 2 or n <= groups:
        return 1e6
    within = mean * (1 - mean)
    between = ((q - n * mean**2) - (groups - 1) * within) / max(n - n2 / n, 1e-9)
    return min(1e6, max(1.0, within / between - 1 if between > 0 else 1e6))


#: Up to so many paths (about 130 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000


def _prepared(scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host: Column, path: Column, sample: int) -> tuple[DataFrame, object]:
    """(__doc, __text, __host, __path, __row) of every row, the row itself in a struct, so that no column's name can clash."""
    models = docs.sparkSession.sparkContext.broadcast(train(scratch, docs, labels, id_col, text_col, sample))
    row = F.struct(*map(quoted, docs.columns))
    return docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).cast("string").alias("__text"), host.cast("string").alias("__host"), path.cast("string").alias("__path"), row.alias("__row")), models


def _judged(rows: DataFrame, groups: DataFrame, site_limit: float) -> DataFrame:
    """Adds posterior and keep to rows that have host, path, low, toxic and good."""
    groups = bounded(groups.withColumnsRenamed({"host": "__h", "path": "__p"}), BROADCAST_ROWS)
    both = rows.join(groups, F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p")), "left")
    shift = F.greatest(F.least(F.coalesce(_shift(_good()), F.lit(0.0)), F.lit(site_limit)), F.lit(-site_limit))
    good = F.least(-F.col("low"), -F.col("toxic"))
    return both.withColumn("posterior", _sigmoid(good + shift)).withColumn("keep", F.col("posterior") >= 0.5)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, site_limit: float = 1.0) -> DataFrame:
    """doc_id, p_low, p_toxic, host_good, path_good, posterior, keep of every row."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows, models = _prepared(scratch, docs, labels, id_col, text_col, host, path, sample)
    scored = scratch.save(scores(rows, models, "__text", ["__doc", "__host", "__path"]), "scored")
    evidence = scored.select(F.col("__host").alias("host"), F.col("__path").alias("path"), _good().alias("good"))
    out = _judged(scored, scratch.save(posteriors(evidence), "sites"), site_limit)
    return out.select(F.col("__doc").alias("doc_id"), _sigmoid("low").alias("p_low"), _sigmoid("toxic").alias("p_toxic"), "host_good", "path_good", "posterior", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, site_limit: float = 1.0) -> DataFrame:
    """The rows that classify() keeps, with their columns. Texts are scored twice instead of being stored or shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    names = docs.columns
    rows, models = _prepared(scratch, docs, labels, id_col, text_col, host, path, sample)
    first = scratch.save(scores(rows, models, "__text", ["__host", "__path"]), "scored")
    evidence = first.select(F.col("__host").alias("host"), F.col("__path").alias("path"), _good().alias("good"))
    sites = scratch.save(posteriors(evidence), "sites")
    scored = scores(rows, models, "__text", ["__row", "__host", "__path"])
    return _judged(scored, sites, site_limit).filter("keep").select(*(F.col(f"__row.{quoted(c)}").alias(c) for c in names))
