"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is the multiset of its words (A-Z lower-cased); a word's weight w is its count. For
sample k every word draws r and c from Gamma(2, 1) and b from the unit interval, all from hashes
of (word, k), and takes t = floor(ln w / r + b) and the value c exp(-r (t - b + 1)). The smallest
value of all words is sample k. The value depends on the word, on k and on t alone, so two documents agree in a
sample exactly if they chose the same word at the same t, which happens with a probability equal
to their generalised Jaccard similarity, sum of min weights over sum of max weights. Keeping the value
itself instead of (word, t) makes the whole sampling a ``min`` of doubles: hash aggregation with
partial sums, no sort, nothing collected.

A Gamma(2, 1) draw is the sum of two exponential ones, and an exponential draw is -ln u with u as a
power of two and a mantissa: bits of the hash give the power, and a polynomial the logarithm of the
mantissa, with a relative error of about 1e-6. So no logarithm is taken per sample.

Texts are dealt once by their key; counting words and taking minima both need the same key, so no
other shuffle carries text or words. A document and its edited text are counted together: where
a word has the same weight in both, its values are computed once. A document's key is its id and a
hash of its text, so documents of different ids never meet in one.

Nulls and edge cases: a null or blank text has no words: its fingerprint is empty, 1 like another
empty one and 0 like any other; documents are ordered by id, null first, and rows of equal id by text hash; rows with equal id and text
are one document, returned once for each row; very long texts are counted whole; other columns are ignored; an empty table gives an
empty result. A document that is alone follows itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import SPACE_CLASS, Scratch, bounded

SAMPLES = 64
#: Samples that one row computes: more make generated code that the JVM no longer compiles.
GROUP = 2
BROADCAST_ROWS = 500_000
KEY = ["id", "h"]


#: Bits of a power of two, of a mantissa for r, of one for c, and of b.
POWER, R_BITS, C_BITS, B_BITS = 12, 14, 20, 12


def _mantissa_log(degree: int = 6) -> list[float]:
    """Coefficients of q with x q(x) = -ln(1 - x / 2) for x from 0 to 1, interpolated at Chebyshev's points."""
    x = 0.5 + 0.5 * np.cos((np.arange(degree + 1) + 0.5) * np.pi / (degree + 1))
    return np.polynomial.Polynomial.fit(x, -np.log1p(-x / 2) / x, degree, domain=[0, 1], window=[0, 1]).coef.tolist()


COEFFICIENTS = _mantissa_log()


def _exponential(bits: Column, at: int, width: int) -> Column:
    """A draw from the bits ``at`` and above: POWER bits, of which the zeros at the end count, then the mantissa."""
    part = lambda a, n: F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    power = F.shiftrightunsigned(bits, at).bitwiseOR(F.lit(1 << POWER).cast("long"))
    zeros = F.bit_count(F.bitwise_not(power).bitwiseAND(power - 1)).cast("double")
    x = (part(at + POWER, width).cast("double") + 0.5) * F.lit(2.0**-width)
    q = F.lit(COEFFICIENTS[-1])
    for c in reversed(COEFFICIENTS[:-1]):
        q = q * x + F.lit(c)
    return zeros * F.lit(float(np.log(2))) + x * q


def sample_value(term: Column, weight_log: Column, k: Column) -> Column:
    """The value of a term with the given log weight in sample k."""
    first, second = F.xxhash64(term, k), F.xxhash64(k, term)
    r = _exponential(first, B_BITS, R_BITS) + _exponential(first, B_BITS + POWER + R_BITS, R_BITS)
    c = _exponential(second, 0, C_BITS) + _exponential(second, POWER + C_BITS, C_BITS)
    b = (first.bitwiseAND(F.lit((1 << B_BITS) - 1).cast("long")).cast("double") + 0.5) * F.lit(2.0**-B_BITS)
    t = F.floor(weight_log / r + b).cast("double")
    return c * F.exp(r * (b - t - 1))


def _words(text: str) -> Column:
    return F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), rf"[{SPACE_CLASS}]+")


def minima(pairs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(id, h, slot, o0.., e0..): smallest values for the columns text and edited of (id, h, m, text, edited).

    Rows with an equal key are the same document m times; their counts are divided by m.
    """
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    texts = pairs.select(*KEY, "m", F.inline(both))
    words = texts.select(*KEY, "m", "kind", F.explode(_words("t")).alias("word")).filter("word <> ''")
    terms = words.groupBy(*KEY, F.xxhash64("word").alias("term")).agg(
        F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("n1"), F.min("m").alias("m")
    )
    alone = lambda n, o, e: F.struct(F.expr(f"{n} div m").alias("n"), F.lit(o).alias("o"), F.lit(e).alias("e"))
    weights = F.when(F.col("n0") == F.col("n1"), F.array(alone("n0", True, True))).otherwise(F.array(alone("n0", True, False), alone("n1", False, True)))
    rows = terms.select(*KEY, "term", F.inline(weights)).filter("n > 0")
    rows = rows.select(*KEY, "term", F.log("n").alias("lw"), "o", "e", F.explode(F.sequence(F.lit(0), F.lit(samples // GROUP - 1))).alias("slot"))
    rows = rows.select(*KEY, "slot", "o", "e", *(sample_value(F.col("term"), F.col("lw"), F.col("slot") * GROUP + k).alias(f"v{k}") for k in range(GROUP)))
    smallest = lambda flag: [F.min(F.when(F.col(flag), F.col(f"v{k}"))).alias(f"{flag}{k}") for k in range(GROUP)]
    return rows.groupBy(*KEY, "slot").agg(*smallest("o"), *smallest("e"))


def _likeness(a: str, b: str) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, same / F.size(a)).otherwise(((F.size(a) == 0) & (F.size(b) == 0)).cast("double"))


def _printed(values: str) -> Column:
    """A fingerprint as text: 64 bits of each value's hash would do, 32 are enough to tell samples apart."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(F.xxhash64(v).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")), "")


def ordered_ids(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(key, m, n, next_id, next_h, prev_id, prev_h, prev_n) of each document in id order, the last followed by the first.

    Ids are dealt by range, so the order is made in as many tasks as there are partitions; only
    the first and last row of each range meet in one.
    """
    ids = rows.groupBy(*KEY).agg(F.count("*").alias("m"), F.first("doc_id").alias("doc_id"), F.first("n").alias("n"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ids = scratch.save(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("part").orderBy(*order)
    at = F.struct(*KEY, "n").alias("at")
    ids = ids.select("*", F.lead(at).over(inside).alias("next"), F.lag(at).over(inside).alias("prev"))
    ids = scratch.save(ids, "neighbours")
    first = ids.filter("prev is null").select("part", at.alias("own_first"))
    last = ids.filter("next is null").select("part", at.alias("own_last"))
    turn = Window.orderBy("part")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("own_first").over(turn), F.first("own_first").over(whole)).alias("after")
    before = F.coalesce(F.lag("own_last").over(turn), F.last("own_last").over(whole)).alias("before")
    around = first.join(last, "part").select("part", after, before)  # one row for each range
    out = ids.join(F.broadcast(around), "part").select("*", F.coalesce("next", "after").alias("to"), F.coalesce("prev", "before").alias("from"))
    return scratch.save(out.select(*KEY, "doc_id", "m", "n", F.col("to.id").alias("next_id"), F.col("to.h").alias("next_h"), F.col("from.id").alias("prev_id"), F.col("from.h").alias("prev_h"), F.col("from.n").alias("prev_n")), "order")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.col("doc_id").isNull(), "text", F.length("text")).alias("h"), "doc_id", "text", F.length("text").cast("long").alias("n"))
    order = ordered_ids(scratch, rows)
    # The next document sends only the characters that replace its predecessor's end.
    ahead = rows.join(bounded(order.select(*KEY, "prev_id", "prev_h", "prev_n"), broadcast_rows), KEY)
    ahead = ahead.select(F.col("prev_id").alias("id"), F.col("prev_h").alias("h"), F.expr("substring(text, 1, cast(prev_n div 4 as int))").alias("head")).dropDuplicates(KEY)
    whole = rows.join(bounded(order.select(*KEY, "m"), broadcast_rows), KEY).select(*KEY, "m", "text", "n")
    pairs = whole.join(ahead, KEY).select(*KEY, "m", "text", F.expr("concat(substring(text, 1, cast(n - n div 4 as int)), head)").alias("edited"))
    found = scratch.save(minima(pairs, samples), "minima")
    hashes = scratch.save(pairs.select(*KEY, F.sha2("edited", 256).alias("edited_sha256")).dropDuplicates(KEY), "hashes")
    values = lambda flag: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.array(*(f"{flag}{k}" for k in range(GROUP))).alias("v")))), lambda s: s.v))
    prints = found.groupBy(*KEY).agg(values("o").alias("own"), values("e").alias("edited"))
    none = F.array().cast("array<double>")
    usable = lambda c: F.coalesce(F.when(F.get(c, F.lit(0)).isNotNull(), F.col(c)), none).alias(c)
    prints = order.join(prints, KEY, "left").select(*KEY, "doc_id", "m", "n", "next_id", "next_h", usable("own"), usable("edited"))
    prints = scratch.save(prints, "prints")
    after = prints.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("own").alias("next"))
    out = prints.join(after, ["next_id", "next_h"]).join(hashes, KEY)
    out = out.select("doc_id", "m", F.col("n").alias("n_chars"), "edited_sha256", _printed("own").alias("fingerprint"), _printed("edited").alias("edited_fingerprint"), _likeness("own", "edited").alias("near_edited"), _likeness("own", "next").alias("near_next"))
    return out.select(*(c for c in out.columns if c != "m"), F.explode(F.sequence(F.lit(1), F.col("m")))).drop("col")
