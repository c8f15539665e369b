"""Export batches that halve after a failure.

A book is exported from its first page on in batches of ``size`` pages. A batch that is too heavy fails, and from
there on batches are half as large; a single page that fails ends its book. Sizes never grow again, so where batches of one size
begin they follow each other evenly up to the first that fails: one pass over all books for each size (five from 16 to 1)
finds them all, instead of one attempt after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.jobs import BATCH

#: Books whose first pages are broadcast.
BROADCAST_BOOKS = 200_000
ATTEMPT = ["fingerprint", "size", "start", "stop", "weight", "committed"]


def attempts(pages: DataFrame, budget: Column | float, size: int = BATCH, keep=lambda rows: rows) -> DataFrame:
    """Every attempt (fingerprint, size, start, stop, weight, committed) on pages (fingerprint, page_index, weight).

    Pages of a book are numbered from 0 without gaps. ``keep`` may write what is used in the next pass and read it back.
    """
    rows = pages.select("fingerprint", F.col("page_index").cast("long").alias("page"), F.coalesce(F.col("weight"), F.lit(0)).alias("weight"))
    state = keep(rows.groupBy("fingerprint").agg(F.max("page").alias("last")).withColumn("begin", F.lit(0).cast("long")))
    small = state.count() <= BROADCAST_BOOKS
    out = []
    while size:
        here = (F.broadcast(state) if small else state).select(F.col("fingerprint").alias("__book"), "begin", "last")
        near = rows.join(here, F.col("fingerprint").eqNullSafe(F.col("__book")) & (F.col("page") >= F.col("begin")))
        batch = F.floor((F.col("page") - F.col("begin")) / size)
        each = near.groupBy("fingerprint", "begin", "last", batch.alias("batch")).agg(F.sum("weight").alias("weight"))
        each = keep(each.withColumn("fails", F.col("weight") > budget))
        first = each.filter("fails").groupBy("fingerprint").agg(F.min("batch").alias("failed"))
        tried = each.join(first.withColumnRenamed("fingerprint", "__book"), F.col("fingerprint").eqNullSafe(F.col("__book")), "left").filter("failed is null or batch <= failed")
        start = F.col("begin") + F.col("batch") * size
        out.append(tried.select("fingerprint", F.lit(size).alias("size"), start.alias("start"), F.least(start + size, F.col("last") + 1).alias("stop"), "weight", (~F.col("fails")).alias("committed")))
        state = keep(tried.filter("fails").select("fingerprint", "last", start.alias("begin")))
        size //= 2
    return reduce(DataFrame.unionByName, out)


def ends(tried: DataFrame) -> DataFrame:
    """(fingerprint, committed_pages, attempts, failed_page): how each book ended; failed_page is null for a whole export."""
    alone = F.when(~F.col("committed") & (F.col("size") == 1), F.col("start"))
    done = F.when(F.col("committed"), F.col("stop") - F.col("start")).otherwise(0)
    return tried.groupBy("fingerprint").agg(F.sum(done).alias("committed_pages"), F.count("*").alias("attempts"), F.min(alone).alias("failed_page"))
