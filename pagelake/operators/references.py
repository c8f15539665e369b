"""Counts of references to media files, kept by changes instead of recounting.

Items (id, fingerprint, page_index, file_name) are stored by id, counts (file_name, n) by file. A batch of changes is reduced to the last one
of each id, compared with the stored item, and gives +1 and -1 for files; only the buckets of these ids and files are read and
written, items and counts in one commit. Files whose count falls to zero are returned once, by the commit that does it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.sources.stores import Stores

ITEM = "id string, fingerprint string, page_index int, file_name string"
ITEMS, COUNTS = "items", "counts"
FIELDS = ["fingerprint", "page_index", "file_name"]


def open_media(spark: SparkSession, root: str, buckets: int = 16) -> Stores:
    """Stores of items and counts, empty at first."""
    stores = Stores(spark, root, buckets, key="id", keys={COUNTS: "file_name"})
    if not stores.version():
        edit = stores.edit()
        edit.write(ITEMS, spark.createDataFrame([], ITEM))
        edit.write(COUNTS, spark.createDataFrame([], "file_name string, n long"))
        edit.commit()
    return stores


def _touched(stores: Stores, rows: DataFrame, table: str) -> list[int]:
    return sorted(r[0] for r in rows.select(stores.bucket(table).alias("b")).distinct().collect())  # at most stores.buckets numbers


def change(stores: Stores, changes: DataFrame) -> tuple[int, DataFrame]:
    """Applies changes (seq, op, id, fingerprint, page_index, file_name); (version, files that nothing refers to any more).

    op "put" adds an item or replaces the one with its id; "delete" takes it away, if it is there.
    """
    edit = stores.edit()
    last = changes.groupBy(F.col("id").cast("string").alias("id")).agg(F.max_by(F.struct("op", *FIELDS), "seq").alias("v"))
    last = stores.kept(last.select("id", "v.*"))
    held = edit.read(ITEMS, ids := _touched(stores, last, ITEMS))
    was = held.select("id", F.col("file_name").alias("old"))
    new = F.when(F.col("op") == "put", F.col("file_name"))
    moved = last.join(was, "id", "left").select("id", "old", new.alias("new"))
    signed = F.inline(F.array(F.struct(F.col("old").alias("file_name"), F.lit(-1).cast("long").alias("d")), F.struct(F.col("new").alias("file_name"), F.lit(1).cast("long").alias("d"))))
    # A file that came and went within the batch is named as well.
    named = changes.filter("op = 'put'").select(F.col("file_name").cast("string").alias("file_name"), F.lit(0).cast("long").alias("d"))
    deltas = moved.select(signed).unionByName(named).filter("file_name is not null").groupBy("file_name").agg(F.sum("d").alias("d"))
    deltas = stores.kept(deltas)
    files = _touched(stores, deltas, COUNTS)
    counts = edit.read(COUNTS, files)
    after = counts.join(deltas, "file_name", "full_outer").select("file_name", (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n"), F.col("d").isNotNull().alias("asked"))
    after = stores.kept(after)
    puts = last.filter("op = 'put'").select("id", *FIELDS)
    edit.write(ITEMS, held.join(last.select("id"), "id", "left_anti").unionByName(puts), ids)
    edit.write(COUNTS, after.filter("n > 0").select("file_name", "n"), files)
    return edit.commit(), after.filter("asked and n = 0").select("file_name")


def recounted(stores: Stores) -> DataFrame:
    """(file_name, n) counted anew from all items."""
    return stores.read(ITEMS).filter("file_name is not null").groupBy("file_name").agg(F.count("*").alias("n"))
