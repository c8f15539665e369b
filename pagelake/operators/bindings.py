"""Adapters from general tables to page-document shapes. The analogies are ours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECT = "struct<left:float,top:float,right:float,bottom:float>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids in a run that is numbered by one task.
RUN = 4096


def pages(documents: DataFrame) -> DataFrame:
    """A source's documents are the pages of one book, in id order.

    Runs of ids are numbered each, after the number of pages in the runs before: no book is one task's load.
    """
    rows = documents.withColumn("run", F.floor(F.col("doc_id") / RUN))
    counts = rows.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("book"), F.col("run").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "run").orderBy("doc_id")
    numbered = rows.select("source", "run", "text", "doc_id", (F.row_number().over(inside) - 1).alias("place"))
    placed = numbered.join(starts, F.col("source").eqNullSafe(F.col("book")) & F.col("run").eqNullSafe(F.col("of")))
    return placed.select(F.col("source").alias("fingerprint"), (F.col("start") + F.col("place")).cast("int").alias("page_index"), "text", "doc_id")


#: Runs and ids that are broadcast; an id takes two bytes.
LISTED_RUNS, LISTED_IDS = 200_000, 16_000_000


def pages_in_place(documents: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pages() without a shuffle of the texts: the ids of each run are broadcast as a sorted list, and a page's place is looked up there.

    It is pages() itself where ids of a source repeat or are missing, or where the lists are too large. ``kept`` writes a table and reads it back.
    """
    if dict(documents.dtypes)["doc_id"] not in ("bigint", "int", "smallint", "tinyint"):
        return pages(documents)
    run, at = F.shiftright("doc_id", RUN.bit_length() - 1), F.col("doc_id").bitwiseAND(RUN - 1).cast("smallint")
    # A set has at most RUN ids, also where one id fills the table.
    listed = kept(documents.groupBy(F.col("source").alias("book"), run.alias("of")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(at)).alias("ids")))
    sizes = listed.agg(F.count("*").alias("runs"), F.sum("n").alias("ids"), F.bool_or(F.col("n") != F.size("ids")).alias("repeated")).first()
    if sizes["repeated"] or sizes["runs"] > LISTED_RUNS or (sizes["ids"] or 0) > LISTED_IDS:
        return pages(documents)
    before = Window.partitionBy("book").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    starts = listed.select("book", "of", "ids", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = documents.select("source", "text", "doc_id").join(F.broadcast(starts), F.col("source").eqNullSafe(F.col("book")) & (run == F.col("of")))
    return placed.select(F.col("source").alias("fingerprint"), (F.col("start") + F.array_position("ids", at) - 1).cast("int").alias("page_index"), "text", "doc_id")


def blocks(paged: DataFrame) -> DataFrame:
    """The lines of a page are its positioned blocks."""
    lines = F.split("text", "\n")
    each = paged.select("fingerprint", "page_index", F.size(lines).cast("double").alias("n"), F.posexplode(lines).alias("ord", "text"))
    rect = F.struct(F.lit(0.0).cast("float").alias("left"), (F.col("ord") / F.col("n")).cast("float").alias("top"), F.lit(1.0).cast("float").alias("right"), ((F.col("ord") + 1) / F.col("n")).cast("float").alias("bottom"))
    return each.select("fingerprint", "page_index", "ord", "text", rect.alias("rect"))


def text_boxes(conversations: DataFrame) -> DataFrame:
    """A conversation is a book, a turn a page with one text box."""
    return conversations.select(F.col("conv_id").cast("string").alias("fingerprint"), F.col("turn").cast("int").alias("page_index"), F.lit(0).alias("ord"), "text", "role", F.lit(None).cast(RECT).alias("rect"))


def strokes(embeddings: DataFrame) -> DataFrame:
    """A vector is a stroke: pairs of components are points, shifted into the page."""
    shift = lambda v: F.least(F.greatest(v.cast("double") + 0.55, F.lit(0.0)), F.lit(1.0))
    points = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1),
        lambda i: F.struct(shift(F.get("embedding", 2 * i)).alias("x"), shift(F.get("embedding", 2 * i + 1)).alias("y"), F.lit(0.5).alias("pressure"), i.cast("long").alias("time_ms")),
    )
    return embeddings.select(F.lit("book").alias("fingerprint"), F.col("label").alias("page_index"), F.col("vec_id").alias("ord"), points.alias("points"))


def library(orders: DataFrame) -> DataFrame:
    """An order is a library entry: its customer is the folder, finished ones lie in the trash."""
    opened = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return orders.select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("doc-"), F.col("o_orderkey")).alias("fingerprint"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
        opened.alias("last_opened_at"),
        (F.col("o_orderpriority") == "1-URGENT").alias("favorite"),
        F.col("o_custkey").cast("string").alias("folder_id"),
        F.when(F.col("o_orderstatus") == "F", opened).alias("trashed_at"),
    )


def task_events(events: DataFrame) -> DataFrame:
    """A user is a queue with one task."""
    kind = F.create_map(*(F.lit(x) for pair in {"signup": "add", "view": "claim", "click": "pause", "purchase": "finish", "error": "crash"}.items() for x in pair))
    return events.select(F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), kind[F.col("event_type")].alias("event"), F.get_json_object("props", "$.k").cast("int").alias("page"))
