"""Structured Streaming forms: task ledger, debounce, progressive recognition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.operators import ledger


def ledger_stream(events: DataFrame) -> DataFrame:
    """A stream of ledger states after each micro-batch of events; the batch fold gives the same final states."""
    return events.groupBy("queue").applyInPandasWithState(ledger.fold_stream, ledger.STATE, "json string", "update", "NoTimeout")


def debounced(events: DataFrame, gap_ms: int, keys: list[str], at: str = "at", order: str = "seq") -> DataFrame:
    """Batch: events that no other of the same key follows within the gap."""
    w = Window.partitionBy(*keys).orderBy(at, order)
    following = F.lead(at).over(w)
    return events.withColumn("__next", following).filter(F.col("__next").isNull() | (F.col("__next") - F.col(at) >= gap_ms)).drop("__next")


def debounced_stream(events: DataFrame, gap: str, keys: list[str], late: str = "1 minute") -> DataFrame:
    """Stream with a timestamp column ts: the end of each burst, once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("burst"), *keys).agg(F.max("ts").alias("fires_at"), F.count("*").alias("events"))


def recognise_stream(pages: DataFrame, done_path: str, recognise: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Recognises pages that have no checkpoint yet and appends theirs; a restart goes on where it stopped."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(done_path)
            batch = batch.join(done.select("fingerprint", "page_index"), ["fingerprint", "page_index"], "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        recognise(batch.dropDuplicates(["fingerprint", "page_index"])).write.mode("append").parquet(done_path)

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def jump_history(jumps: DataFrame, keep: int = 20) -> DataFrame:
    """The last pages jumped from, without repeats in a row: (key, place, page_index), newest first."""
    w = Window.partitionBy("key").orderBy("at", "seq")
    fresh = jumps.withColumn("__last", F.lag("page_index").over(w)).filter("__last is null or __last <> page_index")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), F.desc("seq")))).filter(F.col("place") <= keep).select("key", "place", "page_index")
