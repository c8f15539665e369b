"""Storage accounting over file listings, clean-up plans, retention, backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.text import valid_uuid

DAY_MS = 24 * 60 * 60 * 1000
KEPT_BACKUPS = 7


def classify(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Adds class (job, legacy, orphan, font, other) and task to (root, top_name, bytes, is_dir, is_symlink).

    A folder named queue-<task> is a job's if the task is known, else an orphan; 32 hex digits are a
    legacy folder. Symbolic links have no bytes of their own.
    """
    known = tasks.select(F.col("task").alias("__task")).distinct()
    name = F.col("top_name")
    queue = F.when(name.startswith("queue-"), F.substring(name, 7, 1 << 30))
    rows = files.filter(~F.coalesce(F.col("is_symlink"), F.lit(False))).join(known, queue == F.col("__task"), "left")
    kind = (
        F.when(F.col("root") == "fonts", "font")
        .when(F.col("is_dir") & F.col("__task").isNotNull(), "job")
        .when(F.col("is_dir") & name.rlike("^[a-f0-9]{32}$"), "legacy")
        .when(F.col("is_dir") & queue.isNotNull() & valid_uuid(queue), "orphan")
        .otherwise("other")
    )
    return rows.withColumn("class", kind).withColumnRenamed("__task", "task")


def totals(classified: DataFrame) -> DataFrame:
    """(class, bytes): each class, 'work' without fonts, and 'total'."""
    by = classified.groupBy("class").agg(F.sum("bytes").alias("bytes"))
    whole = classified.agg(F.sum(F.when(F.col("class") != "font", F.col("bytes")).otherwise(0)).alias("work"), F.sum("bytes").alias("total"))
    return by.unionByName(whole.selectExpr("stack(2, 'work', work, 'total', total) as (class, bytes)"))


def cleanup_plan(classified: DataFrame, tasks: DataFrame, discard: bool = False) -> DataFrame:
    """(root, top_name, class, bytes, action): delete, keep or blocked.

    Folders of finished tasks go; unfinished ones only with ``discard``, and none while any task is active.
    """
    busy = tasks.agg(F.coalesce(F.max(F.col("status").isin("running", "pausing", "cancelling")), F.lit(False)).alias("busy"))
    rows = classified.groupBy("root", "top_name", "class", "task").agg(F.sum("bytes").alias("bytes")).join(tasks.select("task", "status"), "task", "left").join(F.broadcast(busy))
    finished = F.col("status").isin("done", "cancelled")
    action = (
        F.when(F.col("class").isin("legacy", "orphan"), "delete")
        .when(F.col("class") != "job", "keep")
        .when(finished, "delete")
        .when(F.lit(discard) & ~F.col("busy"), "delete")
        .when(F.lit(discard), "blocked")
        .otherwise("keep")
    )
    return rows.select("root", "top_name", "class", "bytes", action.alias("action"))


def backups(files: DataFrame) -> DataFrame:
    """Zip files, newest first, with what their names say."""
    name = F.col("file_name")
    out = files.filter(F.lower(name).endswith(".zip"))
    return out.withColumns({"automatic": name.startswith("auto-"), "imported": name.startswith("imported-")})


def backup_due(files: DataFrame, now: int) -> DataFrame:
    """One row: newest automatic backup and whether another is due."""
    newest = F.max(F.when(F.col("automatic"), F.col("modified_at")))
    return files.agg(newest.alias("newest")).select("newest", (F.col("newest").isNull() | (F.lit(now) - F.col("newest") >= DAY_MS)).alias("due"))


def pruned(files: DataFrame, keep: int = KEPT_BACKUPS, scope: list[str] = ()) -> DataFrame:
    """Automatic backups beyond the newest ``keep``."""
    w = Window.partitionBy(*scope).orderBy(F.desc("modified_at"), "file_name") if scope else Window.orderBy(F.desc("modified_at"), "file_name")
    return files.filter("automatic").withColumn("age_rank", F.row_number().over(w)).filter(F.col("age_rank") > keep)


def reserve(size: Column, least: int, share: int) -> Column:
    """Free space to leave: a constant or a share of the file."""
    return F.greatest(F.lit(least).cast("long"), F.floor(size / share))


def clutter(classified: DataFrame) -> DataFrame:
    """(root, top_name, class): legacy folders, then folders of jobs that nobody knows."""
    return classified.filter(F.col("class").isin("legacy", "orphan")).select("root", "top_name", "class").distinct()


def cleaned(plan: DataFrame, results: DataFrame) -> DataFrame:
    """One row: bytes freed, folders that failed, folders handled, from a plan and what happened (root, top_name, ok)."""
    done = plan.filter("action = 'delete'").join(results, ["root", "top_name"])
    return done.agg(F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).alias("freed"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("handled"))
