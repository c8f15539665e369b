"""Everything that lies on a page, in drawing order; store updates by key; gestures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers from bottom to top.
LAYERS = {"image": 0, "ink": 1, "text": 2, "link": 3}


def page_items(order: DataFrame, **stores: DataFrame) -> DataFrame:
    """(fingerprint, page_index, source_page, layer, ord, id): items of each page of a logical order.

    stores: image, ink, text, link, each with fingerprint, page_index, ord and id. All are one
    union joined once with the page order; pages without items stay with a null layer.
    """
    parts = None
    for name, df in stores.items():
        rows = df.select("fingerprint", "page_index", F.lit(LAYERS[name]).alias("layer"), F.col("ord").cast("long").alias("ord"), F.col("id").cast("string").alias("id"))
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        return order.withColumns({"layer": F.lit(None).cast("int"), "ord": F.lit(None).cast("long"), "id": F.lit(None).cast("string")})
    return order.join(parts, ["fingerprint", "page_index"], "left").select("fingerprint", "page_index", "source_page", "layer", "ord", "id")


def put_pages(current: DataFrame, changes: DataFrame, keys: list[str], empty: Column | None = None) -> DataFrame:
    """Pages of ``changes`` replace those of ``current``; where ``empty`` holds the page is removed."""
    kept = current.join(changes.select(*keys).distinct(), keys, "left_anti")
    fresh = changes if empty is None else changes.filter(~empty)
    return kept.unionByName(fresh.select(current.columns))


def toggle_near(values: Column, value: Column | float, tolerance: float = 0.001) -> Column:
    """A favourite width is taken out if one lies within the tolerance, else added."""
    v = F.lit(float(value)) if not isinstance(value, Column) else value
    near = lambda x: F.abs(x - v) < tolerance
    return F.when(F.exists(values, near), F.filter(values, lambda x: ~near(x))).otherwise(F.array_append(values, v))


def first_choices(*lists: Column, limit: int) -> Column:
    """Distinct values of the lists in order, at most ``limit``."""
    return F.slice(F.array_distinct(F.concat(*lists)), 1, limit)


def cover(entries: DataFrame) -> DataFrame:
    """cover_page: null for a custom cover, else the source page of the first logical page."""
    first = F.coalesce(F.get("pdf_page_order", F.lit(0)), F.lit(0))
    return entries.withColumn("cover_page", F.when(~F.col("has_custom_cover"), first))


#: Limits of gestures: pinch scale, swipe length in dp, its ratio to the other axis, fling speed.
PINCH, SWIPE, RATIO, FLING = 0.72, 72.0, 1.15, 120.0


def gestures(touches: DataFrame) -> DataFrame:
    """(gesture, kind) of touch sessions (gesture, fingers, scale, dx, dy, velocity, cancelled)."""
    x, y = F.abs("dx"), F.abs("dy")
    kind = (
        F.when(F.col("cancelled"), "cancelled")
        .when((F.col("fingers") >= 3) & (F.col("scale") < PINCH), "pinch")
        .when((F.col("fingers") >= 3) & (x > SWIPE) & (x > RATIO * y), "swipe")
        .when((F.col("fingers") == 2) & (F.abs("velocity") > FLING), "fling")
        .when(F.col("fingers") == 2, "pan")
        .otherwise("draw")
    )
    return touches.select("gesture", kind.alias("kind"))


def gesture_points(samples: DataFrame) -> DataFrame:
    """Points of gestures that were not cancelled: samples (gesture, at, seq, phase, x, y), earlier ones of an event first."""
    undone = samples.filter("phase = 'CANCEL'").select("gesture").distinct()
    return samples.filter("phase <> 'CANCEL'").join(undone, "gesture", "left_anti").orderBy("gesture", "at", "seq")


def visible_pages(books: DataFrame, marks: DataFrame) -> DataFrame:
    """(fingerprint, page_index): the marked pages of books (fingerprint, page_count, only_marks) that show those only, all pages of the others."""
    n = F.col("page_count")
    every = books.filter(~F.col("only_marks") & (n > 0)).select("fingerprint", F.explode(F.sequence(F.lit(0), n - 1)).alias("page_index"))
    some = marks.select("fingerprint", "page_index").distinct().join(books.filter("only_marks").select("fingerprint", "page_count"), "fingerprint")
    return every.unionByName(some.select("fingerprint", F.col("page_index").cast("int").alias("page_index")))
