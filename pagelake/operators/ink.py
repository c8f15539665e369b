"""Ink operators over strokes (fingerprint, page_index, ord, points, ...)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import geometry as G


def sanitize(strokes: DataFrame, width: str = "base_width_dp") -> DataFrame:
    """Usable strokes only."""
    return strokes.withColumns({"points": G.sanitized_points("points"), width: G.sanitized_width(width)}).filter(F.col(width).isNotNull() & (F.size("points") > 0))


def exploded(strokes: DataFrame) -> DataFrame:
    keys = [c for c in strokes.columns if c != "points"]
    return strokes.select(*keys, F.posexplode("points").alias("pt", "p")).select(*keys, "pt", "p.*")


def segments(strokes: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """Each point with its speed from the point before; the first has none."""
    window = Window.partitionBy("fingerprint", "page_index", "ord").orderBy("pt")
    before = lambda c: F.lag(c).over(window)
    dt = F.greatest(F.col("time_ms") - before("time_ms"), F.lit(1)).cast("double")
    distance = F.hypot((F.col("x") - before("x")) * width, (F.col("y") - before("y")) * height)
    return exploded(strokes).withColumns({"speed": distance / dt, "pressure_before": before("pressure")})


def erase_strokes(strokes: DataFrame, x: float, y: float, rx: float, ry: float) -> DataFrame:
    """Strokes of which no probe point is touched. A shape column, if there is one, names outlines."""
    probes = G.shape_probes("shape", "points") if "shape" in strokes.columns else F.col("points")
    return strokes.filter(~F.exists(probes, lambda p: G.touched(p.x, p.y, x, y, rx, ry)))


def erase_pixels(strokes: DataFrame, x: float, y: float, rx: float, ry: float) -> DataFrame:
    """Free strokes split where they are touched: gaps and islands over the points. One row an island, in order."""
    window = Window.partitionBy("fingerprint", "page_index", "ord").orderBy("pt")
    hit = G.touched(F.col("x"), F.col("y"), x, y, rx, ry)
    points = exploded(strokes).withColumn("hit", hit).withColumn("island", F.sum(F.col("hit").cast("int")).over(window)).filter(~F.col("hit"))
    keys = [c for c in strokes.columns if c != "points"]
    parts = points.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("pt", "x", "y", "pressure", "time_ms"))).alias("sorted"))
    parts = parts.select(*keys, "island", F.transform("sorted", lambda p: p.dropFields("pt")).alias("points"))
    order = Window.partitionBy("fingerprint", "page_index", "ord").orderBy("island")
    return parts.withColumn("island", F.row_number().over(order) - 1)


def lasso(strokes: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    return strokes.filter(G.in_lasso("points", polygon))


def selection_bounds(strokes: DataFrame, pad: float = 0.0) -> DataFrame:
    """Bounds of each page's strokes, optionally padded inside the page."""
    b = strokes.select("fingerprint", "page_index", G.bounds("points").alias("b")).filter("b is not null")
    out = b.groupBy("fingerprint", "page_index").agg(*(f(f"b.{n}").alias(n) for n, f in (("left", F.min), ("top", F.min), ("right", F.max), ("bottom", F.max))))
    return out.select("fingerprint", "page_index", *((F.greatest(F.col(n) - pad, F.lit(0.0)) if n in ("left", "top") else F.least(F.col(n) + pad, F.lit(1.0))).alias(n) for n in ("left", "top", "right", "bottom")))


def duplicate(strokes: DataFrame, chosen: DataFrame, offset: float = 0.025) -> DataFrame:
    """Copies of the chosen strokes, shifted, follow a page's strokes."""
    page = ["fingerprint", "page_index"]
    top = strokes.groupBy(*page).agg(F.max("ord").alias("top"))
    window = Window.partitionBy(*page).orderBy("ord")
    copies = chosen.join(top, page).withColumn("ord", (F.col("top") + F.row_number().over(window)).cast(strokes.schema["ord"].dataType)).withColumn("points", G.moved("points", offset, offset))
    return strokes.unionByName(copies.select(strokes.columns))


def scale(chosen: DataFrame, factor: float) -> DataFrame:
    """The chosen strokes, scaled about the centre of their page's padded bounds."""
    b = selection_bounds(chosen, 0.012)
    both = chosen.join(b, ["fingerprint", "page_index"])
    return both.withColumn("points", G.scaled("points", (F.col("left") + F.col("right")) * 0.5, (F.col("top") + F.col("bottom")) * 0.5, factor)).select(chosen.columns)


def move(chosen: DataFrame, dx: float, dy: float) -> DataFrame:
    """The chosen strokes, moved as far as their bounds stay on the page; ``dirty`` says whether it shows."""
    both = chosen.join(selection_bounds(chosen), ["fingerprint", "page_index"])
    x, y = G.limited_move(dx, F.col("left"), F.col("right")), G.limited_move(dy, F.col("top"), F.col("bottom"))
    return both.withColumn("dirty", (F.abs(x) > 0.0002) | (F.abs(y) > 0.0002)).withColumn("points", G.moved("points", x, y)).select(*chosen.columns, "dirty")


def recognisable(strokes: DataFrame) -> DataFrame:
    """Strokes for handwriting recognition: no highlighter, valid points, pages with two strokes at least."""
    good = F.filter("points", lambda p: G.finite(p.x) & G.finite(p.y) & (p.time_ms >= 0))
    rows = strokes.filter(~F.coalesce(F.col("highlighter"), F.lit(False))).withColumn("points", good).filter(F.size("points") > 0)
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy("fingerprint", "page_index"))).filter("__n >= 2").drop("__n")


#: Fixed values of writing lines: overlap that joins, least reach, share of a height, least heights of a line and a stroke.
LINE_OVERLAP, LINE_REACH, LINE_SHARE, LINE_HEIGHTS = -0.012, 0.042, 0.85, (0.02, 0.01)


def joined_lines(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """The line of each stroke, in order of their beginnings: the extents of all lines so far are two arrays."""
    upper, lower = np.empty(len(top)), np.empty(len(top))
    of = np.empty(len(top), np.int64)
    n = 0
    for k in range(len(top)):
        up, low = upper[:n], lower[:n]
        away = np.abs((top[k] + bottom[k] - up - low) / 2)
        height = np.maximum(np.maximum(low - up, LINE_HEIGHTS[0]), max(bottom[k] - top[k], LINE_HEIGHTS[1]))
        shared = np.minimum(low, bottom[k]) - np.maximum(up, top[k])
        fits = (shared > LINE_OVERLAP) | (away <= np.maximum(LINE_REACH, LINE_SHARE * height))
        if fits.any():
            line = int(np.argmin(np.where(fits, away, np.inf)))
            upper[line], lower[line] = min(upper[line], top[k]), max(lower[line], bottom[k])
        else:
            line, n = n, n + 1
            upper[line], lower[line] = top[k], bottom[k]
        of[k] = line
    return of


def line_clusters(strokes: DataFrame) -> DataFrame:
    """(fingerprint, page_index, ord, line, place): writing lines, top to bottom, then from the left.

    Each stroke's choice depends on those before, so a page is one call. Pages are independent and small.
    """
    rows = strokes.select("fingerprint", "page_index", F.col("ord").cast("long").alias("ord"), G.padded_bounds("points").alias("b"), F.coalesce(F.try_element_at(F.col("points"), F.lit(1)).time_ms, F.lit(2**63 - 1)).alias("at"))
    rows = rows.select("fingerprint", "page_index", "ord", "b.*", "at")

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("ord", kind="stable").reset_index(drop=True)
        page["begun"] = joined_lines(page["top"].to_numpy(), page["bottom"].to_numpy())
        corners = page.groupby("begun")[["top", "left"]].min().sort_values(["top", "left"], kind="stable")
        page["line"] = page["begun"].map(pd.Series(range(len(corners)), corners.index))
        page = page.sort_values(["line", "at"], kind="stable")
        page["place"] = page.groupby("line").cumcount()
        return page[["fingerprint", "page_index", "ord", "line", "place"]]

    return rows.groupBy("fingerprint", "page_index").applyInPandas(fold, "fingerprint string, page_index int, ord long, line int, place int")


HISTORY = 40


def edit_history(edits: DataFrame) -> DataFrame:
    """Current state of each page after an edit log (fingerprint, page_index, seq, op, value).

    op is replace, append, undo or redo; values are lists of stroke names. Undo and redo keep the
    last 40 states; an edit clears redo; replacing by an equal value changes nothing.
    """

    def fold(log: pd.DataFrame) -> pd.DataFrame:
        now: list[str] = []
        undo: list[list[str]] = []
        redo: list[list[str]] = []
        for r in log.sort_values("seq", kind="stable").itertuples():
            value = [] if r.value is None else list(r.value)
            if r.op in ("replace", "append"):
                new = now + value if r.op == "append" else value
                if new == now:
                    continue
                undo, redo, now = [*undo, now][-HISTORY:], [], new
            elif r.op == "undo" and undo:
                redo, now, undo = [*redo, now][-HISTORY:], undo[-1], undo[:-1]
            elif r.op == "redo" and redo:
                undo, now, redo = [*undo, now][-HISTORY:], redo[-1], redo[:-1]
        return pd.DataFrame({"fingerprint": [log["fingerprint"].iloc[0]], "page_index": [log["page_index"].iloc[0]], "value": [now], "can_undo": [bool(undo)], "can_redo": [bool(redo)]})

    return edits.groupBy("fingerprint", "page_index").applyInPandas(fold, "fingerprint string, page_index int, value array<string>, can_undo boolean, can_redo boolean")


def without(strokes: DataFrame, selected: DataFrame) -> DataFrame:
    """Strokes that are not selected (fingerprint, page_index, ord)."""
    keys = ["fingerprint", "page_index", "ord"]
    return strokes.join(selected.select(keys).distinct(), keys, "left_anti")


def inked_pages(strokes: DataFrame) -> DataFrame:
    """(fingerprint, page_index) of pages with a stroke that has points."""
    return strokes.filter(F.size("points") > 0).select("fingerprint", "page_index").distinct()


def shape_corners(samples: DataFrame) -> DataFrame:
    """(gesture, first, last): a shape is drawn between a gesture's first and last sample (gesture, at, seq, x, y)."""
    point = F.struct("x", "y")
    order = F.struct("at", "seq")
    return samples.groupBy("gesture").agg(F.min_by(point, order).alias("first"), F.max_by(point, order).alias("last"))
