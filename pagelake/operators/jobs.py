"""Incremental recognition jobs: pending pages, batches, progress, geometry of text layers, export journal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.text import sanitize

PIXELS = 4_500_000
BATCH = 16


def pending(pages: DataFrame, done: DataFrame, keys: list[str] = ("fingerprint", "page_index")) -> DataFrame:
    """Pages without a checkpoint: only these are recognised."""
    return pages.join(done.select(*keys).distinct(), list(keys), "left_anti")


def needs_refresh(pages: DataFrame, recognised: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds needs_refresh: the page is missing, or has text but no blocks."""
    keys = ["fingerprint", "page_index"]
    known = recognised.select(*keys, F.col("text").alias("__text"), F.lit(True).alias("__known"))
    held = blocks.select(*keys).distinct().withColumn("__blocks", F.lit(True))
    both = pages.join(known, keys, "left").join(held, keys, "left")
    blank = F.regexp_replace(F.coalesce("__text", F.lit("")), r"(?U)\s+", "") == ""
    return both.withColumn("needs_refresh", F.col("__known").isNull() | (~blank & F.col("__blocks").isNull())).drop("__text", "__known", "__blocks")


def batches(pages: DataFrame, size: int = BATCH) -> DataFrame:
    return pages.withColumn("batch", F.floor(F.col("page_index") / size).cast("int"))


def numbered_batches(rows: DataFrame, scope: list[str], order: list[Column], size: int = 100) -> DataFrame:
    """Batches of consecutive rows in order, within a scope."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1) / size).cast("int"))


def recognition_progress(done: Column, pages: Column) -> Column:
    return (5 + F.floor(done * 87 / pages)).cast("int")


def export_progress(done: Column, pages: Column) -> Column:
    return (92 + F.floor(done * 6 / pages)).cast("int")


def copy_progress(copied: Column, size: Column) -> Column:
    return F.when(size > 0, F.floor(copied * 5 / size)).otherwise(0).cast("int")


def raster_size(width: Column, height: Column, longest: int, pixels: int = PIXELS) -> Column:
    """struct<width, height> of a page's bitmap: bounded by the longest side and by pixels."""
    scale = F.least(F.lit(float(longest)) / F.greatest(width, height), F.sqrt(F.lit(float(pixels)) / (width.cast("double") * height)))
    scale = F.least(F.greatest(scale, F.lit(0.001)), F.lit(4.0))
    side = lambda v: F.greatest((v * scale).cast("int"), F.lit(1))
    good = (width > 0) & (height > 0)
    return F.struct(F.when(good, side(width)).otherwise(1).alias("width"), F.when(good, side(height)).otherwise(1).alias("height"))


def rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360))


def display_size(degrees: Column, width: Column, height: Column) -> Column:
    upright = F.pmod(degrees, F.lit(180)) == 0
    return F.struct(F.when(upright, width).otherwise(height).alias("width"), F.when(upright, height).otherwise(width).alias("height"))


def display_matrix(degrees: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Six numbers that map display to user space."""
    row = lambda *v: F.array(*(c.cast("double") if isinstance(c, Column) else F.lit(float(c)) for c in v))
    r = rotation(degrees)
    return F.when(r == 90, row(0, 1, -1, 0, x + width, y)).when(r == 180, row(-1, 0, 0, -1, x + width, y + height)).when(r == 270, row(0, -1, 1, 0, x, y + height)).otherwise(row(1, 0, 0, 1, x, y))


def line_placement(lines: DataFrame, sx: float, sy: float, display_height: float) -> DataFrame:
    """Adds x, y, font_size and horizontal_scale (needs natural_width at font size 1) to lines with l, t, r, b in pixels."""
    w = F.greatest((F.col("r") - F.col("l")) * sx, F.lit(0.5))
    h = F.greatest((F.col("b") - F.col("t")) * sy, F.lit(1.0))
    size = F.least(F.greatest(h * 0.88, F.lit(1.0)), F.lit(96.0))
    natural = F.col("natural_width") * size
    return lines.filter("natural_width > 0").withColumns(
        {"x": F.col("l") * sx, "y": display_height - F.col("b") * sy + h * 0.12, "font_size": size, "horizontal_scale": F.least(F.greatest(w / natural * 100, F.lit(5.0)), F.lit(1000.0))}
    )


def usable_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Recognised lines with text and an area, with their text sanitised."""
    return lines.withColumn(text, sanitize(text)).filter((F.col(text) != "") & (F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))


def first_representatives(glyphs: DataFrame) -> DataFrame:
    """One code point a glyph: the first, unless it is a radical's alias and a later one is not."""
    alias = F.col("code_point").between(0x2E80, 0x2FDF)
    w = Window.partitionBy("glyph").orderBy(alias, "ord")
    return glyphs.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def font_runs(chars: DataFrame) -> DataFrame:
    """Maximal runs of one font: (line, run, font, text) from (line, ord, font, ch)."""
    w = Window.partitionBy("line").orderBy("ord")
    turned = chars.withColumn("run", F.sum(F.when(F.col("font") == F.lag("font").over(w), 0).otherwise(1)).over(w))
    parts = turned.groupBy("line", "run", "font").agg(F.array_sort(F.collect_list(F.struct("ord", "ch"))).alias("cs"))
    return parts.select("line", "run", "font", F.array_join(F.transform("cs", lambda c: c.ch), "").alias("text"))


# ---------------------------------------------------------------- export journal

#: First field of a journal line; journals of other programs name theirs with ``tag``.
JOURNAL = "export-v1"


def parse_journal(lines: DataFrame, column: str = "value", tag: str = JOURNAL) -> DataFrame:
    """original_length, page_count, next_page, working_length of valid tab-separated records; ``valid`` tells them."""
    f = F.split(F.trim(column), "\t")
    number = lambda i, kind: F.get(f, F.lit(i)).try_cast(kind)
    out = lines.withColumns({"original_length": number(1, "bigint"), "page_count": number(2, "int"), "next_page": number(3, "int"), "working_length": number(4, "bigint")})
    sound = (F.size(f) == 5) & (F.get(f, F.lit(0)) == tag) & (F.col("original_length") > 0) & (F.col("page_count") > 0) & F.col("next_page").between(0, F.col("page_count")) & (F.col("working_length") >= F.col("original_length"))
    return out.withColumn("valid", F.coalesce(sound, F.lit(False)))


@dataclass(frozen=True)
class Export:
    original_length: int
    page_count: int
    next_page: int
    working_length: int

    def line(self) -> str:
        return "\t".join(map(str, (JOURNAL, self.original_length, self.page_count, self.next_page, self.working_length))) + "\n"


def appended(state: Export, next_page: int, patch_length: int) -> tuple[Export, Export]:
    """(pending record to write first, state to commit after the append)."""
    if not state.next_page < next_page <= state.page_count or patch_length <= 0:
        raise ValueError("a batch must add pages and bytes")
    return Export(state.original_length, state.page_count, next_page, state.working_length), Export(state.original_length, state.page_count, next_page, state.working_length + patch_length)


def recovered(state: Export | None, pending_: Export | None, length: int | None, corrupt_pending: bool = False) -> tuple[Export | None, int | None]:
    """(state to go on with, length to cut the working file to): None means start again.

    The committed state tells how long the working file is; only a marker of an append that began
    where that state ends explains a longer one, which is cut back. A marker that the state has caught up with is
    left over from an append that was committed.
    """
    again = (None, None)
    if corrupt_pending or state is None or length is None:
        return again
    excess = length - state.working_length
    if pending_ is None:
        return again if excess else (state, None)
    same_export = (pending_.original_length, pending_.page_count) == (state.original_length, state.page_count)
    if not (same_export and pending_.next_page in range(state.next_page, state.page_count + 1) and pending_.working_length >= state.original_length):
        return again
    if pending_.next_page == state.next_page and not excess:
        return state, None
    began_here = pending_.working_length == state.working_length
    return (state, state.working_length) if began_here and excess >= 0 else again


# ---------------------------------------------------------------- recognised lines


def recognised_blocks(lines: DataFrame) -> DataFrame:
    """Lines (left, top, right, bottom in pixels, or null; width and height of the bitmap) with a box and text; boxes as shares of the bitmap, inside it."""
    share = lambda side, size: F.least(F.greatest(F.col(side) / F.greatest(F.col(size), F.lit(1)).cast("double"), F.lit(0.0)), F.lit(1.0))
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") == ""
    boxed = lines.filter(F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("right").isNotNull() & F.col("bottom").isNotNull() & ~blank)
    return boxed.withColumns({side: share(side, size) for side, size in (("left", "width"), ("top", "height"), ("right", "width"), ("bottom", "height"))})


def completed(pages: DataFrame) -> DataFrame:
    """(fingerprint, completed): pages that have an entry, an empty one included."""
    return pages.groupBy("fingerprint").agg(F.countDistinct("page_index").alias("completed"))


def page_texts(blocks: DataFrame) -> DataFrame:
    """(fingerprint, page_index, text): the blocks of a page, joined by a space in their order."""
    each = blocks.groupBy("fingerprint", "page_index").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("b"))
    return each.select("fingerprint", "page_index", F.array_join(F.transform("b", lambda x: x.text), " ").alias("text"))


def natural_widths(runs: DataFrame) -> DataFrame:
    """(line, natural_width): the widths of a line's font runs, at font size 1."""
    return runs.groupBy("line").agg(F.sum("width").alias("natural_width"))


def reported(steps: DataFrame, every: int = 5) -> DataFrame:
    """Progress (page, total, force) that is shown: every fifth page, the last, and what is forced."""
    return steps.filter(F.col("force") | (F.col("page") % every == 0) | (F.col("page") == F.col("total")))


def import_legacy(pages: DataFrame, legacy: DataFrame, keys: list[str] = ("fingerprint",)) -> DataFrame:
    """Pages of documents, and those of an older cache (same columns) for documents that have none yet."""
    return pages.unionByName(legacy.join(pages.select(*keys).distinct(), list(keys), "left_anti").select(pages.columns))
