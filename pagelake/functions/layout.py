"""Placement arithmetic of page objects: crops, sizes, drags, templates, text wrapping, velocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.geometry import clamp, finite

#: Aspect of a note page, and limits of inserted images and stickers (width, least and most height).
PAGE_ASPECT = 1240 / 1754
INSERT = {"image": (0.48, 0.12, 0.58), "sticker": (0.36, 0.10, 0.52)}
#: Least width and height, and largest lower edge, of things on a page.
LEAST = {"text": (0.18, 0.08), "image": (0.08, 0.08)}
LINK_LOWEST = 0.94
#: Template grid in page pixels: page size, step, first line, bottom margin, side margins.
NOTE = (1240, 1754)
STEP, TOP, FOOT = 72, 110, 70
SIDE = {"RULED": 70, "GRID": 55, "DOT": 70}


def between(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def crop_pixels(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """struct<left, top, right, bottom> in pixels, at least one pixel in each direction."""
    l = between((width * left).cast("int"), F.lit(0), width - 1)  # noqa: E741
    t = between((height * top).cast("int"), F.lit(0), height - 1)
    return F.struct(l.alias("left"), t.alias("top"), between((width * right).cast("int"), l + 1, width).alias("right"), between((height * bottom).cast("int"), t + 1, height).alias("bottom"))


def sample_factor(width: Column, target: Column | int) -> Column:
    """The largest power of two by which a width can shrink and still reach the target."""
    t = F.lit(target) if isinstance(target, int) else target
    ratio = F.floor(width / t)
    return F.when(ratio >= 2, F.pow(F.lit(2.0), F.floor(F.log2(ratio)))).otherwise(1.0).cast("int")


def insert_size(kind: str, width: Column, height: Column) -> Column:
    """struct<width, height> of a new image or sticker from its pixels."""
    w, low, high = INSERT[kind]
    aspect = F.when((width > 0) & (height > 0), width / height).otherwise(1.0)
    return F.struct(F.lit(w).alias("width"), clamp(w * PAGE_ASPECT / aspect, low, high).alias("height"))


def link_place(links_on_page: Column) -> Column:
    """y of a page's next link."""
    return F.least(F.lit(0.06) + F.pmod(links_on_page, F.lit(8)) * 0.065, F.lit(0.86))


def dragged(position: Column, delta: Column, size: Column) -> Column:
    """A position moved inside the page."""
    return between(position + delta, F.lit(0.0), F.greatest(1 - size, F.lit(0.0)))


def dragged_link(y: Column, delta: Column) -> Column:
    return clamp(y + delta, 0, LINK_LOWEST)


def resized(kind: str, side: str, size: Column, delta: Column, position: Column) -> Column:
    """A width or height changed inside the page, not below the kind's least."""
    least = LEAST[kind][side == "height"]
    return between(size + delta, F.lit(least), F.greatest(1 - position, F.lit(least)))


def crop_edge(side: str, value: Column, opposite: Column) -> Column:
    """An edge of a crop, kept a twentieth from the opposite one."""
    return between(value, F.lit(0.0), opposite - 0.05) if side in ("left", "top") else between(value, opposite + 0.05, F.lit(1.0))


def font_step(size: Column, up: bool) -> Column:
    return F.least(size + 2, F.lit(42.0)) if up else F.greatest(size - 2, F.lit(10.0))


def rotate_step(degrees: Column, right: bool) -> Column:
    return degrees + (15 if right else -15)


def zoomed(zoom: Column, change: Column) -> Column:
    return clamp(zoom * F.when(finite(change) & (change > 0), change).otherwise(1.0), 0.5, 8)


def panned(pan: Column, delta: Column, zoom: Column, viewport: Column) -> Column:
    """Pan across the reading direction: none unless zoomed in."""
    most = viewport * F.greatest(zoom - 1, F.lit(0.0)) * 0.5
    return F.when(zoom <= 1, 0.0).otherwise(between(pan + delta, -most, most))


def fling(velocity: Column) -> Column:
    """Distances of a fling's 16 ms steps, unless something stops it."""
    v = clamp(velocity, -14000, 14000)
    steps = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: v * F.pow(F.lit(0.92), i))
    return F.transform(F.filter(steps, lambda s: F.abs(s) >= 35), lambda s: s * 0.016)


def axis_velocity(samples: Column | str) -> Column:
    """Smoothed velocity of (delta, time_ms) samples of a two-finger pan."""
    s = F.col(samples) if isinstance(samples, str) else samples
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0).cast("long").alias("t"))

    def step(a: Column, q: Column) -> Column:
        dt = F.greatest(q.time_ms - a.t, F.lit(1)).cast("double")
        v = F.when((a.t != 0) & (q.time_ms != 0), a.v * 0.68 + q.delta * 1000 / dt * 0.32).otherwise(a.v)
        return F.struct(v.alias("v"), F.when(q.time_ms != 0, q.time_ms).otherwise(a.t).cast("long").alias("t"))

    return F.aggregate(s, start, step, lambda a: a.v)


def item_at(items: DataFrame, x: float, y: float) -> DataFrame:
    """The first (by ord) of items (ord, left, top, width, height) that holds the point."""
    inside = F.lit(x).between(F.col("left"), F.col("left") + F.col("width")) & F.lit(y).between(F.col("top"), F.col("top") + F.col("height"))
    return items.filter(inside).orderBy("ord").limit(1)


def nearest_item(items: DataFrame, scope: list[str], centre: float) -> DataFrame:
    """The item of each scope whose middle is nearest to the centre; the first of equals."""
    w = Window.partitionBy(*scope).orderBy(F.abs(F.col("top") + F.col("height") / 2 - centre), "ord")
    return items.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def rebased(points: Column | str, top: Column) -> Column:
    """A line's points in recogniser coordinates: thousandths of the page, from the line's top."""
    p = F.col(points) if isinstance(points, str) else points
    return F.transform(p, lambda q: F.struct((clamp(q.x, 0, 1) * 1000).alias("x"), ((clamp(q.y, 0, 1) - top) * 1000).alias("y"), q.time_ms.alias("time_ms")))


def writing_height(top: Column, bottom: Column) -> Column:
    return F.least(F.greatest((bottom - top) * 1000, F.lit(90.0)) * 1.7, F.lit(1000.0))


def template_lines(template: Column | str) -> Column:
    """array<struct<kind, x0, y0, x1, y1>> of a page template; dots are points."""
    t = F.col(template) if isinstance(template, str) else template
    w, h = NOTE
    rows = list(range(TOP, h - FOOT + 1, STEP))
    part = lambda kind, x0, y0, x1, y1: F.struct(F.lit(kind).alias("kind"), *(F.lit(float(v)).alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))
    across = lambda s: [part("line", s, y, w - s, y) for y in rows]
    columns = lambda s: range(s, w - s + 1, STEP)
    shapes = {
        "RULED": across(SIDE["RULED"]),
        "GRID": across(SIDE["GRID"]) + [part("line", x, TOP, x, h - FOOT) for x in columns(SIDE["GRID"])],
        "DOT": [part("dot", x, y, x, y) for y in rows for x in columns(SIDE["DOT"])],
    }
    out = F.slice(F.array(part("", 0, 0, 0, 0)), 1, 0)
    for name, parts in shapes.items():
        out = F.when(t == name, F.array(*parts)).otherwise(out)
    return out


def wrapped(text: Column | str, widths: Column, most: Column | float) -> Column:
    """Lines of a text, broken where the next character would pass ``most``; ``widths`` is a map from character to width."""
    t = F.col(text) if isinstance(text, str) else text
    most = F.lit(float(most)) if not isinstance(most, Column) else most
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0.0).alias("w"))

    def step(a: Column, ch: Column) -> Column:
        w = F.coalesce(F.try_element_at(widths, ch), F.lit(0.0))
        full = (a.line != "") & (a.w + w > most)
        return F.struct(F.when(full, F.array_append(a.lines, a.line)).otherwise(a.lines).alias("lines"), F.when(full, ch).otherwise(F.concat(a.line, ch)).alias("line"), F.when(full, w).otherwise(a.w + w).alias("w"))

    one = lambda p: F.when(p == "", F.array(F.lit(""))).otherwise(F.aggregate(F.filter(F.split(p, ""), lambda c: c != ""), start, step, lambda a: F.array_append(a.lines, a.line)))
    return F.flatten(F.transform(F.split(t, "\n"), one))


def export_width(brush: Column | str, base_dp: Column, highlighter: Column, pressure_a: Column, pressure_b: Column, speed: Column, page_width: float, page_height: float) -> Column:
    """Width of a segment in an exported page; it differs from the screen's."""
    b = F.col(brush) if isinstance(brush, str) else brush
    scale = min(page_width, page_height) / 850
    base = base_dp * scale
    pressure = clamp((pressure_a + pressure_b) * 0.5, 0.03, 1)
    thin = clamp(speed / max(3.0 * scale, 0.1), 0, 0.24)
    pencil = clamp(base * (0.58 + pressure * 0.34), 0.55 * scale, 3.6 * scale)
    fountain = clamp(base * (0.48 + 0.9 * F.pow(pressure, F.lit(0.58))) * (1 - thin), 0.7 * scale, 4.2 * scale)
    return F.when(highlighter, F.greatest(base, F.lit(3.0))).when(b == "BALLPOINT", F.greatest(base, F.lit(0.65 * scale))).when(b == "PENCIL", pencil).otherwise(fountain)


def midpoints(points: Column | str) -> Column:
    """Quadratic segments of a stroke: from middle to middle around each inner point."""
    p = F.col(points) if isinstance(points, str) else points
    n = F.size(p)
    at = lambda i: F.get(p, i)
    middle = lambda a, b: F.struct(((a.x + b.x) / 2).alias("x"), ((a.y + b.y) / 2).alias("y"))
    inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(inner, lambda i: F.struct(middle(at(i - 1), at(i)).alias("start"), F.struct(at(i).x.alias("x"), at(i).y.alias("y")).alias("control"), middle(at(i), at(i + 1)).alias("stop")))
