"""Strokes as lines to be drawn: quadratic curves through middles, flattened by an error bound; outlines; arrow heads."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An arrow head's largest length in dp, its largest share of the arrow, its angle to it, and the least arrow that has one, in pixels.
HEAD_DP, HEAD_SHARE, HEAD_ANGLE, LEAST = 28.0, 0.32, pi / 7, 1.0


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def scaled(points: Column | str, width: float, height: float) -> Column:
    """Page points in pixels."""
    p = F.col(points) if isinstance(points, str) else points
    return F.transform(p, lambda q: _xy(q.x * width, q.y * height))


def pieces(pixels: Column) -> Column:
    """struct<start, control, stop> of a stroke of three points or more: a curve around each inner point from middle to middle, the first from the first point, then a straight line to the last one."""
    n = F.size(pixels)
    at = lambda i: F.get(pixels, i)
    middle = lambda i: _xy((at(i).x + at(i + 1).x) * 0.5, (at(i).y + at(i + 1).y) * 0.5)
    start = lambda i: F.when(i == 1, at(F.lit(0))).otherwise(middle(i - 1))
    curve = lambda i: F.struct(start(i).alias("start"), at(i).alias("control"), middle(i).alias("stop"))
    straight = F.struct(middle(n - 2).alias("start"), middle(n - 2).alias("control"), at(n - 1).alias("stop"))
    return F.when(n > 2, F.concat(F.transform(F.sequence(F.lit(1), n - 2), curve), F.array(straight)))


def steps(piece: Column, tolerance: float) -> Column:
    """Lines that keep within ``tolerance`` of a curve: its chords' error falls with the square of their number."""
    bend_x, bend_y = (piece.start[c] - 2 * piece.control[c] + piece.stop[c] for c in "xy")
    bend = F.sqrt(bend_x * bend_x + bend_y * bend_y)
    straight = (piece.control.x == piece.start.x) & (piece.control.y == piece.start.y)
    return F.when(straight, 1).otherwise(F.greatest(F.ceil(F.sqrt(bend / (4 * tolerance))).cast("int"), F.lit(1)))


def flattened(piece: Column, tolerance: float) -> Column:
    """Points of the lines along a curve, both ends included."""
    n = steps(piece, tolerance)

    def point(i: Column) -> Column:
        t = i / n
        u = 1 - t
        return _xy(*(u * u * piece.start[c] + 2 * u * t * piece.control[c] + t * t * piece.stop[c] for c in "xy"))

    straight = (piece.control.x == piece.start.x) & (piece.control.y == piece.start.y)
    return F.when(straight, F.array(piece.start, piece.stop)).otherwise(F.transform(F.sequence(F.lit(0), n), point))


def arrow(start: Column, stop: Column, density: float = 1.0) -> Column:
    """Lines (arrays of two points) of an arrow in pixels: the shaft, and both sides of the head unless it is tiny."""
    dx, dy = stop.x - start.x, stop.y - start.y
    length = F.sqrt(dx * dx + dy * dy)
    size = F.least(F.lit(HEAD_DP * density), length * HEAD_SHARE)
    angle = F.atan2(dy, dx)
    side = lambda turn: F.array(stop, _xy(stop.x - F.cos(angle + turn) * size, stop.y - F.sin(angle + turn) * size))
    shaft = F.array(start, stop)
    return F.when(length > LEAST, F.array(shaft, side(-HEAD_ANGLE), side(HEAD_ANGLE))).otherwise(F.array(shaft))


def box(start: Column, stop: Column) -> Column:
    """struct<left, top, right, bottom> of two corners."""
    return F.struct(*(f(start[c], stop[c]).alias(n) for n, f, c in (("left", F.least, "x"), ("top", F.least, "y"), ("right", F.greatest, "x"), ("bottom", F.greatest, "y"))))


def drawn(points: Column | str, shape: Column, width: float, height: float, density: float = 1.0, tolerance: float = 0.25) -> Column:
    """Lines (arrays of points in pixels) that draw a stroke: none for an empty one, a single point for a dot.

    Rectangles and triangles are closed lines; an ellipse is its circle cut evenly, within the tolerance.
    """
    pixels = scaled(points, width, height)
    n = F.size(pixels)
    first, last = F.element_at(pixels, 1), F.element_at(pixels, -1)
    b = box(first, last)
    corner = lambda x, y: _xy(x, y)
    rectangle = F.array(corner(b.left, b.top), corner(b.right, b.top), corner(b.right, b.bottom), corner(b.left, b.bottom), corner(b.left, b.top))
    apex = corner((b.left + b.right) * 0.5, b.top)
    triangle = F.array(apex, corner(b.right, b.bottom), corner(b.left, b.bottom), apex)
    rx, ry = (b.right - b.left) * 0.5, (b.bottom - b.top) * 0.5
    # A chord over an angle a leaves the circle by r (1 - cos(a / 2)), at most r a^2 / 8.
    around = F.greatest(F.ceil(2 * pi * F.sqrt(F.greatest(rx, ry) / (8 * tolerance))).cast("int"), F.lit(8))
    ellipse = F.transform(F.sequence(F.lit(0), around), lambda i: corner((b.left + b.right) * 0.5 + F.cos(2 * pi * i / around) * rx, (b.top + b.bottom) * 0.5 + F.sin(2 * pi * i / around) * ry))
    curve = F.transform(pieces(pixels), lambda p: flattened(p, tolerance))
    shaped = shape.isNotNull() & (n >= 2)
    return (
        F.when(n == 0, F.slice(F.array(pixels), 1, 0))
        .when(shaped & (shape == "LINE"), F.array(F.array(first, last)))
        .when(shaped & (shape == "RECTANGLE"), F.array(rectangle))
        .when(shaped & (shape == "TRIANGLE"), F.array(triangle))
        .when(shaped & (shape == "ELLIPSE"), F.array(ellipse))
        .when(shaped & (shape == "ARROW"), arrow(first, last, density))
        .when(n < 3, F.array(pixels))
        .otherwise(curve)
    )
