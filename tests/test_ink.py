import math
import random

import pytest
from pyspark.sql import functions as F

from pagelake.functions import geometry as G
from pagelake.operators import ink

SCHEMA = "fingerprint string, page_index int, ord long, points array<struct<x:double,y:double,pressure:double,time_ms:bigint>>"


def strokes(spark, *paths, page=0):
    return spark.createDataFrame([("d", page, i, [(float(x), float(y), 0.5, t) for t, (x, y) in enumerate(p)]) for i, p in enumerate(paths)], SCHEMA)


def test_sanitize(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("d", 0, 0, [(nan, 0.5, 0.5, 1), (2.0, -1.0, 0.0, -5)], 100.0), ("d", 0, 1, [(nan, 0.0, 0.0, 0)], 1.0), ("d", 0, 2, [(0.1, 0.1, 0.5, 0)], nan)], SCHEMA + ", base_width_dp double")
    out = ink.sanitize(rows).collect()
    assert len(out) == 1 and out[0]["base_width_dp"] == 64.0
    assert [tuple(p) for p in out[0]["points"]] == [(1.0, 0.0, 0.01, 0)]


def test_polygon_against_brute_force(spark):
    polygon = [(0.1, 0.1), (0.9, 0.2), (0.5, 0.5), (0.8, 0.9), (0.2, 0.8)]

    def inside(x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    r = random.Random(1)
    points = [(r.random(), r.random()) for _ in range(300)]
    rows = spark.createDataFrame(points, "x double, y double")
    got = rows.select("x", "y", G.in_polygon(F.col("x"), F.col("y"), polygon).alias("i"), G.in_polygon(F.col("x"), F.col("y"), polygon[2:] + polygon[:2]).alias("j")).collect()
    assert all(g["i"] == g["j"] == inside(g["x"], g["y"]) for g in got)
    assert not rows.select(G.in_polygon(F.col("x"), F.col("y"), polygon[:2]).alias("i")).filter("i").count()


def test_lasso_uses_the_centre(spark):
    square = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]
    rows = strokes(spark, [(0.1, 0.1), (0.9, 0.9)], [(0.5, 0.5)], [(0.1, 0.1), (0.2, 0.2)])
    assert sorted(r["ord"] for r in ink.lasso(rows, square).collect()) == [0, 1]


def test_islands_partition_untouched_points(spark):
    rows = strokes(spark, [(k / 10, 0.5) for k in range(11)], [(0.5, 0.5)])
    out = ink.erase_pixels(rows, 0.5, 0.5, 0.11, 0.11).orderBy("ord", "island").collect()
    assert [(r["ord"], r["island"], [round(p["x"], 1) for p in r["points"]]) for r in out] == [(0, 0, [0.0, 0.1, 0.2, 0.3]), (0, 1, [0.7, 0.8, 0.9, 1.0])]
    assert sorted(r["ord"] for r in ink.erase_strokes(rows, 0.0, 0.5, 0.01, 0.01).collect()) == [1]


@pytest.mark.parametrize(("shape", "n"), [("LINE", 17), ("RECTANGLE", 36), ("ELLIPSE", 32), ("TRIANGLE", 27), ("ARROW", 35), (None, 2)])
def test_shape_probes(spark, shape, n):
    rows = strokes(spark, [(0.1, 0.2), (0.5, 0.8)]).withColumn("shape", F.lit(shape).cast("string"))
    probes = rows.select(G.shape_probes("shape", "points").alias("p")).first()["p"]
    assert len(probes) == n
    if shape == "ELLIPSE":
        assert all(math.isclose(((p["x"] - 0.3) / 0.2) ** 2 + ((p["y"] - 0.5) / 0.3) ** 2, 1) for p in probes)


def test_move_and_scale_stay_on_the_page(spark):
    rows = strokes(spark, [(0.8, 0.1), (0.95, 0.3)])
    moved = ink.move(rows, 0.5, -0.5).first()
    assert moved["dirty"] and [round(p["x"], 3) for p in moved["points"]] == [0.85, 1.0] and round(moved["points"][0]["y"], 3) == 0.0
    assert all(0 <= p["x"] <= 1 for p in ink.scale(rows, 9).first()["points"])


def test_duplicate_appends(spark):
    rows = strokes(spark, [(0.1, 0.1)], [(0.99, 0.5)])
    out = {r["ord"]: r["points"][0] for r in ink.duplicate(rows, rows.filter("ord = 1")).collect()}
    assert set(out) == {0, 1, 2} and out[2]["x"] == 1.0 and round(out[2]["y"], 3) == 0.525


def test_line_clusters_follow_stroke_order(spark):
    rows = strokes(spark, [(0.1, 0.1), (0.2, 0.12)], [(0.1, 0.5), (0.2, 0.52)], [(0.3, 0.11), (0.4, 0.13)], [(0.3, 0.9), (0.4, 0.9)])
    assert {(r["ord"], r["line"]) for r in ink.line_clusters(rows).collect()} == {(0, 0), (2, 0), (1, 1), (3, 2)}


def test_smoothing_against_a_loop(spark):
    r = random.Random(3)
    samples = [(r.uniform(0, 900), r.uniform(0, 1200), r.random(), 8 * k) for k in range(40)]
    rows = spark.createDataFrame([("d", 0, 0, samples)], SCHEMA)
    got = rows.select(G.smoothed("points", 1000.0, 1400.0).alias("p")).first()["p"]
    sx = sy = rx = ry = sp = v = t0 = 0.0
    want = []
    for k, (x, y, p, t) in enumerate(samples):
        p = min(max(p, 0.03), 1.0)
        if k == 0:
            sx, sy, sp = x, y, p
        else:
            v += (math.hypot(x - rx, y - ry) / max(t - t0, 1) - v) * 0.32
            a = 0.42 + min(max(v / 1.9, 0), 1) * 0.36
            sx, sy, sp = sx + (x - sx) * a, sy + (y - sy) * a, sp + (p - sp) * 0.38
        rx, ry, t0 = x, y, t
        want.append((sx / 1000, sy / 1400, sp, t))
    assert len(got) == len(want)
    assert all(math.isclose(a, b, abs_tol=1e-9) for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))


def test_repeats_of_the_last_kept_point_go(spark):
    still = [(100.0, 100.0, 0.5, k) for k in range(5)]
    rows = spark.createDataFrame([("d", 0, 0, still)], SCHEMA)
    assert len(rows.select(G.smoothed("points", 1000.0, 1000.0).alias("p")).first()["p"]) == 1
    creeping = strokes(spark, [(0.001 * k, 0.0) for k in range(10)])
    assert [round(p["x"], 3) for p in creeping.select(G.decimated("points").alias("p")).first()["p"]] == [0.0, 0.003, 0.006, 0.009]


def test_ruler_snaps(spark):
    end = spark.range(1).select(G.ruler_end(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(4.0)).alias("e")).first()["e"]
    assert math.isclose(end["y"], 0.0, abs_tol=1e-9) and math.isclose(end["x"], math.hypot(100, 4))


def test_history(spark):
    log = [("append", ["a"]), ("append", ["b"]), ("undo", None), ("redo", None), ("undo", None), ("append", ["c"]), ("redo", None), ("replace", ["a", "c"])]
    rows = spark.createDataFrame([("d", 0, i, op, v) for i, (op, v) in enumerate(log)], "fingerprint string, page_index int, seq int, op string, value array<string>")
    r = ink.edit_history(rows).first()
    assert r["value"] == ["a", "c"] and r["can_undo"] and not r["can_redo"]


def test_recognisable(spark):
    rows = strokes(spark, [(0.1, 0.1)], [(0.2, 0.2)]).unionByName(strokes(spark, [(0.1, 0.1)], page=1)).withColumn("highlighter", F.lit(None).cast("boolean"))
    assert {r["page_index"] for r in ink.recognisable(rows).collect()} == {0}
