import math

import pytest
from pyspark.sql import functions as F

from pagelake.functions import layout as L
from pagelake.sources import engines


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_crops_and_samples(spark):
    d = lambda v: F.lit(float(v))
    assert tuple(value(spark, L.crop_pixels(F.lit(100), F.lit(50), d(0.255), d(0), d(0.255), d(1)))) == (25, 0, 26, 50)
    assert [value(spark, L.sample_factor(F.lit(w), 100)) for w in (50, 199, 200, 399, 400, 1700)] == [1, 1, 2, 2, 4, 16]
    assert math.isclose(value(spark, L.crop_edge("left", d(0.9), d(0.5))), 0.45) and math.isclose(value(spark, L.crop_edge("right", d(0.1), d(0.5))), 0.55)


def test_sizes_and_drags(spark):
    d = lambda v: F.lit(float(v))
    s = value(spark, L.insert_size("image", F.lit(1000), F.lit(500)))
    assert s["width"] == 0.48 and math.isclose(s["height"], 0.48 * 1240 / 1754 / 2)
    assert value(spark, L.insert_size("sticker", F.lit(0), F.lit(5)))["height"] == pytest.approx(0.36 * 1240 / 1754)
    assert value(spark, L.dragged(d(0.5), d(0.9), d(0.3))) == pytest.approx(0.7) and value(spark, L.dragged(d(0.5), d(0.9), d(1.3))) == 0
    assert value(spark, L.resized("text", "width", d(0.3), d(9), d(0.5))) == 0.5 and value(spark, L.resized("text", "height", d(0.3), d(-9), d(0.99))) == 0.08
    assert [round(value(spark, L.link_place(F.lit(n))), 3) for n in (0, 1, 8, 9)] == [0.06, 0.125, 0.06, 0.125]
    assert value(spark, L.font_step(d(41), True)) == 42 and value(spark, L.font_step(d(11), False)) == 10
    assert value(spark, L.zoomed(d(2), d(float("nan")))) == 2 and value(spark, L.zoomed(d(2), d(9))) == 8
    assert value(spark, L.panned(d(0), d(99), d(2), d(100))) == 50 and value(spark, L.panned(d(7), d(9), d(1), d(100))) == 0


def test_fling_and_velocity(spark):
    steps = value(spark, L.fling(F.lit(1000.0)))
    want, v = [], 1000.0
    while abs(v) >= 35:
        want.append(v * 0.016)
        v *= 0.92
    assert steps == pytest.approx(want)
    samples = F.array(*(F.struct(F.lit(float(a)).alias("delta"), F.lit(t).cast("long").alias("time_ms")) for a, t in ((5, 0), (1, 10), (2, 20), (3, 40))))
    assert value(spark, L.axis_velocity(samples)) == pytest.approx((0 * 0.68 + 200 * 0.32) * 0.68 + 150 * 0.32)


def test_templates_and_wrapping(spark):
    assert len(value(spark, L.template_lines(F.lit("BLANK")))) == 0
    ruled = value(spark, L.template_lines(F.lit("RULED")))
    assert len(ruled) == len(range(110, 1754 - 70 + 1, 72)) and ruled[0]["x0"] == 70 and ruled[0]["x1"] == 1170
    assert len(value(spark, L.template_lines(F.lit("DOT")))) == len(ruled) * len(range(70, 1171, 72))
    widths = F.create_map(F.lit("a"), F.lit(1.0), F.lit("w"), F.lit(3.0))
    assert value(spark, L.wrapped(F.lit("aaw\n\nwwa"), widths, 3)) == ["aa", "w", "", "w", "w", "a"]


def test_hits_and_segments(spark):
    items = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 10.0), (1, 5.0, 5.0, 10.0, 10.0)], "ord int, left double, top double, width double, height double")
    assert L.item_at(items, 7, 7).first()["ord"] == 0 and L.item_at(items, 12, 12).first()["ord"] == 1 and L.item_at(items, 99, 0).count() == 0
    near = L.nearest_item(items.withColumn("s", F.lit(1)), ["s"], 7.5).first()
    assert near["ord"] == 0
    pts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 2, 4, 8)))
    assert [(s["start"]["x"], s["control"]["x"], s["stop"]["x"]) for s in value(spark, L.midpoints(pts))] == [(1, 2, 3), (3, 4, 6)]
    w = value(spark, L.export_width(F.lit("PENCIL"), F.lit(2.0), F.lit(True), F.lit(0.5), F.lit(0.5), F.lit(0.0), 850, 1200))
    assert w == 3.0 and value(spark, L.writing_height(F.lit(0.1), F.lit(0.9))) == 1000 and value(spark, L.writing_height(F.lit(0.1), F.lit(0.11))) == pytest.approx(153)


def test_engines_have_contracts(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    assert engines.apply("transliterate", rows, lambda batches: batches).first()["text"] == "a"
    with pytest.raises(Exception, match="no engine"):
        engines.apply("transliterate", rows).collect()
