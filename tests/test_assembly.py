import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagelake.operators import assembly as A
from pagelake.sources import archives


def test_page_items(spark):
    order = spark.createDataFrame([("d", 0, 4), ("d", 1, 4), ("d", 2, 0)], "fingerprint string, page_index int, source_page int")
    store = lambda *rows: spark.createDataFrame([("d", p, i, n) for p, i, n in rows], "fingerprint string, page_index int, ord int, id string")
    got = A.page_items(order, text=store((0, 0, "t")), image=store((0, 0, "i"), (1, 0, "j")), ink=store((0, 1, "b"), (0, 0, "a"))).orderBy("page_index", "layer", "ord").collect()
    assert [(r["page_index"], r["source_page"], r["id"]) for r in got] == [(0, 4, "i"), (0, 4, "a"), (0, 4, "b"), (0, 4, "t"), (1, 4, "j"), (2, 0, None)]


def test_put(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "page_index int, n int")
    out = A.put_pages(rows((0, 1), (1, 1), (2, 1)), rows((1, 0), (2, 5)), ["page_index"], F.col("n") == 0)
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1), (2, 5)]


def test_choices_and_covers(spark):
    row = spark.range(1).select(
        A.toggle_near(F.array(F.lit(1.0), F.lit(2.0)), 2.0005).alias("out"), A.toggle_near(F.array(F.lit(1.0)), 3).alias("into"), A.first_choices(F.array(F.lit(3), F.lit(1)), F.array(F.lit(1), F.lit(2)), limit=2).alias("f")
    ).first()
    assert row["out"] == [1.0] and row["into"] == [1.0, 3.0] and row["f"] == [3, 1]
    books = spark.createDataFrame([(True, [3]), (False, [3, 1]), (False, [])], "has_custom_cover boolean, pdf_page_order array<int>")
    assert [r["cover_page"] for r in A.cover(books).collect()] == [None, 3, 0]


def test_gestures(spark):
    rows = [(0, 3, 0.5, 0.0, 0.0, 0.0, False), (1, 3, 1.0, 90.0, 10.0, 0.0, False), (2, 2, 1.0, 0.0, 0.0, 200.0, False), (3, 2, 1.0, 0.0, 0.0, 5.0, False), (4, 1, 1.0, 0.0, 0.0, 0.0, False), (5, 1, 1.0, 0.0, 0.0, 0.0, True)]
    df = spark.createDataFrame(rows, "gesture int, fingers int, scale double, dx double, dy double, velocity double, cancelled boolean")
    assert [r["kind"] for r in A.gestures(df).orderBy("gesture").collect()] == ["pinch", "swipe", "fling", "pan", "draw", "cancelled"]
    samples = spark.createDataFrame([(0, 5, 1, "MOVE", 2.0, 0.0), (0, 5, 0, "MOVE", 1.0, 0.0), (1, 6, 0, "DOWN", 9.0, 0.0), (1, 7, 0, "CANCEL", 9.0, 0.0)], "gesture int, at long, seq int, phase string, x double, y double")
    assert [r["x"] for r in A.gesture_points(samples).collect()] == [1.0, 2.0]


def test_archives(tmp_path):
    root = tmp_path / "data"
    (root / "notes").mkdir(parents=True)
    (root / "notes/a.json").write_text("one")
    now = datetime(2024, 1, 2, 3, 4, 5)
    made = archives.create(root, "auto-", now)
    assert made.name == "auto-20240102-030405.zip" and zipfile.ZipFile(made).namelist() == ["notes/a.json"]
    (root / "notes/a.json").write_text("two")
    (root / "extra").write_text("x")
    archives.restore(made, root)
    assert (root / "notes/a.json").read_text() == "one" and not (root / "extra").exists() and made.exists()
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../../out", "x")
    for f in (lambda: archives.restore(bad, root), lambda: archives.import_archive(bad, root, now)):
        with pytest.raises(ValueError, match="leaves"):
            f()
    assert (root / "notes/a.json").read_text() == "one"
    assert archives.import_archive(made, root, now).name.startswith("imported-")
    (root / "link").symlink_to(root / "notes")
    assert archives.tree_size(root / "notes") == 3 and archives.tree_size(root / "link") == 0
    assert archives.room_for(10 << 30, 13 << 30) and not archives.room_for(10 << 30, 11 << 30)
