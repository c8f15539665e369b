"""Tables of shapes, halved batches, reference counts, curves and change logs against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagelake.functions import curves
from pagelake.functions import geometry as G
from pagelake.operators import halving, library, references, regions

STROKES = "fingerprint string, page_index int, ord long, points array<struct<x:double,y:double,pressure:double,time_ms:long>>"


def strokes(spark, seed, number, spread=1.0):
    r = random.Random(seed)
    rows = []
    for i in range(number):
        x, y = r.random() * spread, r.random() * spread
        rows.append(("f", i % 2, i, [(min(1.0, x + r.random() * 0.1), min(1.0, y + r.random() * 0.1), 0.5, k) for k in range(r.randrange(1, 9))]))
    return spark.createDataFrame(rows, STROKES), rows


def inside(x, y, vertices):
    out = False
    for (ax, ay), (bx, by) in zip(vertices, [vertices[-1], *vertices[:-1]], strict=True):
        rise = by - ay if abs(by - ay) > 1e-6 else 1e-6
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / rise + ax:
            out = not out
    return out


@pytest.mark.parametrize(("spread", "crowd"), [(1.0, 20_000), (0.02, 20_000), (0.02, 10)])
def test_lassos_equal_brute_force(spark, monkeypatch, spread, crowd):
    monkeypatch.setattr(regions, "CROWD", crowd)
    df, rows = strokes(spark, 1, 80, spread)
    r = random.Random(2)
    lassos = [(i, "f", i % 3, [(r.random() * max(spread, 0.3) - 0.02, r.random() * max(spread, 0.3) - 0.02) for _ in range(r.choice([2, 3, 4, 7]))]) for i in range(60)]
    table = spark.createDataFrame(lassos, "lasso int, fingerprint string, page_index int, vertices array<struct<x:double,y:double>>")
    want = set()
    for i, _, page, vertices in lassos:
        for _, at, k, points in rows:
            if at == page and len(vertices) > 2:
                xs, ys = [p[0] for p in points], [p[1] for p in points]
                probes = [*zip(xs, ys, strict=True), ((min(xs) + max(xs)) * 0.5, (min(ys) + max(ys)) * 0.5)]
                if any(inside(x, y, vertices) for x, y in probes):
                    want.add((i, k))
    got = {(x["lasso"], x["ord"]) for x in regions.lassoed(df, table).collect()}
    assert got == want and want


def test_many_lassos_meet_by_cells(spark):
    df, _ = strokes(spark, 3, 200)
    n = 10_000
    c = F.col("id")
    corner = lambda dx, dy: F.struct(((c * 37 % 1000) / 1000 + dx).alias("x"), ((c * 61 % 1000) / 1000 + dy).alias("y"))
    table = spark.range(n).select(c.alias("lasso"), F.lit("f").alias("fingerprint"), (c % 2).cast("int").alias("page_index"), F.array(corner(0.0, 0.0), corner(0.02, 0.0), corner(0.0, 0.02)).alias("vertices"))
    found = regions.lassoed(df, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.select("lasso").distinct().count() > 500


def test_erasers_equal_the_literal_one(spark):
    df, _ = strokes(spark, 4, 60)
    df = df.withColumn("shape", F.when(F.col("ord") % 6 == 0, "RECTANGLE").when(F.col("ord") % 6 == 1, "ARROW"))
    r = random.Random(5)
    erasers = [(i, "f", i % 2, r.random(), r.random(), 0.02 + r.random() * 0.1, 0.02 + r.random() * 0.1) for i in range(30)]
    table = spark.createDataFrame(erasers, "eraser int, fingerprint string, page_index int, x double, y double, rx double, ry double")
    probes = df.select("page_index", "ord", F.explode(G.shape_probes("shape", "points")).alias("p")).select("page_index", "ord", "p.*").collect()
    want = {(i, q["ord"]) for i, _, page, x, y, rx, ry in erasers for q in probes if q["page_index"] == page and ((q["x"] - x) / rx) ** 2 + ((q["y"] - y) / ry) ** 2 <= 1}
    assert {(x["eraser"], x["ord"]) for x in regions.rubbed(df, table).collect()} == want
    assert {x["ord"] for x in regions.erased(df, table).collect()} == set(range(60)) - {k for _, k in want}


# ---------------------------------------------------------------- batches


def tried(weights, budget, size=16):
    out, start = [], 0
    while start < len(weights) and size:
        stop = min(start + size, len(weights))
        good = sum(weights[start:stop]) <= budget
        out.append((size, start, stop, sum(weights[start:stop]), good))
        start, size = (stop, size) if good else (start, size // 2)
    return out


def test_batches_halve_like_one_attempt_after_the_other(spark):
    r = random.Random(6)
    books = {f"b{i}": [r.choice([1, 1, 2, 5, 30]) for _ in range(r.choice([1, 15, 16, 17, 90]))] for i in range(25)} | {"always": [1] * 20 + [1000] + [1] * 20, "first": [1000]}
    rows = [(b, i, w) for b, ws in books.items() for i, w in enumerate(ws)]
    got = halving.attempts(spark.createDataFrame(rows, "fingerprint string, page_index int, weight long"), 60)
    found = {}
    for x in got.orderBy("start", F.desc("size")).collect():
        found.setdefault(x["fingerprint"], []).append(tuple(x)[1:])
    assert found == {b: tried(ws, 60) for b, ws in books.items()}
    ends = {x["fingerprint"]: x for x in halving.ends(got).collect()}
    assert (ends["always"]["failed_page"], ends["always"]["committed_pages"]) == (20, 20)
    assert (ends["first"]["failed_page"], ends["first"]["attempts"]) == (0, 5)


# ---------------------------------------------------------------- references


def test_counts_by_changes_are_recounts(spark, tmp_path):
    r = random.Random(7)
    stores = references.open_media(spark, f"file://{tmp_path}/media", 3)
    items, seq = {}, 0
    for _ in range(5):
        batch, before, named = [], {f for f in items.values()}, set()
        for _ in range(r.choice([1, 12, 40])):
            seq += 1
            op, id_, file = r.choice(["put", "put", "delete"]), f"i{r.randrange(15)}", f"f{r.randrange(8)}"
            batch.append((seq, op, id_, "b", 0, file))
            if op == "put":
                items[id_] = file
                named.add(file)
            else:
                items.pop(id_, None)
        _, free = references.change(stores, spark.createDataFrame(batch, "seq long, op string, id string, fingerprint string, page_index int, file_name string"))
        left = set(items.values())
        assert sorted(x["file_name"] for x in free.collect()) == sorted((before | named) - left)
        counts = {x["file_name"]: x["n"] for x in stores.read(references.COUNTS).collect()}
        assert counts == {x["file_name"]: x["n"] for x in references.recounted(stores).collect()} == {f: list(items.values()).count(f) for f in left}


# ---------------------------------------------------------------- curves


def lines_of(spark, points, shape=None, tolerance=0.25):
    df = spark.createDataFrame([(points, shape)], "points array<struct<x:double,y:double>>, shape string")
    return [[(p["x"], p["y"]) for p in line] for line in df.select(curves.drawn("points", F.col("shape"), 100.0, 200.0, 1.0, tolerance).alias("l")).first()["l"]]


def test_curves_keep_within_their_bound(spark):
    points = [(0.0, 0.0), (0.5, 0.9), (0.9, 0.1), (0.2, 0.3)]
    lines = lines_of(spark, points, tolerance=0.1)
    assert len(lines) == 3
    assert lines[0][0] == (0, 0) and lines[-1][-1] == pytest.approx((20, 60))
    assert all(a[-1] == pytest.approx(b[0]) for a, b in zip(lines[:-1], lines[1:], strict=True))
    start, control, stop = (0, 0), (50, 180), (70, 100)
    for i in range(101):
        t = i / 100
        q = [(1 - t) ** 2 * a + 2 * t * (1 - t) * b + t * t * c for a, b, c in zip(start, control, stop, strict=True)]
        gap = min(abs((b[1] - a[1]) * (q[0] - a[0]) - (b[0] - a[0]) * (q[1] - a[1])) / math.dist(a, b) for a, b in zip(lines[0][:-1], lines[0][1:], strict=True) if min(a[0], b[0]) - 1 <= q[0] <= max(a[0], b[0]) + 1)
        assert gap <= 0.1 + 1e-9
    assert len(lines_of(spark, points, tolerance=10.0)[0]) < len(lines[0])


def test_short_strokes_and_shapes(spark):
    assert lines_of(spark, []) == []
    assert lines_of(spark, [(0.5, 0.5)]) == [[(50, 100)]]
    two = [(0.1, 0.1), (0.5, 0.4)]
    assert lines_of(spark, two) == [[(10, 20), (50, 80)]] == lines_of(spark, two, "LINE")
    assert [len(x) for x in lines_of(spark, two, "RECTANGLE")] == [5] and [len(x) for x in lines_of(spark, two, "TRIANGLE")] == [4]
    ring = lines_of(spark, two, "ELLIPSE")[0]
    assert ring[0] == pytest.approx(ring[-1]) and all(math.isclose(((x - 30) / 20) ** 2 + ((y - 50) / 30) ** 2, 1) for x, y in ring)
    shaft, left, right = lines_of(spark, two, "ARROW")
    assert shaft == [(10, 20), (50, 80)] and left[0] == right[0] == (50, 80)
    size = min(28, 0.32 * math.dist(*shaft))
    assert math.dist(*left) == pytest.approx(size) == math.dist(*right)
    assert len(lines_of(spark, [(0.1, 0.1), (0.1, 0.1)], "ARROW")) == 1


# ---------------------------------------------------------------- library changes


def test_changes_are_those_of_one_after_the_other(spark):
    entries = spark.createDataFrame([("a", "A", "PDF", False, "f", 1, 3, False), ("b", "B", "NOTE", True, None, 2, 0, True)], "fingerprint string, title string, kind string, favorite boolean, folder_id string, last_opened_at long, last_page int, custom_cover boolean")
    folders = spark.createDataFrame([("f", "F"), ("g", "G")], "id string, name string")
    steps = [
        ("rename", "a", "  "), ("favorite", "a", None), ("favorite", "a", None), ("favorite", "b", None), ("last_page", "a", "3"), ("last_page", "a", "-4"), ("last_page", "a", "0"), ("move", "b", "g"), ("delete_folder", "f", None),
        ("create", "c", "NOTE"), ("rename", "c", " Mine "), ("create", "c", "PDF"), ("move", "c", "h"), ("create_folder", "h", " Home "), ("rename_folder", "g", " "), ("rename_folder", "g", "Good"), ("clear_cover", "b", None), ("touch", "b", None), ("rename", "nobody", "x"), ("create_folder", "i", " "),
    ]
    changes = spark.createDataFrame([(i, op, k, v, 100 + i) for i, (op, k, v) in enumerate(steps)], "seq long, op string, id string, value string, at long")
    got = {r["fingerprint"]: tuple(r)[1:] for r in library.changed(entries, folders, changes).collect()}
    assert got == {
        "a": ("PDF", "PDF", False, None, 1, 0, False),
        "b": ("B", "NOTE", False, "g", 117, 0, False),
        "c": ("Mine", "NOTE", False, None, 109, 0, False),
    }
    assert {r["id"]: (r["name"], r["deleted"]) for r in library.changed_folders(folders, changes).collect()} == {"f": ("F", True), "g": ("Good", False), "h": ("Home", False)}
    assert {r["fingerprint"]: r["writes"] for r in library.page_writes(entries, changes).collect()} == {"a": 1}
