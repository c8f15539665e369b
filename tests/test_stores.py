"""Sidecar files, library, jobs and storage."""

import json

import pytest
from pyspark.sql import functions as F

from pagelake.operators import jobs, library, search, storage
from pagelake.operators.jobs import Export
from pagelake.sources import sidecars as S


@pytest.fixture
def write(tmp_path):
    def put(name, doc):
        path = tmp_path / name
        path.write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False))
        return str(path)

    return put


def test_recognised_pages_new_and_old_shape(spark, write, tmp_path):
    rect = {"left": 0.1, "top": 0.1, "right": 0.5, "bottom": 0.2}
    write("a.json", {"pages": {"10": {"text": "ab"}, "2": {"text": "cd", "blocks": [{"text": "cd", "rect": rect}]}}})
    write("b.json", {"pages": {"0": "old"}})
    write("c.json", "{broken")
    rows = S.files(spark, str(tmp_path))
    pages = S.ocr_pages(rows)
    assert sorted((r["fingerprint"], r["page_index"], r["text"], len(r["blocks"])) for r in pages.collect()) == [("a", 2, "cd", 1), ("a", 10, "ab", 0), ("b", 0, "old", 0)]
    assert [r["text"] for r in S.blocks(pages).collect()] == ["cd"]
    assert [r["fingerprint"] for r in S.corrupt(rows, "ocr").collect()] == ["c"]


def test_defaults_and_order(spark, write):
    path = write("n.json", {"pages": {"3": [{"id": "x", "x": 0.1, "y": 0.2}, {"id": "y", "x": 0, "y": 0, "text": "t"}]}})
    boxes = S.text_boxes(S.files(spark, path)).orderBy("ord").collect()
    assert [(b["id"], b["ord"], b["page_index"], round(b["width"], 2), b["font_size_sp"], b["text"]) for b in boxes] == [("x", 0, 3, 0.42, 18.0, ""), ("y", 1, 3, 0.42, 18.0, "t")]


def test_ink_and_navigation(spark, write):
    path = write("i.json", {"pages": {"3": [{"points": [{"x": 0.1, "y": 0.2, "pressure": 0.5, "timeMs": 7}], "colorArgb": -1, "baseWidthDp": 2.0}]}})
    stroke = S.ink_strokes(S.files(spark, path)).first()
    assert stroke["brush"] == "FOUNTAIN" and stroke["highlighter"] is False and stroke["points"][0]["time_ms"] == 7
    nav = write("v.json", {"links": [{"id": "l", "sourcePage": 0, "targetPage": 2, "label": "to"}], "outline": [{"id": "o", "title": "T", "pageIndex": 1, "createdAt": 5}]})
    rows = S.files(spark, nav)
    assert round(S.page_links(rows).first()["width"], 2) == 0.24 and S.outline(rows).first()["page_index"] == 1


def test_library_keeps_last_value_at_first_place(spark, write):
    entry = lambda f, t: {"fingerprint": f, "title": t, "importedAt": 1, "lastOpenedAt": 2}
    path = write("lib.json", {"entries": [entry("a", "one"), entry("b", "two"), entry("a", "three")], "folders": [{"id": "f", "name": "F", "createdAt": 0}]})
    rows = S.files(spark, path)
    assert [(r["fingerprint"], r["title"], r["kind"], r["bookmarks"]) for r in S.library_entries(rows).orderBy("ord").collect()] == [("a", "three", "PDF", []), ("b", "two", "PDF", [])]
    assert S.library_folders(rows).count() == 1


def test_page_journals(spark, write, tmp_path):
    write("page_000001.json", {"width": 1000, "height": 1400, "lines": [["ab", 10, 20, 60, 40], ["  ", 0, 0, 1, 1]]})
    write("page_000002.json", {"width": 0, "height": 1400, "lines": []})
    write("page_000003.json", {"width": 5, "height": 5, "lines": [["ab", 1, 2, 3]]})
    pages = S.journal_pages(S.files(spark, str(tmp_path))).collect()
    assert [(p["page_index"], [tuple(x) for x in p["lines"]]) for p in pages] == [(0, [("ab", 10, 20, 60, 40)])]


def test_queue_manifest_and_backup(spark, write):
    good = write("q.bak", {"entries": [{"id": "1", "inputUri": "u"}]})
    row = S.queue_entries(spark, write("q.json", "{nope"), good).first()
    assert row["status"] == "waiting" and row["quality"] == 2200 and row["unexpected_restarts"] == 0
    with pytest.raises(ValueError, match="without id"):
        S.queue_entries(spark, write("r.json", {"entries": [{"id": " ", "inputUri": "u"}]}), good)


def test_round_trip_and_versions(spark, write, tmp_path):
    doc = {"pages": {"3": [{"id": "x", "x": 0.5, "y": 0.25, "width": 0.5, "height": 0.5, "text": "t", "fontSizeSp": 18.0}]}}
    boxes = S.text_boxes(S.files(spark, write("n.json", doc)))
    item = F.struct("id", "x", "y", "width", "height", "text", F.col("font_size_sp").alias("fontSizeSp"))
    assert json.loads(S.to_paged_json(boxes, item).first()["value"]) == doc
    root = str(tmp_path / "table")
    S.publish(boxes, root, 1)
    S.publish(boxes.limit(0), root, 2)
    assert S.current(spark, root).count() == 0


def test_imports_and_tail(spark, tmp_path):
    for name in ("a.pdf", "b.pdf"):
        (tmp_path / name).write_bytes(b"same")
    got = S.imports(spark, str(tmp_path / "*.pdf")).collect()
    assert len(got) == 1 and got[0]["title"] == "a"
    rows = spark.createDataFrame([(bytearray(b"abcdef"),)], "content binary")
    assert bytes(S.tail(rows, 4).first()["content"]) == b"ef"
    with pytest.raises(Exception, match="unchanged prefix"):
        S.tail(rows, 6).collect()


def test_search_fallback_cap_and_order(spark):
    pages = spark.createDataFrame([("d", 0, "x the y"), ("d", 1, "only the page"), ("d", 2, "none")], "fingerprint string, page_index int, text string")
    rect = "struct<left:float,top:float,right:float,bottom:float>"
    blocks = spark.createDataFrame([("d", 0, 0, "The one", None), ("d", 0, 1, "the two", None), ("d", 2, 0, "no", None)], f"fingerprint string, page_index int, ord int, text string, rect {rect}")
    hits = search.search_pages(pages, blocks, " THE ").orderBy("hit_ord").collect()
    assert [(h["page_index"], h["snippet"]) for h in hits] == [(0, "The one"), (0, "the two"), (1, "only the page")]
    assert search.search_pages(pages, blocks, "the", cap=2).count() == 2
    assert search.search_pages(pages, blocks, "  ").count() == 0
    both = search.unified(search.search_blocks(blocks, "the", "TEXT"), search.search_pages(pages, blocks, "the")).orderBy("rank").collect()
    assert [h["source"] for h in both] == ["PDF", "PDF", "TEXT", "TEXT", "PDF"]


def test_library_views_and_cascade(spark):
    entries = spark.createDataFrame([("a", "A", 1, True, "f", None, 0), ("b", "B", 9, False, "g", None, 1), ("c", "C", 5, True, "f", 7, 2)], "fingerprint string, title string, last_opened_at long, favorite boolean, folder_id string, trashed_at long, ord int")
    names = lambda df: [r["fingerprint"] for r in df.collect()]
    assert names(library.visible(entries).orderBy(*library.library_order())) == ["a", "b"]
    assert names(library.visible(entries, "FAVORITES", folder="g")) == ["a"]
    assert names(library.visible(entries, "TRASH", folder="g")) == ["c"]
    assert names(library.visible(entries, folder="g")) == ["b"]
    assert names(library.live(entries).orderBy(*library.picker_order("a"))) == ["a", "b"]
    again = library.register(entries, spark.createDataFrame([("c", "new title"), ("z", " ")], "fingerprint string, title string"), 99)
    rows = {r["fingerprint"]: r for r in again.collect()}
    assert rows["c"]["trashed_at"] == 7 and rows["c"]["title"] == "C" and rows["c"]["last_opened_at"] == 99 and rows["z"]["title"] == "PDF"
    assert names(library.restore(entries, ["c"]).filter("trashed_at is null").orderBy("ord")) == ["a", "b", "c"]
    left = library.delete_permanently({"e": entries, "f": entries}, entries.filter("ord = 0").select("fingerprint"))
    assert all(df.count() == 2 for df in left.values())


def test_journal_recovery():
    s = Export(100, 40, 16, 150)
    pending, done = jobs.appended(s, 32, 20)
    assert pending == Export(100, 40, 32, 150) and done == Export(100, 40, 32, 170)
    assert jobs.recovered(s, pending, 163) == (s, 150)
    assert jobs.recovered(done, pending, 170) == (done, None)
    assert jobs.recovered(s, pending, 149) == (None, None)
    assert jobs.recovered(s, None, 151) == (None, None)
    assert jobs.recovered(None, None, 100) == (None, None)
    with pytest.raises(ValueError):
        jobs.appended(s, 16, 20)


def test_journal_lines(spark):
    rows = spark.createDataFrame([(Export(100, 40, 16, 150).line(),), ("export-v1\t1\t2\t3",), ("export-v1\t100\t40\t41\t150",), ("v2\t100\t40\t16\t150",)], "value string")
    assert [r["valid"] for r in jobs.parse_journal(rows).collect()] == [True, False, False, False]


def test_job_geometry(spark):
    row = spark.range(1).select(
        jobs.raster_size(F.lit(1000), F.lit(2000), 2200).alias("s"), jobs.raster_size(F.lit(0), F.lit(2), 2200).alias("z"), jobs.rotation(F.lit(-90)).alias("r"),
        jobs.display_matrix(F.lit(90), F.lit(1.0), F.lit(2.0), F.lit(10.0), F.lit(20.0)).alias("m"), jobs.display_size(F.lit(270), F.lit(3), F.lit(4)).alias("d"),
    ).first()
    assert tuple(row["s"]) == (1100, 2200) and tuple(row["z"]) == (1, 1) and row["r"] == 270
    assert row["m"] == [0.0, 1.0, -1.0, 0.0, 11.0, 2.0] and tuple(row["d"]) == (4, 3)


def test_storage(spark):
    u = "123e4567-e89b-12d3-a456-426614174000"
    files = spark.createDataFrame(
        [("cache", "queue-7", 8192, True, False), ("cache", f"queue-{u}", 10, True, False), ("cache", "a" * 32, 512, True, False), ("cache", "x", 1, False, False), ("cache", "y", 99, False, True), ("fonts", "f", 5, False, False)],
        "root string, top_name string, bytes long, is_dir boolean, is_symlink boolean",
    )
    tasks = spark.createDataFrame([("7", "paused")], "task string, status string")
    classed = storage.classify(files, tasks)
    assert {r["class"]: r["bytes"] for r in storage.totals(classed).collect()} == {"job": 8192, "orphan": 10, "legacy": 512, "other": 1, "font": 5, "work": 8715, "total": 8720}
    plan = lambda t, d: {r["top_name"]: r["action"] for r in storage.cleanup_plan(classed, t, d).collect()}
    assert plan(tasks, False)["queue-7"] == "keep" and plan(tasks, True)["queue-7"] == "delete"
    busy = spark.createDataFrame([("7", "running")], "task string, status string")
    assert plan(busy, True)["queue-7"] == "blocked" and plan(busy, True)["a" * 32] == "delete"


def test_backups(spark):
    rows = spark.createDataFrame([(f"auto-{k}.zip", k) for k in range(9)] + [("imported-1.zip", 50), ("note.txt", 60)], "file_name string, modified_at long")
    listed = storage.backups(rows)
    assert sorted(r["file_name"] for r in storage.pruned(listed).collect()) == ["auto-0.zip", "auto-1.zip"]
    assert storage.backup_due(listed, 8 + storage.DAY_MS).first()["due"] and not storage.backup_due(listed, 7 + storage.DAY_MS).first()["due"]


def test_glyphs_and_runs(spark):
    glyphs = spark.createDataFrame([(1, 0, 0x2F00), (1, 1, 0x4E00), (2, 0, 65), (2, 1, 66)], "glyph int, ord int, code_point int")
    assert {r["glyph"]: r["code_point"] for r in jobs.first_representatives(glyphs).collect()} == {1: 0x4E00, 2: 65}
    chars = spark.createDataFrame([(0, i, f, c) for i, (f, c) in enumerate(zip("AABBA", "vwxyz", strict=True))], "line int, ord int, font string, ch string")
    assert [(r["font"], r["text"]) for r in jobs.font_runs(chars).orderBy("run").collect()] == [("A", "vw"), ("B", "xy"), ("A", "z")]


def test_progressive_recognition(spark, tmp_path):
    from pagelake.streaming import queues

    src, done, ck = (str(tmp_path / n) for n in ("src", "done", "ck"))
    spark.createDataFrame([("d", 0), ("d", 1)], "fingerprint string, page_index int").write.parquet(src)
    stream = lambda: spark.readStream.schema("fingerprint string, page_index int").parquet(src)
    recognise = lambda df: df.withColumn("text", F.concat(F.lit("p"), "page_index"))
    queues.recognise_stream(stream(), done, recognise, ck).awaitTermination(60)
    spark.createDataFrame([("d", 1), ("d", 2)], "fingerprint string, page_index int").write.mode("append").parquet(src)
    queues.recognise_stream(stream(), done, recognise, ck).awaitTermination(60)
    assert sorted(r["page_index"] for r in spark.read.parquet(done).collect()) == [0, 1, 2]
