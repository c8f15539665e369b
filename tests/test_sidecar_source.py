"""The data source of sidecar files: round trips through the readers, versions, failures, quarantine, streams."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from pagelake.sources import sidecar_source as X
from pagelake.sources import sidecars as S


@pytest.fixture
def root(spark, tmp_path):
    X.register(spark)
    return str(tmp_path / "store")


def docs(spark, rows):
    return spark.createDataFrame(rows, "name string, value string")


def content(spark, root, at=None):
    return {r["name"]: r["value"] for r in X.read(spark, root, at).filter("error is null").collect()}


def test_newest_files_count_and_versions_stay(spark, root):
    assert X.read(spark, root).count() == 0
    assert X.write(docs(spark, [("a", '{"n":1}'), ("b/c", '{"n":2}')]).repartition(2), root) == 1
    assert X.write(docs(spark, [("a", '{"n":3}'), ("d", "{}"), ("b/c", None)]), f"file://{root}") == 2
    assert content(spark, root) == {"a": '{"n":3}', "d": "{}"}
    assert content(spark, root, 1) == {"a": '{"n":1}', "b/c": '{"n":2}'}
    assert X.write(docs(spark, [("e", "{}")]), root, overwrite=True) == 3
    assert content(spark, root) == {"e": "{}"}
    assert len(X.clean(root, keep=1)) == 2
    assert content(spark, root) == {"e": "{}"}


def test_a_failed_write_leaves_the_files(spark, root):
    X.write(docs(spark, [("a", '{"n":1}')]), root)
    with pytest.raises(Exception, match="bad file name"):
        X.write(docs(spark, [("a", '{"n":2}'), ("../evil", "{}")]), root)
    with pytest.raises(Exception, match="two files"):
        X.write(docs(spark, [("b", "{}"), ("b", "{}")]).coalesce(1), root)
    with pytest.raises(Exception, match="mounted"):
        X.write(docs(spark, [("a", "{}")]), "s3://bucket/x")
    assert content(spark, root) == {"a": '{"n":1}'}
    assert X.version(root) == 1


def test_a_killed_writer_leaves_the_files(spark, root):
    X.write(docs(spark, [("a", '{"n":1}')]), root)
    w = X.Writer(root, False)
    w.write(iter([{"name": "a", "value": '{"n":2}'}]))  # and no commit
    assert content(spark, root) == {"a": '{"n":1}'}
    assert X.clean(root) == [w.folder]


def test_commits_at_the_same_time_are_all_kept(tmp_path):
    root = str(tmp_path)
    every = [threading.Thread(target=X.commit, args=(root, [f"files-{i}"], False)) for i in range(12)]
    for t in every:
        t.start()
    for t in every:
        t.join()
    assert X.versions(root) == list(range(1, 13))
    assert sorted(X.manifest(root, 12)["folders"]) == sorted(f"files-{i}" for i in range(12))
    assert X.commit(root, ["files-x"], False, "s", 3) == 13
    assert X.commit(root, ["files-x"], False, "s", 3) == 13


def test_bad_files_are_put_aside_in_one_pass(spark, root, tmp_path):
    X.write(docs(spark, [("a", '{"n":1}'), ("b", "{broken"), ("c", "[1]"), ("d", "7")]), root)
    good, bad = X.parted(spark, root, str(tmp_path / "aside"))
    assert [r["name"] for r in good.collect()] == ["a"]
    assert sorted(r["name"] for r in bad.collect()) == ["b", "c", "d"]
    moved = X.quarantine(spark, root, str(tmp_path / "quarantine"))
    assert sorted((r["name"], r["value"]) for r in moved.collect()) == [("b", "{broken"), ("c", "[1]"), ("d", "7")]
    assert X.read(spark, root).filter("error is not null").count() == 0
    assert content(spark, root) == {"a": '{"n":1}'}


def test_readers_read_back_what_is_written(spark, root):
    back = lambda name: X.files(X.read(spark, f"{root}-{name}"))
    rect = {"left": 0.25, "top": 0.5, "right": 0.75, "bottom": 1.0}
    ocr = {"pages": {"2": {"text": "cd", "blocks": [{"text": "cd", "rect": rect}]}}}
    X.write(docs(spark, [("f", json.dumps(ocr))]), f"{root}-ocr")
    assert [tuple(r) for r in S.blocks(S.ocr_pages(back("ocr"))).collect()] == [("f", 2, 0, "cd", (0.25, 0.5, 0.75, 1.0))]

    journal = spark.createDataFrame([("job", 0, 100, 200, [("ab", 1, 2, 3, 4), ("é", 5, 6, 7, 8)]), ("job", 1, 10, 20, [])], "fingerprint string, page_index int, width int, height int, lines array<struct<text:string,l:int,t:int,r:int,b:int>>")
    X.write(S.to_journal_json(journal), f"{root}-journal")
    names = sorted(r["name"] for r in X.read(spark, f"{root}-journal").collect())
    assert names == ["job/page_000001", "job/page_000002"]
    got = S.journal_pages(back("journal")).orderBy("page_index").drop("fingerprint")
    assert got.collect() == journal.drop("fingerprint").collect()

    queue = {"entries": [{"id": "1", "inputUri": "u", "status": "paused", "page": 3}, {"id": "2", "inputUri": "v"}], "pausedAll": True}
    X.write(docs(spark, [("q", json.dumps(queue))]), f"{root}-queue")
    rows = S._list(back("queue"), "queue", "entries", S.DEFAULTS["queue"])
    X.write(S.to_queue_json(rows.withColumns({"queue": F.lit("q"), "paused_all": F.lit(True)})), f"{root}-queue")
    assert X.version(f"{root}-queue") == 2
    again = S._list(back("queue"), "queue", "entries", S.DEFAULTS["queue"])
    first = S._list(X.files(X.read(spark, f"{root}-queue", 1)), "queue", "entries", S.DEFAULTS["queue"])
    assert again.orderBy("ord").collect() == first.orderBy("ord").collect()

    entries = [{"fingerprint": f, "title": f"T {f}", "importedAt": 1, "lastOpenedAt": 2, "bookmarks": [1, 2], "kind": "NOTE"} for f in "abcde"]
    X.write(docs(spark, [("library", json.dumps({"entries": entries, "folders": []}))]), f"{root}-library")
    before = S.library_entries(back("library"))
    kept = before.collect()
    X.write(S.to_list_json(before, "entries", S.library_item(), parts=3), f"{root}-library", overwrite=True)
    assert 1 < X.read(spark, f"{root}-library").count() <= 3
    key = lambda rows: sorted(tuple(r)[1:] for r in rows)  # noqa: E731 - places are within a file
    assert key(S.library_entries(back("library")).collect()) == key(kept)

    links = spark.createDataFrame([("f", 0, "l", 1, 2, "to", 0.5, 0.25, 0.125), ("f", 1, "m", 0, 0, "x", 0.5, 0.25, 0.125)], "fingerprint string, ord int, id string, source_page int, target_page int, label string, x float, y float, width float")
    outline = spark.createDataFrame([("g", 0, "o", "T", 3, 5)], "fingerprint string, ord int, id string, title string, page_index int, created_at long")
    nav = S.to_navigation_json(links, outline).withColumnRenamed("fingerprint", "name")
    X.write(nav, f"{root}-nav")
    assert sorted(tuple(r) for r in S.page_links(back("nav")).select(links.columns).collect()) == sorted(tuple(r) for r in links.collect())
    assert [tuple(r) for r in S.outline(back("nav")).select(outline.columns).collect()] == [tuple(r) for r in outline.collect()]


def test_streams_write_and_read_each_file_once(spark, root, tmp_path):
    source, place, seen = (str(tmp_path / n) for n in ("in", "checkpoint", "seen"))

    def go(i):
        docs(spark, [(f"n{i}", f'{{"n":{i}}}'), ("same", f'{{"n":{i}}}')]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("name string, value string").parquet(source)
        query = stream.writeStream.format(X.FORMAT).option("path", root).option("checkpointLocation", place).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    go(1)
    go(2)
    assert content(spark, root) == {"n1": '{"n":1}', "n2": '{"n":2}', "same": '{"n":2}'}
    assert X.manifest(root, X.version(root))["batches"] == {"stream": 1}
    read = lambda: spark.readStream.format(X.FORMAT).option("path", root).load().writeStream.format("parquet").option("path", seen).option("checkpointLocation", f"{place}-read").trigger(availableNow=True).start().awaitTermination(120)
    read()
    go(3)
    read()
    assert sorted(r["name"] for r in spark.read.parquet(seen).collect()) == ["n1", "n2", "n3", "same", "same"]
    assert os.path.isdir(root)
