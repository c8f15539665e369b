"""The index of words within its disk: no shuffle of texts, no sort that spills, matches in bounded broadcasts."""

import pytest
from pyspark.sql import functions as F

from pagelake.operators import bindings, textindex


def kept_under(spark, folder):
    names = (f"{folder}/k{i}" for i in range(1000))

    def kept(rows):
        path = next(names)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return kept


@pytest.mark.parametrize("ids, moved", [([*range(-9000, 9000, 7), 1 << 60, (1 << 60) + 1], False), ([1, 2, 2, 3], True), ([1, None, 3], True)])
def test_pages_are_numbered_without_moving_texts(spark, tmp_path, ids, moved):
    rows = [(i, f"t{k}", [None, "a", "b"][k % 3] if not moved else "a") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, want = bindings.pages_in_place(docs, kept_under(spark, tmp_path)), bindings.pages(docs)
    numbers = lambda df: sorted((tuple(r) for r in df.select("fingerprint", "page_index", "doc_id").collect()), key=str)
    assert numbers(got) == numbers(want)
    if not moved:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_matches_beyond_a_broadcast_are_met_by_buckets(spark, tmp_path, monkeypatch):
    lines = [(f"b{i % 2}", i, 0, f"w{i}a x{i % 3} y") for i in range(60)]
    blocks = spark.createDataFrame(lines, "fingerprint string, page_index int, ord int, text string")
    index = textindex.open_index(spark, f"file://{tmp_path}/index", 4)
    monkeypatch.setattr(textindex, "SORTED_CHARS", 100)
    parts = textindex._parts(blocks)
    assert len(parts) > 1 and sorted(r["page_index"] for p in parts for r in p.collect()) == list(range(60))
    textindex.refresh(index, blocks.select("fingerprint", "page_index", F.lit(0).alias("revision")), blocks)
    # Sixty terms end with "a": they are matched once for the three phrases, in two parts of two buckets or more.
    monkeypatch.setattr(textindex, "BROADCAST_ROWS", 45)
    asked, real = [], index.read
    monkeypatch.setattr(index, "read", lambda name, version=None, buckets=None: (name == "postings" and asked.append(buckets and list(buckets))) or real(name, version, buckets))
    matched, found = [], textindex._matches
    monkeypatch.setattr(textindex, "_matches", lambda *a: matched.append((rows := found(*a)).count()) or rows)
    hits = textindex.find(index, spark.createDataFrame([("a x0",), ("a x1",), ("a x",)], "query string")).collect()
    assert sorted((r["query"], r["page_index"]) for r in hits) == sorted([*(("a x", i) for i in range(60)), *((f"a x{i % 3}", i) for i in range(60) if i % 3 < 2)])
    assert matched == [60] and sorted(b for part in asked for b in part) == [0, 1, 2, 3] and len(asked) > 1
