"""Phrase tables against one phrase at a time, and the whole-page fallback."""

import random

from pyspark.sql import functions as F

from pagelake.operators import bindings, search


def test_phrases_like_single_ones(spark):
    r = random.Random(4)
    lines = ["".join(r.choice("abAB ") for _ in range(r.choice([0, 3, 40, 700]))) for _ in range(60)] + [None, "İab ΣAB ςab", "x" * 255 + "abba ab" + "y" * 300]
    blocks = spark.createDataFrame([("f", i, 0, t, None) for i, t in enumerate(lines)], f"fingerprint string, page_index int, ord int, text string, rect {bindings.RECT}")
    phrases = ["ab", "abba", " ABBA ab ", "b a", "", "σab", "zzzzzzz", None]
    for some in (phrases, [p for p in phrases if p and len(p) > 3]):
        got = search.positioned_hits(blocks, spark.createDataFrame([(p,) for p in some], "query string"), "PDF")
        found = sorted((x["query"], x["page_index"], x["snippet"]) for x in got.collect())
        each = [search.positioned_hits(blocks, p, "PDF").collect() for p in some if p]
        assert found == sorted((x["query"], x["page_index"], x["snippet"]) for hits in each for x in hits)


def test_fallback_reaches_across_lines(spark):
    docs = spark.createDataFrame([(1, "one two\nthree", "s"), (2, "two three", "s"), (5000, "two\nthree", "s"), (7, None, "s"), (3, "two\nthree", None)], "doc_id long, text string, source string")
    paged = bindings.pages(docs)
    order = sorted((r["page_index"], r["doc_id"]) for r in paged.filter("fingerprint = 's'").collect())
    assert order == [(0, 1), (1, 2), (2, 7), (3, 5000)]
    hits = search.search_pages(paged, bindings.blocks(paged), "two\nthree", scope=["query", "fingerprint"]).filter("fingerprint = 's'").collect()
    assert sorted((h["page_index"], h["rect"]) for h in hits) == [(0, None), (3, None)]
    assert search.positioned_hits(bindings.blocks(paged), "two three", "PDF").select(F.col("page_index")).collect()[0][0] == 1
