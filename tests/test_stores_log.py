"""Commits over several tables, logs of page edits, and the stored text index."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.operators import bindings, pagelog, search, textindex
from pagelake.sources.stores import Conflict, Stores


@pytest.fixture
def stores(spark, tmp_path):
    return Stores(spark, f"file://{tmp_path}/stores", buckets=4)


def table(spark, rows):
    return spark.createDataFrame(rows, "fingerprint string, n int")


def content(stores, name, version=None):
    return sorted(tuple(r) for r in stores.read(name, version).collect())


def book_in(stores, spark, bucket):
    """A fingerprint that lies in the bucket."""
    rows = table(spark, [(f"b{i}", i) for i in range(60)])
    return rows.filter(stores.bucket() == bucket).first()["fingerprint"]


# ---------------------------------------------------------------- commits


def test_all_tables_change_at_once(spark, stores):
    assert stores.version() == 0
    first = stores.edit()
    for name in ("ink", "text"):
        first.write(name, table(spark, [("a", 1), ("b", 2), (None, 3)]))
    assert stores.tables() == []
    assert first.commit() == 1
    second = stores.edit()
    second.write("ink", second.read("ink").withColumn("n", F.col("n") + 10))
    second.write("text", second.read("text").filter("n > 1"))
    assert {r["n"] for r in stores.read("ink").collect()} == {1, 2, 3}
    assert second.commit() == 2
    assert {r["n"] for r in stores.read("ink").collect()} == {11, 12, 13}
    assert {r["n"] for r in stores.read("text").collect()} == {2, 3}
    assert {r["n"] for r in stores.read("ink", 1).collect()} == {1, 2, 3}


def test_a_failed_writer_leaves_the_old_state(spark, stores):
    first = stores.edit()
    first.write("ink", table(spark, [("a", 1)]))
    first.write("text", table(spark, [("a", 2)]))
    first.commit()
    broken = stores.edit()
    broken.write("ink", table(spark, [("a", 100)]))
    with pytest.raises(Exception, match="no such page"):
        broken.write("text", table(spark, [("a", 1)]).withColumn("n", F.raise_error(F.lit("no such page")).cast("int")))
    assert stores.version() == 1
    assert (content(stores, "ink"), content(stores, "text")) == ([("a", 1)], [("a", 2)])
    gone = stores.clean()
    assert {g.split("/")[0] for g in gone} == {"ink", "text"}
    assert content(stores, "ink") == [("a", 1)]


def test_concurrent_writers(spark, stores):
    a, b = book_in(stores, spark, 0), book_in(stores, spark, 1)
    start = stores.edit()
    start.write("ink", table(spark, [(a, 1), (b, 2)]))
    start.commit()
    one, other, same = stores.edit(), stores.edit(), stores.edit()
    one.write("ink", table(spark, [(a, 10)]), [0])
    other.write("ink", table(spark, [(b, 20)]), [1])
    same.read("ink", [0])
    same.write("text", table(spark, [(a, 5)]), [0])
    assert (one.commit(), other.commit()) == (2, 3)
    assert content(stores, "ink") == sorted([(a, 10), (b, 20)])
    with pytest.raises(Conflict):
        same.commit()
    assert stores.tables() == ["ink"]
    assert stores.version() == 3


def test_a_version_is_put_in_place_once(stores):
    assert stores.swap(1, {"tables": {}, "touched": []})
    assert not stores.swap(1, {"tables": {}, "touched": [["x", 0]]})
    assert stores.manifest(1)["touched"] == []
    assert stores.versions() == [1]


def test_rows_outside_the_written_buckets_are_an_error(spark, stores):
    a = book_in(stores, spark, 0)
    with pytest.raises(Exception, match="outside the buckets"):
        stores.edit().write("ink", table(spark, [(a, 1)]), [1])


# ---------------------------------------------------------------- logs of page edits


def replay(count, edits):
    """(pages, place of the reader who was on each page), one edit after the other."""
    pages, readers = [(i, "", None) for i in range(count)], list(range(count))
    for seq, op, page, target, template in edits:
        n = len(pages)
        if op == "delete":
            del pages[page]
            readers = [min(r - (r > page), n - 2) for r in readers]
        elif op == "duplicate":
            s, p, t = pages[page]
            pages.insert(page + 1, (s, f"{p}.{seq}".strip("."), t))
            readers = [r + (r > page) for r in readers]
        elif op == "move":
            order = list(range(n))
            order.insert(target, order.pop(page))
            pages = [pages[i] for i in order]
            readers = [order.index(r) for r in readers]
        elif op == "append":
            pages.append((None, str(seq), template))
        else:
            pages[page] = (*pages[page][:2], template)
    return pages, readers


def random_edits(r, count, number):
    out = []
    for seq in range(number):
        op = r.choice(["delete", "duplicate", "move", "append", "template"])
        if op == "delete" and count < 2:
            op = "append"
        out.append((seq, op, r.randrange(count), r.randrange(count), r.choice("xyz")))
        count += {"delete": -1, "duplicate": 1, "append": 1}.get(op, 0)
    return out


def listed(pieces, count):
    out = []
    for s, n, p, t in pieces:
        if s is None:
            out += [(None, p, t)] * n
        else:
            out += [(i, p, t) for i in range(s, min(s + n, count))]
    return out


def mapping(count, edits):
    each = []
    for seq, op, page, target, template in edits:
        each.append((pagelog.edit_mapping(seq, op, page, target, template, count), pagelog.edit_places(op, page, target, count)))
        count += {"delete": -1, "duplicate": 1, "append": 1}.get(op, 0)
    return each


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8), st.integers(1, 14))
def test_composition_is_the_replay_and_associative(seed, count, number):
    edits = random_edits(random.Random(seed), count, number)
    each = mapping(count, edits)
    pages, readers = replay(count, edits)
    whole = pagelog.composed(each)
    assert listed(whole[0], count) == pages
    places = [s + k for s, n, _, _ in whole[1] for k in range(min(n, count))][:count]
    assert places == readers
    cut = seed % len(each)
    parts = [pagelog.composed(p) for p in (each[:cut], each[cut:]) if p]
    assert pagelog.composed(parts) == whole


def test_logs_of_many_books(spark, monkeypatch):
    monkeypatch.setattr(pagelog, "RUN", 4)
    monkeypatch.setattr(pagelog, "FAN", 2)
    monkeypatch.setattr(pagelog, "NUMBERS", 16)
    monkeypatch.setattr(pagelog, "CELL", 4)
    r = random.Random(5)
    counts = {f"b{i}": r.randrange(1, 30) for i in range(9)}
    edits = {b: random_edits(r, n, r.choice([0, 1, 3, 30, 90])) for b, n in counts.items()}
    edits["bad"], counts["bad"] = [(0, "append", None, None, "x"), (1, "delete", 7, None, None), (2, "move", 0, 9, None)], 2
    edits["only"], counts["only"] = [(0, "delete", 0, None, None)], 1
    edits["unknown"] = [(0, "append", None, None, "x")]
    log = spark.createDataFrame([(b, 3 * seq, *rest) for b, es in edits.items() for seq, *rest in es], "fingerprint string, seq long, op string, page int, target int, template string")
    books = spark.createDataFrame(list(counts.items()), "fingerprint string, page_count int")
    good, bad = pagelog.checked(log, books)
    assert sorted((x["fingerprint"], x["seq"]) for x in bad.collect()) == [("bad", 3), ("only", 0), ("unknown", 0)]
    mapped_runs = pagelog.runs(pagelog.mappings(good), books).cache()
    got = {}
    for x in pagelog.page_list(mapped_runs).orderBy("fingerprint", "page_index").collect():
        got.setdefault(x["fingerprint"], []).append((x["page_index"], x["source_page"], x["path"], x["template"]))
    for b, n in counts.items():
        es = [] if b in ("bad", "only") else [(3 * s, *rest) for s, *rest in edits[b]]
        assert got[b] == [(i, *p) for i, p in enumerate(replay(n, es)[0])]
    items = spark.createDataFrame([(b, p, f"{b}-{p}") for b, n in counts.items() for p in range(n)], "fingerprint string, page_index int, id string")
    moved = {}
    for x in pagelog.moved_store(items, mapped_runs).collect():
        moved.setdefault(x["fingerprint"], []).append(x["page_index"])
        assert ("-" in x["id"]) == (got[x["fingerprint"]][x["page_index"]][2] == "")
    assert {b: sorted(p) for b, p in moved.items()} == {b: ps for b in got if (ps := [i for i, s, _, _ in got[b] if s is not None])}
    ids = [x["id"] for x in pagelog.moved_store(items, mapped_runs).collect()]
    assert len(ids) == len(set(ids))


def test_a_log_edits_all_stores_or_none(spark, stores):
    first = stores.edit()
    first.write("text", spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), *((f"unknown {i}", 5, "u") for i in range(9))], "fingerprint string, page_index int, id string"))
    first.write("navigation", spark.createDataFrame([("l", "a", 1, 0, 0.5), ("m", "a", 0, 2, 0.93)], "id string, fingerprint string, source_page int, target_page int, y double"))
    first.write("outline", spark.createDataFrame([("a", 1, "o")], "fingerprint string, page_index int, id string"))
    first.write("library", spark.createDataFrame([("a", 3, [1, 2], 2), ("b", 1, [], 0)], "fingerprint string, page_count int, bookmarks array<int>, last_page int"))
    first.commit()
    edits = [("a", 1, "duplicate", 1, None, None), ("a", 2, "delete", 3, None, None), ("b", 3, "delete", 0, None, None)]
    log = spark.createDataFrame(edits, "fingerprint string, seq long, op string, page int, target int, template string")
    version, refused = pagelog.apply_log(stores, log)
    assert [r["fingerprint"] for r in refused.collect()] == ["b"]
    rows = lambda name: sorted(tuple(r) for r in stores.read(name, version).collect())
    text = [t for t in rows("text") if not t[0].startswith("unknown")]
    assert len(rows("text")) == len(text) + 9  # books that the library doesn't know stay as they are
    assert [t[:2] for t in text] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert [(s, t, round(y, 6)) for _, _, s, t, y in sorted(rows("navigation"), key=lambda x: x[2])] == [(1, 0, 0.5), (2, 0, 0.52)]
    assert rows("outline") == [("a", 1, "o")]
    assert rows("library") == [("a", 3, [1, 2], 2), ("b", 1, [], 0)]
    late = stores.edit()
    late.write("library", late.read("library"))
    pagelog.apply_log(stores, log.filter("seq = 1"))
    with pytest.raises(Conflict):
        late.commit()


# ---------------------------------------------------------------- text index

LINE = f"fingerprint string, page_index int, ord int, text string, rect {bindings.RECT}"


def lines_of(r, number):
    letters = lambda n: "".join(r.choice("abAB  ") for _ in range(n))
    return [(r.choice(["f", "g", None]), p, o, r.choice([None, "", letters(3), letters(40), "İab ΣAB ςab", " b  a "]), None) for p in range(number) for o in range(r.randrange(3))]


PHRASES = ["ab", "abba", " ABBA ab ", "b a", "", "σab", "zz", None, "a  b", "b", "ab ab ab", " ", "a b a"]


def revisions(rows):
    return rows.groupBy("fingerprint", "page_index").agg(F.hash(F.array_sort(F.collect_list(F.struct("ord", "text")))).alias("revision"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_refreshed_is_index_rebuilt(spark, tmp_path, seed):
    r = random.Random(seed)
    old = [x for x in lines_of(r, 40) if x[0] is not None or r.random() > 0.5]
    pages = sorted({x[:2] for x in old}, key=str)
    changed = set(r.sample(pages, 8))
    new = [(f, p, o, t if (f, p) not in changed else f"ab b a {t}", q) for f, p, o, t, q in old if r.random() > 0.1] + [("h", 0, 0, "x abba ab", None)]
    a, b = spark.createDataFrame(old, LINE), spark.createDataFrame(new, LINE)
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "query string")
    index = textindex.open_index(spark, f"file://{tmp_path}/one", 3)
    textindex.refresh(index, revisions(a), a)
    textindex.refresh(index, revisions(b), b)
    again = textindex.open_index(spark, f"file://{tmp_path}/two", 3)
    textindex.refresh(again, revisions(b), b)
    found = lambda i, v=None: sorted((tuple(x) for x in textindex.find(i, phrases, v).collect()), key=str)
    want = sorted(((x["query"], x["fingerprint"], x["page_index"], x["ord"]) for x in search.positioned_hits(b, phrases, "PDF").collect()), key=str)
    assert len(want) > 20
    assert found(index) == found(again) == want
    assert found(index, 1) == sorted(((x["query"], x["fingerprint"], x["page_index"], x["ord"]) for x in search.positioned_hits(a, phrases, "PDF").collect()), key=str)
    before = index.read("postings").count()
    textindex.compact(index)
    assert index.read("postings").count() < before
    assert found(index) == want
    snippets = lambda df: sorted((tuple(x) for x in df.select("query", "fingerprint", "page_index", "ord", "snippet").collect()), key=str)
    assert snippets(textindex.hits(index, phrases, b, "PDF")) == snippets(search.positioned_hits(b, phrases, "PDF"))
