import pytest
from pyspark.sql import functions as F

from pagelake.operators import pages as P


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("d", p, f"r{p}-{k}") for p in range(6) for k in range(p % 3)], "fingerprint string, page_index int, id string")


def got(df):
    return sorted((r["page_index"], r["id"]) for r in df.collect())


@pytest.mark.parametrize("p", [0, 2, 5])
def test_delete_after_duplicate_is_identity(rows, p):
    assert got(P.delete_page(P.duplicate_page(rows, p), p + 1)) == got(rows)


@pytest.mark.parametrize("n", [1, 3, 5])
def test_moves_are_permutations_and_inverse(spark, n):
    pages = spark.range(n).select(F.col("id").cast("int").alias("page_index"))
    for a in range(n):
        for b in range(n):
            there = P.move_page(pages, a, b)
            order = list(range(n))
            order.insert(b, order.pop(a))
            want = {old: new for new, old in enumerate(order)}
            both = pages.select("page_index", P.after_move("page_index", a, b).alias("new"), P.after_move(P.after_move("page_index", a, b), b, a).alias("back")).collect()
            assert all(want[r["page_index"]] == r["new"] and r["back"] == r["page_index"] for r in both)
            assert there.distinct().count() == n


def test_duplicate_gives_new_ids(rows):
    out = P.duplicate_page(rows, 2, new_id="id")
    ids = [r["id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) == rows.count() + 2


def test_links(spark):
    links = spark.createDataFrame([("d", "x", 1, 2, 0.93), ("d", "y", 2, 4, 0.5), ("d", "z", 4, 1, 0.1)], "fingerprint string, id string, source_page int, target_page int, y double")
    ends = lambda df: sorted((r["source_page"], r["target_page"], round(r["y"], 3)) for r in df.collect())
    assert ends(P.links_delete(links, 2)) == [(3, 1, 0.1)]
    assert ends(P.links_duplicate(links, 1)) == [(1, 3, 0.93), (2, 3, 0.94), (3, 5, 0.5), (5, 1, 0.1)]
    assert ends(P.links_move(links, 1, 4)) == [(1, 3, 0.5), (3, 4, 0.1), (4, 1, 0.93)]


def test_arrays(spark):
    a = F.array(*map(F.lit, [10, 11, 12, 13]))
    row = spark.range(1).select(
        P.array_delete(a, 0).alias("d0"), P.array_delete(a, 2).alias("d2"), P.array_duplicate(a, 1).alias("u"), P.array_move(a, 0, 3).alias("m"), P.array_move(a, 3, 0).alias("n"),
        P.bookmarks_delete(F.array(F.lit(0), F.lit(2), F.lit(3)), 2).alias("b"), P.bookmarks_duplicate(F.array(F.lit(0), F.lit(2)), 2).alias("c"),
        P.toggle(F.array(F.lit(1), F.lit(5)), 3).alias("t"), P.toggle(F.array(F.lit(1), F.lit(5)), 5).alias("s"), P.padded(F.array(F.lit("A")), "B", F.lit(3)).alias("p"),
        P.effective_order(F.array(F.lit(2), F.lit(2)), F.lit(2)).alias("bad"), P.effective_order(F.array(F.lit(1), F.lit(1)), F.lit(2)).alias("good"),
        P.resume_after_delete(F.lit(3), 3, F.lit(4)).alias("r"),
    ).first()
    assert row["d0"] == [11, 12, 13] and row["d2"] == [10, 11, 13] and row["u"] == [10, 11, 11, 12, 13]
    assert row["m"] == [11, 12, 13, 10] and row["n"] == [13, 10, 11, 12]
    assert row["b"] == [0, 2] and row["c"] == [0, 2, 3] and row["t"] == [1, 3, 5] and row["s"] == [1]
    assert row["p"] == ["A", "B", "B"] and row["bad"] == [0, 1] and row["good"] == [1, 1] and row["r"] == 2
