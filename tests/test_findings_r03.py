"""Queries against their SQL on tables that the given ones don't resemble."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelake.plans import queries as core
from tests.test_queries import canonical


def same_as_sql(spark, folder, name, tables):
    got = core.QUERIES[name](spark, str(folder)).toPandas()
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(core.ORACLE_SQL[name]).df()
    assert len(got) and canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["cleanup_actions", "clutter_cleaned", "cache_totals"])
def test_pages_of_one_url_are_folders_of_their_own(spark, tmp_path, name):
    ids = [*range(40), *(1_000_000_000_000 + i for i in range(40)), *(1_000_000_000_005 + 10 * i for i in range(100, 140))]
    rows = [(i, f"http://a.b/{i % 3}", "x" * (i % 17 + 1)) for i in ids]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_as_sql(spark, tmp_path, name, ["pages"])


@pytest.mark.parametrize("url, size", [("u", lambda i: i), ("u{}", lambda i: i), ("u", lambda i: i % 20), (None, lambda i: None if i % 3 else i)])
def test_pages_of_one_id_are_folders_of_their_own(spark, tmp_path, url, size):
    rows = [(i % 20, url and url.format(i), None if size(i) is None else "x" * size(i)) for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_as_sql(spark, tmp_path, "clutter_cleaned", ["pages"])


def test_edited_pages_keep_letters_without_one_capital(spark, tmp_path):
    texts = ["die Straße grüßt ŉ 𝒳ß", "große Fuß\nim Maß ǰ", "strasse ǆ ﬁn"]
    spark.createDataFrame([(i, texts[i % 3], "s") for i in range(30)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "die Straße grüßt"), (1, "große Fuß"), (2, "Strasse ǆ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same_as_sql(spark, tmp_path, "search_refreshed", ["documents", "benchmark"])


def test_lassos_of_one_outline_are_one_class(spark):
    from pagelake.operators import regions

    box = lambda a: [(a, a), (a + 0.2, a), (a + 0.2, a + 0.2), (a, a + 0.2)]
    rows = [(i, "b", i % 2, box(0.3 * (i % 3))) for i in range(60)] + [(60, None, 0, box(0.0)), (61, None, 0, box(0.0)), (62, "b", 0, [(0.0, 0.0)])]
    first, members = regions.classes(spark.createDataFrame(rows, "lasso long, fingerprint string, page_index int, vertices array<struct<x: double, y: double>>"))
    assert sorted(r["lasso"] for r in first.collect()) == [0, 1, 2, 3, 4, 5, 60]
    assert sorted(map(tuple, members.collect())) == [*((i, i % 6) for i in range(60)), (60, 60), (61, 60)]


def test_lassos_of_one_outline_are_tested_once(spark, tmp_path, monkeypatch):
    from pagelake.operators import regions

    spark.range(3000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.hash("id", i) % 1000) / 4000.0 - 0.05).cast("float"))
    spark.range(300).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"), vector.alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    tested, real = [], regions.lassoed
    monkeypatch.setattr(regions, "lassoed", lambda strokes, lassos, *a: tested.append(lassos.count()) or real(strokes, lassos, *a))
    same_as_sql(spark, tmp_path, "lasso_table", ["customer", "embeddings"])
    assert tested == [100]


def test_no_index_file_grows_with_the_index(spark, tmp_path, monkeypatch):
    import json

    from pagelake.sources import sidecar_source as X
    from pagelake.sources import sidecars as S

    monkeypatch.setattr(S, "ITEMS", 20)
    files, real = {}, X.write
    monkeypatch.setattr(X, "write", lambda rows, path, *a: files.setdefault(path.rsplit("/", 1)[-1], rows.collect()) and real(rows, path, *a))
    o = spark.range(3000).selectExpr("id as o_orderkey", "id % 97 as o_custkey", "element_at(array('F', 'O', 'P'), cast(id % 3 as int) + 1) as o_orderstatus", "if(id % 5 = 0, '1-URGENT', '5-LOW') as o_orderpriority", "timestamp'2020-01-01' as o_orderdate")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(200).selectExpr("id as s_suppkey", "id % 25 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(25).selectExpr("id as n_nationkey", "'N' || id as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    same_as_sql(spark, tmp_path, "indexes_read_back", ["orders", "supplier", "nation"])
    sizes = {k: [len(json.loads(r["value"]).get(n, [])) for r in rows] for k, n, rows in ((k, {"library": "entries", "stickers": "items", "queues": "entries"}[k], v) for k, v in files.items())}
    assert sum(sizes["library"]) == 3000 and sum(sizes["queues"]) == 2000
    assert max(map(max, sizes.values())) <= 60
    names = sorted((r["name"], [int(e["id"]) for e in json.loads(r["value"])["entries"]]) for r in files["queues"])
    ids = [i for n, part in names if n.startswith("q7.") for i in part]
    assert ids == sorted(ids) and len(ids) > 20


def test_files_reach_spark_in_batches_of_bounded_bytes():
    from pagelake.sources import sidecar_source as X

    rows = [(f"n{i}", "x" * (3 << 20), None) for i in range(10)] + [("e", "", "bad")]
    got = list(X.batches(iter(rows)))
    assert [b.num_rows for b in got] == [3, 3, 3, 2] and [tuple(r.values()) for b in got for r in b.to_pylist()] == rows


def test_only_postings_with_both_words_are_compared_with_the_pages(spark, tmp_path, monkeypatch):
    from pagelake.operators import textindex

    lines = [(f"b{i % 2}", i, 0, "of the" if i % 50 == 0 else "of a") for i in range(200)]
    blocks = spark.createDataFrame(lines, "fingerprint string, page_index int, ord int, text string")
    index = textindex.open_index(spark, f"file://{tmp_path}/index", 2)
    textindex.refresh(index, blocks.select("fingerprint", "page_index", F.lit(0).alias("revision")), blocks)
    compared, real = [], textindex.current
    monkeypatch.setattr(textindex, "current", lambda index, rows, *a: compared.append(rows.count()) or real(index, rows, *a))
    found = textindex.find(index, spark.createDataFrame([("of th",)], "query string"))
    assert sorted(r["page_index"] for r in found.collect()) == [0, 50, 100, 150]
    assert compared == [4]
