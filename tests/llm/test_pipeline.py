"""The pipeline's stages on a small corpus, each against its operator's brute force."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pagelake.llm import secrets


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (None, "no id here", "en", "src1", 10), (9002, "", "en", "src1", 0), (9003, "here is token = Zq81kk20ppQ7 for you and more words", "en", "src1", 51)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
            path = f"{folder}/{name}.parquet"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    before, after = (df.select("doc_id").collect() for df in seen["quality_classifier"])
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    wrong = [i for i, r in labels.items() if (i in kept) != (r["quality"] == 1 and r["toxic"] == 0)]
    assert len(wrong) <= 0.1 * len(labels) and {9001, 9002, 9003, None} <= kept
    before, after = seen["ngram_jaccard_join"]
    from tests.llm.test_operators import brute_components

    component, _ = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, c in component.items() if i == c} | {None}
    before, after = seen["secret_scan"]
    texts = {r["doc_id"]: r for r in after.collect()}
    assert len(texts) == before.count() and "[secret]" in texts[9003]["text"] and texts[9003]["n_chars"] == len(texts[9003]["text"])
    left = secrets.find_secrets(after, repo=F.concat_ws("/", "source", "lang"))
    assert left.filter("n_live > 0").count() == 0
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_run_and_queries(spark, folder):
    import __spark_entry__ as entry

    assert corpus_pipeline.run(spark, folder).count() > 100
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in entry.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries()


def test_rows_of_one_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (1, two), (1, two), (2, two + " end"), (3, one), (None, one), (None, None)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)).withColumn("key", F.lit(1)).withColumn("least", F.lit(2))
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()))
    texts = [t for i, t in got if i]
    assert len(got) == 4 and one in texts and len(texts) == 2 and (0, one) in got and (0, "") in got
    assert texts.count(two) + texts.count(two + " end") == 1


def test_column_names_may_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in ("__host", "__row", "__path", "row", "__text"):
        docs = docs.withColumn(c, F.lit(7))
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.filter("__host <> 7 or __row <> 7 or row <> 7").count() == 0, name
