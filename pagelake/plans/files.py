"""Queries that write sidecar files of every kind and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators import bindings as B
from pagelake.operators import ink
from pagelake.plans.registry import query
from pagelake.sources import sidecar_source as X
from pagelake.sources import sidecars as S
from pagelake.sources.stores import shared_folder

#: Books over which all turns and vectors are dealt.
BOOKS = 50
_PAGE = f"CAST(conv_id // {BOOKS} * 8 + turn AS INTEGER)"
_FP = f"'b' || (conv_id % {BOOKS})"


def _turns(spark, sf) -> DataFrame:
    c = B.read(spark, sf, "conversations")
    return c.select(F.concat(F.lit("b"), F.col("conv_id") % BOOKS).alias("fingerprint"), (F.floor(F.col("conv_id") / BOOKS) * 8 + F.col("turn")).cast("int").alias("page_index"), F.lit(0).alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("id"), "text", (F.col("conv_id") % BOOKS % 5 == 0).alias("old"))


def _paged(rows: DataFrame, item: Column) -> DataFrame:
    """(fingerprint, value): a file a book, {"pages": {page: item}}."""
    return rows.groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct(F.col("page_index").cast("string"), item))).alias("pages")).select("fingerprint", F.to_json(F.struct("pages")).alias("value"))


def _stored(root: str, kind: str, files: DataFrame) -> DataFrame:
    """The files, written and read back by the data source."""
    path = f"{root}/{kind}"
    X.write(files.select(F.col(files.columns[0]).alias("name"), "value"), path)
    return X.files(X.read(files.sparkSession, path).filter("error is null"))


@query(
    f"""WITH t AS (SELECT {_FP} AS fp, {_PAGE} AS page, conv_id || '-' || turn AS id, text, conv_id % {BOOKS} % 5 = 0 AS old FROM conversations),
    v AS (SELECT 'b' || (vec_id % {BOOKS}) AS fp, label AS page, vec_id, embedding FROM embeddings)
    SELECT kind, fingerprint, CAST(page_index AS INTEGER) AS page_index, id, CAST(n AS BIGINT) AS n FROM (
        SELECT 'ocr' AS kind, fp AS fingerprint, page AS page_index, md5(text) AS id, CASE WHEN old THEN 0 ELSE 1 END AS n FROM t
        UNION ALL SELECT 'handwriting', fp, page, md5(text), 1 FROM t
        UNION ALL SELECT 'text', fp, page, id, length(text) FROM t
        UNION ALL SELECT 'image', fp, page, id, 48 FROM t
        UNION ALL SELECT 'ink', fp, page, 'FOUNTAIN', sum(len(embedding) // 2) FROM v GROUP BY fp, page
        UNION ALL SELECT 'links', fp, page, id, page + 1 FROM t
        UNION ALL SELECT 'outline', fp, page, id, length(text) FROM t WHERE page % 3 = 0
        UNION ALL SELECT 'journal', fp, page, md5(trim(text)), 900 FROM t WHERE trim(text) <> '')"""
)
def sidecars_read_back(spark, sf):
    """Recognised pages of both shapes, handwriting, text boxes, images, ink, links, outline and page journals, written as files and read back."""
    X.register(spark)
    root = shared_folder(spark, "sidecars")
    t = _turns(spark, sf)
    rect = F.struct(*(F.lit(v).cast("float").alias(n) for n, v in (("left", 0.125), ("top", 0.25), ("right", 0.5), ("bottom", 0.75))))
    block = F.array(F.struct("text", rect.alias("rect")))
    row = lambda kind, df, id_, n, page="page_index": df.select(F.lit(kind).alias("kind"), "fingerprint", F.col(page).cast("int").alias("page_index"), id_.alias("id"), n.cast("long").alias("n"))
    recognised = _paged(t.filter("not old"), F.struct("text", block.alias("blocks"))).unionByName(_paged(t.filter("old"), F.col("text")))
    ocr = S.ocr_pages(_stored(root, "ocr", recognised))
    written = S.handwriting_blocks(_stored(root, "handwriting", _paged(t, F.struct(block.alias("blocks")))))
    boxes = S.text_boxes(_stored(root, "text", S.to_paged_json(t, F.struct("id", F.lit(0.5).alias("x"), F.lit(0.25).alias("y"), "text"))))
    images = S.page_images(_stored(root, "image", S.to_paged_json(t, F.struct("id", F.concat("id", F.lit(".img")).alias("fileName")))))
    e = B.read(spark, sf, "embeddings")
    points = B.strokes(e).select("ord", F.transform("points", lambda p: F.struct(p.x.cast("float").alias("x"), p.y.cast("float").alias("y"), p.pressure.cast("float").alias("pressure"), p.time_ms.alias("timeMs"))).alias("points"), "page_index")
    points = points.withColumn("fingerprint", F.concat(F.lit("b"), F.col("ord") % BOOKS))
    strokes = ink.sanitize(S.ink_strokes(_stored(root, "ink", S.to_paged_json(points, F.struct("points", F.lit(-1).alias("colorArgb"), F.lit(2.0).alias("baseWidthDp"))))))
    links = t.select("fingerprint", F.col("page_index").alias("ord"), "id", F.col("page_index").alias("source_page"), (F.col("page_index") + 1).alias("target_page"), F.lit("to").alias("label"), *(F.lit(v).alias(n) for n, v in (("x", 0.5), ("y", 0.25), ("width", 0.25))))
    outline = t.filter("page_index % 3 = 0").select("fingerprint", F.col("page_index").alias("ord"), "id", F.col("text").alias("title"), "page_index", F.lit(5).alias("created_at"))
    navigation = _stored(root, "navigation", S.to_navigation_json(links, outline))
    lines = F.array(F.struct("text", *(F.lit(v).alias(n) for n, v in (("l", 1), ("t", 2), ("r", 3), ("b", 4)))))
    journal = t.select(F.col("fingerprint"), "page_index", F.lit(900).alias("width"), F.lit(1200).alias("height"), lines.alias("lines"))
    X.write(S.to_journal_json(journal), f"{root}/journal")
    files = X.read(spark, f"{root}/journal").filter("error is null")
    # A journal's file is named after its page; its folder is the book.
    books = files.select(F.substring_index("name", "/", 1).alias("fingerprint"), F.concat(F.substring_index("name", "/", -1), F.lit(".json")).alias("file"), "value")
    pages = S.journal_pages(books).filter(F.size("lines") > 0)
    one = F.lit(1)
    parts = [
        row("ocr", ocr, F.md5("text"), F.size("blocks")),
        row("handwriting", written, F.md5("text"), one),
        row("text", boxes, F.col("id"), F.length("text")),
        row("image", images, F.regexp_replace("file_name", r"\.img$", ""), F.round(F.col("width") * 100)),
        row("ink", strokes.groupBy("fingerprint", "page_index").agg(F.sum(F.size("points")).alias("n"), F.max("brush").alias("brush")), F.col("brush"), F.col("n")),
        row("links", S.page_links(navigation), F.col("id"), F.col("target_page"), "source_page"),
        row("outline", S.outline(navigation), F.col("id"), F.length("title")),
        row("journal", pages, F.md5(F.trim(F.get("lines", F.lit(0))["text"])), F.col("width")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "WITH o AS (SELECT * FROM orders) SELECT kind, id, n FROM ("
    "SELECT 'library' AS kind, 'doc-' || o_orderkey AS id, CAST(epoch_ms(o_orderdate) AS BIGINT) AS n FROM o UNION ALL SELECT 'folder', CAST(n_nationkey AS VARCHAR), CAST(length(n_name) AS BIGINT) FROM nation "
    "UNION ALL SELECT 'sticker', CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_suppkey % 3 <> 0 "
    "UNION ALL SELECT 'queue', CAST(o_orderkey AS VARCHAR), CAST(o_custkey % 101 AS BIGINT) FROM o WHERE o_orderstatus <> 'F')"
)
def indexes_read_back(spark, sf):
    """The library index with its folders, the sticker index with media that exist, and queue manifests, written as files and read back."""
    X.register(spark)
    root = shared_folder(spark, "indexes")
    o = B.library(B.read(spark, sf, "orders"))
    null = lambda kind: F.lit(None).cast(kind)
    entries = o.select(
        "ord", "fingerprint", "title", F.lit(1).alias("imported_at"), "last_opened_at", F.lit(0).alias("last_page"), null("array<int>").alias("bookmarks"), F.lit(False).alias("has_custom_cover"), F.lit("PDF").alias("kind"), F.lit("BLANK").alias("page_template"),
        F.lit(0).alias("note_page_count"), null("array<string>").alias("page_templates"), null("array<int>").alias("pdf_page_order"), "favorite", "folder_id", "trashed_at",
    )
    folders = B.read(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit(0).cast("long").alias("createdAt"))
    parts = S.to_list_json(entries, "entries", S.library_item(), parts=S.parts(entries, 16)).unionByName(S.to_list_json(folders, "folders", F.struct("id", "name", "createdAt"), key="id"))
    library = _stored(root, "library", parts)
    stickers = B.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("id"), F.concat("s_suppkey", F.lit(".png")).alias("fileName"), F.col("s_nationkey").cast("long").alias("createdAt"))
    kept = _stored(root, "stickers", S.to_list_json(stickers, "items", F.struct("id", "fileName", "createdAt"), parts=S.parts(stickers, 4), key="id"))
    media = stickers.filter("ord % 3 <> 0").select(F.col("fileName").alias("file_name"))
    tasks = B.read(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(
        F.concat(F.lit("q"), F.col("o_custkey") % BOOKS).alias("queue"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("u").alias("input_uri"), *(F.lit("").alias(c) for c in ("tree_uri", "output_uri", "stage", "error")), F.lit("paused").alias("status"), F.lit(2200).alias("quality"),
        (F.col("o_custkey") % 101).cast("int").alias("progress"), *(F.lit(0).alias(c) for c in ("page", "total", "unexpected_restarts", "last_unexpected_restart_at", "created_at")), F.lit(False).alias("paused_by_global"),
    )
    queues = _stored(root, "queues", S.to_queue_json(tasks, parts=S.parts(tasks, BOOKS)))
    out = [
        S.library_entries(library).select(F.lit("library").alias("kind"), F.col("fingerprint").alias("id"), F.col("last_opened_at").alias("n")),
        S.library_folders(library).select(F.lit("folder").alias("kind"), "id", F.length("name").cast("long").alias("n")),
        S.stickers(kept, media).select(F.lit("sticker").alias("kind"), "id", F.col("created_at").alias("n")),
        S.queue_rows(queues).select(F.lit("queue").alias("kind"), "id", F.col("progress").cast("long").alias("n")),
    ]
    return reduce(DataFrame.unionByName, out)


@query(
    "WITH s AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '{broken ' || s_suppkey WHEN 1 THEN '[' || s_suppkey || ']' ELSE '{\"n\":' || s_suppkey || '}' END AS v, s_suppkey % 5 < 2 AS bad FROM supplier) SELECT 's' || s_suppkey AS name, v AS value, bad FROM s"
)
def files_parted(spark, sf):
    """Good files and bad ones, told apart in one pass; the bad ones are put aside."""
    X.register(spark)
    root = shared_folder(spark, "parted")
    k = F.col("s_suppkey")
    value = F.when(k % 5 == 0, F.concat(F.lit("{broken "), k)).when(k % 5 == 1, F.concat(F.lit("["), k, F.lit("]"))).otherwise(F.concat(F.lit('{"n":'), k, F.lit("}")))
    X.write(B.read(spark, sf, "supplier").select(F.concat(F.lit("s"), k).alias("name"), value.alias("value")), f"{root}/files")
    bad = X.quarantine(spark, f"{root}/files", f"{root}/quarantine")
    left = X.read(spark, f"{root}/files").filter("error is null")
    return left.select("name", "value", F.lit(False).alias("bad")).unionByName(bad.select("name", "value", F.lit(True).alias("bad")))
