"""Registered queries of the page-document operators, and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.functions import geometry as G
from pagelake.functions import text as T
from pagelake.operators import bindings as B
from pagelake.operators import ink, jobs, ledger, library, search, storage, textindex
from pagelake.operators import pages as P
from pagelake.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from pagelake.sources.stores import shared_folder
from pagelake.streaming import queues

QUERY = "the"
PAGE, TARGET, ANCHOR = 2, 5, 7
POLYGON = [(0.45, 0.45), (0.75, 0.4), (0.8, 0.7), (0.6, 0.62), (0.4, 0.75)]
ERASER = (0.55, 0.55, 0.06, 0.05)


# ---------------------------------------------------------------- search

_PAGES = "p AS (SELECT source AS fingerprint, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page_index, doc_id, text FROM documents)"
_BLOCKS = "b AS (SELECT fingerprint, page_index, unnest(range(0, len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS text FROM p)"


def _snippet(source: str, size: str = str(len(QUERY))) -> str:
    before, after = T.SNIPPET[source]
    return f"trim(regexp_replace(substring(text, greatest(pos - {before}, 0) + 1, least(pos + {size} + {after}, length(text)) - greatest(pos - {before}, 0)), '\\s+', ' ', 'g'))"


def _find(phrase: str = f"'{QUERY}'") -> str:
    return f"strpos(lower(text), {phrase}) - 1"


_PDF = f"""
    f AS (SELECT fingerprint, page_index, ord, {_snippet("PDF")} AS snippet FROM (SELECT *, {_find()} AS pos FROM b) WHERE pos >= 0),
    g AS (SELECT fingerprint, page_index, 2147483647 AS ord, {_snippet("PDF")} AS snippet FROM (SELECT *, {_find()} AS pos FROM p) q
          WHERE pos >= 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.fingerprint = q.fingerprint AND f.page_index = q.page_index)),
    pdf AS (SELECT fingerprint, page_index, 'PDF' AS source, 0 AS source_ord, row_number() OVER (PARTITION BY fingerprint ORDER BY page_index, ord) AS hit_ord, snippet
            FROM (SELECT * FROM f UNION ALL SELECT * FROM g) QUALIFY hit_ord <= 200)"""
_TEXT = f"""
    txt AS (SELECT fingerprint, page_index, 'TEXT' AS source, 2 AS source_ord, row_number() OVER (PARTITION BY fingerprint ORDER BY page_index) AS hit_ord, snippet
            FROM (SELECT CAST(conv_id AS VARCHAR) AS fingerprint, CAST(turn AS INTEGER) AS page_index, {_snippet("TEXT")} AS snippet FROM (SELECT *, {_find()} AS pos FROM conversations) WHERE pos >= 0) QUALIFY hit_ord <= 200)"""
_HAND = f"""
    hw AS (SELECT fingerprint, page_index, 'HANDWRITING' AS source, 1 AS source_ord, row_number() OVER (PARTITION BY fingerprint ORDER BY page_index) AS hit_ord, snippet
           FROM (SELECT 'notes' AS fingerprint, CAST(item_id AS INTEGER) AS page_index, {_snippet("HANDWRITING")} AS snippet FROM (SELECT *, {_find()} AS pos FROM benchmark) WHERE pos >= 0) QUALIFY hit_ord <= 200)"""
_HIT = "fingerprint, page_index, source, CAST(source_ord AS INTEGER) AS source_ord, CAST(hit_ord AS INTEGER) AS hit_ord, snippet"
_SCOPE = ["query", "fingerprint"]


def _pdf(spark: SparkSession, sf: str) -> DataFrame:
    paged = B.pages(B.read(spark, sf, "documents"))
    return search.search_pages(paged, B.blocks(paged), QUERY, scope=_SCOPE)


def _txt(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_blocks(B.text_boxes(B.read(spark, sf, "conversations")), QUERY, "TEXT", scope=_SCOPE)


def _hw(spark: SparkSession, sf: str) -> DataFrame:
    notes = B.read(spark, sf, "benchmark").select(F.lit("notes").alias("fingerprint"), F.col("item_id").cast("int").alias("page_index"), F.lit(0).alias("ord"), "text", F.lit(None).cast(B.RECT).alias("rect"))
    return search.search_blocks(notes, QUERY, "HANDWRITING", scope=_SCOPE)


@query(f"WITH {_PAGES}, {_BLOCKS}, {_PDF} SELECT {_HIT} FROM pdf")
def search_pdf(spark, sf):
    return _pdf(spark, sf).drop("query", "rect")


@query(f"WITH {_TEXT} SELECT {_HIT} FROM txt")
def search_text(spark, sf):
    return _txt(spark, sf).drop("query", "rect")


@query(f"WITH {_HAND} SELECT {_HIT} FROM hw")
def search_handwriting(spark, sf):
    return _hw(spark, sf).drop("query", "rect")


@query(
    f"WITH {_PAGES}, {_BLOCKS}, {_PDF}, {_TEXT}, {_HAND}, u AS (SELECT * FROM pdf UNION ALL SELECT * FROM txt UNION ALL SELECT * FROM hw) "
    f"SELECT {_HIT}, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY page_index, source_ord, hit_ord) AS INTEGER) AS rank FROM u"
)
def search_unified(spark, sf):
    return search.unified(_pdf(spark, sf), _txt(spark, sf), _hw(spark, sf), scope=_SCOPE).drop("query", "rect")


def _phrases(spark, sf) -> DataFrame:
    """The first two words of every benchmark item."""
    words = F.split("text", " ")
    return B.read(spark, sf, "benchmark").select(F.lower(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))).alias("query")).distinct()


@query(
    f"WITH {_PAGES}, {_BLOCKS}, q AS (SELECT DISTINCT lower(list_extract(string_split(text, ' '), 1) || ' ' || list_extract(string_split(text, ' '), 2)) AS phrase FROM benchmark) "
    "SELECT phrase, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT fingerprint) AS BIGINT) AS books FROM b JOIN q ON strpos(lower(b.text), phrase) > 0 GROUP BY phrase"
)
def search_batch_phrases(spark, sf):
    index = textindex.open_index(spark, shared_folder(spark, "index"))
    paged = index.kept(B.pages(B.read(spark, sf, "documents")))
    textindex.refresh(index, paged.select("fingerprint", "page_index", F.lit(0).alias("revision")), B.blocks(paged))
    hits = textindex.find(index, _phrases(spark, sf))
    return hits.groupBy(F.col("query").alias("phrase")).agg(F.count("*").alias("hits"), F.countDistinct("fingerprint").alias("books"))


_EDITED = "p2 AS (SELECT fingerprint, page_index, CASE WHEN doc_id % 5 = 0 THEN reverse(text) || chr(10) || 'of the ' || upper(substring(text, 1, 200)) ELSE text END AS text FROM p WHERE doc_id % 7 <> 0)"


@query(
    f"WITH {_PAGES}, {_EDITED}, {_BLOCKS.replace('FROM p)', 'FROM p2)')}, q AS (SELECT DISTINCT lower(list_extract(string_split(text, ' '), 1) || ' ' || list_extract(string_split(text, ' '), 2)) AS phrase FROM benchmark UNION SELECT unnest(['of the', 'f t', 'th'])) "
    "SELECT phrase, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT fingerprint || '-' || page_index) AS BIGINT) AS pages FROM b JOIN q ON strpos(lower(b.text), phrase) > 0 GROUP BY phrase"
)
def search_refreshed(spark, sf):
    """An index brought up to date after edits and deletions of pages."""
    docs = B.read(spark, sf, "documents")
    index = textindex.open_index(spark, shared_folder(spark, "index"))
    paged = B.pages_in_place(docs, index.kept)
    revised = lambda rows: rows.select("fingerprint", "page_index", F.xxhash64("text").alias("revision"))
    textindex.refresh(index, revised(paged), B.blocks(paged))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.reverse("text"), F.lit("\nof the "), T.upper(F.substring("text", 1, 200)))).otherwise(F.col("text"))
    edited = paged.filter("doc_id % 7 <> 0").withColumn("text", text)
    textindex.refresh(index, revised(edited), B.blocks(edited))
    more = spark.createDataFrame([("of the",), ("f t",), ("th",)], "query string")
    hits = textindex.find(index, _phrases(spark, sf).union(more).distinct())
    pages = hits.groupBy(F.col("query").alias("phrase"), "fingerprint", "page_index").agg(F.count("*").alias("hits"))
    return pages.groupBy("phrase").agg(F.sum("hits").alias("hits"), F.count("*").alias("pages"))


@query("SELECT conv_id, CAST(n AS BIGINT) AS hits, CAST((n + 2) % n AS BIGINT) AS cursor FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def hit_cursor(spark, sf):
    n = B.read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("hits"))
    return n.withColumn("cursor", search.cursor(F.col("hits") + 2, F.col("hits")))


# ---------------------------------------------------------------- text


@query(
    f"SELECT page_id, md5(t) AS digest, length(t) AS n FROM (SELECT page_id, translate(trim(regexp_replace(regexp_replace(html, '\\p{{Cf}}+', '', 'g'), '[\\p{{Cc}}\\p{{Z}}\\s]+', ' ', 'g')), '{T.TRADITIONAL}', '{T.SIMPLIFIED}') AS t FROM pages)"
)
def normalise_search_layer(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", T.search_layer("html").alias("t")).select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def sanitise_lines(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", F.md5(T.sanitize("text")).alias("digest"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{Hangul}') THEN 'korean' WHEN regexp_matches(text, '[\\p{Hiragana}\\p{Katakana}]') THEN 'japanese' WHEN regexp_matches(text, '\\p{Han}') THEN 'chinese' ELSE 'unicode' END AS script, regexp_full_match(text, '[ -~\\s\\p{Cf}]*') AS ascii FROM documents")
def detect_script(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", T.script("text").alias("script"), T.is_standard_ascii("text").alias("ascii"))


@query(
    "SELECT doc_id, CASE WHEN v < 1024 THEN CAST(v AS VARCHAR) || ' B' WHEN v < 1048576 THEN printf('%.1f KB', round(v / 1024.0, 1)) WHEN v < 1073741824 THEN printf('%.1f MB', round(v / 1048576.0, 1)) ELSE printf('%.2f GB', round(v / 1073741824.0, 2)) END AS size "
    "FROM (SELECT doc_id, n_chars * n_chars AS v FROM documents)"
)
def size_format(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", T.byte_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


_BASE = "CASE WHEN s = '' THEN 'document' ELSE substring(s, 1, 85) END"


@query(
    f"WITH n AS (SELECT page_id, {_BASE} AS base FROM (SELECT page_id, trim(regexp_replace(regexp_replace(url, '\\.[^.]*$', ''), '[\\\\/:*?\"<>|\\x00-\\x1F\\x7F]', '_', 'g')) AS s FROM pages)), "
    "r AS (SELECT page_id, base, row_number() OVER (PARTITION BY lower(base) ORDER BY page_id) AS n FROM n) "
    "SELECT page_id, base || '_OCR' || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.pdf' AS name FROM r"
)
def output_names(spark, sf):
    rows = B.read(spark, sf, "pages").select("page_id", T.output_base("url").alias("base"))
    n = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("page_id"))
    return rows.withColumn("n", n).select("page_id", T.output_name("base", F.col("n")).alias("name"))


@query("SELECT page_id, substring(sha256(url || '|' || CAST(length(html) AS VARCHAR) || '|' || CAST(page_id AS VARCHAR)), 1, 32) AS job_id FROM pages")
def job_ids(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", T.job_id("url", F.length("html"), "page_id").alias("job_id"))


@query("SELECT page_id, CASE WHEN n BETWEEN 1 AND 500 THEN n END AS page FROM (SELECT page_id, TRY_CAST(substring(regexp_replace(url, '[^0-9]', '', 'g'), 1, 6) AS INTEGER) AS n FROM pages)")
def page_jump(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", T.page_jump("url", 500).alias("page"))


@query("SELECT event_id, len(list_distinct([event_id % 7, event_id % 3, event_id % 2])) AS n FROM events")
def favourite_numbers(spark, sf):
    listed = F.concat_ws(",", *((F.col("event_id") % k).cast("string") for k in (7, 3, 2)), F.lit("x"), F.lit(""))
    return B.read(spark, sf, "events").select("event_id", F.size(T.parse_numbers(listed, "bigint")).cast("long").alias("n"))


# ---------------------------------------------------------------- library

_LIB = "l AS (SELECT o_orderkey AS ord, 'doc-' || o_orderkey AS fingerprint, epoch_ms(o_orderdate) AS last_opened_at, o_orderpriority = '1-URGENT' AS favorite, CAST(o_custkey AS VARCHAR) AS folder_id, CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) END AS trashed_at FROM orders)"


def _library(spark, sf):
    return B.library(B.read(spark, sf, "orders"))


def _ranked(rows: DataFrame, order) -> DataFrame:
    return rows.select("fingerprint", "folder_id", F.row_number().over(Window.partitionBy("folder_id").orderBy(*order)).alias("place"))


_RANK = "SELECT fingerprint, folder_id, CAST(row_number() OVER (PARTITION BY folder_id ORDER BY favorite DESC, last_opened_at DESC, ord) AS INTEGER) AS place FROM l WHERE "


@query(f"WITH {_LIB} {_RANK} trashed_at IS NULL")
def library_all(spark, sf):
    return _ranked(library.visible(_library(spark, sf)), library.library_order())


@query(f"WITH {_LIB} {_RANK} trashed_at IS NULL AND favorite")
def library_favourites(spark, sf):
    return _ranked(library.visible(_library(spark, sf), "FAVORITES", folder="1"), library.library_order())


@query(f"WITH {_LIB} {_RANK} trashed_at IS NULL AND folder_id = '7'")
def library_folder(spark, sf):
    return _ranked(library.visible(_library(spark, sf), folder="7"), library.library_order())


@query(f"WITH {_LIB} SELECT fingerprint, folder_id, CAST(row_number() OVER (PARTITION BY folder_id ORDER BY trashed_at DESC, ord) AS INTEGER) AS place FROM l WHERE trashed_at IS NOT NULL")
def library_trash(spark, sf):
    return _ranked(library.visible(_library(spark, sf), "TRASH"), [F.desc("trashed_at"), "ord"])


@query(f"WITH {_LIB} SELECT fingerprint, folder_id, CAST(row_number() OVER (PARTITION BY folder_id ORDER BY fingerprint = 'doc-7' DESC, last_opened_at DESC, ord) AS INTEGER) AS place FROM l WHERE trashed_at IS NULL")
def library_picker(spark, sf):
    return _ranked(library.live(_library(spark, sf)), library.picker_order("doc-7"))


@query(f"WITH {_LIB} SELECT fingerprint FROM l WHERE trashed_at IS NULL AND ord IN (SELECT l_orderkey FROM lineitem)")
def library_existing_files(spark, sf):
    files = B.read(spark, sf, "lineitem").select(F.concat(F.lit("doc-"), F.col("l_orderkey")).alias("fingerprint"))
    return library.live(_library(spark, sf), files).select("fingerprint")


@query(f"WITH {_LIB} SELECT fingerprint, folder_id, c_name AS folder_name FROM l LEFT JOIN customer ON folder_id = CAST(c_custkey AS VARCHAR)")
def folder_lookup(spark, sf):
    folders = B.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return library.with_folder(_library(spark, sf), folders).select("fingerprint", "folder_id", "folder_name")


@query(f"WITH {_LIB} SELECT fingerprint, CAST(c_custkey AS VARCHAR) AS folder_id FROM l LEFT JOIN customer ON folder_id = CAST(c_custkey AS VARCHAR) AND c_acctbal > 0")
def folder_fk_nullify(spark, sf):
    folders = B.read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return library.checked_folders(_library(spark, sf), folders).select("fingerprint", "folder_id")


@query("SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(n_name), n_nationkey) AS INTEGER) AS place FROM nation")
def folder_order(spark, sf):
    rows = B.read(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    return rows.select("n_nationkey", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(*library.folder_order())).alias("place"))


@query(
    f"WITH {_LIB} SELECT coalesce(l.fingerprint, i.f) AS fingerprint, CASE WHEN i.f IS NOT NULL THEN 5 ELSE last_opened_at END AS last_opened_at, trashed_at FROM l FULL JOIN (SELECT DISTINCT 'doc-' || (l_orderkey + 100) AS f FROM lineitem) i ON l.fingerprint = i.f"
)
def library_import(spark, sf):
    imports = B.read(spark, sf, "lineitem").select(F.concat(F.lit("doc-"), F.col("l_orderkey") + 100).alias("fingerprint"), F.lit(" ").alias("title")).distinct()
    return library.register(_library(spark, sf), imports, 5).select("fingerprint", "last_opened_at", "trashed_at")


@query(f"WITH {_PAGES}, gone AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0) SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM gone)")
def cascade_delete(spark, sf):
    docs = B.read(spark, sf, "documents")
    gone = docs.join(B.read(spark, sf, "labels").filter("toxic = 1 and quality = 0"), "doc_id").select(F.col("source").alias("fingerprint"))
    left = library.delete_permanently({"pages": B.pages(docs)}, gone)["pages"]
    return left.select("doc_id", F.col("fingerprint").alias("source"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_media(spark, sf):
    name = F.col("doc_id").cast("string").alias("file_name")
    media, used = B.read(spark, sf, "documents").select("doc_id", name), B.read(spark, sf, "labels").select(name)
    return library.unreferenced(media, used).select("doc_id")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS age_rank FROM orders QUALIFY age_rank <= 7")
def retention_top7(spark, sf):
    return library.newest(B.read(spark, sf, "orders"), 7, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "age_rank")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text), role) AS INTEGER) AS place FROM conversations")
def toc_order(spark, sf):
    return B.read(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.length("text"), "role")).alias("place"))


# ---------------------------------------------------------------- page edits

_BOX = "t AS (SELECT CAST(conv_id AS VARCHAR) AS fingerprint, CAST(turn AS INTEGER) AS page_index, role FROM conversations)"


def _boxes(spark, sf):
    return B.text_boxes(B.read(spark, sf, "conversations")).select("fingerprint", "page_index", "role")


@query(f"WITH {_BOX} SELECT fingerprint, CASE WHEN page_index > {PAGE} THEN page_index - 1 ELSE page_index END AS page_index, role FROM t WHERE page_index <> {PAGE}")
def page_delete(spark, sf):
    return P.delete_page(_boxes(spark, sf), PAGE)


@query(f"WITH {_BOX} SELECT fingerprint, CASE WHEN page_index > {PAGE} THEN page_index + 1 ELSE page_index END AS page_index, role FROM t UNION ALL SELECT fingerprint, page_index + 1, role FROM t WHERE page_index = {PAGE}")
def page_duplicate(spark, sf):
    return P.duplicate_page(_boxes(spark, sf), PAGE)


_MOVE = f"CASE WHEN {{0}} = {PAGE} THEN {TARGET} WHEN {{0}} > {PAGE} AND {{0}} <= {TARGET} THEN {{0}} - 1 ELSE {{0}} END"


@query(f"WITH {_BOX} SELECT fingerprint, {_MOVE.format('page_index')} AS page_index, role FROM t")
def page_move(spark, sf):
    return P.move_page(_boxes(spark, sf), PAGE, TARGET)


_LINK = "k AS (SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS fingerprint, CAST(turn AS INTEGER) AS source_page, CAST(turn + 1 AS INTEGER) AS target_page, least(0.06 + (turn % 8) * 0.065, 0.86) AS y FROM conversations)"


def _links(spark, sf):
    c = B.read(spark, sf, "conversations")
    y = F.least(F.lit(0.06) + (F.col("turn") % 8) * F.lit(0.065), F.lit(0.86))
    return c.select(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("fingerprint"), F.col("turn").cast("int").alias("source_page"), (F.col("turn") + 1).cast("int").alias("target_page"), y.alias("y"))


def _linked(links: DataFrame) -> DataFrame:
    return links.select("fingerprint", "source_page", "target_page", F.round("y", 6).alias("y"))


_K = "CASE WHEN {0} > %d THEN {0} %s 1 ELSE {0} END AS {0}"


@query(f"WITH {_LINK} SELECT fingerprint, {(_K % (PAGE, '-')).format('source_page')}, {(_K % (PAGE, '-')).format('target_page')}, CAST(round(y, 6) AS DOUBLE) AS y FROM k WHERE source_page <> {PAGE} AND target_page <> {PAGE}")
def links_delete(spark, sf):
    return _linked(P.links_delete(_links(spark, sf), PAGE))


@query(
    f"WITH {_LINK} SELECT fingerprint, {(_K % (PAGE, '+')).format('source_page')}, {(_K % (PAGE, '+')).format('target_page')}, CAST(round(y, 6) AS DOUBLE) AS y FROM k "
    f"UNION ALL SELECT fingerprint, {PAGE + 1}, {(_K % (PAGE, '+')).format('target_page')}, CAST(round(least(y + 0.02, 0.94), 6) AS DOUBLE) FROM k WHERE source_page = {PAGE}"
)
def links_duplicate(spark, sf):
    return _linked(P.links_duplicate(_links(spark, sf), PAGE))


@query(f"WITH {_LINK} SELECT fingerprint, {_MOVE.format('source_page')} AS source_page, {_MOVE.format('target_page')} AS target_page, CAST(round(y, 6) AS DOUBLE) AS y FROM k")
def links_move(spark, sf):
    return _linked(P.links_move(_links(spark, sf), PAGE, TARGET))




def _bookmarks(spark, sf):
    marked = B.pages(B.read(spark, sf, "documents")).join(B.read(spark, sf, "labels").filter("quality = 1"), "doc_id")
    return marked.groupBy("fingerprint").agg(F.array_sort(F.collect_set("page_index")).alias("marks"))


@query(f"WITH {_PAGES}, m AS (SELECT DISTINCT fingerprint, page_index FROM p JOIN labels USING (doc_id) WHERE quality = 1) SELECT fingerprint, CASE WHEN page_index > {PAGE} THEN page_index - 1 ELSE page_index END AS mark, CAST({_MOVE.format('page_index')} AS INTEGER) AS moved FROM m WHERE page_index <> {PAGE}")
def bookmarks_remap(spark, sf):
    rows = _bookmarks(spark, sf)
    kept = F.filter("marks", lambda m: m != PAGE)
    both = F.arrays_zip(P.bookmarks_delete(kept, PAGE).alias("mark"), F.transform(kept, lambda m: P.after_move(m, PAGE, TARGET)).alias("moved"))
    return rows.select("fingerprint", F.inline(both)).toDF("fingerprint", "mark", "moved")


@query(
    f"WITH {_PAGES} SELECT fingerprint, CAST(unnest(range(0, n)) AS INTEGER) AS page_index, CAST(unnest(CASE WHEN n > {TARGET} THEN list_concat(range(0, {PAGE}), list_concat(range({PAGE + 1}, {TARGET + 1}), list_concat([{PAGE}], range({TARGET + 1}, n)))) ELSE range(0, n) END) AS INTEGER) AS source_page "
    "FROM (SELECT fingerprint, count(*) AS n FROM p GROUP BY fingerprint)"
)
def page_order_map(spark, sf):
    books = B.pages(B.read(spark, sf, "documents")).groupBy("fingerprint").agg(F.count("*").cast("int").alias("page_count"))
    order = F.sequence(F.lit(0), F.col("page_count") - 1)
    moved = F.when(F.col("page_count") > TARGET, P.array_move(order, PAGE, TARGET))
    return P.order_map(books.withColumn("pdf_page_order", moved))


@query(f"WITH {_PAGES} SELECT fingerprint, page_index, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY abs(page_index - {ANCHOR}), page_index) AS INTEGER) AS turn FROM p")
def ocr_schedule(spark, sf):
    w = Window.partitionBy("fingerprint").orderBy(F.abs(F.col("page_index") - ANCHOR), "page_index")
    return B.pages(B.read(spark, sf, "documents")).select("fingerprint", "page_index", F.row_number().over(w).alias("turn"))


# ---------------------------------------------------------------- recognition jobs


def _done(spark, sf):
    return B.pages(B.read(spark, sf, "documents")).join(B.read(spark, sf, "labels").select("doc_id"), "doc_id").select("fingerprint", "page_index")


@query(f"WITH {_PAGES} SELECT fingerprint, page_index FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ocr_pending(spark, sf):
    return jobs.pending(B.pages(B.read(spark, sf, "documents")), _done(spark, sf)).select("fingerprint", "page_index")


@query(f"WITH {_PAGES} SELECT fingerprint, CAST(page_index // 16 AS INTEGER) AS batch, CAST(count(*) AS BIGINT) AS pages, CAST(5 + (min(page_index) * 87) // 1000 AS INTEGER) AS recognised, CAST(92 + (min(page_index) * 6) // 1000 AS INTEGER) AS exported FROM p GROUP BY ALL")
def batch_progress(spark, sf):
    rows = jobs.batches(B.pages(B.read(spark, sf, "documents"))).groupBy("fingerprint", "batch").agg(F.count("*").alias("pages"), F.min("page_index").alias("first"))
    return rows.select("fingerprint", "batch", "pages", jobs.recognition_progress(F.col("first"), F.lit(1000)).alias("recognised"), jobs.export_progress(F.col("first"), F.lit(1000)).alias("exported"))


@query(f"WITH {_PAGES} SELECT fingerprint, page_index, doc_id NOT IN (SELECT doc_id FROM labels) OR (trim(text) <> '' AND doc_id % 2 = 1) AS needs_refresh FROM p")
def needs_refresh(spark, sf):
    paged = B.pages(B.read(spark, sf, "documents"))
    recognised = paged.join(B.read(spark, sf, "labels").select("doc_id"), "doc_id")
    blocks = recognised.filter("doc_id % 2 = 0")
    return jobs.needs_refresh(paged, recognised, blocks).select("fingerprint", "page_index", "needs_refresh")


@query(
    "SELECT page_id, CASE WHEN w > 0 THEN greatest(1, CAST(trunc(w * s) AS INTEGER)) ELSE 1 END AS width, CASE WHEN w > 0 THEN greatest(1, CAST(trunc(h * s) AS INTEGER)) ELSE 1 END AS height FROM "
    "(SELECT page_id, w, h, least(greatest(least(CAST(2200 AS DOUBLE) / greatest(w, h), sqrt(CAST(4500000 AS DOUBLE) / (CAST(w AS DOUBLE) * h))), 0.001), 4.0) AS s FROM (SELECT page_id, CAST(length(html) AS INTEGER) AS w, CAST(length(url) * 10 AS INTEGER) AS h FROM pages))"
)
def raster_sizes(spark, sf):
    rows = B.read(spark, sf, "pages").select("page_id", F.length("html").alias("w"), (F.length("url") * 10).alias("h"))
    return rows.select("page_id", jobs.raster_size(F.col("w"), F.col("h"), 2200).alias("s")).select("page_id", "s.width", "s.height")


@query("SELECT event_type, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, event_type, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS f FROM events)) GROUP BY event_type, run")
def font_runs(spark, sf):
    chars = B.read(spark, sf, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("ord"), F.col("event_type").alias("font"), F.lit("x").alias("ch"))
    runs = jobs.font_runs(chars)
    return runs.groupBy(F.col("font").alias("event_type"), F.col("run").cast("long").alias("run")).agg(F.sum(F.length("text")).alias("n"))


# ---------------------------------------------------------------- ink

_PT = "SELECT label AS page_index, vec_id AS ord, unnest(range(0, len(embedding) // 2)) AS pt, embedding FROM embeddings"
_XY = f"e AS (SELECT page_index, ord, pt, least(greatest(CAST(embedding[2 * pt + 1] AS DOUBLE) + 0.55, 0.0), 1.0) AS x, least(greatest(CAST(embedding[2 * pt + 2] AS DOUBLE) + 0.55, 0.0), 1.0) AS y FROM ({_PT}))"


def _strokes(spark, sf):
    return B.strokes(B.read(spark, sf, "embeddings"))


@query(f"WITH {_XY} SELECT page_index, ord, round(min(x), 6) AS l, round(min(y), 6) AS t, round(max(x), 6) AS r, round(max(y), 6) AS b FROM e GROUP BY page_index, ord")
def stroke_bounds(spark, sf):
    b = _strokes(spark, sf).select("page_index", "ord", G.bounds("points").alias("b"))
    return b.select("page_index", "ord", *(F.round(f"b.{n}", 6).alias(n[0]) for n in ("left", "top", "right", "bottom")))


_SEG = f"{_XY}, s AS (SELECT page_index, ord, pt, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS speed FROM e WINDOW w AS (PARTITION BY ord ORDER BY pt))"


@query(f"WITH {_SEG} SELECT page_index, ord, CAST(count(speed) AS BIGINT) AS n, round(sum(speed), 5) AS length FROM s GROUP BY page_index, ord")
def segment_speed(spark, sf):
    return ink.segments(_strokes(spark, sf)).groupBy("page_index", "ord").agg(F.count("speed").alias("n"), F.round(F.sum("speed"), 5).alias("length"))


@query(
    f"WITH {_SEG} SELECT page_index, ord, round(avg(least(greatest(2.0 * (0.48 + 0.9 * pow(0.5, 0.58)) * (1 - least(greatest(speed / 3.0, 0), 0.24)), 0.72), 4.2)), 5) AS fountain, round(avg(least(greatest(2.0 * (0.58 + 0.5 * 0.34), 0.55), 3.6)), 5) AS pencil FROM s WHERE speed IS NOT NULL GROUP BY page_index, ord"
)
def pen_width(spark, sf):
    s = ink.segments(_strokes(spark, sf)).filter("speed is not null")
    w = lambda brush: F.round(F.avg(G.pen_width(F.lit(brush), F.lit(2.0), F.lit(False), F.col("pressure_before"), F.col("pressure"), F.col("speed"))), 5).alias(brush.lower())
    return s.groupBy("page_index", "ord").agg(w("FOUNTAIN"), w("PENCIL"))


def _inside(x: str, y: str) -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(POLYGON, [POLYGON[-1], *POLYGON[:-1]], strict=True):
        parts.append(f"CAST((({ay} > {y}) <> ({by} > {y})) AND ({x} < CAST({bx - ax!r} AS DOUBLE) * ({y} - {ay}) / CAST({by - ay!r} AS DOUBLE) + {ax}) AS INTEGER)")
    return f"({' + '.join(parts)}) % 2 = 1"


@query(f"WITH {_XY}, g AS (SELECT page_index, ord, bool_or({_inside('x', 'y')}) AS any_in, (min(x) + max(x)) * 0.5 AS cx, (min(y) + max(y)) * 0.5 AS cy FROM e GROUP BY page_index, ord) SELECT page_index, ord FROM g WHERE any_in OR {_inside('cx', 'cy')}")
def lasso_select(spark, sf):
    return ink.lasso(_strokes(spark, sf), POLYGON).select("page_index", "ord")


_HITTEST = f"((x - {ERASER[0]}) / CAST({ERASER[2]} AS DOUBLE)) ** 2 + ((y - {ERASER[1]}) / CAST({ERASER[3]} AS DOUBLE)) ** 2 <= 1"


@query(f"WITH {_XY} SELECT page_index, ord FROM e GROUP BY page_index, ord HAVING NOT bool_or({_HITTEST})")
def stroke_erase(spark, sf):
    return ink.erase_strokes(_strokes(spark, sf), *ERASER).select("page_index", "ord")


@query(
    f"WITH {_XY}, h AS (SELECT *, {_HITTEST} AS hit FROM e), i AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY ord ORDER BY pt) AS g FROM h) "
    "SELECT page_index, ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY g) - 1 AS INTEGER) AS island, n FROM (SELECT page_index, ord, g, CAST(count(*) AS INTEGER) AS n FROM i WHERE NOT hit GROUP BY page_index, ord, g)"
)
def pixel_erase_islands(spark, sf):
    return ink.erase_pixels(_strokes(spark, sf), *ERASER).select("page_index", "ord", "island", F.size("points").alias("n"))


_PAGE_BOX = "pb AS (SELECT page_index, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM e GROUP BY page_index)"


def _mean(strokes: DataFrame) -> DataFrame:
    return ink.exploded(strokes.select("fingerprint", "page_index", "ord", "points")).groupBy("page_index", "ord").agg(F.round(F.avg("x"), 6).alias("mx"), F.round(F.avg("y"), 6).alias("my"))


@query(
    f"WITH {_XY}, {_PAGE_BOX}, c AS (SELECT page_index, (greatest(l - 0.012, 0) + least(r + 0.012, 1)) * 0.5 AS cx, (greatest(t - 0.012, 0) + least(b + 0.012, 1)) * 0.5 AS cy FROM pb) "
    "SELECT page_index, ord, round(avg(least(greatest(cx + (x - cx) * 1.25, 0), 1)), 6) AS mx, round(avg(least(greatest(cy + (y - cy) * 1.25, 0), 1)), 6) AS my FROM e JOIN c USING (page_index) GROUP BY page_index, ord"
)
def stroke_scale(spark, sf):
    return _mean(ink.scale(_strokes(spark, sf), 1.25))


@query(
    f"WITH {_XY}, {_PAGE_BOX}, d AS (SELECT page_index, least(greatest(0.1, -l), 1 - r) AS dx, least(greatest(-0.05, -t), 1 - b) AS dy FROM pb) "
    "SELECT page_index, ord, round(avg(least(greatest(x + dx, 0), 1)), 6) AS mx, round(avg(least(greatest(y + dy, 0), 1)), 6) AS my FROM e JOIN d USING (page_index) GROUP BY page_index, ord"
)
def stroke_move(spark, sf):
    return _mean(ink.move(_strokes(spark, sf), 0.1, -0.05))


@query(
    f"WITH {_XY}, k AS (SELECT page_index, max(ord) AS top FROM e GROUP BY page_index), n AS (SELECT page_index, ord, row_number() OVER (PARTITION BY page_index ORDER BY ord) AS rn FROM (SELECT DISTINCT page_index, ord FROM e)), "
    "a AS (SELECT page_index, ord, x, y FROM e UNION ALL SELECT e.page_index, top + rn, least(greatest(x + 0.025, 0), 1), least(greatest(y + 0.025, 0), 1) FROM e JOIN k USING (page_index) JOIN n USING (page_index, ord)) "
    "SELECT page_index, ord, round(avg(x), 6) AS mx, round(avg(y), 6) AS my FROM a GROUP BY page_index, ord"
)
def stroke_duplicate(spark, sf):
    s = _strokes(spark, sf)
    return _mean(ink.duplicate(s, s))


_HEIGHT = f"greatest(greatest(q.b - q.t, CAST({ink.LINE_HEIGHTS[0]} AS DOUBLE)), greatest(n.b - n.t, CAST({ink.LINE_HEIGHTS[1]} AS DOUBLE)))"
#: Strokes join the nearest fitting line one after the other.
_LINES = f"""{_XY},
    sb AS (SELECT page_index, ord, greatest(min(x) - 0.008, 0.0) AS l, greatest(min(y) - 0.012, 0.0) AS t, least(max(y) + 0.012, 1.0) AS b, row_number() OVER (PARTITION BY page_index ORDER BY ord) AS i FROM e GROUP BY page_index, ord),
    g AS (
        SELECT page_index, i, ord, l, t, b, 1 AS line, [{{'t': t, 'b': b}}] AS lines FROM sb WHERE i = 1
        UNION ALL
        SELECT page_index, i, ord, l, t, b, CAST(coalesce(pick, len(lines) + 1) AS INTEGER),
               CASE WHEN pick IS NULL THEN list_append(lines, {{'t': t, 'b': b}}) ELSE list_transform(lines, lambda q, k: CASE WHEN k = pick THEN {{'t': least(q.t, t), 'b': greatest(q.b, b)}} ELSE q END) END
        FROM (SELECT n.page_index, n.i, n.ord, n.l, n.t, n.b, g.lines,
                     list_sort(list_filter(list_transform(g.lines, lambda q, k: {{'away': abs((n.t + n.b - q.t - q.b) / 2), 'k': k,
                         'fits': least(q.b, n.b) - greatest(q.t, n.t) > {ink.LINE_OVERLAP} OR abs((n.t + n.b - q.t - q.b) / 2) <= greatest(CAST({ink.LINE_REACH} AS DOUBLE), CAST({ink.LINE_SHARE} AS DOUBLE) * {_HEIGHT})}}), lambda z: z.fits))[1].k AS pick
              FROM g JOIN sb n ON n.page_index = g.page_index AND n.i = g.i + 1)),
    corner AS (SELECT page_index, line, CAST(row_number() OVER (PARTITION BY page_index ORDER BY min(t), arg_min(l, l), line) - 1 AS INTEGER) AS place FROM g GROUP BY page_index, line)"""


@query(f"WITH RECURSIVE {_LINES} SELECT page_index, ord, corner.place AS line, CAST(row_number() OVER (PARTITION BY page_index, line ORDER BY ord) - 1 AS INTEGER) AS place FROM g JOIN corner USING (page_index, line)")
def line_clusters(spark, sf):
    return ink.line_clusters(_strokes(spark, sf)).drop("fingerprint")


@query(
    f"""WITH RECURSIVE {_XY}, q AS (SELECT page_index, ord, pt, x * 1000 AS px, y * 1400 AS py, pt * 8 AS ms FROM e),
    r AS (
        SELECT page_index, ord, pt, px AS sx, py AS sy, px AS rx, py AS ry, CAST(0.5 AS DOUBLE) AS sp, CAST(0 AS DOUBLE) AS v, ms, true AS keep, least(greatest(px / 1000, 0), 1) AS lx, least(greatest(py / 1400, 0), 1) AS ly, CAST(0.5 AS DOUBLE) AS lp FROM q WHERE pt = 0
        UNION ALL
        SELECT page_index, ord, pt, sx, sy, px, py, sp, v, ms, keep, CASE WHEN keep THEN nx ELSE lx END, CASE WHEN keep THEN ny ELSE ly END, CASE WHEN keep THEN np ELSE lp END FROM (
            SELECT *, abs(lx - nx) > 0.00002 OR abs(ly - ny) > 0.00002 OR abs(lp - np) > 0.004 AS keep FROM (
                SELECT *, least(greatest(sx / 1000, 0), 1) AS nx, least(greatest(sy / 1400, 0), 1) AS ny, least(greatest(sp, 0.01), 1) AS np FROM (
                    SELECT page_index, ord, pt, px, py, ms, v, lx, ly, lp, bx + (px - bx) * alpha AS sx, bh + (py - bh) * alpha AS sy, bp + (0.5 - bp) * CAST(0.38 AS DOUBLE) AS sp FROM (
                        SELECT *, CAST(0.42 AS DOUBLE) + least(greatest(v / CAST(1.9 AS DOUBLE), 0), 1) * CAST(0.36 AS DOUBLE) AS alpha FROM (
                            SELECT q.page_index, q.ord, q.pt, q.px, q.py, q.ms, r.lx, r.ly, r.lp, r.sx AS bx, r.sy AS bh, r.sp AS bp,
                                   r.v + (sqrt((q.px - r.rx) ** 2 + (q.py - r.ry) ** 2) / greatest(q.ms - r.ms, 1) - r.v) * CAST(0.32 AS DOUBLE) AS v
                            FROM r JOIN q ON q.page_index = r.page_index AND q.ord = r.ord AND q.pt = r.pt + 1))))))
    SELECT page_index, ord, CAST(row_number() OVER (PARTITION BY page_index, ord ORDER BY pt) - 1 AS INTEGER) AS place, round(lx, 5) AS x, round(ly, 5) AS y, round(lp, 5) AS pressure, CAST(ms AS BIGINT) AS time_ms FROM r WHERE keep"""
)
def ink_smooth(spark, sf):
    s = _strokes(spark, sf).withColumn("points", F.transform("points", lambda p: F.struct((p.x * 1000).alias("x"), (p.y * 1400).alias("y"), p.pressure.alias("pressure"), (p.time_ms * 8).alias("time_ms"))))
    points = s.select("page_index", "ord", F.posexplode(G.smoothed("points", 1000.0, 1400.0)).alias("place", "p"))
    return points.select("page_index", "ord", "place", *(F.round(f"p.{c}", 5).alias(c) for c in ("x", "y", "pressure")), F.col("p.time_ms").alias("time_ms"))


# ---------------------------------------------------------------- ledger and events


def _events(spark, sf):
    return ledger.with_event_columns(B.task_events(B.read(spark, sf, "events")).withColumn("status", F.lit(None).cast("string")), F.lit("task-0"))


_TASK = "{{'status': {status}, 'quality': {quality}, 'progress': {progress}, 'crashes': {crashes}, 'crashed': {crashed}}}"


def _task(status="x.status", quality="x.quality", progress="x.progress", crashes="x.crashes", crashed="x.crashed") -> str:
    return _TASK.format(status=status, quality=quality, progress=progress, crashes=crashes, crashed=crashed)


_STRIKE = f"least(CASE WHEN x.crashed > 0 AND ms - x.crashed BETWEEN 0 AND {ledger.CRASH_GAP_MS} THEN x.crashes ELSE 0 END + 1, {ledger.CRASHES})"
#: Each user's events drive the tasks of one queue; all tasks have one name, so pauses and ends are about the first.
_QUEUES = f"""
    ev AS (SELECT CAST(user_id AS VARCHAR) AS queue, event_type AS kind, epoch_ns(ts) // 1000000 AS ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    qs AS (
        SELECT DISTINCT queue, CAST(0 AS BIGINT) AS i, [{_task("CAST('' AS VARCHAR)", "CAST(0 AS INTEGER)", "CAST(0 AS INTEGER)", "CAST(0 AS INTEGER)", "CAST(0 AS BIGINT)")}][1:0] AS tasks FROM ev
        UNION ALL
        SELECT ev.queue, ev.i, CASE kind
            WHEN 'signup' THEN list_append(tasks, {_task("'waiting'", "CAST(CASE WHEN k = 0 THEN 2200 ELSE least(greatest(k, 1200), 3200) END AS INTEGER)", "CAST(0 AS INTEGER)", "CAST(0 AS INTEGER)", "CAST(0 AS BIGINT)")})
            WHEN 'view' THEN CASE WHEN len(list_filter(tasks, lambda x: x.status IN ('running', 'pausing', 'cancelling'))) > 0 THEN tasks
                ELSE list_transform(tasks, lambda x, n: CASE WHEN n = list_position(list_transform(tasks, lambda y: y.status), 'waiting') THEN {_task("'running'")} ELSE x END) END
            WHEN 'click' THEN list_transform(tasks, lambda x, n: CASE WHEN n = 1 AND x.status IN ('running', 'waiting') THEN {_task("CASE x.status WHEN 'running' THEN 'pausing' ELSE 'paused' END")} ELSE x END)
            WHEN 'purchase' THEN list_transform(tasks, lambda x, n: CASE WHEN n > 1 THEN x WHEN x.status = 'pausing' THEN {_task("'paused'", crashes="CAST(0 AS INTEGER)", crashed="CAST(0 AS BIGINT)")} ELSE {_task("'done'", progress="CAST(100 AS INTEGER)", crashes="CAST(0 AS INTEGER)", crashed="CAST(0 AS BIGINT)")} END)
            ELSE list_transform(tasks, lambda x: CASE x.status WHEN 'pausing' THEN {_task("'paused'", crashes="CAST(0 AS INTEGER)", crashed="CAST(0 AS BIGINT)")}
                WHEN 'running' THEN {_task(f"CASE WHEN {_STRIKE} = {ledger.CRASHES} THEN 'failed' ELSE 'waiting' END", crashes=f"CAST({_STRIKE} AS INTEGER)", crashed="CAST(ms AS BIGINT)")} ELSE x END) END
        FROM qs JOIN ev ON ev.queue = qs.queue AND ev.i = qs.i + 1),
    ls AS (SELECT queue, unnest(tasks) AS x, unnest(range(0, len(tasks))) AS ord FROM (SELECT * FROM qs QUALIFY row_number() OVER (PARTITION BY queue ORDER BY i DESC) = 1))"""


@query(
    f"WITH RECURSIVE {_QUEUES} SELECT queue, CAST(ord AS INTEGER) AS ord, 'task-0' AS task, x.status AS status, x.quality AS quality, CAST(0 AS INTEGER) AS page, x.progress AS progress, false AS paused_by_global, x.crashes AS crashes, x.crashed AS crashed_at, false AS paused_all FROM ls"
)
def queue_final_state(spark, sf):
    """Each user's events drive the tasks of one queue."""
    return ledger.final_states(_events(spark, sf))


@query(
    f"WITH RECURSIVE {_QUEUES} SELECT count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE x.status IN ({', '.join(repr(v) for v in states)})) AS {name}" for name, states in (("running", ledger.ACTIVE), *((v, (v,)) for v in ("waiting", "paused", "done", "failed", "cancelled"))))
    + " FROM ls"
)
def queue_counts(spark, sf):
    return ledger.counters(ledger.final_states(_events(spark, sf)))


@query(
    "WITH c AS (SELECT CAST(user_id AS VARCHAR) AS queue, event_id AS seq, (epoch_ns(ts) // 1000000) AS ms FROM events WHERE event_type = 'error'), "
    "n AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY queue ORDER BY ms, seq) <= 3600000 THEN 0 ELSE 1 END AS f FROM c), "
    "r AS (SELECT *, sum(f) OVER (PARTITION BY queue ORDER BY ms, seq) AS run FROM n) "
    "SELECT queue, seq, ms AS \"at\", CAST(row_number() OVER (PARTITION BY queue, run ORDER BY ms, seq) AS INTEGER) AS strike FROM r"
)
def crash_strikes(spark, sf):
    return ledger.crash_strikes(_events(spark, sf))


@query("SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS queue FROM (SELECT *, lead((epoch_ns(ts) // 1000000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR nx - (epoch_ns(ts) // 1000000) >= 3600000")
def debounce_fires(spark, sf):
    return queues.debounced(_events(spark, sf), 3_600_000, ["queue"]).select("seq", "queue")


@query(
    "WITH j AS (SELECT CAST(user_id AS VARCHAR) AS key, (epoch_ns(ts) // 1000000) AS ms, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS page_index FROM events), "
    "f AS (SELECT * FROM (SELECT *, lag(page_index) OVER (PARTITION BY key ORDER BY ms, seq) AS before FROM j) WHERE before IS NULL OR before <> page_index) "
    "SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS INTEGER) AS place, page_index FROM f QUALIFY place <= 20"
)
def jump_history(spark, sf):
    e = _events(spark, sf).select(F.col("queue").alias("key"), "at", "seq", F.col("page").alias("page_index"))
    return queues.jump_history(e)


# ---------------------------------------------------------------- storage


def _files(spark, sf):
    p = B.read(spark, sf, "pages")
    kind = F.col("page_id") % 5
    # Every page is a folder of its own: urls repeat, and ids may have more digits than a UUID's last group.
    digits = F.lpad(F.hex("page_id"), 16, "0")
    stranger = F.concat(F.lit("queue-00000000-0000-0000-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 12))
    name = F.when(kind == 0, F.concat(F.lit("queue-"), F.col("page_id"))).when(kind == 1, F.md5(F.concat_ws("|", "page_id", "url"))).when(kind == 2, stranger).otherwise(F.concat(F.lit("file-"), F.col("page_id")))
    root = F.when(kind == 4, "fonts").otherwise("cache")
    return p.select(root.alias("root"), name.alias("top_name"), F.length("html").cast("long").alias("bytes"), (kind != 3).alias("is_dir"), F.lit(False).alias("is_symlink"), "page_id")


@query(
    "WITH c AS (SELECT CASE page_id % 5 WHEN 0 THEN 'job' WHEN 1 THEN 'legacy' WHEN 2 THEN 'orphan' WHEN 4 THEN 'font' ELSE 'other' END AS class, length(html) AS bytes FROM pages) "
    "SELECT class, CAST(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY class UNION ALL SELECT 'work', CAST(sum(bytes) AS BIGINT) FROM c WHERE class <> 'font' UNION ALL SELECT 'total', CAST(sum(bytes) AS BIGINT) FROM c"
)
def cache_totals(spark, sf):
    files = _files(spark, sf)
    tasks = B.read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("task"))
    return storage.totals(storage.classify(files, tasks))


@query("SELECT newest, newest IS NULL OR 1000000000000 - newest >= 86400000 AS due FROM (SELECT max(epoch_ms(o_orderdate)) FILTER (WHERE o_orderpriority = '1-URGENT') AS newest FROM orders)")
def backup_due(spark, sf):
    rows = _library(spark, sf).select(F.col("favorite").alias("automatic"), F.col("last_opened_at").alias("modified_at"))
    return storage.backup_due(rows, 1_000_000_000_000)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'doc-' || o_orderkey) AS r FROM orders) WHERE r > 7")
def backups_to_prune(spark, sf):
    rows = B.read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("modified_at"), F.concat(F.lit("doc-"), F.col("o_orderkey")).alias("file_name"), F.lit(True).alias("automatic"))
    return storage.pruned(rows, 7, ["o_custkey"]).select("o_custkey", "o_orderkey")


# These modules add their own queries.
from pagelake.plans import canvas, columns, edits, files, requests, shelf, upkeep  # noqa: E402, F401
