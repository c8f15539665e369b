"""Queries of page-edit logs: composed mappings, refused logs, one commit over all stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators import bindings as B
from pagelake.operators import pagelog
from pagelake.plans.registry import query
from pagelake.sources.stores import Stores, shared_folder

#: Events as edits: what each kind does.
OPS = {"purchase": "delete", "click": "duplicate", "view": "move", "signup": "append", "error": "template"}


def _log(spark, sf) -> DataFrame:
    """A user is a book, an event an edit of page k."""
    e = B.read(spark, sf, "events")
    op = F.create_map(*(F.lit(x) for pair in OPS.items() for x in pair))
    page = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").cast("string").alias("fingerprint"), F.col("event_id").alias("seq"), op[F.col("event_type")].alias("op"), page.alias("page"), ((page * 7 + F.col("event_id")) % 100).cast("int").alias("target"), F.concat(F.lit("T"), F.col("event_id") % 3).alias("template"))


def _books(spark, sf, each: bool = True) -> DataFrame:
    """Books with a hundred pages and one for each edit, so that every edit has its page; else with sixty pages."""
    n = F.count("*") + 100 if each else F.lit(60)
    return B.read(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("fingerprint")).agg(n.cast("int").alias("page_count"))


_CASES = " ".join(f"WHEN '{kind}' THEN '{op}'" for kind, op in OPS.items())
_LOG = f"""lg AS (SELECT CAST(user_id AS VARCHAR) AS fp, event_id AS seq, CASE event_type {_CASES} END AS op, k AS page, CAST((k * 7 + event_id) % 100 AS INTEGER) AS target, 'T' || (event_id % 3) AS template,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
#: Every edit is done on the list of a book's pages, one after the other.
_STATES = f"""{_LOG},
    bk AS (SELECT fp, CAST(count(*) + 100 AS INTEGER) AS n FROM lg GROUP BY fp),
    st AS (
        SELECT fp, CAST(0 AS BIGINT) AS i, list_transform(range(0, n), lambda x: {{'s': CAST(x AS INTEGER), 'p': '', 't': CAST(NULL AS VARCHAR)}}) AS l,
               CAST(fp AS INTEGER) % 100 AS reader, n AS size FROM bk
        UNION ALL
        SELECT st.fp, lg.i,
               CASE op WHEN 'delete' THEN list_concat(l[1:page], l[page + 2:])
                       WHEN 'duplicate' THEN list_concat(list_append(l[1:page + 1], {{'s': l[page + 1].s, 'p': CASE WHEN l[page + 1].p = '' THEN CAST(seq AS VARCHAR) ELSE l[page + 1].p || '.' || seq END, 't': l[page + 1].t}}), l[page + 2:])
                       WHEN 'move' THEN list_concat(list_append(list_concat(l[1:page], l[page + 2:])[1:target], l[page + 1]), list_concat(l[1:page], l[page + 2:])[target + 1:])
                       WHEN 'append' THEN list_append(l, {{'s': CAST(NULL AS INTEGER), 'p': CAST(seq AS VARCHAR), 't': template}})
                       ELSE list_concat(list_append(l[1:page], {{'s': l[page + 1].s, 'p': l[page + 1].p, 't': template}}), l[page + 2:]) END,
               CASE op WHEN 'delete' THEN least(CASE WHEN reader > page THEN reader - 1 ELSE reader END, size - 2)
                       WHEN 'duplicate' THEN CASE WHEN reader > page THEN reader + 1 ELSE reader END
                       WHEN 'move' THEN CASE WHEN reader = page THEN target WHEN reader > page AND reader <= target THEN reader - 1 WHEN reader < page AND reader >= target THEN reader + 1 ELSE reader END
                       ELSE reader END,
               size + CASE op WHEN 'delete' THEN -1 WHEN 'duplicate' THEN 1 WHEN 'append' THEN 1 ELSE 0 END
        FROM st JOIN lg ON st.fp = lg.fp AND lg.i = st.i + 1),
    fin AS (SELECT fp, l, reader FROM st QUALIFY row_number() OVER (PARTITION BY fp ORDER BY i DESC) = 1),
    pg AS (SELECT fp, CAST(k AS INTEGER) AS page_index, l[k + 1].s AS source_page, l[k + 1].p AS path, l[k + 1].t AS template,
                  CAST(CASE WHEN l[k + 1].p = '' THEN 0 ELSE len(string_split(l[k + 1].p, '.')) END - CASE WHEN l[k + 1].s IS NULL THEN 1 ELSE 0 END AS INTEGER) AS copies
           FROM (SELECT fp, l, unnest(range(0, len(l))) AS k FROM fin))"""


@query(f"WITH RECURSIVE {_STATES} SELECT fp AS fingerprint, page_index, source_page, path, copies, template FROM pg")
def page_log_map(spark, sf):
    """Every page of every book after all its edits."""
    log, _ = pagelog.checked(_log(spark, sf), _books(spark, sf))
    return pagelog.page_list(pagelog.runs(pagelog.mappings(log), _books(spark, sf)))


@query(
    f"WITH {_LOG}, c AS (SELECT *, CAST(60 + coalesce(sum(CASE op WHEN 'delete' THEN -1 WHEN 'duplicate' THEN 1 WHEN 'append' THEN 1 ELSE 0 END) OVER (PARTITION BY fp ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM lg) "
    "SELECT fp AS fingerprint, seq, op, page, target, before FROM c WHERE CASE op WHEN 'append' THEN false WHEN 'delete' THEN page >= before OR before <= 1 WHEN 'move' THEN page >= before OR target >= before ELSE page >= before END "
    "QUALIFY row_number() OVER (PARTITION BY fp ORDER BY seq) = 1"
)
def page_log_refused(spark, sf):
    """The first edit that doesn't fit, of books that have sixty pages."""
    return pagelog.checked(_log(spark, sf), _books(spark, sf, each=False))[1]


def _stores(spark, sf) -> dict[str, DataFrame]:
    """Nine stores of those of books 0 to 99 that have events, from general tables."""
    item = lambda df, book, page, id_: df.select((F.col(book) % 100).cast("string").alias("fingerprint"), page.cast("int").alias("page_index"), F.col(id_).cast("long").alias("ord"), F.concat_ws("-", F.lit(id_), F.col(id_)).alias("id"))
    read = lambda name: B.read(spark, sf, name)
    turns = read("conversations").select((F.col("conv_id") % 100).cast("string").alias("fingerprint"), "conv_id", "turn", F.concat_ws("-", "conv_id", "turn", "role").alias("id"))
    books = _books(spark, sf).filter(F.col("fingerprint").cast("int") < 100)
    marks = read("labels").filter("quality = 1").select((F.col("doc_id") % 100).cast("string").alias("fingerprint"), (F.col("doc_id") * 3 % 100).cast("int").alias("m"))
    marks = marks.groupBy("fingerprint").agg(F.array_sort(F.collect_set("m")).alias("bookmarks"))
    stores = {
        "ink": item(read("embeddings"), "vec_id", F.col("label") * 11, "vec_id"),
        "text": turns.select("fingerprint", F.col("turn").cast("int").alias("page_index"), F.col("turn").cast("long").alias("ord"), "id"),
        "image": item(read("orders"), "o_orderkey", F.col("o_custkey") % 100, "o_orderkey"),
        "handwriting": item(read("pages"), "page_id", F.col("page_id") * 7 % 100, "page_id"),
        "ocr": item(read("documents"), "doc_id", F.col("n_chars") % 100, "doc_id"),
        "outline": item(read("supplier"), "s_suppkey", F.col("s_nationkey") * 4, "s_suppkey"),
        "navigation": turns.select("id", "fingerprint", F.col("turn").cast("int").alias("source_page"), ((F.col("turn") * 13 + F.col("conv_id")) % 100).cast("int").alias("target_page"), F.least(F.lit(0.06) + (F.col("turn") % 8) * F.lit(0.065), F.lit(0.86)).alias("y")),
        "pages": books.select("fingerprint", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page_index")).select("fingerprint", "page_index", (F.col("page_index") * 2).alias("source_page"), F.concat(F.lit("P"), F.col("page_index") % 4).alias("template")),
        "library": books.join(marks, "fingerprint", "left").select("fingerprint", "page_count", F.coalesce("bookmarks", F.array().cast("array<int>")).alias("bookmarks"), (F.col("fingerprint").cast("int") % 100).alias("last_page")),
    }
    return {name: rows.join(books.select("fingerprint"), "fingerprint", "left_semi") for name, rows in stores.items()}


def _summary(stores: dict[str, DataFrame]) -> DataFrame:
    """What each page holds: (store, fingerprint, page_index, n, low, high)."""
    shape = lambda name, page, low, high: stores[name].groupBy(F.lit(name).alias("store"), "fingerprint", F.col(page).cast("int").alias("page_index")).agg(F.count("*").alias("n"), F.min(low).cast("string").alias("low"), F.max(high).cast("string").alias("high"))
    parts = [shape(name, "page_index", "id", "id") for name in ("ink", "text", "image", "handwriting", "ocr", "outline")]
    y = F.floor(F.round(F.col("y") * 1000, 3) + 0.5).cast("int")
    parts += [shape("navigation", "source_page", "target_page", y), shape("navigation", "target_page", "id", "id"), shape("pages", "page_index", "source_page", "template")]
    library = stores["library"].withColumn("m", F.explode("bookmarks"))
    parts += [library.groupBy(F.lit("marks").alias("store"), "fingerprint", F.col("m").alias("page_index")).agg(F.count("*").alias("n"), F.min("last_page").cast("string").alias("low"), F.max("page_count").cast("string").alias("high"))]
    return reduce(DataFrame.unionByName, parts)


_ID = "CASE WHEN pg.path = '' THEN x.id ELSE substring(sha256('copy|' || pg.path || '|' || x.id), 1, 32) END"
_ITEM = "SELECT CAST({book} % 100 AS VARCHAR) AS fp, CAST({page} AS INTEGER) AS p, '{id}-' || {id} AS id FROM {table}"
_ITEMS = {
    "ink": _ITEM.format(book="vec_id", page="label * 11", id="vec_id", table="embeddings"),
    "text": "SELECT CAST(conv_id % 100 AS VARCHAR) AS fp, CAST(turn AS INTEGER) AS p, conv_id || '-' || turn || '-' || role AS id FROM conversations",
    "image": _ITEM.format(book="o_orderkey", page="o_custkey % 100", id="o_orderkey", table="orders"),
    "handwriting": _ITEM.format(book="page_id", page="page_id * 7 % 100", id="page_id", table="pages"),
    "ocr": _ITEM.format(book="doc_id", page="n_chars % 100", id="doc_id", table="documents"),
    "outline": _ITEM.format(book="s_suppkey", page="s_nationkey * 4", id="s_suppkey", table="supplier"),
}
_MOVED = " UNION ALL ".join(
    f"SELECT '{name}' AS store, fp AS fingerprint, page_index, count(*) AS n, min(id) AS low, max(id) AS high FROM (SELECT pg.fp, pg.page_index, {'x.id' if name == 'outline' else _ID} AS id FROM ({sql}) x JOIN pg ON x.fp = pg.fp AND x.p = pg.source_page{' AND pg.copies = 0' if name == 'outline' else ''}) GROUP BY ALL"
    for name, sql in _ITEMS.items()
)


@query(
    f"""WITH RECURSIVE {_STATES},
    li AS (SELECT CAST(conv_id % 100 AS VARCHAR) AS fp, conv_id || '-' || turn || '-' || role AS id, CAST(turn AS INTEGER) AS s, CAST((turn * 13 + conv_id) % 100 AS INTEGER) AS t, least(0.06 + (turn % 8) * 0.065, 0.86) AS y FROM conversations),
    nav AS (SELECT a.fp, a.page_index AS s, b.page_index AS t, CASE WHEN a.path = '' THEN x.id ELSE substring(sha256('copy|' || a.path || '|' || x.id), 1, 32) END AS id,
                   CAST(floor(round(CASE WHEN a.copies > 0 THEN least(CAST(y AS DOUBLE) + 0.02 * a.copies, 0.94) ELSE y END * 1000, 3) + 0.5) AS INTEGER) AS y
            FROM li x JOIN pg a ON x.fp = a.fp AND x.s = a.source_page JOIN pg b ON x.fp = b.fp AND x.t = b.source_page AND b.copies = 0),
    mk AS (SELECT DISTINCT CAST(doc_id % 100 AS VARCHAR) AS fp, CAST(doc_id * 3 % 100 AS INTEGER) AS m FROM labels WHERE quality = 1)
    SELECT store, fingerprint, page_index, CAST(n AS BIGINT) AS n, low, high FROM (
    {_MOVED}
    UNION ALL SELECT 'navigation', fp, s, count(*), CAST(min(t) AS VARCHAR), CAST(max(y) AS VARCHAR) FROM nav GROUP BY ALL
    UNION ALL SELECT 'navigation', fp, t, count(*), min(id), max(id) FROM nav GROUP BY ALL
    UNION ALL SELECT 'pages', fp, page_index, 1, CAST(source_page * 2 AS VARCHAR), coalesce(template, 'P' || (source_page % 4), 'BLANK') FROM pg WHERE CAST(fp AS INTEGER) < 100
    UNION ALL SELECT 'marks', pg.fp, pg.page_index, 1, CAST(reader AS VARCHAR), CAST(len(l) AS VARCHAR) FROM mk JOIN pg ON mk.fp = pg.fp AND mk.m = pg.source_page JOIN fin ON fin.fp = pg.fp)"""
)
def page_log_commit(spark, sf):
    """The edits of all books, done to nine stores in one commit, read back from it."""
    stores = Stores(spark, shared_folder(spark, "stores"))
    first = stores.edit()
    for name, rows in _stores(spark, sf).items():
        first.write(name, rows)
    first.commit()
    log = _log(spark, sf).filter(F.col("fingerprint").cast("int") < 100)
    version, _ = pagelog.apply_log(stores, log)
    return _summary({name: stores.read(name, version) for name in stores.tables(version)})
