"""Queries of halved export batches and of reference counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators import bindings as B
from pagelake.operators import halving, references
from pagelake.plans.registry import query
from pagelake.sources.stores import Stores, shared_folder

#: Letters that an export batch may hold.
BUDGET = 60_000
_PAGES = "p AS (SELECT source AS fingerprint, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page_index, length(coalesce(text, '')) AS weight FROM documents)"
#: Attempts one after the other: the total before each page tells what a batch weighs.
_ATTEMPTS = f"""{_PAGES},
    n AS (SELECT fingerprint, count(*) AS pages FROM p GROUP BY fingerprint),
    c AS (SELECT fingerprint, page_index AS k, sum(weight) OVER (PARTITION BY fingerprint ORDER BY page_index) - weight AS total FROM p UNION ALL SELECT fingerprint, count(*), sum(weight) FROM p GROUP BY fingerprint),
    a AS (
        SELECT n.fingerprint, 16 AS size, CAST(0 AS BIGINT) AS start, least(16, pages) AS stop, CAST(z.total AS BIGINT) AS weight, pages FROM n JOIN c z ON z.fingerprint = n.fingerprint AND z.k = least(16, pages)
        UNION ALL
        SELECT x.fingerprint, x.size, x.start, least(x.start + x.size, x.pages), CAST(z.total - y.total AS BIGINT), x.pages
        FROM (SELECT fingerprint, CASE WHEN weight <= {BUDGET} THEN size ELSE size // 2 END AS size, CASE WHEN weight <= {BUDGET} THEN stop ELSE start END AS start, pages FROM a) x
        JOIN c y ON y.fingerprint = x.fingerprint AND y.k = x.start JOIN c z ON z.fingerprint = x.fingerprint AND z.k = least(x.start + x.size, x.pages)
        WHERE x.size >= 1 AND x.start < x.pages)"""


def _attempts(spark, sf) -> DataFrame:
    pages = B.pages(B.read(spark, sf, "documents")).select("fingerprint", "page_index", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("weight"))
    keep = Stores(spark, shared_folder(spark, "halving")).kept
    return halving.attempts(keep(pages), BUDGET, keep=keep)


@query(f"WITH RECURSIVE {_ATTEMPTS} SELECT fingerprint, size, start, stop, weight, weight <= {BUDGET} AS committed FROM a")
def export_attempts(spark, sf):
    """Every batch that an export tries: half as large after each that is too heavy."""
    return _attempts(spark, sf)


@query(
    f"WITH RECURSIVE {_ATTEMPTS} SELECT fingerprint, CAST(sum(CASE WHEN weight <= {BUDGET} THEN stop - start ELSE 0 END) AS BIGINT) AS committed_pages, count(*) AS attempts, CAST(min(CASE WHEN weight > {BUDGET} AND size = 1 THEN start END) AS BIGINT) AS failed_page FROM a GROUP BY fingerprint"
)
def export_ends(spark, sf):
    """How far each book's export comes; a page that is too heavy by itself ends it."""
    return halving.ends(_attempts(spark, sf))


_CHANGES = "ch AS (SELECT event_id AS seq, event_id % 3 AS batch, CASE WHEN event_type IN ('purchase', 'error') THEN 'delete' ELSE 'put' END AS op, (user_id % 50) || '-' || (k % 10) AS id, 'f' || ((k * 7 + user_id) % 400) AS file FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"


@query(
    f"""WITH {_CHANGES},
    st AS (SELECT b.batch, id, arg_max(file, ch.batch * 1000000000000 + seq) AS file, arg_max(op, ch.batch * 1000000000000 + seq) AS op FROM range(0, 3) b(batch) JOIN ch ON ch.batch <= b.batch GROUP BY b.batch, id),
    cn AS (SELECT batch, file, count(*) AS n FROM st WHERE op = 'put' GROUP BY batch, file),
    al AS (SELECT f.file, b.batch, coalesce(cn.n, 0) AS n, coalesce(pr.n, 0) AS before, EXISTS (SELECT 1 FROM ch WHERE ch.batch = b.batch AND ch.file = f.file AND ch.op = 'put') AS named
           FROM (SELECT DISTINCT file FROM ch WHERE op = 'put') f CROSS JOIN range(0, 3) b(batch) LEFT JOIN cn ON cn.file = f.file AND cn.batch = b.batch LEFT JOIN cn pr ON pr.file = f.file AND pr.batch = b.batch - 1)
    SELECT file AS file_name, CAST(sum(CASE WHEN batch = 2 THEN n ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN n = 0 AND (before > 0 OR named) THEN 1 ELSE 0 END) AS BIGINT) AS freed FROM al
    GROUP BY file HAVING sum(CASE WHEN batch = 2 THEN n ELSE 0 END) > 0 OR sum(CASE WHEN n = 0 AND (before > 0 OR named) THEN 1 ELSE 0 END) > 0"""
)
def media_references(spark, sf):
    """References to media files after three batches of changes, and how often each file was set free."""
    e = B.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    op = F.when(F.col("event_type").isin("purchase", "error"), "delete").otherwise("put")
    changes = e.select(
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.concat_ws("-", F.col("user_id") % 50, k % 10).alias("id"),
        F.col("user_id").cast("string").alias("fingerprint"),
        k.alias("page_index"),
        F.concat(F.lit("f"), (k * 7 + F.col("user_id")) % 400).alias("file_name"),
    )
    stores = references.open_media(spark, shared_folder(spark, "media"))
    freed = [references.change(stores, changes.filter(F.col("seq") % 3 == i))[1] for i in range(3)]
    free = reduce(DataFrame.unionByName, freed).groupBy("file_name").agg(F.count("*").alias("freed"))
    counts = stores.read(references.COUNTS)
    return counts.join(free, "file_name", "full_outer").select("file_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("freed", F.lit(0)).alias("freed"))
