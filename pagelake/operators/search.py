"""Unified full-text search over page-keyed sources.

A hit is (fingerprint, page_index, source, source_ord, hit_ord, snippet, rect). Each source gives
hits in page and block order, capped before the union; the union keeps duplicates and is ordered
by page, source and original order. A query may be one phrase or a table of phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pagelake.functions import text as T

SOURCES = ["PDF", "HANDWRITING", "TEXT"]
CAP = 200


#: Phrases of one automaton; a larger table is searched in several rounds, dealt by hash.
PHRASES = 50_000


def _found(rows: DataFrame, query: str | DataFrame) -> DataFrame:
    """rows with query and ``at``, the place of its first hit: for one phrase, or for each of a table of phrases.

    A table's phrases go to the tasks as one automaton, which reads each text once, whatever it repeats. For phrases that
    are asked again and again see textindex.
    """
    if isinstance(query, str):
        return rows.withColumn("query", F.lit(query)).withColumn("at", T.find_ci("text", "query")).filter("at >= 0")
    phrases = query.select("query", T.fold(T.trim_unicode("query")).alias("needle")).filter("needle <> ''").distinct()
    rounds = -(-phrases.count() // PHRASES) or 1
    dealt = phrases.withColumn("round", F.pmod(F.xxhash64("query"), F.lit(rounds)))
    parts = [_round(rows, dealt.filter(F.col("round") == i)) for i in range(rounds)]
    return reduce(DataFrame.unionByName, parts)


def _round(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast([(r["query"], r["needle"]) for r in phrases.collect()])  # about PHRASES of them
    low = F.coalesce(T.fold("text"), F.lit(""))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        queries: dict[str, list[str]] = {}
        for name, needle in given.value:
            queries.setdefault(needle, []).append(name)
            machine.add_word(needle, needle)
        machine.make_automaton() if queries else None
        for batch in batches:
            at_row, names, places = [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist() if queries else []):
                first: dict[str, int] = {}
                for end, needle in machine.iter(text):
                    first.setdefault(needle, end - len(needle) + 1)
                for needle, at in first.items():
                    for name in queries[needle]:
                        at_row.append(i)
                        names.append(name)
                        places.append(at)
            kept = batch.take(pa.array(at_row, pa.int64())).columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(places, pa.int32())], names=[*batch.schema.names[:-1], "query", "at"])

    schema = StructType([*rows.schema.fields, StructField("query", StringType()), StructField("at", IntegerType())])
    return rows.withColumn("__low", low).mapInArrow(run, schema)


def positioned_hits(blocks: DataFrame, query: str | DataFrame, source: str) -> DataFrame:
    """Blocks (fingerprint, page_index, ord, text, rect) that contain the query."""
    found = _found(blocks.select("fingerprint", "page_index", "ord", "text", "rect"), query)
    size = F.length(T.trim_unicode("query"))
    return found.select("query", "fingerprint", "page_index", "ord", T.snippet("text", F.col("at"), size, source).alias("snippet"), "rect")


def fallback_hits(pages: DataFrame, positioned: DataFrame, query: str | DataFrame, source: str) -> DataFrame:
    """Pages (fingerprint, page_index, text) whose whole text contains the query and none of whose blocks does."""
    found = _found(pages.select("fingerprint", "page_index", "text"), query)
    keys = ["query", "fingerprint", "page_index"]
    rest = found.join(positioned.select(keys).distinct(), keys, "left_anti")
    size = F.length(T.trim_unicode("query"))
    no_rect = F.lit(None).cast(positioned.schema["rect"].dataType)
    return rest.select(*keys, F.lit(2**31 - 1).alias("ord"), T.snippet("text", F.col("at"), size, source).alias("snippet"), no_rect.alias("rect"))


def ranked(hits: DataFrame, source: str, cap: int = CAP, scope: list[str] | None = None) -> DataFrame:
    """The first ``cap`` hits in page and block order, within ``scope`` (the query by default)."""
    window = Window.partitionBy(*(scope or ["query"])).orderBy("page_index", "fingerprint", "ord")
    out = hits.withColumn("hit_ord", F.row_number().over(window)).filter(F.col("hit_ord") <= cap)
    return out.select("query", "fingerprint", "page_index", F.lit(source).alias("source"), F.lit(SOURCES.index(source)).alias("source_ord"), "hit_ord", "snippet", "rect")


def search_pages(pages: DataFrame, blocks: DataFrame, query: str | DataFrame, cap: int = CAP, scope: list[str] | None = None) -> DataFrame:
    """Recognised pages: positioned hits, and whole-page fallback where a page has none."""
    hits = positioned_hits(blocks, query, "PDF")
    return ranked(hits.unionByName(fallback_hits(pages, hits, query, "PDF")), "PDF", cap, scope)


def search_blocks(blocks: DataFrame, query: str | DataFrame, source: str, cap: int = CAP, scope: list[str] | None = None) -> DataFrame:
    """Handwriting or text boxes: positioned hits only."""
    return ranked(positioned_hits(blocks, query, source), source, cap, scope)


def unified(*sources: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """All hits; ``rank`` is their order within ``scope`` (the query by default): page, source, original order."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    window = Window.partitionBy(*(scope or ["query"])).orderBy("page_index", "source_ord", "hit_ord", "fingerprint")
    return out.withColumn("rank", F.row_number().over(window))


def cursor(index: Column | int, hits: Column | int) -> Column:
    """A hit cursor that wraps at both ends; -1 without hits."""
    n = F.lit(hits) if isinstance(hits, int) else hits
    i = F.lit(index) if isinstance(index, int) else index
    return F.when(n > 0, F.pmod(i, n)).otherwise(-1)


def highlight(hits: DataFrame, page: int) -> DataFrame:
    return hits.filter(F.col("page_index") == page)
