"""Logs of page edits, composed into one mapping a book and applied to all its stores in one commit.

A mapping is the list of a book's new pages as runs of old ones: (source, length, path, template). source is null for pages
that an edit has added; path names the edits that made a copy ("" for the page itself, "12.40" for the copy by edit 40
of the copy by edit 12); template is set where an edit has set one. Reading one mapping through another
gives a mapping again, and this composition is associative: a book's log is cut into runs of edits, each run becomes a
mapping by itself, and neighbouring mappings are put together level by level, FAN at a time, all books at once. The
result grows by two runs an edit at most, however many pages the book has. Beside it goes the mapping the other way, where the reader of
each page is now, which also says who takes the place of a deleted page; it is composed in the opposite order.

An edit is (fingerprint, seq, op, page, target, template): delete, duplicate (the copy comes next),
move (to place ``target``), append (a page at the end) or template (of a page). What does not fit the book at that
time (a page that isn't there, the deletion of its only page) has been refused when it was logged; a book whose log
holds such an edit is left out and listed by checked().
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.sources.stores import Stores

#: Length of the run after a book's last page.
REST = 1 << 40
#: Edits of a run, mappings that are put together at once, pages of a cell when a mapping meets rows, sequence numbers of a run that is counted by one task.
RUN, FAN, CELL, NUMBERS = 64, 8, 64, 4096
PIECE = "struct<source:long,length:long,path:string,template:string>"
LOG = ["fingerprint", "seq", "op", "page", "target", "template"]

Piece = tuple  # (source, length, path, template)


def joined(pieces: Iterable[Piece]) -> list[Piece]:
    """Neighbours that continue each other as one; empty ones go."""
    out: list[Piece] = []
    for source, length, path, template in pieces:
        if not length:
            continue
        if out:
            s, n, p, t = out[-1]
            if s is not None and source == s + n and (path, template) == (p, t):
                out[-1] = (s, n + length, p, t)
                continue
        out.append((source, length, path, template))
    return out


def through(first: list[Piece], second: list[Piece]) -> list[Piece]:
    """second's pages, whose sources are places of first, as pages of first's sources."""
    ends = list(accumulate(p[1] for p in first))

    def parts() -> Iterator[Piece]:
        for source, length, path, template in second:
            if source is None:
                yield source, length, path, template
                continue
            i = bisect_right(ends, source)
            while length and i < len(first):  # what lies beyond is after the last page of any book
                s, n, p, t = first[i]
                skip = source - (ends[i] - n)
                take = min(length, n - skip)
                yield None if s is None else s + skip, take, ".".join(filter(None, (p, path))), t if template is None else template
                source, length, i = source + take, length - take, i + 1

    return joined(parts())


def edit_mapping(seq: int, op: str, page: int | None, target: int | None, template: str | None, count: int) -> list[Piece]:
    """One edit of a book that has ``count`` pages."""
    run = lambda a, b, path="", t=None: (a, b - a, path, t)
    match op:
        case "delete":
            return joined([run(0, page), run(page + 1, REST)])
        case "duplicate":
            return joined([run(0, page + 1), run(page, page + 1, str(seq)), run(page + 1, REST)])
        case "move" if target > page:
            return joined([run(0, page), run(page + 1, target + 1), run(page, page + 1), run(target + 1, REST)])
        case "move":
            return joined([run(0, target), run(page, page + 1), run(target, page), run(page + 1, REST)])
        case "append":
            return joined([run(0, count), (None, 1, str(seq), template), run(count, REST - 1)])
        case "template":
            return joined([run(0, page), run(page, page + 1, t=template), run(page + 1, REST)])
    raise ValueError(f"unknown edit {op}")


def edit_places(op: str, page: int | None, target: int | None, count: int) -> list[Piece]:
    """Where the reader of each page is after one edit: runs of new places in the order of old ones."""
    run = lambda new, length: (new, length, "", None)
    match op:
        case "delete" if page == count - 1:
            return joined([run(0, page), run(page - 1, 1), run(page, REST)])
        case "delete":
            return joined([run(0, page + 1), run(page, REST)])
        case "duplicate":
            return joined([run(0, page + 1), run(page + 2, REST)])
        case "move" if target > page:
            return joined([run(0, page), run(target, 1), run(page, target - page), run(target + 1, REST)])
        case "move":
            return joined([run(0, target), run(target + 1, page - target), run(target, 1), run(page + 1, REST)])
    return [run(0, REST)]


def composed(mappings: Iterable[tuple[list[Piece], list[Piece]]]) -> tuple[list[Piece], list[Piece]]:
    """(pages, places) of several mappings, earlier ones first."""
    every = list(mappings)
    pages, places = every[0]
    for more, then in every[1:]:
        pages, places = through(pages, more), through(then, places)
    return pages, places


# ---------------------------------------------------------------- logs as tables


def counted(log: DataFrame, books: DataFrame) -> DataFrame:
    """The log with each edit's ``number`` in its book, ``before``, the pages the book has then, and ``fits``. books: (fingerprint, page_count).

    Runs of sequence numbers are counted each, after the changes in the runs before: no book is one task's load.
    """
    change = F.when(F.col("op").isin("duplicate", "append"), 1).when(F.col("op") == "delete", -1).otherwise(0)
    rows = log.select(*LOG, change.alias("__change"), F.floor(F.col("seq") / NUMBERS).alias("__run"))
    sums = rows.groupBy("fingerprint", "__run").agg(F.sum("__change").alias("__sum"), F.count("*").alias("__edits"))
    earlier = Window.partitionBy("fingerprint").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    starts = sums.select("fingerprint", "__run", total("__sum", earlier).alias("__start"), total("__edits", earlier).alias("__first"))
    inside = Window.partitionBy("fingerprint", "__run").orderBy("seq")
    rows = rows.withColumns({"__inside": total("__change", inside.rowsBetween(Window.unboundedPreceding, -1)), "__place": F.row_number().over(inside) - 1}).join(starts, ["fingerprint", "__run"])
    rows = rows.join(books.select("fingerprint", F.col("page_count").cast("long").alias("__pages")), "fingerprint", "left")
    before = F.col("__pages") + F.col("__start") + F.col("__inside")
    there = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) < F.col("before")), F.lit(False))
    fits = (
        F.when(F.col("before").isNull(), False)
        .when(F.col("op") == "append", True)
        .when(F.col("op") == "delete", there("page") & (F.col("before") > 1))
        .when(F.col("op") == "move", there("page") & there("target"))
        .when(F.col("op").isin("duplicate", "template"), there("page"))
        .otherwise(False)
    )
    return rows.withColumns({"number": F.col("__first") + F.col("__place"), "before": before}).withColumn("fits", fits).select(*LOG, "number", "before", "fits")


def checked(log: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log of the books that it fits, the first edit that doesn't fit of each other book)."""
    rows = counted(log, books)
    bad = rows.filter("not fits").groupBy("fingerprint").agg(F.min("seq").alias("seq"))
    good = rows.join(bad.select("fingerprint"), "fingerprint", "left_anti").drop("fits")
    return good, rows.join(bad, ["fingerprint", "seq"]).select("fingerprint", "seq", "op", "page", "target", "before")


_STEP = f"fingerprint string, run long, pages array<{PIECE}>, places array<{PIECE}>"
_NAMES = ("source", "length", "path", "template")


def _row(book: str, run: int, mapping: tuple[list[Piece], list[Piece]]) -> pd.DataFrame:
    pages, places = ([dict(zip(_NAMES, p, strict=True)) for p in m] for m in mapping)
    return pd.DataFrame({"fingerprint": [book], "run": [run], "pages": [pages], "places": [places]})


def _of_edits(log: pd.DataFrame) -> pd.DataFrame:
    whole = lambda x: None if pd.isna(x) else int(x)
    each = []
    for e in log.sort_values("number").itertuples():
        page, target, count = whole(e.page), whole(e.target), int(e.before)
        each.append((edit_mapping(int(e.seq), e.op, page, target, e.template, count), edit_places(e.op, page, target, count)))
    return _row(log["fingerprint"].iloc[0], int(log["run"].iloc[0]), composed(each))


def _of_mappings(steps: pd.DataFrame) -> pd.DataFrame:
    steps = steps.sort_values("run")
    pieces = lambda m: [tuple(p[n] for n in _NAMES) for p in m]
    each = [(pieces(a), pieces(b)) for a, b in zip(steps["pages"], steps["places"], strict=True)]
    return _row(steps["fingerprint"].iloc[0], int(steps["run"].iloc[0]) // FAN, composed(each))


def mappings(log: DataFrame) -> DataFrame:
    """(fingerprint, pages, places) of a log with ``number`` and ``before``."""
    rows = log.select(F.col("fingerprint").cast("string").alias("fingerprint"), *LOG[1:], "number", "before", F.floor(F.col("number") / RUN).alias("run"))
    steps = rows.groupBy("fingerprint", "run").applyInPandas(_of_edits, _STEP)
    span = (log.agg(F.max("number")).first()[0] or 0) // RUN + 1
    while span > 1:
        steps = steps.groupBy("fingerprint", F.floor(F.col("run") / FAN).alias("__next")).applyInPandas(_of_mappings, _STEP)
        span = -(-span // FAN)
    return steps.select("fingerprint", "pages", "places")


def runs(mapped: DataFrame, books: DataFrame) -> DataFrame:
    """(fingerprint, start, source, length, path, copies, template): the mappings as rows, cut at the books' ends; books without edits map to themselves."""
    counts = books.select(F.col("fingerprint").cast("string").alias("fingerprint"), F.col("page_count").cast("long").alias("page_count"))
    same = F.from_json(F.lit(f'[{{"source":0,"length":{REST},"path":""}}]'), f"array<{PIECE}>")
    rows = counts.join(mapped.select("fingerprint", "pages"), "fingerprint", "left")
    each = rows.select("fingerprint", "page_count", F.posexplode(F.coalesce("pages", same)).alias("i", "p"))
    kept = F.when(F.col("p.source").isNull(), F.col("p.length")).otherwise(F.greatest(F.least(F.col("p.length"), F.col("page_count") - F.col("p.source")), F.lit(0)))
    before = Window.partitionBy("fingerprint").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("length", kept).withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    made = F.when(F.col("p.path") == "", 0).otherwise(F.size(F.split("p.path", r"\.")))
    copies = (made - F.when(F.col("p.source").isNull(), 1).otherwise(0)).cast("int")
    return each.filter("length > 0").select("fingerprint", "start", F.col("p.source").alias("source"), "length", F.col("p.path").alias("path"), copies.alias("copies"), F.col("p.template").alias("template"))


def page_list(mapped_runs: DataFrame) -> DataFrame:
    """(fingerprint, page_index, source_page, path, copies, template): every page of the edited books."""
    places = mapped_runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    return places.select("fingerprint", (F.col("start") + F.col("k")).cast("int").alias("page_index"), (F.col("source") + F.col("k")).cast("int").alias("source_page"), "path", "copies", "template")


def moved(rows: DataFrame, mapped_runs: DataFrame, page: str = "page_index", originals: bool = False) -> DataFrame:
    """rows at their new pages, once for each page that shows theirs, with ``path`` and ``copies`` of that page.

    Runs and rows meet by book and cell of pages, an equi-join; rows of pages that are gone go. With
    ``originals`` only pages count that are no copies.
    """
    low, high = F.floor(F.col("source") / CELL), F.floor((F.col("source") + F.col("length") - 1) / CELL)
    cells = mapped_runs.filter("source is not null" + (" and copies = 0" if originals else "")).withColumn("__cell", F.explode(F.sequence(low, high)))
    cells = cells.select(F.col("fingerprint").alias("__book"), "__cell", "source", "length", "start", "path", "copies")
    p = F.col(page).cast("long")
    keyed = rows.withColumns({"__of": F.floor(p / CELL), "__key": F.col("fingerprint").cast("string")})
    met = keyed.join(cells, (F.col("__key") == F.col("__book")) & (F.col("__of") == F.col("__cell")) & (p >= F.col("source")) & (p < F.col("source") + F.col("length")))
    kind = rows.schema[page].dataType
    return met.withColumn(page, (F.col("start") + p - F.col("source")).cast(kind)).select(*rows.columns, "path", "copies")


def copy_id(name: str = "id") -> Column:
    """A copy's id, derived from the original's and the edits that made it."""
    derived = F.substring(F.sha2(F.concat_ws("|", F.lit("copy"), F.col("path"), F.col(name).cast("string")), 256), 1, 32)
    return F.when(F.col("path") == "", F.col(name).cast("string")).otherwise(derived)


def moved_store(rows: DataFrame, mapped_runs: DataFrame) -> DataFrame:
    """Items (fingerprint, page_index, ...) of a store; an ``id`` is unique again."""
    out = moved(rows, mapped_runs)
    if "id" in rows.columns:
        out = out.withColumn("id", copy_id())
    return out.select(rows.columns)


def moved_links(links: DataFrame, mapped_runs: DataFrame) -> DataFrame:
    """Links follow their pages at both ends: copies of a page have copies of its links, a little lower each, and lead where the original's lead."""
    ahead = moved(links, mapped_runs, "target_page", originals=True).drop("path", "copies")
    out = moved(ahead, mapped_runs, "source_page")
    return out.withColumns({"id": copy_id(), "y": F.when(F.col("copies") > 0, F.least(F.col("y") + 0.02 * F.col("copies"), F.lit(0.94))).otherwise(F.col("y"))}).select(links.columns)


def moved_outline(outline: DataFrame, mapped_runs: DataFrame) -> DataFrame:
    """Outline entries follow their page; copies of a page have none."""
    return moved(outline, mapped_runs, originals=True).select(outline.columns)


def moved_pages(pages: DataFrame, mapped_runs: DataFrame, default: str = "BLANK") -> DataFrame:
    """Pages (fingerprint, page_index, source_page, template) in their new order; added ones show no source page."""
    old = pages.select(F.col("fingerprint").alias("__book"), F.col("page_index").alias("__page"), F.col("source_page").alias("__source"), F.col("template").alias("__template"))
    listed = page_list(mapped_runs)
    both = listed.join(old, (F.col("fingerprint") == F.col("__book")) & (F.col("source_page") == F.col("__page")), "left")
    return both.select("fingerprint", "page_index", F.col("__source").alias("source_page"), F.coalesce("template", "__template", F.lit(default)).alias("template"))


def moved_library(entries: DataFrame, mapped: DataFrame, mapped_runs: DataFrame) -> DataFrame:
    """Entries (fingerprint, page_count, bookmarks, last_page, ...): counts follow, copies of marked pages are marked, a deleted resume page gives its place to the next."""
    pages = mapped_runs.groupBy("fingerprint").agg(F.sum("length").alias("__pages"))
    marks = moved(entries.select("fingerprint", F.explode("bookmarks").alias("page_index")), mapped_runs).groupBy("fingerprint").agg(F.array_sort(F.collect_set("page_index")).alias("__marks"))
    each = mapped.select("fingerprint", F.posexplode("places").alias("i", "p"))
    before = Window.partitionBy("fingerprint").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("__from", F.coalesce(F.sum("p.length").over(before), F.lit(0))).join(entries.select("fingerprint", F.col("last_page").alias("__last")), "fingerprint")
    here = (F.col("__last") >= F.col("__from")) & (F.col("__last") < F.col("__from") + F.col("p.length"))
    place = each.filter(here).select("fingerprint", (F.col("p.source") + F.col("__last") - F.col("__from")).alias("__place"))
    out = entries
    for more in (pages, marks, place):
        out = out.join(more, "fingerprint", "left")
    kind = lambda c: entries.schema[c].dataType
    return out.withColumns(
        {
            "page_count": F.coalesce("__pages", F.col("page_count").cast("long")).cast(kind("page_count")),
            "bookmarks": F.coalesce("__marks", F.slice("bookmarks", 1, 0)).cast(kind("bookmarks")),
            "last_page": F.coalesce("__place", F.col("last_page").cast("long")).cast(kind("last_page")),
        }
    ).select(entries.columns)


# ---------------------------------------------------------------- all stores at once

#: How each store follows a log: page items, links, outline, page order with templates.
FOLLOW = {name: moved_store for name in ("ink", "text", "image", "handwriting", "ocr")} | {"navigation": moved_links, "outline": moved_outline, "pages": moved_pages}
LIBRARY = "library"


def apply_log(stores: Stores, log: DataFrame) -> tuple[int, DataFrame]:
    """Edits all stores of the books in the log in one commit: (new version, refused books with their first bad edit).

    Only the buckets of these books are read and written.
    """
    edit = stores.edit()
    asked = log.select(F.col("fingerprint").cast("string").alias("fingerprint"), *LOG[1:])
    buckets = sorted(r[0] for r in asked.select(stores.bucket().alias("b")).distinct().collect())  # at most stores.buckets numbers
    library = edit.read(LIBRARY, buckets)
    good, refused = checked(asked, library)
    mapped = stores.kept(mappings(good))  # every table needs them
    edited = mapped.select("fingerprint")
    mapped_runs = stores.kept(runs(mapped, library.join(edited, "fingerprint", "left_semi")))
    there = stores.tables(edit.base)
    for name, follow in {**FOLLOW, LIBRARY: lambda rows, moves: moved_library(rows, mapped, moves)}.items():
        if name in there:
            rows = edit.read(name, buckets)
            # Other books of these buckets stay as they are, whether the library knows them or not.
            others = rows.join(edited, rows["fingerprint"].eqNullSafe(edited["fingerprint"]), "left_anti")
            moves = follow(rows.join(edited, "fingerprint", "left_semi").select(rows.columns), mapped_runs)
            edit.write(name, others.unionByName(moves.select(rows.columns)), buckets)
    return edit.commit(), refused
