"""Page-structure edits as a relation of old and new page numbers, applied to every page-keyed table.

delete p drops page p and moves later pages back; duplicate p moves later pages on and maps p to p
and p + 1; move a to b maps a to b and shifts the pages between. All are expressions on the page
column, so an edit is a narrow projection over a table of any size and one versioned commit covers all tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(page: Column | str) -> Column:
    return F.col(page) if isinstance(page, str) else page


def after_delete(page: Column | str, p: int) -> Column:
    """New number; null for the deleted page."""
    c = _c(page)
    return F.when(c < p, c).when(c > p, c - 1)


def after_duplicate(page: Column | str, p: int) -> Column:
    """New number of the original."""
    c = _c(page)
    return F.when(c > p, c + 1).otherwise(c)


def after_move(page: Column | str, a: int, b: int) -> Column:
    c = _c(page)
    if a == b:
        return c
    between = (c > a) & (c <= b) if a < b else (c >= b) & (c < a)
    return F.when(c == a, F.lit(b)).when(between, c - 1 if a < b else c + 1).otherwise(c)


def delete_page(rows: DataFrame, p: int, page: str = "page_index") -> DataFrame:
    return rows.withColumn(page, after_delete(page, p)).filter(F.col(page).isNotNull())


def duplicate_page(rows: DataFrame, p: int, page: str = "page_index", new_id: str | None = None) -> DataFrame:
    """Copies of page p's rows lie on p + 1; a copy's ``new_id`` column is derived from the original's."""
    c = F.col(page)
    targets = F.when(c == p, F.array(c, c + 1)).otherwise(F.array(after_duplicate(page, p)))
    out = rows.withColumn("__from", c).withColumn(page, F.explode(targets))
    if new_id:
        copy = (F.col("__from") == p) & (F.col(page) == p + 1)
        out = out.withColumn(new_id, F.when(copy, F.substring(F.sha2(F.concat_ws("|", F.lit("copy"), F.col(new_id).cast("string")), 256), 1, 32)).otherwise(F.col(new_id).cast("string")))
    return out.drop("__from")


def move_page(rows: DataFrame, a: int, b: int, page: str = "page_index") -> DataFrame:
    return rows.withColumn(page, after_move(page, a, b))


# ---------------------------------------------------------------- links and outline


def links_delete(links: DataFrame, p: int) -> DataFrame:
    """Links from or to the page go; both ends of the others follow."""
    kept = links.filter((F.col("source_page") != p) & (F.col("target_page") != p))
    return kept.withColumns({c: after_delete(c, p) for c in ("source_page", "target_page")})


def links_duplicate(links: DataFrame, p: int) -> DataFrame:
    """Links from the page are copied to its copy, a little lower; targets follow. The outline has no copies."""
    moved = links.withColumns({c: after_duplicate(c, p) for c in ("source_page", "target_page")})
    copies = moved.filter(F.col("source_page") == p).withColumns(
        {"source_page": F.lit(p + 1).cast(links.schema["source_page"].dataType), "y": F.least(F.col("y") + 0.02, F.lit(0.94)), "id": F.substring(F.sha2(F.concat(F.lit("copy|"), F.col("id").cast("string")), 256), 1, 32)}
    )
    return moved.withColumn("id", F.col("id").cast("string")).unionByName(copies.select(links.columns))


def links_move(links: DataFrame, a: int, b: int) -> DataFrame:
    return links.withColumns({c: after_move(c, a, b) for c in ("source_page", "target_page")})


# ---------------------------------------------------------------- page order, bookmarks, templates


def valid_order(order: Column, pages: Column) -> Column:
    """Is it a non-empty list of source pages of the document?"""
    return order.isNotNull() & (F.size(order) > 0) & F.forall(order, lambda i: (i >= 0) & (i < pages))


def effective_order(order: Column, pages: Column) -> Column:
    """The logical order, or the identity where it is not valid."""
    return F.when(valid_order(order, pages), order).otherwise(F.when(pages > 0, F.sequence(F.lit(0), pages - 1)).otherwise(F.array().cast("array<int>")))


def order_map(entries: DataFrame) -> DataFrame:
    """(fingerprint, page_index, source_page) of (fingerprint, pdf_page_order, page_count)."""
    return entries.select("fingerprint", F.posexplode(effective_order(F.col("pdf_page_order"), F.col("page_count"))).alias("page_index", "source_page"))


def array_delete(a: Column, p: int) -> Column:
    return F.concat(F.slice(a, 1, p), F.slice(a, p + 2, 1 << 30)) if p else F.slice(a, 2, 1 << 30)


def array_duplicate(a: Column, p: int) -> Column:
    return F.concat(F.slice(a, 1, p + 1), F.slice(a, p + 1, 1 << 30))


def array_move(a: Column, f: int, t: int) -> Column:
    item, rest = F.slice(a, f + 1, 1), array_delete(a, f)
    return F.concat(F.slice(rest, 1, t), item, F.slice(rest, t + 1, 1 << 30)) if t else F.concat(item, rest)


def bookmarks_delete(marks: Column, p: int) -> Column:
    return F.array_sort(F.filter(F.transform(marks, lambda m: after_delete(m, p)), lambda m: m.isNotNull()))


def bookmarks_duplicate(marks: Column, p: int) -> Column:
    return F.array_sort(F.flatten(F.transform(marks, lambda m: F.when(m == p, F.array(m, m + 1)).otherwise(F.array(after_duplicate(m, p))))))


def bookmarks_move(marks: Column, a: int, b: int) -> Column:
    return F.array_sort(F.transform(marks, lambda m: after_move(m, a, b)))


def toggle(items: Column, item: Column | int) -> Column:
    item = F.lit(item) if isinstance(item, int) else item
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_sort(F.array_append(items, item)))


def resume_after_delete(resume: Column, p: int, pages: Column) -> Column:
    """The page to resume at stays the same page; the deleted page gives its place to the next, within the document."""
    return F.greatest(F.least(F.when(resume > p, resume - 1).otherwise(resume), pages - 2), F.lit(0))


def padded(templates: Column, default: Column | str, pages: Column) -> Column:
    """Page templates cut or filled up to the page count."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.slice(F.concat(F.coalesce(templates, F.array().cast("array<string>")), F.array_repeat(d, pages)), 1, F.greatest(pages, F.lit(0)))


def schedule(rows: DataFrame, anchor: int, page: str = "page_index") -> DataFrame:
    """Recognition order: the anchor page, then outward, left before right."""
    return rows.orderBy(F.abs(F.col(page) - anchor), page)
