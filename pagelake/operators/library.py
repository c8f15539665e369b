"""Document library: views, upserts, folders, soft and permanent deletion, queue-independent lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(entries: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Entries outside the trash whose file exists."""
    out = entries.filter("trashed_at is null")
    return out if files is None else out.join(files.select("fingerprint").distinct(), "fingerprint", "left_semi")


def trash(entries: DataFrame, files: DataFrame | None = None) -> DataFrame:
    out = entries.filter("trashed_at is not null")
    return out if files is None else out.join(files.select("fingerprint").distinct(), "fingerprint", "left_semi")


def library_order() -> list[Column]:
    """Favourites first, then last opened, then original order."""
    return [F.col("favorite").desc(), F.col("last_opened_at").desc(), F.col("ord")]


def visible(entries: DataFrame, view: str = "ALL", folder: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """ALL or a folder, FAVORITES, TRASH; a folder doesn't narrow favourites or trash."""
    if view == "TRASH":
        return trash(entries, files)
    rows = live(entries, files)
    if view == "FAVORITES":
        return rows.filter("favorite")
    return rows.filter(F.col("folder_id") == folder) if folder is not None else rows


def picker_order(current: str) -> list[Column]:
    """The open document first, then last opened."""
    return [(F.col("fingerprint") == current).desc(), F.col("last_opened_at").desc(), F.col("ord")]


def folder_order() -> list[Column]:
    return [F.lower("name"), F.col("ord")]


def with_folder(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """folder_name of each entry; null for an unknown folder."""
    names = folders.select(F.col("id").cast("string").alias("folder_id"), F.col("name").alias("folder_name"))
    return entries.join(names, "folder_id", "left")


def checked_folders(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """A folder that doesn't exist (any more) becomes null."""
    known = folders.select(F.col("id").cast("string").alias("__known")).distinct()
    return entries.join(known, F.col("folder_id") == F.col("__known"), "left").withColumn("folder_id", F.col("__known")).drop("__known")


def upsert(current: DataFrame, changes: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """Rows of changes replace those with the same key, else they are added; columns in ``keep`` prefer the current value."""
    a, b = current.alias("a"), changes.alias("b")
    columns = []
    for c in current.columns:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}") if c in changes.columns else F.lit(None)
        columns.append((F.coalesce(old, new) if c in keep else F.coalesce(new, old) if c == key else F.when(F.col(f"b.{key}").isNotNull() & F.lit(c in changes.columns), new).otherwise(old)).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


def register(entries: DataFrame, imports: DataFrame, now: int) -> DataFrame:
    """Imported (fingerprint, title) rows: a known document keeps everything but its last opening, also its place in the trash."""
    fresh = imports.withColumns({"last_opened_at": F.lit(now).cast("long"), "title": F.when(F.trim("title") == "", "PDF").otherwise(F.trim("title"))})
    return upsert(entries, fresh.select("fingerprint", "title", "last_opened_at"), "fingerprint", keep=["title"])


def soft_delete(entries: DataFrame, fingerprints: list[str], now: int) -> DataFrame:
    return entries.withColumn("trashed_at", F.when(F.col("fingerprint").isin(fingerprints), F.lit(now).cast("long")).otherwise(F.col("trashed_at")))


def restore(entries: DataFrame, fingerprints: list[str]) -> DataFrame:
    return entries.withColumn("trashed_at", F.when(~F.col("fingerprint").isin(fingerprints), F.col("trashed_at")))


def delete_permanently(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in ``gone`` (fingerprint)."""
    keys = gone.select("fingerprint").distinct()
    return {name: df.join(keys, "fingerprint", "left_anti") for name, df in tables.items()}


def unreferenced(media: DataFrame, *users: DataFrame) -> DataFrame:
    """Media files (file_name) that no table of ``users`` refers to."""
    used = reduce(DataFrame.unionByName, (u.select("file_name") for u in users)).distinct()
    return media.join(used, "file_name", "left_anti")


def newest(rows: DataFrame, keep: int, scope: list[str], order: list[Column]) -> DataFrame:
    """Retention: the newest rows of each scope."""
    return rows.withColumn("age_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).filter(F.col("age_rank") <= keep)


def toc(outline: DataFrame) -> DataFrame:
    return outline.orderBy("page_index", "created_at", "ord")


#: Titles of entries whose title is blank, by kind.
DEFAULT_TITLES = {"NOTE": "Notebook", "PDF": "PDF"}


def titled(title: Column, kind: Column) -> Column:
    """A trimmed title, or the kind's default."""
    t = F.trim(title)
    return F.when(F.coalesce(t, F.lit("")) != "", t).otherwise(F.when(kind == "NOTE", DEFAULT_TITLES["NOTE"]).otherwise(DEFAULT_TITLES["PDF"]))


def changed_folders(folders: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, name, created_seq, deleted) after changes (seq, op, id, value): create_folder, rename_folder, delete_folder.

    A blank name is refused; a folder that is deleted stays so, and is kept here for those that moved entries into it.
    """
    f = changes.filter(F.col("op").isin("create_folder", "rename_folder", "delete_folder"))
    name = F.when(F.trim("value") != "", F.trim("value"))
    made = f.groupBy(F.col("id").cast("string").alias("id")).agg(
        F.min(F.when((F.col("op") == "create_folder") & name.isNotNull(), F.col("seq"))).alias("created_seq"),
        F.max_by(name, F.when((F.col("op") != "delete_folder") & name.isNotNull(), F.col("seq"))).alias("new_name"),
        F.max(F.col("op") == "delete_folder").alias("gone"),
    )
    old = folders.select(F.col("id").cast("string").alias("id"), "name")
    both = old.join(made, "id", "full_outer")
    known = F.col("name").isNotNull()
    out = both.select("id", F.coalesce("new_name", "name").alias("name"), F.when(known, F.lit(None)).otherwise(F.col("created_seq")).cast("long").alias("created_seq"), F.coalesce("gone", F.lit(False)).alias("deleted"), (known | F.col("created_seq").isNotNull()).alias("there"))
    return out.filter("there").drop("there")


def changed(entries: DataFrame, folders: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries (fingerprint, title, kind, favorite, folder_id, last_opened_at, last_page, custom_cover) after changes (seq, op, id, value, at).

    create (value: kind) adds a notebook or document unless it is there; rename, favorite (toggle), touch, last_page, move (value: folder), set_cover and clear_cover
    change one field. For each field the last change counts, toggles by their number, so a book's changes are one
    partial aggregate and need no order in a task. Changes of books that are not there (yet) change nothing; a folder that isn't there when an entry moves into
    it, or is deleted afterwards, is none.
    """
    born = changes.filter("op = 'create'").groupBy("id").agg(F.min_by(F.struct("value", "at", "seq"), "seq").alias("v"))
    born = born.join(entries.select(F.col("fingerprint").alias("id")), "id", "left_anti").select(
        F.col("id").alias("fingerprint"), titled(F.lit(None).cast("string"), F.col("v.value")).alias("title"), F.col("v.value").alias("kind"), F.lit(False).alias("favorite"), F.lit(None).cast("string").alias("folder_id"),
        F.col("v.at").alias("last_opened_at"), F.lit(0).alias("last_page"), F.lit(False).alias("custom_cover"), F.col("v.seq").alias("__since"),
    )
    every = entries.withColumn("__since", F.lit(None).cast("long")).unionByName(born)
    since = every.select(F.col("fingerprint").alias("id"), "__since")
    known = changes.join(since, "id").filter(F.col("__since").isNull() | (F.col("seq") > F.col("__since")))
    of = lambda *ops: F.when(F.col("op").isin(*ops), F.col("seq"))
    last = known.groupBy(F.col("id").alias("fingerprint")).agg(
        F.max_by(F.struct("value"), of("rename")).alias("renamed"),
        F.count_if(F.col("op") == "favorite").alias("toggles"),
        F.max_by("at", of("touch")).alias("touched"),
        F.max_by(F.col("value").try_cast("int"), of("last_page")).alias("page"),
        F.max_by(F.struct("value", "seq"), of("move")).alias("moved"),
        F.max_by(F.col("op") == "set_cover", of("set_cover", "clear_cover")).alias("cover"),
    )
    valid = changed_folders(folders, changes).filter("not deleted").select(F.col("id").alias("__folder"), "created_seq")
    both = every.join(last, "fingerprint", "left")
    target = F.when(F.col("moved").isNotNull(), F.col("moved.value")).otherwise(F.col("folder_id"))
    both = both.withColumn("__target", target).join(valid, F.col("__target") == F.col("__folder"), "left")
    there = F.col("__folder").isNotNull() & (F.col("created_seq").isNull() | (F.col("moved.seq") > F.col("created_seq")))
    return both.select(
        "fingerprint",
        F.when(F.col("renamed").isNotNull(), titled(F.col("renamed.value"), F.col("kind"))).otherwise(F.col("title")).alias("title"),
        "kind",
        (F.col("favorite") != (F.coalesce("toggles", F.lit(0)) % 2 == 1)).alias("favorite"),
        F.when(there, F.col("__target")).alias("folder_id"),
        F.coalesce("touched", "last_opened_at").alias("last_opened_at"),
        F.coalesce(F.greatest("page", F.lit(0)), "last_page").alias("last_page"),
        F.coalesce("cover", "custom_cover").alias("custom_cover"),
    )


def page_writes(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """(fingerprint, writes): how often the resume page was written; a page that is the same already is not."""
    steps = changes.filter("op = 'last_page'").select(F.col("id").alias("fingerprint"), "seq", F.col("value").try_cast("int").alias("page"))
    steps = steps.join(entries.select("fingerprint", "last_page"), "fingerprint")
    before = F.greatest(F.lag("page").over(Window.partitionBy("fingerprint").orderBy("seq")), F.lit(0))
    first = F.lag(F.lit(1)).over(Window.partitionBy("fingerprint").orderBy("seq")).isNull()
    was = F.when(first, F.col("last_page")).otherwise(before)
    return steps.withColumn("new", F.col("page") != was).groupBy("fingerprint").agg(F.count_if("new").alias("writes"))


def marked(bookmarks: DataFrame, toggles: DataFrame) -> DataFrame:
    """(fingerprint, page_index) of bookmarks after toggles of the same columns: those with an odd number of both."""
    both = bookmarks.select("fingerprint", "page_index").distinct().unionByName(toggles.select("fingerprint", "page_index"))
    return both.groupBy("fingerprint", "page_index").agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def current(handles: DataFrame, entries: DataFrame, fields: list[str]) -> DataFrame:
    """Handles (fingerprint, fields) with what the library has now, else as they are."""
    now = entries.select("fingerprint", F.lit(True).alias("__there"), *(F.col(f).alias(f"__{f}") for f in fields))
    out = handles.join(now, "fingerprint", "left")
    return out.select("fingerprint", *(F.when(F.col("__there"), F.col(f"__{f}")).otherwise(F.col(f)).alias(f) for f in fields))


def stickers(items: DataFrame) -> DataFrame:
    """Newest first."""
    return items.orderBy(F.desc("created_at"), "ord")
