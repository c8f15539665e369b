"""JSON sidecars of documents as tables, and back.

Readers take whole files, parse with fixed schemas and fill the defaults that writers leave out.
A file that doesn't parse gives no rows; corrupt() lists such files so they can be put aside.
Map keys are page numbers as text. Every table has an explicit order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECT = "struct<left:float,top:float,right:float,bottom:float>"
BLOCK = f"struct<text:string,rect:{RECT}>"
POINT = "struct<x:float,y:float,pressure:float,timeMs:bigint>"
#: File shapes, and the defaults of fields that files leave out.
SHAPES = {
    "ocr": f"struct<pages:map<string,struct<text:string,blocks:array<{BLOCK}>>>>",
    "ocr_legacy": "struct<pages:map<string,string>>",
    "handwriting": f"struct<pages:map<string,struct<blocks:array<{BLOCK}>>>>",
    "text": "struct<pages:map<string,array<struct<id:string,x:float,y:float,width:float,height:float,text:string,fontSizeSp:float>>>>",
    "image": "struct<pages:map<string,array<struct<id:string,fileName:string,x:float,y:float,width:float,height:float,rotationDegrees:float,cropLeft:float,cropTop:float,cropRight:float,cropBottom:float,locked:boolean>>>>",
    "ink": f"struct<pages:map<string,array<struct<points:array<{POINT}>,colorArgb:int,baseWidthDp:float,highlighter:boolean,shape:string,brush:string>>>>",
    "navigation": "struct<links:array<struct<id:string,sourcePage:int,targetPage:int,label:string,x:float,y:float,width:float>>,outline:array<struct<id:string,title:string,pageIndex:int,createdAt:bigint>>>",
    "stickers": "struct<items:array<struct<id:string,fileName:string,cropLeft:float,cropTop:float,cropRight:float,cropBottom:float,createdAt:bigint>>>",
    "library": "struct<entries:array<struct<fingerprint:string,title:string,importedAt:bigint,lastOpenedAt:bigint,lastPage:int,bookmarks:array<int>,hasCustomCover:boolean,kind:string,pageTemplate:string,notePageCount:int,pageTemplates:array<string>,pdfPageOrder:array<int>,favorite:boolean,folderId:string,trashedAt:bigint>>,folders:array<struct<id:string,name:string,createdAt:bigint>>>",
    "journal": "struct<width:int,height:int,lines:array<array<string>>>",
    "queue": "struct<entries:array<struct<id:string,name:string,inputUri:string,treeUri:string,outputUri:string,status:string,quality:int,progress:int,page:int,total:int,stage:string,error:string,pausedByGlobal:boolean,unexpectedRestarts:int,lastUnexpectedRestartAt:bigint,createdAt:bigint>>,pausedAll:boolean>",
}
DEFAULTS = {
    "text": {"width": 0.42, "height": 0.16, "text": "", "fontSizeSp": 18.0},
    "image": {"x": 0.16, "y": 0.18, "width": 0.48, "height": 0.34, "rotationDegrees": 0.0, "cropLeft": 0.0, "cropTop": 0.0, "cropRight": 1.0, "cropBottom": 1.0, "locked": False},
    "ink": {"highlighter": False, "brush": "FOUNTAIN"},
    "links": {"x": 0.06, "y": 0.06, "width": 0.24},
    "stickers": {"cropLeft": 0.0, "cropTop": 0.0, "cropRight": 1.0, "cropBottom": 1.0},
    "entries": {"lastPage": 0, "hasCustomCover": False, "kind": "PDF", "pageTemplate": "BLANK", "notePageCount": 0, "favorite": False},
    "queue": {"id": "", "name": "", "inputUri": "", "treeUri": "", "outputUri": "", "status": "waiting", "quality": 2200, "progress": 0, "page": 0, "total": 0, "stage": "等待处理", "error": "", "pausedByGlobal": False, "unexpectedRestarts": 0, "lastUnexpectedRestartAt": 0, "createdAt": 0},
}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint, file, value): whole files; the fingerprint is the file's name without endings."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("fingerprint", F.regexp_extract("file", r"^([^.]*)", 1)).select("fingerprint", "file", "value")


def parsed(rows: DataFrame, shape: str) -> DataFrame:
    return rows.withColumn("doc", F.from_json("value", SHAPES[shape]))


def corrupt(rows: DataFrame, shape: str) -> DataFrame:
    """Files that don't parse."""
    broken = F.try_variant_get(F.try_parse_json("value"), "$", "string").isNull()
    return rows.filter(broken | F.get_json_object("value", "$").isNull()).select("fingerprint", "file")


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _paged(rows: DataFrame, shape: str, defaults: dict) -> DataFrame:
    """One row an item of map<page, array<item>>."""
    pages = parsed(rows, shape).select("fingerprint", F.explode("doc.pages").alias("page", "items"))
    items = pages.select("fingerprint", F.col("page").try_cast("int").alias("page_index"), F.posexplode("items").alias("ord", "item"))
    names = items.schema["item"].dataType.names
    kinds = {f.name: f.dataType for f in items.schema["item"].dataType}
    columns = [(F.coalesce(F.col("item")[n], F.lit(defaults[n]).cast(kinds[n])) if n in defaults else F.col("item")[n]).alias(_snake(n)) for n in names]
    return items.filter("page_index is not null").select("fingerprint", "page_index", "ord", *columns)


def ocr_pages(rows: DataFrame) -> DataFrame:
    """(fingerprint, page_index, text, blocks); a file of the old shape gives texts without blocks."""
    both = parsed(rows, "ocr").withColumn("old", F.from_json("value", SHAPES["ocr_legacy"]))
    # The old shape parses a new file as well, so it counts only where the new one doesn't.
    is_new = F.exists(F.map_values("doc.pages"), lambda p: p.isNotNull())
    empty = F.from_json(F.lit("[]"), f"array<{BLOCK}>")
    new = F.transform(F.map_entries("doc.pages"), lambda e: F.struct(e.key.alias("page"), F.coalesce(e.value.text, F.lit("")).alias("text"), F.coalesce(e.value.blocks, empty).alias("blocks")))
    old = F.transform(F.map_entries("old.pages"), lambda e: F.struct(e.key.alias("page"), F.coalesce(e.value, F.lit("")).alias("text"), empty.alias("blocks")))
    pages = both.select("fingerprint", F.explode(F.when(is_new, new).otherwise(old)).alias("p"))
    return pages.select("fingerprint", F.col("p.page").try_cast("int").alias("page_index"), "p.text", "p.blocks").filter("page_index is not null")


def blocks(pages: DataFrame) -> DataFrame:
    return pages.select("fingerprint", "page_index", F.posexplode("blocks").alias("ord", "b")).select("fingerprint", "page_index", "ord", "b.text", "b.rect")


def handwriting_blocks(rows: DataFrame) -> DataFrame:
    pages = parsed(rows, "handwriting").select("fingerprint", F.explode("doc.pages").alias("page", "p"))
    return blocks(pages.select("fingerprint", F.col("page").try_cast("int").alias("page_index"), F.col("p.blocks").alias("blocks")).filter("page_index is not null"))


def text_boxes(rows: DataFrame) -> DataFrame:
    return _paged(rows, "text", DEFAULTS["text"])


def page_images(rows: DataFrame) -> DataFrame:
    return _paged(rows, "image", DEFAULTS["image"])


def ink_strokes(rows: DataFrame) -> DataFrame:
    """Strokes as stored; pass them through ink.sanitize()."""
    out = _paged(rows, "ink", DEFAULTS["ink"])
    points = F.transform("points", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), p.pressure.alias("pressure"), p.timeMs.alias("time_ms")))
    return out.withColumn("points", points)


def _list(rows: DataFrame, shape: str, name: str, defaults: dict) -> DataFrame:
    items = parsed(rows, shape).select("fingerprint", F.posexplode(f"doc.{name}").alias("ord", "item"))
    kinds = {f.name: f.dataType for f in items.schema["item"].dataType}
    columns = [(F.coalesce(F.col("item")[n], F.lit(defaults[n]).cast(k)) if n in defaults else F.col("item")[n]).alias(_snake(n)) for n, k in kinds.items()]
    return items.select("ord", *(columns if "fingerprint" in kinds else ["fingerprint", *columns]))


def page_links(rows: DataFrame) -> DataFrame:
    return _list(rows, "navigation", "links", DEFAULTS["links"])


def outline(rows: DataFrame) -> DataFrame:
    return _list(rows, "navigation", "outline", {})


def stickers(rows: DataFrame, media: DataFrame) -> DataFrame:
    """Stickers whose media file (file_name) exists."""
    return _list(rows, "stickers", "items", DEFAULTS["stickers"]).join(media.select("file_name").distinct(), "file_name", "left_semi")


def library_entries(rows: DataFrame) -> DataFrame:
    """Entries; of repeated fingerprints the last value at the first place."""
    out = _list(rows, "library", "entries", DEFAULTS["entries"])
    none = lambda kind: F.from_json(F.lit("[]"), f"array<{kind}>")
    out = out.withColumns({"bookmarks": F.coalesce("bookmarks", none("int")), "page_templates": F.coalesce("page_templates", none("string")), "pdf_page_order": F.coalesce("pdf_page_order", none("int"))})
    rest = [c for c in out.columns if c not in ("ord", "fingerprint")]
    return out.groupBy("fingerprint").agg(F.min("ord").alias("ord"), F.max_by(F.struct(*rest), "ord").alias("v")).select("ord", "fingerprint", "v.*")


def library_folders(rows: DataFrame) -> DataFrame:
    return _list(rows, "library", "folders", {})


def journal_pages(rows: DataFrame) -> DataFrame:
    """(file, page_index, width, height, lines) of per-page journals page_000001.json, ...; bad pages are absent."""
    out = parsed(rows, "journal").withColumn("page_index", F.regexp_extract("file", r"page_(\d{6})\.json$", 1).try_cast("int") - 1)
    line = lambda r: F.struct(r[0].alias("text"), *(r[i + 1].try_cast("int").alias(n) for i, n in enumerate("ltrb")))
    sound = (F.col("doc.width") > 0) & (F.col("doc.height") > 0) & F.forall("doc.lines", lambda r: (F.size(r) == 5))
    good = out.filter(F.coalesce(sound, F.lit(False)) & F.col("page_index").isNotNull())
    lines = F.filter(F.transform("doc.lines", line), lambda r: F.trim(r.text) != "")
    return good.select("fingerprint", "page_index", F.col("doc.width").alias("width"), F.col("doc.height").alias("height"), lines.alias("lines"))


def queue_entries(spark: SparkSession, path: str, backup: str) -> DataFrame:
    """A queue manifest, else its backup. Rows without an id or input are an error, as a lost queue is worse than a stop."""
    for name in (path, backup):
        rows = parsed(files(spark, name), "queue").filter("doc.entries is not null")
        if rows.limit(1).count():
            out = _list(rows, "queue", "entries", DEFAULTS["queue"])
            if out.filter("trim(id) = '' or trim(input_uri) = ''").limit(1).count():
                raise ValueError(f"queue manifest {name} holds entries without id or input")
            return out
    raise ValueError(f"no readable queue manifest at {path} or {backup}")


def queue_rows(rows: DataFrame) -> DataFrame:
    """Entries of queue manifests (several queues' files)."""
    return _list(rows, "queue", "entries", DEFAULTS["queue"])


def imports(spark: SparkSession, path: str) -> DataFrame:
    """Binary files by content hash; equal contents are one document."""
    rows = spark.read.format("binaryFile").load(path)
    out = rows.select(F.sha2("content", 256).alias("fingerprint"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.pdf$", "").alias("title"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), "path")
    return out.groupBy("fingerprint").agg(F.min_by(F.struct("title", "size", "modified", "path"), "path").alias("v")).select("fingerprint", "v.*")


def tail(rows: DataFrame, prefix: int, column: str = "content") -> DataFrame:
    """Bytes after the first ``prefix``; a shorter input is an error."""
    long_enough = F.octet_length(column) > prefix
    checked = F.when(long_enough, F.expr(f"substring({column}, {prefix + 1})")).otherwise(F.raise_error(F.lit("input is not longer than its unchanged prefix")).cast("binary"))
    return rows.withColumn(column, checked)


def to_paged_json(rows: DataFrame, item: Column) -> DataFrame:
    """(fingerprint, value): sidecar files of rows (fingerprint, page_index, ord)."""
    pages = rows.groupBy("fingerprint", "page_index").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))).alias("items"))
    pages = pages.select("fingerprint", F.col("page_index").cast("string").alias("key"), F.transform("items", lambda i: i.item).alias("value"))
    docs = pages.groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("pages"))
    return docs.select("fingerprint", F.to_json(F.struct("pages")).alias("value"))


#: Items of a part of an index: one value holds them, and a task that gathers parts holds up to 128 of them at once.
ITEMS = 2000


def parts(rows: DataFrame, least: int = 1) -> int:
    """Into how many files an index of rows goes, so that none grows with the index."""
    return max(least, -(-rows.count() // ITEMS))


def to_list_json(rows: DataFrame, name: str, item: Column, parts: int = 1, key: str = "fingerprint") -> DataFrame:
    """(name, value): an index such as the library's as ``parts`` files {name: [items]} of rows with ``ord``; together they are the whole list."""
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")
    lists = rows.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))).alias("items"))
    value = F.to_json(F.struct(F.transform("items", lambda i: i.item).alias(name)))
    return lists.select(F.concat(F.lit(f"{name}-"), F.col("part")).alias("name"), value.alias("value"))


def library_item() -> Column:
    """An entry of the library index, from a row of library_entries()."""
    kinds = [(f.name, f.dataType) for f in _fields("library", "entries")]
    return F.struct(*(F.col(_snake(n)).cast(k).alias(n) for n, k in kinds))


def _fields(shape: str, field: str) -> list:
    """Fields of an item of a list in a file shape."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SHAPES[shape][len("struct<") : -1])[field].dataType.elementType.fields


def to_queue_json(entries: DataFrame, queue: str = "queue", parts: int = 1) -> DataFrame:
    """(name, value): a queue's manifest of rows of queue_entries() with a column that names their queue.

    With ``parts`` all entries, in the order of queues and places, are cut into about so many files, <queue>.000000, ...: a queue's files are its
    entries in order, and no file has entries of two queues.
    """
    item = F.struct(*(F.col(_snake(f.name)).cast(f.dataType).alias(f.name) for f in _fields("queue", "entries")))
    held = F.col("paused_all") if "paused_all" in entries.columns else F.lit(False)
    rows, name = entries.select(F.col(queue).alias("__queue"), "ord", item.alias("item"), held.alias("held")), F.col("__queue").cast("string")
    keys = ["__queue"]
    if parts > 1:
        rows = rows.repartitionByRange(parts, "__queue", "ord").withColumn("part", F.spark_partition_id())
        keys, name = [*keys, "part"], F.concat(name, F.lit("."), F.lpad(F.col("part").cast("string"), 6, "0"))
    lists = rows.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("items"), F.max("held").alias("held"))
    value = F.to_json(F.struct(F.transform("items", lambda i: i.item).alias("entries"), F.col("held").alias("pausedAll")))
    return lists.select(name.alias("name"), value.alias("value"))


def to_journal_json(pages: DataFrame, job: str = "fingerprint") -> DataFrame:
    """(name, value): page journals <job>/page_000001, ... of rows of journal_pages()."""
    line = lambda r: F.array(r.text, *(r[n].cast("string") for n in "ltrb"))
    value = F.to_json(F.struct("width", "height", F.transform("lines", line).alias("lines")))
    return pages.select(F.concat(F.col(job), F.lit("/page_"), F.lpad((F.col("page_index") + 1).cast("string"), 6, "0")).alias("name"), value.alias("value"))


def to_navigation_json(links: DataFrame, outline: DataFrame) -> DataFrame:
    """(fingerprint, value): links and outline of each document."""
    shaped = lambda field: F.struct(*(F.col(_snake(f.name)).cast(f.dataType).alias(f.name) for f in _fields("navigation", field)))
    listed = lambda rows, field: rows.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("ord", shaped(field).alias("item")))).alias(field))
    both = listed(links, "links").join(listed(outline, "outline"), "fingerprint", "full_outer")
    items = lambda c: F.coalesce(F.transform(c, lambda i: i.item), F.array().cast(both.schema[c].dataType.elementType["item"].dataType.simpleString().join(["array<", ">"])))
    return both.select("fingerprint", F.to_json(F.struct(items("links").alias("links"), items("outline").alias("outline"))).alias("value"))


def publish(df: DataFrame, root: str, version: int) -> str:
    """Writes a new version of a single table and then names it; readers never see half of one, the version before stays, and a version that is there is an error. For several tables see stores."""
    spark = df.sparkSession
    path = f"{root}/v{version:06d}"
    df.write.parquet(path)
    spark.createDataFrame([(version, path)], "version int, path string").coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    newest = spark.read.parquet(f"{root}/versions").orderBy(F.desc("version")).first()
    return spark.read.parquet(newest["path"])
