"""Queries of column functions: names, sizes, fonts, geometry, lists; each over a whole table."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import fonts
from pagelake.functions import geometry as G
from pagelake.functions import layout as L
from pagelake.functions import text as T
from pagelake.operators import assembly, ink, jobs, storage
from pagelake.operators import bindings as B
from pagelake.operators import pages as P
from pagelake.plans.canvas import XY
from pagelake.plans.registry import query
from pagelake.sources import sidecars


def _d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


# ---------------------------------------------------------------- names and text


@query(
    r"SELECT page_id, CASE WHEN trim(x) = '' THEN 'Page' ELSE trim(x) END AS title, regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.PDF' END, '\.pdf$', '') AS name, "
    "'backup-' || strftime(make_timestamp(1700000000000000 + page_id * 86461000000), '%Y%m%d-%H%M%S') || '.zip' AS file, printf('%04X', unicode(substring(url, 3, 1))) AS hex, CAST(page_id % 70000 BETWEEN 1 AND 65535 AND NOT page_id * 97 % 60000 BETWEEN 55296 AND 57343 AS BOOLEAN) AS valid "
    "FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN '  ' ELSE ' ' || url || ' ' END AS x FROM pages)"
)
def text_names(spark, sf):
    """Default titles, stripped suffixes, timestamped names, UTF-16 of a character, valid glyph ids."""
    p = B.read(spark, sf, "pages")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 86461)
    title = F.when(F.col("page_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("url"), F.lit(" ")))
    return p.select(
        "page_id",
        T.default_if_blank(title, "Page").alias("title"),
        T.strip_pdf_suffix(F.concat(F.col("url"), F.when(F.col("page_id") % 2 == 0, ".pdf").otherwise(".PDF"))).alias("name"),
        T.timestamp_name("backup-", at, ".zip").alias("file"),
        T.utf16_hex(F.substring("url", 3, 1)).alias("hex"),
        T.valid_cid(F.col("page_id") % 70000, F.col("page_id") * 97 % 60000).alias("valid"),
    )


@query(
    "WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') AS t FROM conversations) "
    "SELECT conv_id, turn, CAST(CASE WHEN t = '' THEN 1 ELSE (length(t) + 39) // 40 END AS INTEGER) AS lines, md5(substring(t, 1, 40)) AS first, CAST(CASE WHEN t = '' THEN 0 ELSE (length(t) - 1) % 40 + 1 END AS INTEGER) AS last_length FROM t"
)
def wrapped_text(spark, sf):
    """Turns as text boxes of characters of one width, broken greedily at forty."""
    letters = [chr(c) for c in range(32, 127)]
    widths = F.create_map(*(F.lit(x) for c in letters for x in (c, 1.0)))
    rows = B.read(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "").alias("t"))
    lines = rows.select("conv_id", "turn", L.wrapped("t", widths, 40).alias("lines"))
    return lines.select("conv_id", "turn", F.size("lines").alias("lines"), F.md5(F.element_at("lines", 1)).alias("first"), F.length(F.element_at("lines", -1)).alias("last_length"))


@query(
    "SELECT doc_id, sha256(substring(text, 1, 3)) AS head, length(text) - 3 AS bytes, sha256(substring(text, 4)) AS tail FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM documents) WHERE length(text) > 3"
)
def file_tails(spark, sf):
    """What follows a file's first three bytes."""
    rows = B.read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("text")).filter(F.length("text") > 3)
    kept = sidecars.tail(rows.withColumn("content", F.col("text").cast("binary")), 3)
    return kept.select("doc_id", F.sha2(F.substring("text", 1, 3), 256).alias("head"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("tail"))


# ---------------------------------------------------------------- sizes and places


@query(
    f"""WITH d AS (SELECT doc_id, CAST(n_chars % 3000 AS INTEGER) AS w, CAST(doc_id * 13 % 2000 AS INTEGER) AS h, (doc_id % 11) / CAST(10 AS DOUBLE) AS a FROM documents WHERE n_chars IS NOT NULL),
    s AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN CAST(w AS DOUBLE) / h ELSE 1 END AS aspect FROM d),
    c AS (SELECT *, least(greatest(CAST(trunc((w + 1) * a) AS INTEGER), 0), w) AS l, least(greatest(CAST(trunc((h + 1) * a) AS INTEGER), 0), h) AS t FROM s)
    SELECT doc_id, l, t, least(greatest(CAST(trunc((w + 1) * (a + 0.3)) AS INTEGER), l + 1), w + 1) AS r, least(greatest(CAST(trunc((h + 1) * (a + 0.3)) AS INTEGER), t + 1), h + 1) AS b,
           CAST(CASE WHEN w // 100 >= 2 THEN pow(2, floor(log2(w // 100))) ELSE 1 END AS INTEGER) AS factor,
           round(least(greatest({_d(0.48 * L.PAGE_ASPECT)} / aspect, 0.12), 0.58), 6) AS image, round(least(greatest({_d(0.36 * L.PAGE_ASPECT)} / aspect, 0.10), 0.52), 6) AS sticker,
           round(CAST(least({_d(0.06)} + (doc_id % 8) * {_d(0.065)}, 0.86) AS DOUBLE), 6) AS link, CAST(CASE WHEN h > 0 THEN w * 5 // h ELSE 0 END AS INTEGER) AS copied FROM c"""
)
def object_sizes(spark, sf):
    """Crops in pixels, sample factors, sizes of new images and stickers, places of links, copy progress."""
    d = B.read(spark, sf, "documents").filter("n_chars is not null")
    d = d.select("doc_id", (F.col("n_chars") % 3000).cast("int").alias("w"), (F.col("doc_id") * 13 % 2000).cast("int").alias("h"), ((F.col("doc_id") % 11) / F.lit(10.0)).alias("a"))
    w, h, a = F.col("w"), F.col("h"), F.col("a")
    crop = L.crop_pixels(w + 1, h + 1, a, a, a + 0.3, a + 0.3)
    rows = d.withColumn("c", crop)
    return rows.select(
        "doc_id", F.col("c.left").alias("l"), F.col("c.top").alias("t"), F.col("c.right").alias("r"), F.col("c.bottom").alias("b"), L.sample_factor(w, 100).alias("factor"),
        F.round(L.insert_size("image", w, h)["height"], 6).alias("image"), F.round(L.insert_size("sticker", w, h)["height"], 6).alias("sticker"), F.round(L.link_place(F.col("doc_id")), 6).alias("link"), jobs.copy_progress(w, h).alias("copied"),
    )


@query(
    "WITH p AS (SELECT page_id, CAST(length(html) % 900 + 100 AS INTEGER) AS w, CAST(length(url) * 10 AS INTEGER) AS h, CAST(page_id % 9 * 90 - 180 AS INTEGER) AS deg FROM pages), q AS (SELECT *, ((deg % 360) + 360) % 360 AS rot FROM p) "
    "SELECT page_id, CAST(rot AS INTEGER) AS rot, CASE WHEN rot % 180 = 0 THEN w ELSE h END AS width, CASE WHEN rot % 180 = 0 THEN h ELSE w END AS height, "
    "CAST(CASE rot WHEN 90 THEN 3 + w WHEN 180 THEN 3 + w WHEN 270 THEN 3 ELSE 3 END AS DOUBLE) AS e, CAST(CASE rot WHEN 180 THEN 4 + h WHEN 270 THEN 4 + h ELSE 4 END AS DOUBLE) AS f, CAST(CASE rot WHEN 180 THEN -1 WHEN 0 THEN 1 ELSE 0 END AS DOUBLE) AS a FROM q"
)
def page_rotation(spark, sf):
    """Rotations, display sizes and matrices of pages."""
    p = B.read(spark, sf, "pages").select("page_id", (F.length("html") % 900 + 100).alias("w"), (F.length("url") * 10).alias("h"), (F.col("page_id") % 9 * 90 - 180).cast("int").alias("deg"))
    deg, w, h = F.col("deg"), F.col("w"), F.col("h")
    rows = p.select("page_id", jobs.rotation(deg).alias("rot"), jobs.display_size(deg, w, h).alias("s"), jobs.display_matrix(deg, F.lit(3), F.lit(4), w, h).alias("m"))
    return rows.select("page_id", "rot", "s.width", "s.height", F.get("m", F.lit(4)).alias("e"), F.get("m", F.lit(5)).alias("f"), F.get("m", F.lit(0)).alias("a"))


@query(
    f"""WITH r AS (SELECT l_orderkey AS line, CAST(sum(l_quantity) AS DOUBLE) / 100 AS natural_width, count(*) AS n FROM lineitem GROUP BY l_orderkey),
    x AS (SELECT *, CAST(line % 500 AS INTEGER) AS l, CAST(line % 700 AS INTEGER) AS t, CAST(line % 500 + line % 90 AS INTEGER) AS r, CAST(line % 700 + line % 60 AS INTEGER) AS b FROM r),
    y AS (SELECT *, greatest((r - l) * {_d(0.5)}, 0.5) AS w, greatest((b - t) * {_d(0.25)}, 1.0) AS h FROM x WHERE r > l AND b > t AND line % 13 <> 0), z AS (SELECT *, least(greatest(h * {_d(0.88)}, 1.0), 96.0) AS size FROM y)
    SELECT line, round(l * {_d(0.5)}, 6) AS x, round(900 - b * {_d(0.25)} + h * {_d(0.12)}, 6) AS y, round(size, 6) AS font_size, round(least(greatest(w / (natural_width * size) * 100, 5.0), 1000.0), 6) AS scale FROM z"""
)
def text_layer(spark, sf):
    """Where recognised lines with text and an area go, with the width of their font runs."""
    items = B.read(spark, sf, "lineitem")
    widths = jobs.natural_widths(items.select(F.col("l_orderkey").alias("line"), F.col("l_quantity").cast("double").alias("width"))).withColumn("natural_width", F.col("natural_width") / 100)
    line = F.col("line")
    lines = widths.withColumns({"l": (line % 500).cast("int"), "t": (line % 700).cast("int"), "r": (line % 500 + line % 90).cast("int"), "b": (line % 700 + line % 60).cast("int"), "text": F.when(line % 13 == 0, " \n ").otherwise("a\nb")})
    placed = jobs.line_placement(jobs.usable_lines(lines), 0.5, 0.25, 900.0)
    return placed.select("line", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("font_size", 6).alias("font_size"), F.round("horizontal_scale", 6).alias("scale"))


@query(
    "WITH p AS (SELECT page_id, CAST(page_id % 4 AS INTEGER) AS k FROM pages), c AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"({k}, {len(parts)}, {sum(x for x, _, _, _ in parts)}, {sum(y for _, _, _, y in parts)})"
        for k, parts in enumerate(
            [
                [],
                [(70, y, 1170, y) for y in range(110, 1685, 72)],
                [(55, y, 1185, y) for y in range(110, 1685, 72)] + [(x, 110, x, 1684) for x in range(55, 1186, 72)],
                [(x, y, x, y) for y in range(110, 1685, 72) for x in range(70, 1171, 72)],
            ]
        )
    )
    + ") v(k, n, x, y)) SELECT page_id, CAST(n AS INTEGER) AS n, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM p JOIN c USING (k)"
)
def template_grids(spark, sf):
    """Number and sums of the lines or dots of each page's template."""
    template = F.get(F.array(*map(F.lit, ("BLANK", "RULED", "GRID", "DOT"))), (F.col("page_id") % 4).cast("int"))
    rows = B.read(spark, sf, "pages").select("page_id", L.template_lines(template).alias("ls"))
    total = lambda c: F.aggregate("ls", F.lit(0.0), lambda s, p: s + p[c])
    return rows.select("page_id", F.size("ls").alias("n"), total("x0").alias("x"), total("y1").alias("y"))


# ---------------------------------------------------------------- fonts

_NAMES = "p_partkey || CASE p_partkey % 7 WHEN 0 THEN '-Regular' WHEN 1 THEN '-Bold' WHEN 2 THEN '-CJK-SC' WHEN 3 THEN '-Sans-Fallback' WHEN 4 THEN '-Emoji' WHEN 5 THEN '-KR-Bold' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN '.ttf' WHEN 1 THEN '.TTC' WHEN 2 THEN '.otf' WHEN 3 THEN '.txt' ELSE '.ttf.bak' END"


def _contains(*parts: str) -> str:
    return "(" + " OR ".join(f"contains(n, '{p}')" for p in parts) + ")"


_SCORE = (
    f"CASE WHEN {_contains(*fonts.EXCLUDED)} THEN {fonts.RULED_OUT} ELSE CASE WHEN {_contains('bold')} THEN {fonts.NOT_BOLD} ELSE 0 END + "
    + " + ".join(f"CASE WHEN {_contains(p)} THEN {v} ELSE 0 END" for p, v in fonts.SCORES.items())
    + f" + CASE WHEN {_contains(*fonts.LANGUAGE['chinese'])} THEN {fonts.LANGUAGE_SCORE} ELSE 0 END END"
)


@query(
    f"WITH f AS (SELECT p_partkey, {_NAMES} AS file_name, '/fonts/' || p_brand || '/' || {_NAMES} AS path FROM part), g AS (SELECT *, lower(file_name) AS n FROM f WHERE regexp_matches(lower(file_name), '\\.(ttf|ttc|otf)$')) "
    f"SELECT p_partkey, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (ORDER BY CASE WHEN p_partkey % 35 = 0 THEN p_partkey END ASC NULLS LAST, score DESC, path) AS INTEGER) AS turn FROM (SELECT *, {_SCORE} AS score FROM g)"
)
def font_candidates(spark, sf):
    """Font files in the order to try them: the named ones, then by score and path."""
    k = F.col("p_partkey")
    kinds = F.get(F.array(*map(F.lit, ("-Regular", "-Bold", "-CJK-SC", "-Sans-Fallback", "-Emoji", "-KR-Bold", ""))), (k % 7).cast("int"))
    ends = F.get(F.array(*map(F.lit, (".ttf", ".TTC", ".otf", ".txt", ".ttf.bak"))), (k % 5).cast("int"))
    files = B.read(spark, sf, "part").select(k, F.concat(k.cast("string"), kinds, ends).alias("file_name"), "p_brand")
    files = files.withColumn("path", F.concat(F.lit("/fonts/"), F.col("p_brand"), F.lit("/"), F.col("file_name")))
    named = files.filter(k % 35 == 0).select("file_name", F.col("p_partkey").alias("place"))
    found = fonts.candidates(files, named, "chinese")
    order = [F.col("place").asc_nulls_last(), F.desc("score"), F.col("path")]
    return found.select("p_partkey", "score", F.row_number().over(Window.orderBy(*order)).alias("turn"))


@query(
    "WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[\\s\\p{Cf}\\x1C-\\x1F\\x85]', '', 'g'), ''), lambda c: c <> '') AS cs, doc_id % 3 AS k FROM documents) "
    "SELECT doc_id, len(list_filter(cs, lambda c: NOT (c BETWEEN ' ' AND '~') AND NOT (k = 1 AND unicode(c) % 2 = 0))) = 0 AS covered, CAST(len(list_filter(cs, lambda c: regexp_matches(c, '\\p{Han}'))) AS INTEGER) AS han FROM d"
)
def font_coverage(spark, sf):
    """Whether a font of ASCII characters, for some with even others, covers a text, and how many Han characters it has."""
    d = B.read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = F.transform(F.sequence(F.lit(32), F.lit(126)), lambda c: F.char(c))
    others = F.filter(F.array_distinct(fonts.visible("text")), lambda c: F.ascii(c) % 2 == 0)  # the code point, whatever its name
    rows = d.withColumn("cover", F.when(F.col("doc_id") % 3 == 1, F.concat(plain, others)).otherwise(plain))
    return rows.select("doc_id", fonts.supports("text", "cover").alias("covered"), fonts.han_coverage("text", "cover")["han"].alias("han"))


@query(
    "WITH g AS (SELECT o_custkey AS font, o_orderkey % 60000 + 1 AS cid, chr(CAST(65 + o_orderkey % 900 AS INTEGER)) AS ch, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 60000 ORDER BY o_orderkey) = 1), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY font ORDER BY cid) - 1 AS place FROM g) "
    "SELECT font, CAST(place // 100 AS INTEGER) AS block, CAST(count(*) AS INTEGER) AS n, md5(string_agg('<' || printf('%04X', cid) || '> <' || printf('%04X', unicode(ch)) || '>', ' ' ORDER BY cid)) AS digest FROM p GROUP BY font, place // 100"
)
def glyph_blocks(spark, sf):
    """Blocks of a hundred rows of each font's glyph map."""
    o = B.read(spark, sf, "orders").select(F.col("o_custkey").alias("font"), (F.col("o_orderkey") % 60000 + 1).cast("int").alias("cid"), (65 + F.col("o_orderkey") % 900).alias("code"), "o_orderkey")
    once = o.groupBy("font", "cid").agg(F.min_by("code", "o_orderkey").alias("code"))
    ch = F.decode(F.unhex(F.lpad(F.hex("code"), 4, "0")), "UTF-16BE")
    rows = fonts.glyph_map(once.select("font", "cid", ch.alias("ch")), ["font"])
    return rows.select("font", "block", F.size("rows").alias("n"), F.md5(F.array_join("rows", " ")).alias("digest"))


@query(
    "SELECT glyph, arg_min(code_point, ord + CASE WHEN code_point BETWEEN 11904 AND 12255 THEN 1000000000 ELSE 0 END) AS code_point FROM (SELECT l_partkey AS glyph, l_orderkey * 10 + l_linenumber AS ord, 11800 + (l_orderkey * 7 + l_linenumber) % 600 AS code_point FROM lineitem) GROUP BY glyph"
)
def glyph_representatives(spark, sf):
    """One code point a glyph: the first that is no radical's alias, if there is one."""
    li = B.read(spark, sf, "lineitem")
    glyphs = li.select(F.col("l_partkey").alias("glyph"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (11800 + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 600).alias("code_point"))
    return jobs.first_representatives(glyphs).select("glyph", "code_point")


# ---------------------------------------------------------------- geometry


def _strokes(spark, sf) -> DataFrame:
    return B.strokes(B.read(spark, sf, "embeddings"))


@query(
    f"""WITH {XY}, b AS (SELECT page_index, ord, greatest(min(x) - 0.008, 0) AS l, greatest(min(y) - 0.012, 0) AS t, least(max(x) + 0.008, 1) AS r, least(max(y) + 0.012, 1) AS b, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM e GROUP BY page_index, ord)
    SELECT page_index, ord, round(l, 6) AS l, round(t, 6) AS t, round(r, 6) AS r, round(b, 6) AS b, round(least(x0, 0.4), 6) AS ul, round(least(y0, 0.5), 6) AS ut, round(greatest(x1, 0.6), 6) AS ur, round(greatest(y1, 0.7), 6) AS ub,
           round(least(greatest((b - t) * 1000, 90.0) * 1.7, 1000.0), 4) AS height FROM b"""
)
def stroke_boxes(spark, sf):
    """Padded bounds, their union with a fixed box, and the height that a recogniser is told."""
    fixed = F.struct(*(F.lit(v).alias(n) for n, v in (("left", 0.4), ("top", 0.5), ("right", 0.6), ("bottom", 0.7))))
    rows = _strokes(spark, sf).select("page_index", "ord", G.padded_bounds("points").alias("p"), G.union(G.bounds("points"), fixed).alias("u"))
    sides = [F.round(f"{c}.{n}", 6).alias(f"{'u' if c == 'u' else ''}{n[0]}") for c in "pu" for n in ("left", "top", "right", "bottom")]
    return rows.select("page_index", "ord", *sides, F.round(L.writing_height(F.col("p.top"), F.col("p.bottom")), 4).alias("height"))


_RAW = "CASE WHEN vec_id % 9 = 0 AND pt = 3 THEN CAST('NaN' AS DOUBLE) WHEN vec_id % 11 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(embedding[2 * pt + {i}] AS DOUBLE) * 4 END"


@query(
    f"""WITH p AS (SELECT vec_id, label, pt, {_RAW.format(i=1)} AS x, {_RAW.format(i=2)} AS y FROM (SELECT *, unnest(range(0, len(embedding) // 2)) AS pt FROM embeddings)),
    g AS (SELECT vec_id, label, count(*) AS n, round(sum(least(greatest(x, 0.0), 1.0)), 5) AS sx, round(sum(least(greatest(y, 0.0), 1.0)), 5) AS sy FROM p WHERE isfinite(x) AND isfinite(y) GROUP BY vec_id, label)
    SELECT vec_id, label, CAST(n AS INTEGER) AS n, sx, sy, CAST(least(greatest((vec_id % 90) - 5, 0.2), 64) AS DOUBLE) AS width FROM g WHERE vec_id % 13 <> 0"""
)
def sanitised_strokes(spark, sf):
    """Finite points inside the page, widths within their limits; strokes without a width or points go."""
    e = B.read(spark, sf, "embeddings")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    odd = lambda i, v: F.when((F.col("vec_id") % 9 == 0) & (i == 3), nan).when(F.col("vec_id") % 11 == 0, inf).otherwise(v.cast("double") * 4)
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: F.struct(odd(i, F.get("embedding", 2 * i)).alias("x"), odd(i, F.get("embedding", 2 * i + 1)).alias("y"), F.lit(0.5).alias("pressure"), i.cast("long").alias("time_ms")))
    width = F.when(F.col("vec_id") % 13 == 0, nan).otherwise((F.col("vec_id") % 90 - 5).cast("double"))
    kept = ink.sanitize(e.select("vec_id", "label", points.alias("points"), width.alias("base_width_dp")))
    total = lambda c: F.round(F.aggregate("points", F.lit(0.0), lambda s, p: s + p[c]), 5)
    return kept.select("vec_id", "label", F.size("points").alias("n"), total("x").alias("sx"), total("y").alias("sy"), F.col("base_width_dp").alias("width"))


@query(
    f"""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 400 AS x0, CAST(embedding[2] AS DOUBLE) * 400 AS y0, CAST(embedding[3] AS DOUBLE) * 400 AS x1, CAST(embedding[4] AS DOUBLE) * 400 AS y1 FROM embeddings),
    q AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS d, round_even(atan2(y1 - y0, x1 - x0) / {_d(pi / 12)}, 0) * {_d(pi / 12)} AS a FROM p)
    SELECT vec_id, round(CASE WHEN d < 0.5 THEN x0 ELSE x0 + cos(a) * d END, 4) AS x, round(CASE WHEN d < 0.5 THEN y0 ELSE y0 + sin(a) * d END, 4) AS y FROM q"""
)
def ruler_ends(spark, sf):
    """Lines snapped to multiples of fifteen degrees."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 400
    rows = B.read(spark, sf, "embeddings").select("vec_id", G.ruler_end(at(0), at(1), at(2), at(3)).alias("p"))
    return rows.select("vec_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


def _on(shape: str, points: list[tuple[str, str]]) -> str:
    xs, ys = " + ".join(x for x, _ in points), " + ".join(y for _, y in points)
    return f"WHEN '{shape}' THEN [CAST({len(points)} AS DOUBLE), {xs}, {ys}]"


def _steps(a: tuple[str, str], b: tuple[str, str], n: int) -> list[tuple[str, str]]:
    return [tuple(f"({p} + ({q} - {p}) * {_d(i / n)})" for p, q in zip(a, b, strict=True)) for i in range(n + 1)]


_LT, _RT, _RB, _LB = ("l", "t"), ("r", "t"), ("r", "b"), ("l", "b")
_TIP, _BASE = ("x1", "y1"), ("x0", "y0")
_BARBS = [(f"(x1 - head * (x1 - x0) {s} head * {_d(0.55)} * (y1 - y0))", f"(y1 - head * (y1 - y0) {o} head * {_d(0.55)} * (x1 - x0))") for s, o in (("-", "+"), ("+", "-"))]
_SHAPES = {
    "LINE": _steps(_BASE, _TIP, 16),
    "RECTANGLE": [p for a, b in ((_LT, _RT), (_RT, _RB), (_RB, _LB), (_LB, _LT)) for p in _steps(a, b, 8)],
    "TRIANGLE": [p for a, b in ((("(l + r) / 2", "t"), _RB), (_RB, _LB), (_LB, ("(l + r) / 2", "t"))) for p in _steps(a, b, 8)],
    "ELLIPSE": [(f"((l + r) / 2 + cos({_d(2 * pi * i / 32)}) * (r - l) / 2)", f"((t + b) / 2 + sin({_d(2 * pi * i / 32)}) * (b - t) / 2)") for i in range(32)],
    "ARROW": _steps(_BASE, _TIP, 16) + _steps(_TIP, _BARBS[0], 8) + _steps(_TIP, _BARBS[1], 8),
}


@query(
    f"""WITH {XY}, f AS (SELECT page_index, ord, arg_min(x, pt) AS x0, arg_min(y, pt) AS y0, arg_max(x, pt) AS x1, arg_max(y, pt) AS y1 FROM e GROUP BY page_index, ord),
    g AS (SELECT *, least(x0, x1) AS l, greatest(x0, x1) AS r, least(y0, y1) AS t, greatest(y0, y1) AS b, least(0.08 / greatest(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 0.0001), 0.28) AS head, list_extract({list(_SHAPES)}, CAST(ord % 5 + 1 AS INTEGER)) AS shape FROM f),
    s AS (SELECT page_index, ord, shape, CASE shape {" ".join(_on(name, points) for name, points in _SHAPES.items())} END AS v FROM g)
    SELECT page_index, ord, shape, CAST(v[1] AS INTEGER) AS n, round(v[2], 5) AS sx, round(v[3], 5) AS sy FROM s"""
)
def shape_outlines(spark, sf):
    """Points on the outlines of shapes that an eraser tests: number and sums."""
    shape = F.get(F.array(*map(F.lit, _SHAPES)), (F.col("ord") % 5).cast("int"))
    rows = _strokes(spark, sf).select("page_index", "ord", shape.alias("shape"), G.shape_probes(shape, "points").alias("p"))
    total = lambda c: F.round(F.aggregate("p", F.lit(0.0), lambda s, q: s + q[c]), 5)
    return rows.select("page_index", "ord", "shape", F.size("p").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


@query(
    "WITH s AS (SELECT label AS page, vec_id, vec_id % 5 = 0 AS marker, list_filter(range(0, len(embedding) // 2), lambda i: NOT (vec_id % 4 = 0 AND i < 30) AND vec_id % 6 <> 0) AS pts FROM embeddings), k AS (SELECT page // 3 * 3 + page % 3 AS page, vec_id, len(pts) AS n FROM s WHERE NOT marker AND len(pts) > 0) "
    "SELECT page AS page_index, vec_id AS ord, CAST(n AS INTEGER) AS n FROM k WHERE page IN (SELECT page FROM k GROUP BY page HAVING count(*) >= 2)"
)
def recognisable_strokes(spark, sf):
    """Strokes that go to handwriting recognition: no highlighter, valid points, two on a page at least."""
    s = _strokes(spark, sf)
    bad = (F.col("ord") % 4 == 0, F.col("ord") % 6 == 0)
    odd = F.transform("points", lambda p, i: F.struct(F.when(bad[1] | (bad[0] & (i < 30)), F.lit(float("nan"))).otherwise(p.x).alias("x"), p.y.alias("y"), p.pressure.alias("pressure"), p.time_ms.alias("time_ms")))
    kept = ink.recognisable(s.withColumns({"points": odd, "highlighter": F.col("ord") % 5 == 0}))
    return kept.select("page_index", "ord", F.size("points").alias("n"))


@query(
    "WITH i AS (SELECT o_custkey AS page, o_orderkey AS ord, CAST(o_orderkey * 31 % 900 AS DOUBLE) AS top, CAST(50 + o_orderkey % 60 AS DOUBLE) AS height FROM orders) "
    "SELECT page, ord FROM i QUALIFY row_number() OVER (PARTITION BY page ORDER BY abs(top + height / 2 - 450), ord) = 1"
)
def nearest_items(spark, sf):
    """The item of each page that is nearest to the middle of the viewport."""
    items = B.read(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * 31 % 900).cast("double").alias("top"), (50 + F.col("o_orderkey") % 60).cast("double").alias("height"))
    return L.nearest_item(items, ["page"], 450.0).select("page", "ord")


# ---------------------------------------------------------------- lists and logs


@query(
    "WITH b AS (SELECT conv_id, list(turn ORDER BY turn) AS a, count(*) AS n FROM conversations GROUP BY conv_id) "
    "SELECT conv_id, list_aggregate(list_transform(list_concat(list_transform(a, lambda x: 'T' || x), list_transform(range(0, 9), lambda x: 'BLANK'))[1:6], lambda x: x), 'string_agg', ',') AS padded, "
    "list_aggregate(list_concat(a[1:2], a[4:]), 'string_agg', ',') AS less, list_aggregate(list_concat(a[1:2], a[2:]), 'string_agg', ',') AS more, CAST(greatest(least(CASE WHEN n - 1 > 2 THEN n - 2 ELSE n - 1 END, n - 2), 0) AS INTEGER) AS resume, "
    "list_aggregate(CASE WHEN list_contains(a, 3) THEN list_filter(a, lambda x: x <> 3) ELSE list_sort(list_append(a, 3)) END, 'string_agg', ',') AS toggled, list_aggregate(list_distinct(list_concat([9], a))[1:1], 'string_agg', ',') IS NOT NULL AS some FROM b"
)
def page_lists(spark, sf):
    """Templates padded to six pages, pages deleted and duplicated, the page to resume at, a toggled bookmark."""
    b = B.read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("a"))
    text = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    n = F.size("a")
    return b.select(
        "conv_id",
        text(P.padded(F.transform("a", lambda x: F.concat(F.lit("T"), x.cast("string"))), "BLANK", F.lit(6))).alias("padded"),
        text(P.array_delete(F.col("a"), 2)).alias("less"),
        text(P.array_duplicate(F.col("a"), 1)).alias("more"),
        P.resume_after_delete(n - 1, 2, n).alias("resume"),
        text(P.toggle(F.col("a"), 3)).alias("toggled"),
        (F.size(assembly.first_choices(F.array(F.lit(9)), F.col("a"), limit=1)) > 0).alias("some"),
    )


@query(
    "WITH l AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN 'other' ELSE 'export-v1' END AS tag, k * 100 AS orig, CAST(event_id % 50 AS INTEGER) AS pages, CAST(user_id % 60 AS INTEGER) AS nxt, k * 100 + user_id - 20 AS work, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)) "
    "SELECT event_id, CAST(orig AS BIGINT) AS original_length, pages AS page_count, CASE WHEN k % 7 = 0 THEN NULL ELSE nxt END AS next_page, CAST(work AS BIGINT) AS working_length, tag = 'export-v1' AND k % 7 <> 0 AND orig > 0 AND pages > 0 AND nxt <= pages AND work >= orig AS valid FROM l"
)
def export_journal(spark, sf):
    """Records of export journals, and whether they hold."""
    e = B.read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    line = F.concat_ws("\t", F.when(k % 10 == 0, "other").otherwise("export-v1"), k * 100, F.col("event_id") % 50, F.when(k % 7 == 0, "x").otherwise((F.col("user_id") % 60).cast("string")), k * 100 + F.col("user_id") - 20)
    return jobs.parse_journal(e.select("event_id", line.alias("value"))).drop("value")


@query(
    "WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'job' WHEN 1 THEN 'legacy' WHEN 2 THEN 'orphan' WHEN 4 THEN 'font' ELSE 'other' END AS class, length(html) AS bytes, CASE page_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'paused' ELSE 'failed' END AS status FROM pages) "
    "SELECT page_id, class, CAST(bytes AS BIGINT) AS bytes, CASE WHEN class IN ('legacy', 'orphan') THEN 'delete' WHEN class <> 'job' THEN 'keep' ELSE 'delete' END AS action FROM p"
)
def cleanup_actions(spark, sf):
    """What a clean-up that also discards unfinished work does with each folder while nothing runs."""
    from pagelake.plans.queries import _files

    files = _files(spark, sf)
    tasks = B.read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("task"), F.get(F.array(*map(F.lit, ("done", "paused", "failed"))), (F.col("page_id") % 3).cast("int")).alias("status"))
    plan = storage.cleanup_plan(storage.classify(files, tasks), tasks, discard=True)
    return plan.join(files.select("root", "top_name", "page_id"), ["root", "top_name"]).select("page_id", "class", "bytes", "action")


@query(
    "WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS fp, CAST(turn AS INTEGER) AS page, text FROM conversations), n AS (SELECT fp, page, CASE WHEN page % 2 = 0 THEN '' ELSE 'new ' || text END AS text FROM c WHERE page % 3 <> 1) "
    "SELECT fp AS fingerprint, page AS page_index, text FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.fp = c.fp AND n.page = c.page) UNION ALL SELECT * FROM n WHERE text <> ''"
)
def pages_put(spark, sf):
    """Pages of a store after some have been written anew; empty ones are removed."""
    c = B.read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("fingerprint"), F.col("turn").cast("int").alias("page_index"), "text")
    new = c.filter("page_index % 3 <> 1").withColumn("text", F.when(F.col("page_index") % 2 == 0, "").otherwise(F.concat(F.lit("new "), F.col("text"))))
    return assembly.put_pages(c, new, ["fingerprint", "page_index"], F.col("text") == "")


@query(
    "WITH t AS (SELECT vec_id AS gesture, vec_id % 4 + 1 AS fingers, CAST(embedding[1] AS DOUBLE) + 0.8 AS scale, CAST(embedding[2] AS DOUBLE) * 900 AS dx, CAST(embedding[3] AS DOUBLE) * 900 AS dy, CAST(embedding[4] AS DOUBLE) * 2000 AS v, vec_id % 10 = 0 AS cancelled FROM embeddings) "
    "SELECT gesture, CASE WHEN cancelled THEN 'cancelled' WHEN fingers >= 3 AND scale < 0.72 THEN 'pinch' WHEN fingers >= 3 AND abs(dx) > 72 AND abs(dx) > 1.15 * abs(dy) THEN 'swipe' WHEN fingers = 2 AND abs(v) > 120 THEN 'fling' WHEN fingers = 2 THEN 'pan' ELSE 'draw' END AS kind FROM t"
)
def gesture_kinds(spark, sf):
    """What each gesture is."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = B.read(spark, sf, "embeddings")
    touches = e.select(F.col("vec_id").alias("gesture"), (F.col("vec_id") % 4 + 1).alias("fingers"), (at(0) + 0.8).alias("scale"), (at(1) * 900).alias("dx"), (at(2) * 900).alias("dy"), (at(3) * 2000).alias("velocity"), (F.col("vec_id") % 10 == 0).alias("cancelled"))
    return assembly.gestures(touches)


@query(
    "WITH o AS (SELECT CAST(conv_id AS VARCHAR) AS fp, CAST(turn AS INTEGER) AS page FROM conversations GROUP BY ALL), "
    "i AS (SELECT CAST(conv_id AS VARCHAR) AS fp, CAST(turn AS INTEGER) AS page, 2 AS layer, turn AS ord, conv_id || '-' || turn AS id FROM conversations WHERE role = 'user' UNION ALL SELECT CAST(vec_id % 100 AS VARCHAR), label, 1, vec_id, CAST(vec_id AS VARCHAR) FROM embeddings) "
    "SELECT o.fp AS fingerprint, o.page AS page_index, o.page * 2 AS source_page, i.layer AS layer, CAST(i.ord AS BIGINT) AS ord, i.id AS id FROM o LEFT JOIN i ON o.fp = i.fp AND o.page = i.page"
)
def page_assembly(spark, sf):
    """Everything that lies on each page of a book, in drawing order."""
    c = B.read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("fingerprint"), F.col("turn").cast("int").alias("page_index"), F.col("turn").alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("id"), "role")
    order = c.select("fingerprint", "page_index").distinct().withColumn("source_page", F.col("page_index") * 2)
    strokes = B.read(spark, sf, "embeddings").select((F.col("vec_id") % 100).cast("string").alias("fingerprint"), F.col("label").alias("page_index"), F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"))
    return assembly.page_items(order, text=c.filter("role = 'user'"), ink=strokes)


@query(
    "SELECT font, glyph, CAST((row_number() OVER (PARTITION BY font ORDER BY glyph) - 1) // 100 AS INTEGER) AS batch FROM (SELECT DISTINCT l_suppkey AS font, l_partkey AS glyph FROM lineitem)"
)
def glyph_batches(spark, sf):
    """Batches of a hundred glyphs of each font."""
    li = B.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("font"), F.col("l_partkey").alias("glyph")).distinct()
    return jobs.numbered_batches(li, ["font"], [F.col("glyph")])
