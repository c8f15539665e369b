"""Choosing fonts for text layers, and the maps that make their text searchable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a file name and what they add to its score; parts that rule a font out.
SCORES = {"cjk": 100, "fallback": 90, "sans": 20, "regular": 15}
EXCLUDED = ("emoji", "symbol", "math")
LANGUAGE = {"chinese": ("sc", "hans", "chinese", "zh"), "korean": ("kr", "korean", "ko"), "japanese": ("jp", "japanese", "ja")}
LANGUAGE_SCORE, BOLD, NOT_BOLD, RULED_OUT = 80, 20, -10, -1000
#: Rows of a block in a glyph map.
MAP_ROWS = 100


def _any(name: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def font_score(file_name: Column | str, script: str, bold: bool = False) -> Column:
    name = F.lower(F.col(file_name) if isinstance(file_name, str) else file_name)
    score = F.when(name.contains("bold"), BOLD if bold else NOT_BOLD).otherwise(0)
    for part, add in SCORES.items():
        score = score + F.when(name.contains(part), add).otherwise(0)
    score = score + F.when(_any(name, LANGUAGE.get(script, ())), LANGUAGE_SCORE).otherwise(0)
    return F.when(_any(name, EXCLUDED), RULED_OUT).otherwise(score)


def candidates(files: DataFrame, priority: DataFrame, script: str, bold: bool = False) -> DataFrame:
    """Font files in the order to try them: named ones first, then by score and path; each file once.

    files: (path, file_name); priority: (file_name, place).
    """
    kinds = files.filter(F.lower("file_name").rlike(r"\.(ttf|ttc|otf)$"))
    both = kinds.join(priority.select("file_name", "place"), "file_name", "left").withColumn("score", font_score("file_name", script, bold))
    order = [F.col("place").asc_nulls_last(), F.desc("score"), F.col("path")]
    first = both.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).filter("__n = 1").drop("__n")
    return first.orderBy(*order)


def embeddable(tables: Column | str) -> Column:
    """Can a subset of the font be embedded? It needs outlines of the glyf kind."""
    t = F.col(tables) if isinstance(tables, str) else tables
    return F.array_contains(t, "glyf") & F.array_contains(t, "loca") & ~F.array_contains(t, "CFF ")


def visible(text: Column | str) -> Column:
    """Characters that need a glyph."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, ""), lambda c: (c != "") & ~c.rlike(r"(?U)^[\s\p{Cf}]$"))


def supports(text: Column | str, coverage: Column | str) -> Column:
    """Does an array of characters cover the text?"""
    c = F.col(coverage) if isinstance(coverage, str) else coverage
    return F.size(F.array_except(visible(text), c)) == 0


def han_coverage(text: Column | str, coverage: Column | str) -> Column:
    """struct<han, resolved, usable>: a line with Han characters needs a font for one of them at least."""
    c = F.col(coverage) if isinstance(coverage, str) else coverage
    han = F.filter(visible(text), lambda ch: ch.rlike(r"\p{IsHan}"))
    found = F.size(F.filter(han, lambda ch: F.array_contains(c, ch)))
    return F.struct(F.size(han).alias("han"), found.alias("resolved"), ((F.size(han) == 0) | (found > 0)).alias("usable"))


def glyph_map(glyphs: DataFrame, scope: list[str]) -> DataFrame:
    """Blocks of a glyph-to-text map: (scope, block, rows) with lines ``<cid> <utf-16>`` in glyph order.

    glyphs: (scope, cid, ch). A glyph outside 1..65535 or a lone surrogate is an error.
    """
    good = F.col("cid").between(1, 0xFFFF)
    cid = F.when(good, F.lpad(F.hex("cid"), 4, "0")).otherwise(F.raise_error(F.concat(F.lit("glyph out of range: "), F.col("cid").cast("string"))))
    line = F.concat(F.lit("<"), cid, F.lit("> <"), F.hex(F.encode("ch", "UTF-16BE")), F.lit(">"))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy("cid")) - 1
    rows = glyphs.withColumns({"line": line, "place": place}).withColumn("block", F.floor(F.col("place") / MAP_ROWS).cast("int"))
    parts = rows.groupBy(*scope, "block").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("ls"))
    return parts.select(*scope, "block", F.transform("ls", lambda x: x.line).alias("rows"))
