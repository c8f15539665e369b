import pytest
from pyspark.sql import functions as F

from pagelake.functions import fonts


def test_candidates(spark):
    files = spark.createDataFrame([("/s/NotoSansCJK-Regular.ttc", "NotoSansCJK-Regular.ttc"), ("/s/Emoji.ttf", "Emoji.ttf"), ("/s/B.ttf", "B.ttf"), ("/s/x.txt", "x.txt"), ("/s/NotoSansSC.otf", "NotoSansSC.otf")], "path string, file_name string")
    named = spark.createDataFrame([("B.ttf", 0)], "file_name string, place int")
    assert [r["file_name"] for r in fonts.candidates(files, named, "chinese").collect()] == ["B.ttf", "NotoSansCJK-Regular.ttc", "NotoSansSC.otf", "Emoji.ttf"]
    score = lambda name, script, bold: spark.range(1).select(fonts.font_score(F.lit(name), script, bold).alias("s")).first()["s"]
    assert score("NotoSansSC-Bold.ttf", "chinese", True) == 120 and score("NotoSansSC-Bold.ttf", "korean", False) == 10


def test_coverage(spark):
    row = spark.createDataFrame([("a 漢​字", ["a", "漢"], ["glyf", "loca"])], "text string, cover array<string>, tables array<string>").select(
        fonts.supports("text", "cover").alias("s"), fonts.han_coverage("text", "cover").alias("h"), fonts.embeddable("tables").alias("e")
    ).first()
    assert not row["s"] and tuple(row["h"]) == (2, 1, True) and row["e"]


def test_glyph_map(spark):
    rows = spark.createDataFrame([("f", k, "é" if k != 7 else "😀") for k in range(1, 151)], "font string, cid int, ch string")
    blocks = {r["block"]: r["rows"] for r in fonts.glyph_map(rows, ["font"]).collect()}
    assert [len(blocks[0]), len(blocks[1])] == [100, 50] and blocks[0][0] == "<0001> <00E9>" and blocks[0][6] == "<0007> <D83DDE00>"
    with pytest.raises(Exception, match="out of range"):
        fonts.glyph_map(rows.withColumn("cid", F.lit(0)), ["font"]).collect()
