from pyspark.sql import functions as F

from pagelake.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_find_without_case(spark):
    assert one(spark, T.find_ci("t", "q"), t="Straße GROSS", q="gross") == 7
    assert one(spark, T.find_ci("t", "q"), t="σασ here", q="ΣΑΣ") == 0
    assert one(spark, T.find_ci("t", "q"), t="İx needle", q="NEEDLE") == 3
    assert one(spark, T.find_ci("t", "q"), t="😀abc", q="ABC") == 1
    assert one(spark, T.find_ci("t", "q"), t="abc", q="  ") == -1
    assert one(spark, T.find_ci("t", "q"), t=None, q="a") == -1


def test_snippet_is_one_line_and_cut(spark):
    text = "a" * 40 + "\nneedle\t " + "b" * 60
    got = one(spark, T.snippet("t", F.lit(41), F.lit(6), "PDF"), t=text)
    assert got == "a" * 23 + " needle " + "b" * 36


def test_search_layer(spark):
    assert one(spark, T.search_layer("t"), t=" a​b \u0007　c­ ") == "ab c"
    assert one(spark, T.search_layer("t"), t="題數 x²≤y") == "题数 x²≤y"
    assert one(spark, T.search_layer("t"), t="​ \n") == ""


def test_names(spark):
    assert one(spark, T.output_base("t"), t="a/b:c?.v2.pdf") == "a_b_c_.v2"
    assert one(spark, T.output_base("t"), t=" .pdf") == "document"
    assert len(one(spark, T.output_base("t"), t="x" * 200)) == 85
    assert one(spark, T.output_name("t", 1), t="b") == "b_OCR.pdf"
    assert one(spark, T.output_name("t", 3), t="b") == "b_OCR_3.pdf"
    assert one(spark, T.strip_pdf_suffix("t"), t="a.pdf.pdf") == "a.pdf"
    assert one(spark, T.strip_pdf_suffix("t"), t="a.PDF") == "a.PDF"


def test_sizes(spark):
    shown = lambda n: one(spark, T.byte_size("n"), n=n)
    assert [shown(n) for n in (0, 1023, 1536, 5 << 20, 3 << 30)] == ["0 B", "1023 B", "1.5 KB", "5.0 MB", "3.00 GB"]


def test_script_precedence(spark):
    assert [one(spark, T.script("t"), t=t) for t in ("漢かな한", "漢かな", "漢", "abc")] == ["korean", "japanese", "chinese", "unicode"]


def test_numbers_and_pages(spark):
    assert one(spark, T.parse_numbers("t"), t="3, x,5,3,,") == [3, 5]
    assert one(spark, T.page_jump("t", 40), t="p. 12") == 12
    assert one(spark, T.page_jump("t", 40), t="41") is None
    assert one(spark, T.page_jump("t", 40), t="") is None


def test_identifiers(spark):
    import hashlib

    assert one(spark, T.job_id("t", F.lit(5), F.lit(6)), t="uri") == hashlib.sha256(b"uri|5|6").hexdigest()[:32]
    assert one(spark, T.valid_uuid("t"), t="123e4567-e89b-12d3-a456-426614174000")
    assert not one(spark, T.valid_uuid("t"), t="123e4567-e89b-12d3-a456-42661417400")
    assert one(spark, T.utf16_hex("t"), t="é") == "00E9"
    assert one(spark, T.default_if_blank("t", "Page 1"), t=" 　") == "Page 1"
