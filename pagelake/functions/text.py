"""Text expressions: search, snippets, normalisation, naming, scripts, formatting.

All are native column expressions. Positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points around a hit in each source's snippets, before and after.
SNIPPET = {"PDF": (24, 38), "HANDWRITING": (14, 24), "TEXT": (18, 30)}

#: Explicit single-character simplifications of the search layer.
TRADITIONAL = "題選擇數學計機導圖轉換對應"
SIMPLIFIED = "题选择数学计机导图转换对应"

_SPACE = r"(?U)\s+"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def trim_unicode(text: Column | str) -> Column:
    """text without white space of any kind at both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def squeeze(text: Column | str) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return trim_unicode(F.regexp_replace(_c(text), _SPACE, " "))


def fold(text: Column | str) -> Column:
    """text in lower case, letter by letter where that keeps the length (all but U+0130 do)."""
    return F.lower(F.translate(_c(text), "İΣς", "iσσ"))


def upper(text: Column | str) -> Column:
    """text in upper case, letter by letter; letters whose capitals are several (as of ß) stay."""
    t = _c(text)
    letters = F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    return F.when(F.length(F.upper(t)) == F.length(t), F.upper(t)).otherwise(F.array_join(letters, ""))


def find_ci(text: Column | str, query: Column | str) -> Column:
    """0-based position of query in text without regard to case, or -1; a blank query is nowhere.

    fold() keeps lengths, so positions hold in the original text.
    """
    t, needle = _c(text), trim_unicode(query)
    return F.when(t.isNull() | needle.isNull() | (needle == ""), F.lit(-1)).otherwise(F.instr(fold(t), fold(needle)) - 1)


def snippet(text: Column | str, at: Column, length: Column, source: str) -> Column:
    """The text around a hit, on one line."""
    before, after = SNIPPET[source]
    t = _c(text)
    start = F.greatest(at - before, F.lit(0))
    end = F.least(at + length + after, F.length(t))
    return squeeze(F.substring(t, start + 1, end - start))


def search_layer(text: Column | str) -> Column:
    """Text as the search layer keeps it: format characters go without a trace, runs of controls, separators and white space become one space, explicit characters are simplified."""
    plain = F.regexp_replace(_c(text), r"\p{Cf}+", "")
    spaced = F.regexp_replace(plain, r"(?U)[\p{Cc}\p{Z}\s]+", " ")
    return F.translate(F.trim(spaced), TRADITIONAL, SIMPLIFIED)


def sanitize(text: Column | str) -> Column:
    """Line ends and runs of white space become one space."""
    return squeeze(F.translate(_c(text), "\r\n", "  "))


def default_if_blank(text: Column | str, default: Column | str) -> Column:
    t = trim_unicode(text)
    return F.when(t.isNull() | (t == ""), F.lit(default) if isinstance(default, str) else default).otherwise(t)


def strip_pdf_suffix(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"\.pdf$", "")


def job_id(uri: Column | str, size: Column | str, modified: Column | str) -> Column:
    """First 16 bytes of the SHA-256 of uri|size|modified, as hex."""
    return F.substring(F.sha2(F.concat_ws("|", _c(uri), _c(size).cast("string"), _c(modified).cast("string")), 256), 1, 32)


def valid_uuid(text: Column | str) -> Column:
    return _c(text).rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def byte_size(n: Column | str) -> Column:
    """1536 -> 1.5 KB."""
    v = _c(n).cast("double")
    step = 1024.0
    shown = lambda k, unit: F.format_string(f"%.{1 if k < 3 else 2}f {unit}", v / step**k)
    return F.when(v < step, F.concat(_c(n).cast("string"), F.lit(" B"))).when(v < step**2, shown(1, "KB")).when(v < step**3, shown(2, "MB")).otherwise(shown(3, "GB"))


def output_base(name: Column | str) -> Column:
    """A file name's safe base: no last extension, no reserved characters, at most 85 characters."""
    base = F.regexp_replace(_c(name), r"\.[^.]*$", "")
    safe = trim_unicode(F.regexp_replace(base, r"[\\/:*?\"<>|\x00-\x1F\x7F]", "_"))
    return F.when(safe.isNull() | (safe == ""), F.lit("document")).otherwise(F.substring(safe, 1, 85))


def output_name(base: Column | str, n: Column | int) -> Column:
    """The n-th name for a base: base_OCR.pdf, base_OCR_2.pdf, ..."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(_c(base), F.lit("_OCR"), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(".pdf"))


def script(text: Column | str) -> Column:
    """korean, japanese, chinese or unicode: Hangul before kana before Han."""
    t = _c(text)
    return F.when(t.rlike(r"\p{IsHangul}"), "korean").when(t.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), "japanese").when(t.rlike(r"\p{IsHan}"), "chinese").otherwise("unicode")


def is_standard_ascii(text: Column | str) -> Column:
    """Printable ASCII, white space and format characters only."""
    return _c(text).rlike(r"(?U)^[\x20-\x7E\s\p{Cf}]*$")


def utf16_hex(char: Column | str) -> Column:
    return F.hex(F.encode(_c(char), "UTF-16BE"))


def valid_cid(cid: Column | str, code_point: Column | str) -> Column:
    """A glyph id that a ToUnicode map may hold: 1..65535, and no surrogate."""
    c, u = _c(cid), _c(code_point)
    return c.between(1, 0xFFFF) & ~u.between(0xD800, 0xDFFF)


def timestamp_name(prefix: str, at: Column | str, suffix: str) -> Column:
    return F.concat(F.lit(prefix), F.date_format(_c(at), "yyyyMMdd-HHmmss"), F.lit(suffix))


def parse_numbers(text: Column | str, kind: str = "int") -> Column:
    """Distinct numbers of a comma-separated text, in order; what isn't a number is dropped."""
    parts = F.transform(F.split(F.coalesce(_c(text), F.lit("")), ","), lambda p: F.trim(p).try_cast(kind))
    return F.array_distinct(F.filter(parts, lambda p: p.isNotNull()))


def page_jump(text: Column | str, pages: Column | int) -> Column:
    """The page that a typed number names: digits only, at most six, 1..pages; else null."""
    pages = F.lit(pages) if isinstance(pages, int) else pages
    n = F.substring(F.regexp_replace(_c(text), r"\D", ""), 1, 6).try_cast("int")
    return F.when(n.between(1, pages), n)
