"""A stored index of words and their places, kept up to date by page revisions, for tables of phrases.

A line in lower case is cut at its spaces, and every word of it is posted with the one that follows: (term, next, fingerprint,
page_index, ord, pos). As nothing but single spaces lies between neighbouring words, a phrase stands in a line just where a
word ends with its first word, the next ones equal its next ones, and one begins with its last. So phrases are found anywhere, also
inside words, without looking at the texts again. Which terms end like a phrase's first word, equal or begin like its third
and later ones, or hold a phrase of one word is asked of the distinct terms only, by their last, first or any letters, up to
three, in an equi-join for each length; its second word is compared with what follows.

The index consists of tables in one store: a refresh adds the postings of pages whose revision has changed, with the refresh's
number, and writes the list of pages with the number that counts for each; postings of other numbers are out of
date and are left out when read, until compact() writes them anew. All of it is one commit.

Disk is the postings, about twice the compressed texts; what is shuffled are terms and hits, not texts or postings, but for sets of
pages or matches beyond BROADCAST_ROWS.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.sources.stores import Stores

#: Letters by which words are looked up; rows that are broadcast.
LETTERS, BROADCAST_ROWS = 3, 500_000
#: Characters whose postings a task sorts at once: about 270 MB of rows, so that a sort doesn't spill.
SORTED_CHARS = 12 << 20
PAGE = ["fingerprint", "page_index"]
#: Postings lie in this order, in which equal values are neighbours, and are packed by this codec.
ORDER, CODEC = ["term", "next", *PAGE, "ord", "pos"], "zstd"
#: How a word of a phrase meets a term.
EQUAL, END, START, INSIDE = "equal", "end", "start", "inside"


def open_index(spark: SparkSession, root: str, buckets: int = 16) -> Stores:
    return Stores(spark, root, buckets, keys={"postings": "term", "terms": "term"})


def tokens(blocks: DataFrame) -> DataFrame:
    """(term, next, fingerprint, page_index, ord, pos) of blocks (fingerprint, page_index, ord, text); the last word of a line has no next."""
    lines = blocks.filter("text is not null").select(*PAGE, "ord", F.split(T.fold("text"), " ").alias("terms"))
    pairs = F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.get("terms", i + 1).alias("next")))
    return lines.select(F.posexplode(pairs).alias("pos", "t"), *PAGE, "ord").select("t.term", "t.next", *PAGE, "ord", "pos")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _among(index: Stores, rows: DataFrame, pages: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose values of names are those of a row of pages.

    Pages are broadcast, 64 neighbours of a book as one row with a bit each, so that rows aren't shuffled.
    """
    slot, bit = F.shiftright("page_index", 6), F.coalesce(F.col("page_index").bitwiseAND(63), F.lit(0))
    keys = [n for n in names if n != "page_index"]
    packed = index.kept(pages.groupBy(*keys, slot.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")), CODEC)
    if packed.count() > BROADCAST_ROWS:
        return rows.join(pages, _same(rows, pages, names), "left_semi")
    here = _same(rows, packed, keys) & slot.eqNullSafe(packed["slot"]) & (F.getbit(packed["bits"], bit) == 1)
    return rows.join(F.broadcast(packed), here, "left_semi")


def _parts(blocks: DataFrame) -> list[DataFrame]:
    """blocks by pages, in as many parts as keep a task's text within SORTED_CHARS; each part reads the blocks anew."""
    most = blocks.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("text")).alias("chars")).agg(F.max("chars")).first()[0] or 0
    n = -(-most // SORTED_CHARS)
    return [blocks.filter(F.pmod(F.xxhash64(*PAGE), F.lit(n)) == i) for i in range(n)] if n > 1 else [blocks]


def refresh(index: Stores, pages: DataFrame, blocks: DataFrame) -> int:
    """Brings the index up to date with pages (fingerprint, page_index, revision) and their blocks; returns its version."""
    edit = index.edit()
    number = edit.base + 1
    now = index.kept(pages.select(*PAGE, F.col("revision").cast("string").alias("revision")))
    if edit.base:
        old = edit.read("pages")
        fresh = index.kept(now.join(old, _same(now, old, [*PAGE, "revision"]), "left_anti"))
        stays = old.join(now, _same(old, now, [*PAGE, "revision"]), "left_semi")
        listed = stays.unionByName(fresh.withColumn("number", F.lit(number)))
        changed = _among(index, blocks, fresh, PAGE)
    else:
        listed, changed = now.withColumn("number", F.lit(number)), blocks
    posted = reduce(DataFrame.unionAll, (tokens(part) for part in _parts(changed))).withColumn("number", F.lit(number))
    posted = edit.write("postings", posted, add=True, order=ORDER, codec=CODEC)
    edit.write("terms", posted.select("term").distinct(), add=True, codec=CODEC)
    edit.write("pages", listed, codec=CODEC)
    return edit.commit()


def current(index: Stores, rows: DataFrame, version: int | None = None) -> DataFrame:
    """Postings whose number counts."""
    return _among(index, rows, index.read("pages", version), [*PAGE, "number"])


def compact(index: Stores) -> int:
    """Drops postings that are out of date."""
    edit = index.edit()
    rows = current(index, edit.read("postings"), edit.base)
    edit.read("pages")
    edit.write("postings", rows, order=ORDER, codec=CODEC)
    edit.write("terms", rows.select("term").distinct(), codec=CODEC)
    return edit.commit()


# ---------------------------------------------------------------- phrases


def _pieces(phrases: DataFrame) -> DataFrame:
    """(query, size, i, word, how, key): the words of each phrase and the letters by which they are looked up."""
    needles = phrases.select("query", T.fold(T.trim_unicode("query")).alias("needle")).filter("needle <> ''").distinct()
    words = needles.withColumn("words", F.split("needle", " "))
    each = words.select("query", F.size("words").alias("size"), F.posexplode("words").alias("i", "word"))
    last = F.col("i") == F.col("size") - 1
    how = F.when(F.col("size") == 1, INSIDE).when(F.col("i") == 0, END).when(last, START).otherwise(EQUAL)
    n = F.least(F.length("word"), F.lit(LETTERS))
    key = F.when(how == EQUAL, F.col("word")).when(how == END, F.substring("word", F.length("word") - n + 1, n)).otherwise(F.substring("word", F.lit(1), n))
    return each.withColumns({"how": how, "key": key})


def _keys(terms: DataFrame, asked: list[tuple[str, int]]) -> DataFrame:
    """(term, how, key): the keys of every term, of the kinds and lengths that are asked."""
    t, n = F.col("term"), F.length("term")

    def of(how: str, size: int) -> Column:
        if how == EQUAL:
            keys = F.array(t)
        elif how == END:
            keys = F.array(F.substring(t, n - size + 1, F.lit(size)))
        elif how == START:
            keys = F.array(F.substring(t, F.lit(1), F.lit(size)))
        else:
            keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(size))))
        some = F.transform(keys, lambda k: F.struct(F.lit(how).alias("how"), k.alias("key")))
        return some if how == EQUAL else F.when(n >= size, some).otherwise(F.filter(some, lambda _: F.lit(False)))

    return terms.select("term", F.inline(F.concat(*(of(h, s) for h, s in asked))))


def _matches(terms: DataFrame, pieces: DataFrame) -> DataFrame:
    """(how, word, term): the terms that each word may be, once for all phrases that have it."""
    # At most one length of whole words and three each of the others.
    asked = sorted({(r["how"], 0 if r["how"] == EQUAL else r["n"]) for r in pieces.select("how", F.least(F.length("key"), F.lit(LETTERS)).alias("n")).distinct().collect()})
    if not asked:
        return pieces.select("how", "word", F.col("word").alias("term")).limit(0)
    met = _keys(terms, asked).join(pieces.select("how", "key", "word").distinct(), ["how", "key"])
    t, w = F.col("term"), F.col("word")
    fits = F.when(F.col("how") == EQUAL, t == w).when(F.col("how") == END, F.endswith(t, w)).when(F.col("how") == START, F.startswith(t, w)).otherwise(F.contains(t, w))
    return met.filter(fits).select("how", "word", "term").distinct()


def _meeting(index: Stores, version: int, matches: DataFrame, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """then(postings with the matches of their terms).

    Where the matches are too many for one broadcast, some buckets of terms are met after the other, and each part is written before the next one.
    """
    total, buckets = matches.count(), index.buckets
    if total <= BROADCAST_ROWS:
        return then(index.read("postings", version).join(F.broadcast(matches), "term"))
    # A tenth more, as buckets are not quite even.
    n = next((n for n in range(2, buckets) if total * 1.1 * -(-buckets // n) / buckets <= BROADCAST_ROWS), buckets)
    parts = []
    for i in range(n):
        some = range(i, buckets, n)
        mine = matches.filter(index.bucket("postings").isin(*some))
        few = F.broadcast(mine) if mine.count() <= BROADCAST_ROWS else mine
        parts.append(index.kept(then(index.read("postings", version, some).join(few, "term")), CODEC))
    return reduce(DataFrame.unionAll, parts)


def find(index: Stores, phrases: DataFrame, version: int | None = None) -> DataFrame:
    """(query, fingerprint, page_index, ord): the lines that hold each phrase (query) of a table."""
    version = index.version() if version is None else version
    pieces = index.kept(_pieces(phrases))
    terms, line = index.kept(index.read("terms", version).distinct(), CODEC), ["query", *PAGE, "ord"]
    few = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    # Only postings that also have the second word go on to be compared with the list of pages.
    firsts = pieces.filter("i = 0").select("query", "size", "how", "word")
    firsts = few(index.kept(firsts.join(pieces.filter("i = 1").select("query", F.col("word").alias("second")), "query", "left")))
    fits = F.when(F.col("size") == 1, True).when(F.col("size") == 2, F.startswith("next", F.col("second"))).otherwise(F.col("next") == F.col("second"))
    begin = lambda met: met.join(firsts, ["how", "word"]).filter(fits).select(*line, "size", F.col("pos").alias("start"), "number")
    heads = _meeting(index, version, index.kept(_matches(terms, pieces.filter("i = 0")), CODEC), begin)
    heads = current(index, heads, version).drop("number")
    short = heads.filter("size <= 2").select(line).distinct()
    if not pieces.filter("i > 1").limit(1).count():
        return short
    here = [*line, "start"]
    later = few(index.kept(pieces.filter("i > 1").select("query", "size", "i", "how", "word")))
    follow = lambda met: met.join(later, ["how", "word"]).withColumn("start", F.col("pos") - F.col("i")).select(*here, "size", "number")
    rest = _meeting(index, version, index.kept(_matches(terms, pieces.filter("i > 1")), CODEC), follow)
    heads = heads.filter("size > 2").drop("size")
    after = current(index, rest, version).join(heads, _same(rest, heads, here), "left_semi").groupBy(*here, "size").agg(F.count("*").alias("n"))
    return short.unionByName(after.filter("n = size - 2").select(line).distinct())


def hits(index: Stores, phrases: DataFrame, blocks: DataFrame, source: str) -> DataFrame:
    """Positioned hits with snippets, as search.positioned_hits() gives them."""
    found, lines = find(index, phrases), blocks.select(*PAGE, "ord", "text", "rect")
    both = found.join(lines, _same(found, lines, [*PAGE, "ord"])).select("query", *(lines[c] for c in [*PAGE, "ord", "text", "rect"]))
    at, size = T.find_ci("text", "query"), F.length(T.trim_unicode("query"))
    return both.select("query", *PAGE, "ord", T.snippet("text", at, size, source).alias("snippet"), "rect")
