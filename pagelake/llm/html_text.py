"""Main text of web pages: site template removal by counted subtree hashes, and structure.

Pass 1 parses every page and hashes each element's subtree (tag, attributes without addresses,
text and children). Spark counts, for each host, the distinct pages that hold a hash: pages of one
text, read without any template, are one page, so a group of copies does not make its content a template.
Pages of one task and host meet in partial aggregation, so a host with a third of all pages is no single task's load.
Hashes on at least ``min_pages`` distinct pages and a ``min_share`` of the host's are its template; on small
hosts, those on ``few_pages`` and a ``high_share``. What is on fewer pages is left to structure and names.
Pass 2 parses again, deletes template subtrees, elements that are never content (scripts, forms,
menus, ...) or whose class, id or role says so (adverts, notices, comments, ...), and reads the
blocks of the article that is left: all outermost ``article`` elements, else all ``main`` ones, in page order, else
the whole body. A form that holds an article or most of the page's text is read like any other element. A class or id counts as a whole word, not of a paragraph
or heading with text of its own, and neither of nor around an article that only so would be lost. Inside ``article`` or ``main`` only containers (divisions, lists, tables, ...) can be
template subtrees: a sentence that many articles quote is still their text. Where removal would leave
nothing but headings of a page that has more, the page is read without it.

A block is the text between block-level tags with character references decoded and each run of
white space turned into one space; blocks are joined by two line ends. The tokenizer follows
browsers where pages are broken: unclosed tags end with their parent, a new paragraph closes an open one,
a stray end tag is ignored, a tag that another "<" breaks off is text, text of script and style ends only at its own end tag, an unfinished
tag or comment at the end of a page is dropped.

Nulls and edge cases: a null or empty html gives an empty text; a null or odd url has the host
'' and shares templates with its like; repeated rows are extracted each, and count as one page;
other columns are ignored; an empty table gives an empty result. Time and memory grow in proportion to a page, however
many tags, quotes or comments it leaves open.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import Scratch

#: Fixed sets of HTML's element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
NEVER = frozenset(
    "head script style noscript template nav header footer aside form button select textarea input label fieldset iframe object embed svg canvas audio video map dialog menu title noembed noframes xmp".split()
)
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("div section ul ol dl table figure details center blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A class or id of these says how they look rather than what they are, where they have text of their own.
OWN_TEXT = HEADINGS | {"p"}
#: An open element of the key closes when one of the value starts.
CLOSED_BY = {
    "p": BLOCK - frozenset("html body caption td th tr tbody thead tfoot".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: An end tag closes only elements inside these.
SCOPE = frozenset("table td th article main section div body html".split())
#: Words that mark an element that is not content, what may stand before and behind one in a class or id, and of comments.
MARKS = "ads? adverts? advertisements? advertising banner breadcrumbs? comments? commentlist consent cookies? cookiebar disqus footer header menu modal nav navbar navigation newsletter notices? pagination pager popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widgets?".split()
BEFORE = "ad ads article blog bottom cookie gdpr global left main mobile newsletter page post primary reader readers right secondary site social sticky story top user".split()
BEHIND = "area articles banner bar block body bottom box buttons? consent container content form holder icons inline left links list menu notice panel popup posts right section slot stories thread top unit widget wrap wrapper".split()
MARKED = re.compile(rf"(?:(?:{'|'.join(BEFORE)})[_-])?(?:{'|'.join(MARKS)})(?:[_-](?:{'|'.join(BEHIND)}))*(?:[_-]?\d+)?")
#: Headers of an article hold its title.
TITLES = re.compile(r"(?:article|blog|post|story|entry|main)[_-]header")
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())

#: Outside quotes a tag ends at the next "<" at the latest; a quote that doesn't follow "=" is a letter like any other.
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)?)*+)>|<[!?][^<>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


class Node:
    __slots__ = ("attrs", "hash", "items", "tag", "wraps")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs = tag, attrs
        self.items: list[Node | str] = []
        self.hash = 0
        self.wraps = False


#: Tags whose start can close an open element, and those at which the search for it ends.
CLOSERS = frozenset().union(*CLOSED_BY.values())
STOPS = (BLOCK - {"p"}) | frozenset(CLOSED_BY)


class Open:
    """The open elements, with the places of each name, so that no tag walks through all of them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.stops: list[int] = []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)
        if node.tag in STOPS:
            self.stops.append(at)

    def cut(self, at: int) -> None:
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:]
        for places in (self.scopes, self.stops):
            while places and places[-1] >= at:
                places.pop()

    def end(self, name: str) -> bool:
        """Close the innermost element of the name; False if there is none at all."""
        places = self.places.get(name)
        if not places:
            return bool(self.scopes) and name not in SCOPE
        if name in SCOPE or not self.scopes or self.scopes[-1] <= places[-1]:
            self.cut(places[-1])
        return True

    def start(self, name: str) -> None:
        """Close the paragraph (also below unclosed inline elements) or list item that ends here."""
        if name not in CLOSERS:
            return
        for at in reversed(self.stops):
            tag = self.stack[at].tag
            if name in CLOSED_BY.get(tag, ()):
                self.cut(at)
                return
            if tag in BLOCK and tag != "p":
                return


def parse(page: str) -> Node:
    """The element tree of a page."""
    root = Node("html", "")
    open_ = Open(root)
    stack = open_.stack
    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            tail = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", tail)  # an unfinished tag
            if text := tail[: cut.start()] if cut else tail:
                stack[-1].items.append(text)
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if not open_.end(name) and name == "br":
                stack[-1].items.append(Node("br", ""))
            continue
        if name == "html" or name == "head" and open_.places.get("head"):
            continue
        open_.start(name)
        node = Node(name, m[3])
        stack[-1].items.append(node)
        if name in RAW:
            end = ENDS[name].search(page, at)
            if name not in ("script", "style") and end:
                node.items.append(page[at : end.start()])
            at = end.end() if end else size
        elif name not in VOID and not m[3].endswith("/"):
            open_.push(node)
    mark_wrapping_forms(root)
    return root


def mark_wrapping_forms(root: Node) -> None:
    """Sets ``wraps`` of forms that hold an article or more than half of the page's text: some sites put whole pages into one."""
    forms: list[tuple[Node, int, bool]] = []
    letters, tops = 0, 0
    begun: list[tuple[Node, int, int]] = []
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        item, done = todo.pop()
        if isinstance(item, str):
            letters += len(item) - item.count(" ")
        elif done:
            form, was, had = begun.pop()
            forms.append((form, letters - was, tops > had))
        else:
            tops += item.tag in ("article", "main")
            if item.tag == "form":
                begun.append((item, letters, tops))
                todo.append((item, True))
            if item.tag == "form" or item.tag not in NEVER:
                todo += [(c, False) for c in reversed(item.items)]
    for form, own, holds in forms:
        form.wraps = holds or 2 * own > letters


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def has_words(node: Node) -> bool:
    """Whether an element holds text of its own, not only in links or other elements."""
    return any(isinstance(c, str) and c.strip() for c in node.items)


def is_marked(node: Node) -> bool:
    """Whether attributes say that an element is hidden or not content; a class counts as a whole, so has-sidebar is none."""
    if not node.attrs.strip():
        return False
    a = attributes(node.attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if node.tag in ("body", "html", "main"):
        return False
    if node.tag in OWN_TEXT and has_words(node):
        return False
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    return any(MARKED.fullmatch(x) for x in names) and not any(TITLES.fullmatch(x) for x in names)


def digest(node: Node) -> int:
    """Sets and returns a subtree's hash; addresses and white space don't count."""
    todo = [(node, False)]
    while todo:
        n, ready = todo.pop()
        if not ready:
            todo.append((n, True))
            todo += [(c, False) for c in n.items if isinstance(c, Node)]
            continue
        a = sorted((k, v) for k, v in attributes(n.attrs).items() if k not in ("href", "src", "srcset")) if n.attrs.strip() else ()
        parts = [n.tag, repr(a)]
        for c in n.items:
            parts.append(f"\1{c.hash:x}" if isinstance(c, Node) else " ".join(c.split()))
        n.hash = stable_hash("\0".join(parts))
    return node.hash


def stable_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def subtree_hashes(page: str) -> set[int]:
    """Hashes of subtrees that can be a template."""
    return tree_hashes(parse(page))


def tree_hashes(root: Node) -> set[int]:
    digest(root)
    out: set[int] = set()
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        for c in n.items:
            if isinstance(c, Node) and c.tag not in ("head", "script", "style"):
                if c.items and c.tag not in ("body", "article", "main") and (not inside or c.tag in CONTAINERS):
                    out.add(c.hash)
                todo.append((c, inside or c.tag in ("article", "main")))
    return out


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the article without template subtrees, joined by two line ends."""
    root = parse(page)
    if template:
        digest(root)
        blocks = text_blocks(root, template)
        if all(heading for _, heading in blocks):
            whole = text_blocks(root)
            if not all(heading for _, heading in whole) or not blocks:
                blocks = whole
    else:
        blocks = text_blocks(root)
    return "\n\n".join(text for text, _ in blocks)


def articles(root: Node, marks: bool = True) -> list[Node]:
    """The outermost ``article`` elements in page order, else the ``main`` elements; none within something that is dropped.

    Without ``marks``, classes and ids don't count, neither theirs nor those of what is around them.
    """
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(root, False)]
    while todo:
        n, in_main = todo.pop()
        if n.tag == "article" or n.tag == "main" and not in_main:
            found[n.tag].append(n)
        if n.tag != "article":
            for c in reversed(n.items):
                if isinstance(c, Node) and (c.tag not in NEVER or c.wraps) and not (marks and is_marked(c)):
                    todo.append((c, in_main or n.tag == "main"))
    return found["article"] or found["main"]


def text_blocks(root: Node, template: frozenset[int] = frozenset()) -> list[tuple[str, bool]]:
    """(text, whether it is a heading) of the article's blocks."""
    tops = articles(root)
    blocks = blocks_of(tops, template) if tops else []
    if all(heading for _, heading in blocks) and (more := articles(root, marks=False)) and more != tops:
        # The only article has a name that would drop it, or lies in something that has.
        blocks = blocks_of(more, template) or blocks
        tops = tops or more
    return blocks if tops else blocks_of([], template, root)


def blocks_of(tops: list[Node], template: frozenset[int], root: Node | None = None) -> list[tuple[str, bool]]:
    """The blocks of these articles, else of the whole page."""
    order, inside = tops or [root], bool(tops)
    blocks: list[tuple[str, bool]] = []
    current: list[str] = []
    headings = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(current)).split())
        if text:
            blocks.append((text, headings > 0))
        current.clear()

    for top in order:
        work: list[tuple[Node | str, bool]] = [(top, False)]
        while work:
            item, done = work.pop()
            if isinstance(item, str):
                current.append(item)
            elif done:
                flush()
                headings -= item.tag in HEADINGS
            elif item is top or not (dropped_in(item, inside) or (item.hash in template and (not inside or item.tag in CONTAINERS))):
                if item.tag == "br":
                    current.append(" ")
                    continue
                if item.tag in BLOCK:
                    flush()
                    work.append((item, True))
                    headings += item.tag in HEADINGS
                work += [(c, False) for c in reversed(item.items)]
        flush()
    return blocks


def dropped_in(n: Node, inside: bool) -> bool:
    """Inside an article a header holds its own heading and stays."""
    return (n.tag in NEVER and not n.wraps and not (inside and n.tag == "header")) or (is_marked(n) and not n.wraps)


# ---------------------------------------------------------------- Spark


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def counted(pages: DataFrame) -> DataFrame:
    """(host, hash, n): distinct pages of the host that hold the subtree; a null hash counts all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, contents, hashes = [], [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                root = parse(page.as_py() or "")
                content = stable_hash("\n\n".join(text for text, _ in text_blocks(root)) or page.as_py() or "")
                found = [*tree_hashes(root), None]
                hosts += [h] * len(found)
                contents += [content] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "content", "hash"])

    held = pages.select("host", "html").mapInArrow(run, "host string, content long, hash long").distinct()
    return held.groupBy("host", "hash").agg(F.count("*").alias("n"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 20, min_share: float = 0.02, few_pages: int = 4, high_share: float = 0.6, broadcast_rows: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    counts = scratch.save(counted(rows).filter(F.col("hash").isNull() | (F.col("n") >= min(min_pages, few_pages))), "counts")
    whole = counts.filter("hash is null").select("host", F.col("n").alias("pages"))
    often = (F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("pages"))
    common = often | ((F.col("n") >= few_pages) & (F.col("n") >= high_share * F.col("pages")))
    found = counts.filter("hash is not null").join(whole, "host").filter(common).select("host", "hash")
    found = scratch.save(found, "templates")
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        table: dict[str, set[int]] = {}
        for r in found.collect():  # at most broadcast_rows pairs
            table.setdefault(r["host"], set()).add(r["hash"])
        shared = pages.sparkSession.sparkContext.broadcast({h: frozenset(v) for h, v in table.items()})
        rows = rows.withColumn("own", F.lit(None).cast("array<long>"))
        lookup = lambda h, own: shared.value.get(h, frozenset())
    else:  # each page gets the template hashes that it holds, by a shuffle on (host, hash) and one on the page
        keyed = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))

        def run_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for k, h, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out += [(k, h, x) for x in subtree_hashes(page or "")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["key", "host", "hash"])

        held = keyed.select("key", "host", "html").mapInArrow(run_keys, "key long, host string, hash long").join(found, ["host", "hash"])
        own = held.groupBy("key").agg(F.collect_set("hash").alias("own"))
        rows = keyed.join(own, "key", "left")
        lookup = lambda h, own: frozenset(own or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, owns = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            texts = [main_text(page.as_py() or "", lookup(h, own)) for page, h, own in zip(batch.column(3), hosts, owns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "host", "html", "own").mapInArrow(run, "page_id long, url string, text string, n_chars long")
