"""Secret scan with corpus-wide ownership frequency.

One pass finds candidates in every whole text: the three base kinds, and bare strings that look
random. Candidate values travel as hashes. Three partial aggregations count, for each hash, the
documents, repositories and owners that hold it, so a value that is everywhere reaches the last
one as one row a task. A secret of one owner looks live, in however many of the owner's repositories; so does one of up to
``max_owners`` owners in at most ``max_repos`` repositories. What is spread more widely is an example. The verdicts go back to the documents:

- ``live``: the value of a base candidate that looks live;
- ``sighted``: a bare string whose value is a live-looking secret somewhere else in the corpus. Bare are whole
  runs of 16 or more characters without '.', with a letter and a digit; shorter values, and values glued
  to '=' or '/', are found where they are assigned, not where they stand bare.

Spans count code points, the end is exclusive. Nulls and edge cases: a null or empty text has no
spans; a very long text takes time in proportion to it; a null owner or repository is an owner of its own; repeated rows are scanned each and count
as one owner; other columns are ignored by scan() and kept by redact(); an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelake.llm.common import free_name, lean, quoted, Scratch

#: Fixed values of the contract: kinds in their order, patterns and least lengths.
KINDS = ["assign", "access", "hex", "live", "sighted"]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f]+ is maximal, so its length can be asked for at once
LEAST = {"assign": 6, "access": 20}

#: Tasks over which the rows of one value are dealt.
SALTS = 16
BARE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
FOUND = "array<struct<kind:int,start:int,end:int,hash:string,secret:boolean>>"
SCANNED = f"uid long, doc_id long, owner string, repo string, base array<struct<start:int,kind:int,end:int>>, found {FOUND}"


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) of the three base kinds."""
    out = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                out.append((0, m.start(), m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        out += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(2, *m.span(), *m.span()) for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> tuple[list[dict], list[dict]]:
    """(base spans, hashed candidate values) of a text."""
    spans = base_spans(text)
    base = [{"start": s, "kind": k, "end": e} for k, s, e, _, _ in spans]
    values = {(a, b): True for _, _, _, a, b in spans}
    taken = sorted((s, e) for _, s, e, _, _ in spans)
    at, reach = 0, 0  # both lists go by start: how far base spans that begin before the word's end reach
    for m in BARE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        word = m.group()
        if reach <= m.start() and not word.isalpha() and any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
            values[m.span()] = False
    found = [
        {"kind": 3 if secret else 4, "start": a, "end": b, "hash": hashlib.blake2b(text[a:b].encode(), digest_size=16).hexdigest(), "secret": secret}
        for (a, b), secret in values.items()
    ]
    return base, found


def scan(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column, keep: str = "") -> DataFrame:
    """Candidates of every row; ``keep`` names a struct column to carry along."""
    kept = [F.col(keep).alias("kept")] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        types = {"base": pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))}
        types["found"] = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("secret", pa.bool_())]))
        for batch in batches:
            base, found = [], []
            for text in batch.column(1):
                b, f = candidates(text.as_py() or "")
                base.append(b)
                found.append(f)
            uids = pa.array(range(uid, uid + len(batch)), pa.int64())
            uid += len(batch)
            columns = [uids, batch.column(0), batch.column(2), batch.column(3), pa.array(base, types["base"]), pa.array(found, types["found"])]
            names = ["uid", "doc_id", "owner", "repo", "base", "found"]
            if keep:
                columns.append(batch.column(4))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = StructType.fromDDL(SCANNED)
    return rows.mapInArrow(lean(run), schema.add("kept", docs.schema[keep].dataType) if keep else schema)


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, documents, repos, owners, secret: how widely each candidate value is held."""
    each = scanned.select("uid", "owner", "repo", F.inline("found"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("documents"), F.max("secret").alias("secret"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("documents").alias("documents"), F.max("secret").alias("secret"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("documents").alias("documents"), F.max("secret").alias("secret"))


def judged(scanned: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """(uid, added, n_live, n_example, owners, repos): what the method adds to each row that has secrets or sightings.

    A value that one owner holds, in however many repositories, is that owner's. One that up to ``max_owners`` hold is live as long as it
    lies in no more than ``max_repos`` repositories; whatever is copied more widely is an example.
    """
    own = F.col("owners") == 1
    few = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    secret = ownership(scanned).filter("secret").select("hash", (own | few).alias("live"), "owners", "repos")
    # A secret that very many rows hold is dealt over SALTS tasks; the verdicts, one row a hash, go to all of them.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    each = scanned.select("uid", F.pmod("uid", F.lit(SALTS)).cast("int").alias("salt"), F.inline("found")).join(secret.select("*", salts), ["hash", "salt"])
    span = F.when(F.col("live"), F.struct("start", "kind", "end"))
    counted = F.col("secret")
    return each.groupBy("uid").agg(
        F.collect_list(span).alias("added"),
        F.count_if(F.col("live") & counted).alias("n_live"),
        F.count_if(~F.col("live") & counted).alias("n_example"),
        F.max(F.when(counted, F.col("owners"))).alias("owners"),
        F.max(F.when(counted, F.col("repos"))).alias("repos"),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def find_secrets(docs: DataFrame, max_owners: int = 2, max_repos: int = 4, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo: Column | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, and the most owners and repositories that hold one of its secrets."""
    scratch = Scratch(docs.sparkSession, "secrets")
    scanned = scratch.save(scan(docs, id_col, text_col, F.col(owner_col), F.col(owner_col) if repo is None else repo), "scanned")
    rows = scanned.join(judged(scanned, max_owners, max_repos), "uid", "left")
    of_kind = lambda k: F.filter("base", lambda s: s.kind == k)
    count = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    every = F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return rows.select(
        "doc_id",
        *count,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce("owners", F.lit(0)).alias("most_owners"),
        F.coalesce("repos", F.lit(0)).alias("most_repos"),
    )


def redact(docs: DataFrame, mask: str = "[secret]", max_owners: int = 2, max_repos: int = 4, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo: Column | None = None) -> DataFrame:
    """The same rows and columns; live-looking values in the text, overlapping ones as one, are replaced by ``mask``, widely copied examples stay."""
    scratch = Scratch(docs.sparkSession, "redact")
    names = docs.columns
    own = list(map(quoted, names))
    row = free_name("row", names)
    whole = docs.select(*own, F.struct(*own).alias(row))
    scanned = scratch.save(scan(whole, id_col, text_col, F.col(owner_col), F.col(owner_col) if repo is None else repo, row), "scanned")
    live = judged(scanned, max_owners, max_repos).filter("n_live > 0 or size(added) > 0").select("uid", "added")
    rows = scanned.select("uid", "kept").join(live, "uid", "left")
    columns = [F.col(f"kept.{quoted(c)}").alias(f"k{i}") for i, c in enumerate(names)]
    flat = rows.select(*columns, F.array_sort("added").alias("added"))
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, spans = batch.columns[:-1], batch.column(len(names))
            texts = [x.as_py() if not s.is_valid else masked(x.as_py(), s.as_py(), mask) for x, s in zip(columns[place], spans, strict=True)]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    clean = flat.mapInArrow(lean(run), StructType(flat.schema.fields[:-1]))
    return clean.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)))


def masked(text: str, spans: list[dict], mask: str) -> str:
    """text with a mask in the place of sorted spans; one that begins inside what is already masked only makes the masked part longer."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], mask]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])
