"""Media columns, filter interaction audit and hard-negative mining against brute force, and their edge cases."""

import hashlib
import io
import itertools
import random
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.llm import filter_audit, media, negatives, queries

# ---------------------------------------------------------------- media


def netpbm(kind, image, top):
    """An image (rows, columns, channels) as a Netpbm file of one of the six kinds."""
    h, w, _ = image.shape
    head = f"P{kind}\n# made here\n{w} {h}\n".encode() + (b"" if kind in (1, 4) else f"{top}\n".encode())
    if kind == 1:
        return head + b"\n".join(bytes(48 + int(v) for v in row.ravel()) for row in image)
    if kind in (2, 3):
        return head + b"\n".join(" ".join(map(str, row.ravel().tolist())).encode() for row in image)
    if kind == 4:
        return head + b"".join(np.packbits(row.ravel().astype(np.uint8)).tobytes() for row in image)
    return head + image.astype(">u2" if top > 255 else "u1").tobytes()


def bmp(image, bits=24, top_down=False, table=None):
    h, w = image.shape[:2]
    rows = []
    for row in image if top_down else image[::-1]:
        if bits == 24:
            raw = row[:, ::-1].astype(np.uint8).tobytes()
        elif bits == 32:
            raw = np.concatenate([row[:, ::-1], np.zeros((w, 1))], axis=1).astype(np.uint8).tobytes()
        else:
            flat = np.unpackbits(row.astype(np.uint8)[:, None], axis=1)[:, 8 - bits :].ravel()
            raw = np.packbits(flat).tobytes()
        rows.append(raw + b"\0" * (-len(raw) % 4))
    body, colours = b"".join(rows), b"".join(bytes([*c[::-1], 0]) for c in (table or []))
    start = 54 + len(colours)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, bits, 0, len(body), 0, 0, len(table or []), 0) + colours + body


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([1, 2, 3, 4, 5, 6]), st.integers(1, 19), st.integers(1, 19), st.sampled_from([1, 7, 255, 256, 65535]), st.integers(0, 10**6))
def test_netpbm_round_trip(kind, h, w, top, seed):
    top = 1 if kind in (1, 4) else top
    image = np.random.default_rng(seed).integers(0, top + 1, (h, w, 3 if kind in (3, 6) else 1))
    name, got = media.decode(netpbm(kind, image, top))
    assert name == f"P{kind}"
    assert got.dtype == (np.uint16 if top > 255 else np.uint8)
    assert (got == image).all()


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([1, 4, 8, 24, 32]), st.integers(1, 17), st.integers(1, 17), st.booleans(), st.integers(0, 10**6))
def test_bmp_round_trip(bits, h, w, top_down, seed):
    r = np.random.default_rng(seed)
    if bits >= 24:
        image = want = r.integers(0, 256, (h, w, 3))
        table = None
    else:
        table = r.integers(0, 256, (1 << bits, 3)).tolist()
        image = r.integers(0, 1 << bits, (h, w))
        want = np.array(table)[image]
    assert (media.decode(bmp(image, bits, top_down, table))[1] == want).all()


def test_bmp_bit_fields():
    pixels = struct.pack("<HH", 0xF800 | 31, 0x07E0)
    data = b"BM" + struct.pack("<IHHI", 70, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 16, 3, 4, 0, 0, 0, 0) + struct.pack("<III", 0xF800, 0x07E0, 0x1F) + pixels
    assert media.decode(data)[1].tolist() == [[[255, 0, 255], [0, 255, 0]]]


@pytest.mark.parametrize("data", [b"", b"P5", b"P5\n2 2\n255\nabc", b"P4\n9 2\n\0", b"P2\n2 2\n9\n1 2 3", b"P5\n0 2\n255\n", b"P5 1 1 70000 a", b"BM", b"BM" + b"\0" * 60, b"GIF89a", b"P9 1 1 1 1", bmp(np.zeros((3, 3, 3)))[:-1]])
def test_bad_media_are_errors_not_crashes(data):
    assert media._inspected(data, (2, 2), 2)[-1]


def brute_resize(image, rows, columns):
    h, w, c = image.shape
    out = np.zeros((rows, columns, c), dtype=object)
    for i, j, k in itertools.product(range(rows), range(columns), range(c)):
        total = Fraction(0)
        for y, x in itertools.product(range(h), range(w)):
            a = min(Fraction((i + 1) * h, rows), y + 1) - max(Fraction(i * h, rows), y)
            b = min(Fraction((j + 1) * w, columns), x + 1) - max(Fraction(j * w, columns), x)
            if a > 0 and b > 0:
                total += a * b * int(image[y, x, k])
        out[i, j, k] = int(total / Fraction(h * w, rows * columns) + Fraction(1, 2))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3]), st.integers(1, 7), st.integers(1, 7), st.integers(0, 10**6))
def test_resize_is_the_mean_of_areas(h, w, c, rows, columns, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(np.uint8)
    a, b = media.resized(image, [(rows, columns), (8, 9)])
    assert (a == brute_resize(image, rows, columns)).all()
    assert (b == brute_resize(image, 8, 9)).all()


def test_resize_in_bands_equals_one_band(monkeypatch):
    image = np.random.default_rng(1).integers(0, 256, (777, 64, 1)).astype(np.uint8)
    whole = media.resized(image, [(16, 16), (8, 9)])
    monkeypatch.setattr(media, "BAND", 640)
    assert all((a == b).all() for a, b in zip(whole, media.resized(image, [(16, 16), (8, 9)]), strict=True))


def test_tiles_and_hashes():
    image = np.arange(35, dtype=np.uint8).reshape(5, 7, 1)
    found = media.tiles(image, 4)
    assert [(r, c) for r, c, _ in found] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert (np.load(io.BytesIO(found[1][2])) == image[:4, 4:]).all()
    assert media.difference_hash(np.zeros((8, 9, 1), np.uint8)) == "0" * 16
    assert media.difference_hash(np.tile(np.arange(9, 0, -1, dtype=np.uint8), (8, 1))[:, :, None]) == "f" * 16
    red = np.zeros((8, 9, 3), np.uint8)
    red[:, 0, 0] = 200
    assert media.difference_hash(red) == "80" * 8


def test_inspect_keeps_all_columns_and_says_what_is_wrong(spark):
    rows = [(1, netpbm(5, np.full((3, 5, 1), 9), 255)), (1, netpbm(5, np.full((3, 5, 1), 9), 255)), (None, None), (3, b""), (4, b"BMx")]
    df = spark.createDataFrame(rows, "id long, media binary").withColumn("feature", F.lit("mine")).withColumn("odd `x`", F.lit(7))
    got = media.inspect(df, shape=(4, 4), side=2)
    assert got.columns[:3] == ["id", "feature", "odd `x`"]
    found = got.toPandas()
    assert sorted(found["error"].fillna("").tolist()) == sorted(["", "", "null", "neither Netpbm nor BMP", "image is cut"])
    good = got.filter("error is null").collect()
    assert [len(r["tiles"]) for r in good] == [4, 4]
    assert good[0]["samples_bytes"] == 15
    assert media.inspect(df.limit(0)).count() == 0


def test_op11_equals_brute_force(spark, tmp_path):
    texts = ["", None, "x", "é" * 31 + "ab", "a" * 64, "a" * 65, "long " * 200_000, "long " * 200_000, "Ω\0z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_media(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows)
    byid = {None if i != i else int(i): r for i, r in zip(got["doc_id"], got.to_dict("records"), strict=True)}
    for i, text in rows:
        raw = (text or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = f"P5\n64 {len(padded) // 64}\n255\n".encode() + padded
        r = byid[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        small = media.resized(np.frombuffer(padded, np.uint8).reshape(-1, 64, 1), [(8, 9)])[0]
        assert r["feature"] == media.difference_hash(small)
    assert byid[6]["feature"] == byid[7]["feature"]


# ---------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    """Every order is applied document by document."""
    rows = []
    for doc_id, text, part in docs:
        t = text or ""
        w = t.encode().split()
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in t for c in "#$%&*|")}
        fails["E"] = doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in docs)
        rows.append((doc_id, part or "", {k for k, v in fails.items() if v}))
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    out = {}
    for part in {r[1] for r in rows}:
        own = [(d, f) for d, p, f in rows if p == part]
        average = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                lost = [(d, f) for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                average[c] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), sum(c in f for _, f in own) - len(lost), sum(f == {c} for _, f in own), sum(d in good for d, _ in lost), sum(d in toxic for d, _ in lost), c]
        # the average is known only after all orders
        for key, v in out.items():
            if key[0] == part:
                v[6] = average[key[1][key[2] - 1]]
    return out


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in df.collect()}


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, source string, part string, mask long, n long")


@pytest.mark.parametrize("parts", ["3", "40"])
def test_audit_equals_brute_force(spark, parts):
    r = random.Random(int(parts))
    texts = ["copy " * 60, "Copy Of #1", "", None, " ".join(f"w{i}" for i in range(70)), " ".join(f"W{i}" for i in range(60)), "a|b " * 50, "ÄÖÜ" * 30 + " ABC", "one\x1ctwo\x85three four", "x " * 300_000]
    rows = [(i if r.random() > 0.05 else None, r.choice(texts) if r.random() > 0.4 else texts[0], r.choice(["a", "b", None, ""])) for i in range(400)]
    rows += [(7, texts[0], "a"), (7, texts[0], "a"), (7, "other", "b")]
    labels = [(i, *r.choice([(1, 0), (0, 1), (1, 1), (None, None)])) for i in range(0, 400, 3)] + [(6, 0, 0), (6, 1, 0), (None, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = audited(filter_audit.interactions(documents(spark, rows).repartition(5), told, F.col("source")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_audit(rows, labels)


def test_audit_mends_groups_that_cross_tasks_by_shuffle_as_well(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", 0)
    rows = [(i, "same" if i % 3 else f"own {i}", "s") for i in range(200, 0, -1)]
    found = filter_audit.failures(documents(spark, rows).repartition(7), F.col("source"))
    assert {r["doc_id"] for r in found.filter("mask >= 16").collect()} == {i for i, t, _ in rows if t == "same" and i != 1}


def test_audit_compares_texts_where_fingerprints_are_equal(monkeypatch):
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(["p"] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([5] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "doc_id", "mark", "text"])

    run = filter_audit._compared(filter_audit.FILTERS)
    out = [r for b in run(iter([batch([(1, b"a"), (4, b"a")]), batch([(2, b"b"), (3, b"b")])])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["first"]) for r in out if r["mask"] >= 0] == [(1, 1), (4, 1), (2, 2), (3, 2)]
    ends = {r["key"]: r["first"] for r in out if r["mask"] < 0}
    assert ends == {hashlib.sha256(b"a").hexdigest(): 1, hashlib.sha256(b"b").hexdigest(): 2}


def test_audit_of_nothing(spark):
    none = documents(spark, [(1, "x", "s")]).limit(0)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(none, labels, F.col("source")).count() == 0
    some = audited(filter_audit.interactions(documents(spark, [(1, "x", "s")]), labels.limit(0), F.col("source")))
    assert some["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, every=5, positives=5, take=3, scale=4):
    import math

    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(Fraction(x) * scale) for x in v]
        if i not in kept or (label, q) < kept[i]:
            kept[i] = (label, q)
    out = set()
    for a, (label, q) in kept.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, w, strict=True)) for i, (_, w) in kept.items() if i != a and len(w) == len(q)}
        for p in sorted((i for i in score if kept[i][0] == label), key=lambda i: (-score[i], i))[:positives]:
            fit = [i for i in score if kept[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            for rank, n in enumerate(sorted(fit, key=lambda i: (-score[i], i))[:take], 1):
                out.add((a, p, rank, n, score[p], score[n]))
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("q", F.lit("clash")).withColumn("norm", F.lit(1)).withColumn("team", F.lit(None))
    got = negatives.mined(df, F.col("vec_id") % 5 == 0, scale=4, **options)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    return set(found)


def vectors(seed, n, kind):
    r = random.Random(seed)
    out = []
    for i in range(n):
        d = 6 if r.random() < 0.9 else 3
        if kind == "ties":
            v = [r.choice([0.0, 0.25, 0.5]) for _ in range(d)]
        elif kind == "norms":
            v = [r.gauss(0.3, 1) * 10 ** r.uniform(-1, 1.5) for _ in range(d)]
        elif kind == "huge":
            v = [r.gauss(0.3, 1) * 2.0 ** r.choice([0, 20, 27]) for _ in range(d)]
        else:
            v = [0.5, 0.25, 0.25, 0.5, 0.25, 1.0] if r.random() < 0.4 else [r.gauss(0.4, 0.5) for _ in range(d)]
        out.append((i, v, r.randrange(4)))
    return out


@pytest.mark.parametrize("kind", ["ties", "norms", "huge", "copies"])
@pytest.mark.parametrize("options", [{"team": 7, "block": 13, "lane": 2}, {}])
def test_negatives_equal_brute_force(spark, kind, options):
    rows = vectors(len(kind), 160, kind)
    want = brute_negatives(rows)
    assert len(want) > 30
    assert mined(spark, rows, **options) == want


def test_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BROADCAST_ROWS", 0)
    rows = [*vectors(3, 60, "ties"), (None, [1.0] * 6, 1), (70, None, 1), (75, [1.0, None, 1.0, 0.0, 0.0, 0.0], 1), (80, [float("nan")] * 6, 1), (85, [float("inf")] * 6, 2), (90, [1.0] * 6, None), (95, [], 1), (96, [], 1), (97, [], 2), (100, [0.0] * 6, 0)]
    rows += rows[:9] + [(10, [1.0, 0.5, 0.5, 0.25, 0.5, 1.0], 0), (10, [1.0, 0.5, 0.5, 0.25, 0.5, 1.0], 3)]
    assert mined(spark, rows, team=5, block=7, lane=1) == brute_negatives(rows)
    assert mined(spark, rows[:0] or [(1, [1.0], 1)]) == set()


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mined(none, F.col("vec_id") % 5 == 0).count() == 0
