"""Cases that earlier versions got wrong: colliding words, wrapped pages, many secrets, widely copied ones, walks of the automaton."""

import random
import time
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagelake.llm import common, html_text, lm, ngram_join, packing, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, flip):
    word, swap = "a", str.maketrans("ab", "ba")
    while len(word) < n:
        word += word.translate(swap)
    return word.translate(swap) if flip else word


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


# ---------------------------------------------------------------- word hashes


@pytest.mark.parametrize("n", [8, 16, 64, 128, 1024, 4096])
def test_words_that_sums_over_places_confuse(spark, n):
    a, b = thue_morse(n, False), thue_morse(n, True)
    hashes, _ = common.word_hashes([f"{a} {b} {a.upper()}"])
    assert hashes[0] != hashes[1]
    assert hashes[0] == hashes[2]


def test_documents_without_a_common_shingle_do_not_link(spark):
    rows = [(i, thue_morse(1024, bool(i)), "s") for i in (0, 1)] + [(2, " ".join([thue_morse(2048, False)] * 5), "s"), (3, " ".join([thue_morse(2048, True)] * 5), "s")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(documents(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_an_unseen_word_is_unknown(spark):
    import zlib

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    seen = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    got = {r["doc_id"]: r for r in lm.score_texts(documents(spark, [(seen, thue_morse(1024, False), "s"), (held, thue_morse(1024, True), "s")])).collect()}
    assert (got[held]["n_known"], got[seen]["n_known"]) == (1, 2)


def test_pipeline_keeps_both(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark, [(0, thue_morse(1024, False), "s"), (1, thue_morse(1024, True), "s"), (2, thue_morse(1024, True), "t")])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1]


# ---------------------------------------------------------------- pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<form id="aspnetForm"><div><article><p>One two</p></article></div></form>', "One two"),
        ('<form id="aspnetForm"><div><p>One two three four five six</p></div></form><nav>Menu</nav><p>end</p>', "One two three four five six\n\nend"),
        ("<p>A long text that is the page itself</p><form><p>Your name</p></form>", "A long text that is the page itself"),
        ('<main><article class="post notice"><p>One</p></article></main>', "One"),
        ('<article class="comment"><p>Nice</p></article><article><p>Text</p></article>', "Text"),
        ('<article><p class="social">Social security</p><p>More</p></article>', "Social security\n\nMore"),
        *((f'<article><p>Text</p><div {mark}>Buy it</div></article>', "Text") for mark in ('class="ad-container-top"', 'class="advert-inline"', 'id="ad1"', 'class="sponsored-content"', 'class="comment-body"', 'class="reader-comments"', 'class="cookiebar"', 'class="sidebar-right"', 'id="ad-slot-1"')),
        ('<article><div class="addendum">Kept</div><div class="headline">Kept too</div></article>', "Kept\n\nKept too"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("tag", sorted(html_text.NEVER | html_text.BLOCK | html_text.VOID | set(html_text.CLOSED_BY) | {"article", "a", "b", "span", "optgroup"}))
def test_open_tags_take_time_in_proportion(tag):
    def took(n, other):
        page = f"<{tag}>" * n + f"<{other}>x" * n
        best = min(timed(page) for _ in range(3))
        return best

    def timed(page):
        began = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - began

    for other in ("p", "div", "li"):
        assert took(8000, other) < 12 * took(2000, other) + 0.05


# ---------------------------------------------------------------- secrets


def test_many_masks_take_time_in_proportion():
    spans = [{"start": 10 * i, "kind": 0, "end": 10 * i + 5} for i in range(100_000)]
    began = time.perf_counter()
    text = secrets.masked("0123456789" * 100_000, spans, "#")
    assert text == "#56789" * 100_000
    assert time.perf_counter() - began < 5
    assert secrets.masked("abcdefgh", [{"start": 1, "end": 4}, {"start": 2, "end": 6}, {"start": 6, "end": 7}], "#") == "a##h"
    assert secrets.masked("abc", [], "#") == "abc"


def test_repositories_tell_examples_from_owners_secrets(spark):
    value = lambda n: f"password = Zx81kQ{n}pLm29"
    rows = [(i, value(1), "one") for i in range(9)]
    rows += [(20 + i, value(2), "one" if i % 2 else "two") for i in range(2)]
    rows += [(40 + i, value(3), "one" if i % 2 else "two") for i in range(6)]
    rows += [(60 + i, value(4), f"owner {i}") for i in range(3)]
    docs = documents(spark, rows).withColumn("repo", F.col("doc_id"))
    found = {r["doc_id"]: r for r in secrets.find_secrets(docs, repo=F.col("repo")).collect()}
    live = {i: found[i]["n_live"] for i in (0, 20, 40, 60)}
    assert live == {0: 1, 20: 1, 40: 0, 60: 0}
    assert [(found[i]["most_owners"], found[i]["most_repos"]) for i in (0, 20, 40, 60)] == [(1, 9), (2, 2), (2, 6), (3, 3)]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, repo=F.col("repo")).collect()}
    assert clean[0] == "password = [secret]" and clean[40] == value(3)


# ---------------------------------------------------------------- automaton


def test_the_walk_equals_the_formula(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"], n, p=[0.4, 0.3, 0.2, 0.05, 0.05])) for n in (0, 1, 2, 3, 30, 400)] + ["new words only", "a b new a b"]
    hashes, offsets = common.word_hashes(texts)
    tokens = np.insert(hashes.view(np.int64), offsets[1:], lm.END)
    words, at = np.unique(tokens, return_inverse=True)
    sizes = (np.diff(offsets) + 1).tolist()
    chunk = lm.Chunk(sizes, words.tobytes(), lm.narrow(at))
    train = np.repeat([True] * 5 + [False] * 3, sizes)
    of_word = np.bincount(chunk.word, train, len(words)).astype(np.int64)
    grams, first, index = np.unique(chunk.grams(), return_index=True, return_inverse=True)
    of_gram = np.bincount(index, chunk.at_grams(train), len(grams)).astype(np.int64)
    prior, base = 5.0, (of_word + 0.1) / (of_word.sum() + 0.1 * ((of_word > 0).sum() + 1))
    got = lm.Automaton(chunk, first, index, of_word, of_gram, base, prior).scores()
    counts = Counter()
    ends = np.cumsum([0, *sizes])
    parts = [tuple(at[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for p in parts[:5]:
        for n in (1, 2, 3):
            counts.update(p[i : i + n] for i in range(len(p) - n + 1))

    def probability(gram):
        if len(gram) == 1:
            return base[gram[0]]
        return (counts[gram] + prior * probability(gram[1:])) / (counts[gram[:-1]] + prior)

    for p, score in zip(parts, got, strict=True):
        assert score == pytest.approx(sum(log10(probability(p[max(0, i - 2) : i + 1])) for i in range(len(p))), abs=1e-9)


# ---------------------------------------------------------------- nearest neighbours


def recall(spark, x, every=40, k=20, **options):
    from pagelake.llm import permutation_index

    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found: dict[int, set] = {}
    for r in permutation_index.nearest(rows, F.col("vec_id") % every == 0, k, **options).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    shares = []
    for q, got in found.items():
        score = x @ x[q]
        score[q] = -np.inf
        least = np.partition(score, -k)[-k]
        shares.append(len([i for i in got if score[i] >= least - 1e-9]) / k)
    assert len(found) == len(range(0, len(x), every))
    return float(np.mean(shares))


@pytest.mark.parametrize("kind", ["many components", "few components", "clusters", "norms"])
def test_the_share_follows_the_data(spark, kind):
    r = np.random.default_rng(5)
    if kind == "many components":
        x = r.normal(size=(6000, 256))
    elif kind == "few components":
        x = r.normal(size=(5000, 8))
    elif kind == "clusters":
        x = r.normal(size=(50, 64))[r.integers(0, 50, 5000)] + 0.2 * r.normal(size=(5000, 64))
    else:
        x = r.normal(size=(5000, 48)) * r.lognormal(0, 1, (5000, 1))
    assert recall(spark, x) >= 0.9


def test_the_whole_block_is_exact(spark):
    x = np.random.default_rng(6).normal(size=(1500, 128))
    assert recall(spark, x, keep=1.0, block=400) == 1


def test_repeated_ids_are_candidates_each(spark):
    from pagelake.llm import permutation_index

    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (1, [0.25, 1.0]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    got = permutation_index.nearest(rows, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 0.5), (1, 0.5), (1, 0.25)]


# ---------------------------------------------------------------- tokens of packing


def packing_encoder():
    args = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return packing.Encoder(*args)


def test_ordinary_texts_need_no_lookahead():
    encode = packing_encoder()
    encode.fast = None
    for text in ("", "One line.\nTwo don't lines, 12 words  ", ("word " * 50 + "\n\n") * 9 + "  end", " " * 300_000 + "x" * 200):
        assert encode(text).tolist() == encode.plain.encode(text, add_special_tokens=False).ids


def test_ids_around_white_space():
    encode = packing_encoder()
    white = [*map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
    other = ["\x1c", "\x1f", "᠎", "​", "﻿", "²", "é", "日本", "😀", "'s", "'", "'ll", "don't", "x", "_", "-", "9", "<|endoftext|>"]
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(white if r.random() < 0.6 else other) for _ in range(r.randint(0, 14))) + r.choice(["", "plain words " * 60])
        assert encode(text).tolist() == encode.plain.encode(text, add_special_tokens=False).ids
