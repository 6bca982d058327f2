"""Problems 6 and 7: the tokenizer against public ones, round trips, and packing by tiers."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstat.llm import bpe, packing

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

TEXTS = [
    None, "", " ", "\n\n  \t x", "hello world", "The quick brown fox's 1234 jumps!!", "naïve Straße — «œuvre» ſt", "日本語のテキスト 🙂🙂", "<|endoftext|> as text", "a" * 5000, "ab" * 3000 + " " * 4000, "\x00\x01​﻿", "é" * 200,
    "lines\r\nand\rreturns\n" * 50, "don't we'll I'd you're '' ''s",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark, reference):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again")], "doc_id long, text string, ids string")
    out = df.select("doc_id", "text", bpe.encode(df).alias("made"), bpe.count_tokens(df).alias("n"))
    out = out.select("*", bpe.decode(out, "made").alias("back"))
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert r.made == (reference.encode_ordinary(r.text) if r.text else [])
        assert r.n == len(r.made) and r.back == (r.text or "")


def test_words_of_random_tokens(reference):
    a = bpe.automaton(open(bpe.tokenizer_path(), "rb").read())
    rnd, tokens = random.Random(2), list(a.token)
    for _ in range(20_000):
        w = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 4)))
        assert list(a.path(w)) == reference._core_bpe.encode_single_piece(w)


def test_no_arc_means_no_pair():
    """A transition that the table forbids never occurs in an encoding, and all those that occur are allowed."""
    a = bpe.automaton(open(bpe.tokenizer_path(), "rb").read())
    for w in (b"unbelievable", b"aaaaaaa", b" internationalization"):
        path = a.path(w)
        assert all(a.has_arc(x, y) for x, y in zip((-1, *path), path)) and b"".join(a.label[t] for t in path) == w
    t = {b: a.token[b] for b in (b"t", b"h", b"e", b"he")}
    assert not a.has_arc(t[b"h"], t[b"e"]) and a.has_arc(a.token[b"\x00"], t[b"e"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert df.select(bpe.encode(df).alias("ids")).count() == 0 and packing.pack(df.select("doc_id", F.lit(1).alias("n_tokens"))).count() == 0


def sizes(seed, n=3000):
    rng = np.random.default_rng(seed)
    return np.minimum(2048, np.maximum(1, rng.lognormal(5.8, 0.8, n))).astype(np.int64)


@pytest.mark.parametrize("seed", range(5))
def test_block(seed):
    n = sizes(seed)
    where, window, offset, made = packing.pack_block(n)
    used = np.bincount(where, weights=n, minlength=made)
    assert used.max() <= 2048 and used.min() > 0
    for c in range(made):  # pieces of a container follow each other without overlap
        at = np.flatnonzero(where == c)
        at = at[np.argsort(offset[at])]
        assert (offset[at] == np.concatenate(([0], np.cumsum(n[at])[:-1]))).all()
    assert 1 - n.sum() / made / 2048 < 0.01


def test_tiers_pack_windows_of_their_own():
    n = sizes(1)
    where, window, _, made = packing.pack_block(n)
    flat = packing.pack_block(n, tiers=(2048,))
    assert (where != flat[0]).any()
    tiers = np.array((256, 512, 1024, 2048))
    several = 0
    for c in range(made):
        inside = [n[(where == c) & (window == w)] for w in range(window[where == c].max() + 1)]
        # a window holds what its longest piece's tier holds, and the windows of a container fill it
        tops = [int(tiers[np.searchsorted(tiers, x.max())]) for x in inside]
        assert all(x.sum() <= t for x, t in zip(inside, tops)) and sum(tops) <= 2048
        several += len(inside) > 1
    assert several > made / 4


def test_tiers_must_divide():
    with pytest.raises(ValueError):
        packing.pack(None, tiers=(300, 2048))


def test_pack(spark):
    rows = [(1, 5000), (2, 0), (3, None), (4, -3), (5, 2048), (6, 2049), (7, 10), (7, 10), (None, 20)]
    placed = packing.pack(spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, n_tokens int, tier string"), blocks=2).collect()
    got = {}
    for r in placed:
        got.setdefault(r.doc_id, []).append(r)
    assert [sum(x.n_tokens for x in got[i]) for i in (1, 2, 3, 4, 5, 6, 7, None)] == [5000, 0, 0, 0, 2048, 2049, 20, 20]
    assert [len(got[i]) for i in (1, 2, 3, 4, 5, 6, 7, None)] == [3, 1, 1, 1, 1, 2, 2, 1]
    assert all(got[i][0].container is None and got[i][0].tier == 0 for i in (2, 3, 4))
    used = {}
    for r in placed:
        if r.container is not None:
            used[r.block, r.container] = used.get((r.block, r.container), 0) + r.n_tokens
    assert max(used.values()) <= 2048


def test_step_groups_are_even():
    cost = np.random.default_rng(0).lognormal(0, 1, 160)
    g = packing.step_groups(cost, 16)
    assert (np.bincount(g) == 16).all() and np.bincount(g, weights=cost).max() < 1.5 * np.bincount(g, weights=cost).mean()
