"""Problem 9 against looking at every window."""

import random

import numpy as np
import pytest

from folioscan.llm import spans as sp


def brute(docs, t):
    owners = {}
    for i, text in docs:
        for k in range(len(text or "") - t + 1):
            owners.setdefault(text[k : k + t], set()).add(i)
    out = set()
    for i, text in docs:
        end = start = None
        for k in range(len(text or "") - t + 1):
            if len(owners[text[k : k + t]]) > 1:
                if end is None or k > end:
                    if end is not None:
                        out.add((i, start, end))
                    start = k
                end = k + t
        if end is not None:
            out.add((i, start, end))
    return out


def run(spark, docs, t, k, few=1000):
    df = spark.createDataFrame([(i, x, "clash") for i, x in docs], "doc_id bigint, text string, a string").repartition(3)
    return {tuple(r) for r in sp.shared_spans(df, t, k, few).collect()}


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé𝄞 \n") for _ in range(rng.randrange(3, 30)))
    parts = [word() for _ in range(12)]
    docs = []
    for i in range(n):
        docs.append((i, "".join(rng.choice(parts) if rng.random() < 0.6 else word() for _ in range(rng.randrange(1, 12)))))
    return [*docs, (900, docs[0][1]), (901, docs[0][1]), (902, None), (903, ""), (904, "ab" * 60), (905, "x" + "ab" * 50), (906, "zzzz " * 30)]


@pytest.mark.parametrize("seed,t,k", [(1, 20, 10), (2, 20, 20), (3, 35, 7), (4, 50, 30)])
def test_against_every_window(spark, seed, t, k):
    docs = corpus(seed, 60)
    expected = brute(docs, t)
    for few in (1000, 3, 0):
        assert run(spark, docs, t, k, few) == expected


def test_edges(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    assert run(spark, [(1, text), (2, text)], 200, 100) == {(1, 0, 300), (2, 0, 300)}
    assert run(spark, [(1, text[:199]), (2, text)], 200, 100) == set() and run(spark, [(1, text[:200]), (2, text)], 200, 100) == {(1, 0, 200), (2, 0, 200)}
    assert run(spark, [(1, text + text)], 200, 100) == set()
    assert run(spark, [], 200, 100) == set()


def test_long_text_in_blocks(spark, monkeypatch):
    docs = corpus(5, 30)
    big = "".join(x for _, x in docs if x)
    monkeypatch.setattr(sp, "BLOCK", 256)
    found = []
    for owner, text in ((1, big), (2, big[300:900])):
        for start, piece in sp._blocks(text, 40):
            number, ah, sh, a, b = sp._units([piece], 40, 20)
            found += [(owner, int(x) + start, int(y) + start) for x, y in zip(a, b)]
    for owner, text in ((1, big), (2, big[300:900])):
        starts = sorted(k for o, x, y in found if o == owner for k in range(x, y + 1))
        assert starts == list(range(len(text) - 40 + 1))  # each window in one unit


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1 << 60, 1000).astype(np.uint64)
    for w in (1, 2, 7, 101, 1000):
        assert (sp.sliding_min(x, w) == np.lib.stride_tricks.sliding_window_view(x, w).min(axis=1)).all()


def test_share_and_paragraphs(spark):
    a = "p" * 210 + "\n\nshort\n\n" + "Q  q" * 60
    docs = spark.createDataFrame([(1, a), (2, "q " + "\n\n" + "q q" * 60), (3, None), (4, ""), (5, "x\n\n" + "p" * 210)], "doc_id bigint, text string")
    got = {tuple(r) for r in sp.repeated_paragraphs(docs, 100).collect()}
    assert got == {(2, 4, 184, 1, 219), (5, 3, 213, 1, 0)}
    share = {r.doc_id: (r.n_chars, r.shared_chars, r.share) for r in sp.shared_share(docs, sp.shared_spans(docs)).collect()}
    assert share[5] == (213, 210, round(210 / 213, 6)) and share[3] == (0, 0, None) and share[2][1] == 0
