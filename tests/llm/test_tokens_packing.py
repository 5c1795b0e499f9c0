import base64
import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.llm import packing, tokens

RANKS = f"{tokens.VOCAB_DIR}/{tokens.BYTE_BPE}"
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files")


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab é1٣² \n\t\u00a0'sreß中.-!\u0301"), max_size=300))
def test_pieces_give_the_same_ids(text):
    enc = tokens.load_encoding(RANKS)
    whole = enc.encode_ordinary(text) if text else []
    assert tokens.encode_text(enc, text) == whole
    for size in (1, 5, 40):
        assert "".join(tokens.safe_pieces(text, size)) == text
        assert tokens.encode_text(enc, text, size) == whole


def test_long_texts_without_blanks_are_cut():
    enc = tokens.load_encoding(RANKS)
    for text in ("中文，" * 30_000, "#1" * 40_000, "a\n" * 40_000, "中" * 60_000 + "!" * 60_000):
        pieces = list(tokens.safe_pieces(text))
        assert len(pieces) > 1 and "".join(pieces) == text and max(map(len, pieces)) < 70_000
        assert tokens.encode_text(enc, text) == enc.encode_ordinary(text)


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{tokens.VOCAB_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    enc = tokens.load_encoding(RANKS)
    for t in ("Hello wörld  x", "  lead", "a\n\n b", "<|endoftext|>", "👩‍🔧 中文", " ", "don't 123"):
        assert tokens.encode_text(enc, t) == other.encode(t, add_special_tokens=False).ids
    assert len({base64.b64decode(x.split()[0]) for x in open(RANKS, "rb")}) == 50256


def test_corpus(spark):
    long = "word " * 40_000 + "é" * 1000
    docs = spark.createDataFrame([(1, "Hi é", 7), (2, "", 7), (3, None, 7), (4, "  ", 7), (5, long, 7), (1, "Hi é", 7)], "doc_id bigint, text string, ids int")
    ids = tokens.encode_corpus(docs)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert ids.count() == 6 and got[2] == [] and got[3] == [] and len(got[4]) > 0 and ids.columns == ["doc_id", "ids"]
    assert {r.doc_id: r.text for r in tokens.decode_ids(ids).collect()} == {1: "Hi é", 2: "", 3: "", 4: "  ", 5: long}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


def brute(sizes, capacity):
    """Best fit decreasing, item by item, by looking at every container."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=80), st.integers(20, 45))
def test_best_fit(sizes, capacity):
    """The packing by counts is the one of item after item."""
    runs, opened = packing.best_fit_decreasing(dict(Counter(sizes)), capacity)
    filled, ranks = [0] * opened, {}
    for size, rank, n, first, each in runs:
        for i in range(n):
            filled[first + i // each] += size
            ranks.setdefault(size, []).append(rank + i)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in Counter(sizes).items()}
    assert sorted(capacity - v for v in filled) == brute(sizes, capacity)


def test_tree():
    rng = random.Random(1)
    tree, there = packing.CapacityTree(37), set()
    for _ in range(3000):
        room, size = rng.randrange(38), rng.randrange(38)
        (there.add if room % 2 == rng.randrange(2) else there.discard)(room)
        tree.put(room, room in there)
        assert tree.tightest(size) == min((r for r in there if r >= size), default=-1)


@pytest.mark.parametrize("parts", [1, 7])
def test_packing(spark, parts):
    """Equal containers however the rows are partitioned, also if one size holds most items."""
    sizes = [(i, n, "x") for i, n in enumerate([5, 0, None, 250, 100, 60, 40, 100, 200, *[7] * 100])]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint, spec_id string").repartition(parts)
    specs = spark.createDataFrame([(1, 100), (2, 64), (3, None), (4, 0), (2, 60)], "spec_id bigint, capacity_tokens bigint")
    rows = packing.pack_sizes(df, specs).collect()
    for spec, cap in ((1, 100), (2, 64)):
        own = [r for r in rows if r.spec_id == spec]
        filled, pieces = {}, {}
        for r in own:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        for i, n, _ in sizes:
            p = sorted(pieces[i])
            assert sum(x for _, x in p) == (n or 0) and all(a + x == b for (a, x), (b, _) in zip(p, p[1:])) and (len(p) == 1 or n > cap)
        assert sorted(cap - v for v in filled.values()) == brute([r.n_tokens for r in own], cap)
    assert {r.spec_id for r in rows} == {1, 2}
    numbers = {(r.spec_id, r.doc_id, r.piece): r.container_id for r in rows}
    assert hash_of(numbers) == test_packing.__dict__.setdefault("seen", hash_of(numbers))
    assert packing.pack_sizes(df.limit(0), specs).count() == 0 and packing.pack_sizes(df, specs.limit(0)).count() == 0


def hash_of(numbers):
    return sorted(map(str, numbers.items()))
