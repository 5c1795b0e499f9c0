import re

import duckdb
import numpy as np
import pytest

from folioscan.llm import encoding as en

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.sql(f"select text from '{DATA}' where text is not null and trim(text) <> '' order by hash(doc_id)").fetchall()]


@pytest.fixture(scope="module")
def model(texts):
    return en.fit(texts[: len(texts) * 3 // 4])


def test_chains_invert():
    for chain in en.CHAINS:
        for text in ("“naïve” – é", "Привет", "σήμα", "中文"):
            g = en.garble(text, chain)
            if g is not None:
                assert en.ungarble(g, chain) == text
    assert en.garble("ascii", "utf8>cp1252") is None and en.ungarble("é", "utf8>cp1252") is None
    assert en.garble("”", "utf8>cp1252") == "â€\x9d"


def test_held_out(texts, model):
    """Texts the model hasn't seen: clean ones stay, garbled ones are found and restored."""
    judge = en.Repairer(model)
    held = [t for t in texts[len(texts) * 3 // 4 :] if not t.isascii() and "�" not in t]
    assert sum(judge.repair(t)[0] is not None for t in held) <= 0.03 * len(held)
    for chain, least in (("utf8>cp1252", 0.97), ("utf8>latin1", 0.97), ("utf8>mac", 0.97), ("utf8>cp437", 0.95), ("utf8>cp1252 twice", 0.97), ("cp1252>mac", 0.85), ("koi8r>cp1251", 0.9), ("cp1251>cp1252", 0.9)):
        pairs = [(t, g) for t in held for g in [en.garble(t, chain)] if g]
        found = [judge.repair(g) for _, g in pairs]
        if len(pairs) > 10:
            assert sum(c is not None for c, _ in found) >= least * len(pairs), chain
            if chain.startswith("utf8"):
                assert sum(r == t for (t, _), (_, r) in zip(pairs, found)) >= 0.85 * len(pairs), chain


def test_partly_garbled_and_lost(model):
    judge = en.Repairer(model)
    text = "Den Kran prÃ¼ft das Büro."
    chain, restored = judge.repair(text)
    assert chain.startswith("utf8>") and restored == "Den Kran prüft das Büro."
    assert judge.repair("le d�p�t")[0] == en.LOST and judge.repair("plain")[0] is None and judge.repair("")[0] is None and judge.repair(None) == (None, None)


def test_fields(spark, model):
    rows = spark.createDataFrame([(1, "cafÃ© fermÃ©", None, "x"), (2, "", "cafÃ© fermÃ©", "x"), (3, None, None, "x"), (4, "café", "plain", "x"), (1, "cafÃ© fermÃ©", None, "x")], "match_id bigint, context string, document_text string, field string")
    got = sorted((r.match_id, r.field, r.restored) for r in en.repair_fields(rows, model).collect())
    assert got == [(1, "context", "café fermé")] * 2 + [(2, "document_text", "café fermé")]
    assert en.repair_fields(rows.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, "x " * 300_000 + "cafÃ© fermÃ©", None)], "match_id bigint, context string, document_text string")
    assert en.repair_fields(long, model).first().restored.endswith("café fermé")


def test_sample_is_bounded(spark):
    from folioscan.llm.sampling import sample_texts

    df = spark.createDataFrame([(f"t{i % 500}",) for i in range(2000)] + [(None,), ("",), ("  ",)], "text string")
    got = sample_texts(df, 50)
    assert 0 < len(got) <= 50 and len(set(got)) == len(got) and got == sample_texts(df.repartition(7), 50)
    assert sample_texts(df.limit(0), 50) == []


def test_many_at_once(texts, model, monkeypatch):
    """Many values are judged as each by itself, and the words of each are looked for once."""
    chains = [None, "utf8>cp1252", "utf8>mac", "cp1251>cp1252"]
    values = [(c and en.garble(t, c)) or t for t, c in zip(texts, chains * len(texts))] + [None, "", "plain", "le d�p�t", "Den Kran prÃ¼ft das Büro."]
    each = [en.Repairer(model).repair(v) for v in values[-60:]]
    seen, words_of = [], en.words_of
    monkeypatch.setattr(en, "words_of", lambda t: seen.append(t) or words_of(t))
    for chars in (1, 2000, 1 << 20):
        seen.clear()
        judge = en.Repairer(model)
        assert judge.repair_all(values, chars)[-60:] == each
        assert sorted(seen) == sorted(v for v in values if v and not v.isascii())


def test_words_beyond_ascii():
    """A word is all ASCII letters and digits and all other characters around the first beyond ASCII."""
    text = "ab1é2 xyz ñ\nüü-aß_ç 9"
    assert [(text[s:e], w) for s, e, w in en.words_of(text)] == [("ab1é2", "  ab1é2 a"), ("ñ", "a ñ\n\x01"), ("üü", "\x01\nüü-a"), ("aß", "\x01-aß_\x01"), ("ç", "\x01_ç 0")]
    assert en.words_of("x" * 100_000 + "é")[0][:2] == (0, 100_001) and en.words_of("plain") == []


def test_letter_spans():
    texts = ["", "ab", "a1 Bc_dé,x", "сло́во ½Ⅷ²", " \n", "\U00010400\U00020000 \U000e0041\U0010fffd", "中文 a", "x" * 5000]
    for least in (1, 2):
        for rows in (1, 3, 100):
            got = [list(zip(*x)) for x in en.letter_spans(texts, least, rows)]
            assert got == [[m.span() for m in re.finditer(rf"[^\W\d_]{{{least},}}", t)] for t in texts]
    every = "".join(map(chr, range(0x110000)))
    assert list(zip(*next(en.letter_spans([every])))) == [m.span() for m in re.finditer(r"[^\W\d_]+", every)]


def test_scores_are_sums(texts, model):
    """However many words are scored at once, each has the sum of its own weights."""
    words = sorted({w for t in texts[:300] for _, _, w in en.words_of(t)}) + ["  " + "é" * 70_000 + "  ", "  ü  "]
    scores = model.scores(words)
    for i in (0, 1, len(words) // 2, len(words) - 2, len(words) - 1):
        _, bucket = en.features([words[i]])
        assert np.allclose(scores[i], model.weights[bucket].sum(axis=0, dtype=np.float64) * en.TEMPER + model.prior)
    assert model.scores([]).shape == (0, len(en.LABELS))
