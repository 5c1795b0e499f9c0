import random
import re

import duckdb
import numpy as np
import pytest

from folioscan.llm import scans as sc

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.sql(f"select distinct text from '{DATA}' where length(text) > 200 order by hash(text)").fetchall()]


@pytest.fixture(scope="module")
def model(texts):
    return sc.fit(texts[: len(texts) * 3 // 4])


def test_spoiling_is_invertible():
    rng = random.Random(1)
    text = "The modern boilers are running near the window of Bilem, Brown said. " * 5
    noisy, gold = sc.spoil(text, rng, 0.3, 0.3, 0.1, 0.2)
    assert noisy != text and gold
    out, at = [], 0
    for (o, p), was in sorted(gold.items()):
        assert noisy[o : o + len(p)] == p
        out += [noisy[at:o], was]
        at = o + len(p)
    assert "".join(out) + noisy[at:] == text


def test_held_out(texts, model):
    held = texts[len(texts) * 3 // 4 :]
    restorer, rng = sc.Restorer(model), random.Random(2)
    clean = restorer.restore(held)
    assert sum(sc.is_case(c) for _, c in clean) <= 0.06 * len(held)
    latin = [t for t in held if re.search(r"[a-z]{4}", t)]
    spoilt = [sc.spoil(t, rng, 0.05, 0.05, 0.01, 0.01)[0] for t in latin]
    got = restorer.restore(spoilt)
    assert sum(sc.is_case(c) for _, c in got) >= 0.95 * len(latin)
    wrong = lambda a, b: sum(x != y for x, y in zip(a.split(), b.split()))
    before, after = sum(wrong(t, s) for t, s in zip(latin, spoilt)), sum(wrong(t, g) for t, (g, _) in zip(latin, got))
    assert after < 0.6 * before
    titles = [t.split("\n", 1)[0] for t in latin if len(t.split("\n", 1)[0]) < 40]
    pages = [(sc.furnish(t, rng, titles)) for t in latin]
    pages = [(p, f) for p, f in pages if f]
    assert sum(restorer.furniture(p)[1] > 0 for p, _ in pages) >= 0.9 * len(pages)


def test_repairs(model):
    restorer = sc.Restorer(model)
    text = "According to Pobes, the pump bor-\nders the valve, and the cop-\n— 12 —\nper tower opens later."
    (new, counts), = restorer.restore([text])
    assert counts["join"] == 2 and counts["furniture"] == 1 and "borders the valve" in new and "copper tower" in new
    assert sc.reflow("one line that is long enough to be wrapped by a page\ncontinues here\n\n- a\n- b") == "one line that is long enough to be wrapped by a page continues here\n\n- a\n- b"
    (same, counts), = restorer.restore(["a\nb\n12\nc"])
    assert not counts["join"]


def test_misread_twice(model):
    """A misread word is repaired though it stands twice, or within another word."""
    restorer = sc.Restorer(model)
    clean = "The pump stands beside the valve, and the tower opens later. According to Pobes, the boiler beside the window borders the valve."
    (new, counts), = restorer.restore([clean.replace("beside", "beslde")])
    assert new == clean and counts["wrong"] == 2 and sc.is_case(counts)
    words = lambda t, *edits: sc.Words(t, list(edits), sc.lexicon_of(["areia parcial modern levanta"]))
    assert not words("arcia parcial", (2, "c", "e")).keeps(2, "c", "e")
    two = [(0, "rn", "m"), (4, "c", "e")]  # both wrong, so that none of them alone makes a known word
    twice = words("rnodcrn rnodcrn", *two)
    assert not any(twice.keeps(*e) for e in two)
    # what is known, or made into nothing known, stays if it recurs, also over a line's end and cut at the text's
    assert words("levanta levan-\nta", (0, "l", "i")).keeps(0, "l", "i") and words("Xarilo xarilo", (2, "ri", "n")).keeps(2, "ri", "n")
    assert words("Pofurigen a pofuri", (15, "ri", "n")).keeps(15, "ri", "n") and not words("xarilo", (2, "ri", "n")).keeps(2, "ri", "n")


def test_fields(spark, model):
    bad = "the pump bor-\nders the valve of the new-\nest tower"
    rows = spark.createDataFrame([(1, bad, None, 0), (2, None, "", 0), (3, "plain text\nwrapped", bad, 0), (1, bad, None, 0)], "match_id bigint, context string, document_text string, wrong int")
    got = sorted((r.match_id, r.field, r.joins) for r in sc.restore_fields(rows, model).collect())
    assert got == [(1, "context", 2), (1, "context", 2), (3, "document_text", 2)]
    assert sc.restore_fields(rows.limit(0), model).count() == 0
    from folioscan.llm import encoding

    garbled = encoding.fit(["Der Kran prüft das Büro für Öl.", "o armário e o inventário – “note” à 5 €"] * 30)
    rows = spark.createDataFrame([(1, "o armÃ¡rio e o inventÃ¡rio", None)], "match_id bigint, context string, document_text string")
    assert sc.restore_fields(rows, model, garbled).count() == 0


def test_long_text(model):
    text = ("the pump borders the valve of the tower. " * 40 + "\n\n") * 400 + "a bor-\nders b"
    (new, counts), = sc.Restorer(model).restore([text])
    assert counts["join"] == 1 and new.endswith("a borders b") and len(new) == len(text) - 2


def test_pieces_change_nothing(texts, model, monkeypatch):
    """A text is judged alike whole and in pieces, also where a misread word recurs far away."""
    rng = random.Random(7)
    noisy = " ".join(sc.spoil(t, rng, 0.04, 0.04, 0.01, 0.01)[0] for t in texts[:60])
    restorer = sc.Restorer(model)
    whole = restorer.restore([noisy])
    for chunk in (5000, 777):
        monkeypatch.setattr(sc, "CHUNK", chunk)
        assert restorer.restore([noisy]) == whole


def test_learnt_confusions_and_inserts(texts, model):
    clean = texts[:200]
    noisy = [t.replace("g", "q") for t in clean]
    learnt = sc.learn_confusions(noisy, clean)
    assert ("q", "g") in learnt and ("g", "q") not in learnt
    assert sc.learn_confusions([], clean) == [] and sc.learn_confusions(clean, []) == []
    n = repaired = 0
    for t in clean[:60]:  # a letter the scan lost is put back
        word = next(iter(re.findall(r"\b[a-z]{2,}ll[a-z]+", t)), None)
        if word:
            (new, _), = sc.Restorer(model).restore([re.sub(rf"\b{word}\b", word.replace("ll", "l"), t, count=1)])
            n, repaired = n + 1, repaired + (word.replace("ll", "l") not in new.split() or word.replace("ll", "l") in t.split())
    assert n > 10 and repaired > 0.8 * n


def test_coding_is_no_noise(model):
    text = "The co\u0301py of the fac\u0327ade be\u200bside the pu\u00admp, and the sce\u0301ne opens later."
    (_, counts), = sc.Restorer(model).restore([text])
    assert not counts["wrong"] and not counts["spaced"]


def _word(n: int, letters: str = "bcdfhjkmnprstvwz") -> str:
    """A word of its own for each number; no two differ in one letter or by one."""
    digits = [n >> k & 15 for k in (0, 4, 8)]
    return "".join(letters[d] + v for d, v in zip([*digits, sum(digits) % 16, sum(k * d for k, d in enumerate(digits, 1)) % 16], "aeiou"))


@pytest.fixture(scope="module")
def tables(spark):
    """More texts and values than any bound, with a word of its own in each text and a rare confusion in the values."""
    docs = spark.createDataFrame([(f"the pump {_word(n)} borders the valve",) for n in range(4000)] + [("",), (None,), ("  ",)], "text string")
    bad = {n: _word(n).replace("a", "ы", 1) for n in range(0, 4000, 400)}
    rows = spark.createDataFrame([(n, f"row {n}: the pump {bad.get(n, _word(n))} borders the valve", None) for n in range(4000)], "match_id bigint, context string, document_text string")
    return docs, rows


@pytest.fixture(scope="module")
def fitted(tables):
    return sc.fit_on(*tables)


def test_all_texts_and_values_count(fitted):
    """No word of a text and no value with a rare confusion is left to chance."""
    model, _ = fitted
    assert all(sc.is_known(_word(n), model.lexicon) for n in range(4000))
    assert model.candidates.options.get("ы") == ["a"]


def test_fit_ignores_order_and_partitions(tables, fitted):
    docs, rows = tables
    again, code = sc.fit_on(docs.union(docs).orderBy("text").repartition(3), rows.repartition(5))
    model, garbled = fitted
    assert (again.weights == model.weights).all() and (again.lexicon == model.lexicon).all() and again.lines == model.lines
    assert again.candidates.options == model.candidates.options and (code.weights == garbled.weights).all() and (code.prior == garbled.prior).all()


def test_fit_of_nothing(tables):
    docs, rows = tables
    model, garbled = sc.fit_on(docs.limit(0), rows.limit(0))
    assert not model.weights.any() and sc.restore_fields(rows.limit(5), model, garbled).count() == 0


def test_parts_are_all_texts(spark):
    from folioscan.llm.sampling import distinct_parts

    texts = [f"{n} text" * (1 + n % 3) for n in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, *texts, "x" * 7000, None, "", " "]], "text string")
    got = distinct_parts(df, rows=100)
    assert sorted(r.t for r in got.collect()) == sorted([*texts, "x" * 3000, "x" * 1000]) and got.rdd.getNumPartitions() == 7


def test_confusions_in_tables(spark, texts):
    clean = texts[:200]
    noisy = [t.replace("g", "q").replace("ll", "l") for t in clean]
    table = lambda ts: spark.createDataFrame([(w,) for w in sorted({w for t in ts for w in sc._spelt(t)})], "word string")
    assert sc.confusions_in(table(noisy), table(clean)) == sc.learn_confusions(noisy, clean) != []


def test_lexicon_holds_long_words():
    lexicon = sc.lexicon_of(["ab " + "x" * 3_000_000 + " " + "y" * 400_000 + " " + "z" * 400_000])
    assert sc.is_known("ab", lexicon) and sc.is_known("y" * 400_000, lexicon) and not sc.is_known("ba", lexicon)


def test_groups_are_all_texts(monkeypatch):
    monkeypatch.setattr(sc, "GROUP_CHARS", 100)
    for texts in (["a"], ["ab" * n for n in range(1, 40)], ["x" * 500, "y", "z" * 90]):
        groups = list(sc.groups_of(texts))
        assert [t for g in groups for t in g] == texts and all(groups) and all(sum(map(len, g[1:])) <= 200 for g in groups)


def test_contexts_once_for_each_length(texts, monkeypatch):
    """What stands around all places of a page is looked at once for each length of patterns, not for each pattern."""
    candidates, seen, contexts = sc.Candidates(), [], sc.Page.contexts
    monkeypatch.setattr(sc.Page, "contexts", lambda page, words, size: seen.append(size) or contexts(page, words, size))
    sites = sc.sites_of(sc.Page(texts[:40]), sc.lexicon_of(texts[:20]), candidates)
    assert len(sites) > 20 and sorted(seen) == sorted({len(candidates.patterns[s.pattern]) for s in sites})
    assert [s.pattern for s in sites] == sorted({s.pattern for s in sites})
    for s in sites:
        assert s.features.shape == (1 + len(candidates.options[candidates.patterns[s.pattern]]), sc.FEATURES, len(s.pos))


def test_scores_and_average(texts, monkeypatch):
    """Scores are sums of weights, and the weights the mean of every eighth state."""
    rng = np.random.default_rng(3)
    w, f = rng.normal(size=1 << sc.BITS).astype(np.float32), rng.integers(0, 1 << sc.BITS, (sc.FEATURES, 3, 50), np.int32)
    assert (sc._scores(w, f) == w[np.ascontiguousarray(f.transpose(2, 1, 0))].sum(axis=2).T).all()
    states, scores = [], sc._scores
    monkeypatch.setattr(sc, "_scores", lambda w, f: states.append(w.copy()) or scores(w, f))
    got, _ = sc.fit_editor(texts[:10], random.Random(4), sc.Candidates())
    assert len(states) > 40 and np.abs(got).max() > 0.1
    if len(states) % 8:  # else the last state isn't seen here
        assert np.allclose(got, np.mean(states[8::8], axis=0), atol=1e-6)
