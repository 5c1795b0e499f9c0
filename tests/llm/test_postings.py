"""Problems 2 and 5 against plain Python, with dirt, hot terms and spilling at every size."""

import math
import random
from collections import defaultdict

import pytest

from folioscan.llm import distinctive, frequency

SCHEMA = "term string, path string, unit_ord int, positions array<int>, root_folder string, tf string"


def rows_of(seed, n, terms, paths):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = "hot" if rng.random() < 0.4 else rng.choice(terms)
        p = "/hot" if rng.random() < 0.3 else rng.choice(paths)
        unit = rng.randrange(4)
        out.append((rng.choice([t, t.upper(), f" {t} ", f"\t{t}"]), p, unit, list(range(sum(map(ord, t + p)) % 4 + unit)), "r", "clash"))
    out += [(None, "/a", 0, [1], "r", ""), ("  ", "/a", 0, [1], "r", ""), ("gone", "/a", 0, None, "r", ""), ("x", None, 0, [1], "r", ""), ("empty", "/z", 0, [], "r", "")]
    return out + out[:20]


def expected(rows):
    units = {}
    for t, p, u, pos, *_ in rows:
        if t and t.strip() and pos is not None and p is not None:
            k = (t.strip().lower(), p, u)
            units[k] = max(units.get(k, 0), len(pos))
    tf = defaultdict(int)
    for (t, p, _), n in units.items():
        tf[t, p] += n
    return tf


@pytest.mark.parametrize("seed,n", [(1, 400), (2, 3000)])
def test_scores_and_frequencies(spark, seed, n):
    rows = rows_of(seed, n, [f"w{chr(97 + i)}" for i in range(26)], [f"/p{i}" for i in range(30)])
    df = spark.createDataFrame(rows, SCHEMA)
    tf = expected(rows)
    files, lengths, occ = defaultdict(int), defaultdict(int), defaultdict(int)
    for (t, p), k in tf.items():
        files[t] += 1
        lengths[p] += k
        occ[t] += k
    total, avg = len(lengths), sum(lengths.values()) / len(lengths)
    got = {(r.term, r.path): r for r in distinctive.term_scores(df).collect()}
    assert got.keys() == tf.keys()
    for (t, p), k in tf.items():
        idf = math.log(1 + (total - files[t] + 0.5) / (files[t] + 0.5))
        want = idf * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * lengths[p] / avg)) if k else 0.0
        r = got[t, p]
        assert (r.tf, r.df, r.file_len, r.n_files) == (k, files[t], lengths[p], total) and abs(r.score - want) < 1e-9
    found = {(r.term, r.path) for r in distinctive.distinctive_terms(df).collect()}
    assert found == {k for k, v in tf.items() if v >= 4 and files[k[0]] <= 5}
    want = {t: (occ[t], files[t], "rare" if files[t] == 1 else "common" if files[t] > 0.2 * total else None) for t in occ}
    for size in (1_000_000, 200, 7):
        freq = {r.term: (r.occurrences, r.files, r.mark) for r in frequency.term_frequencies(df, piece_rows=size).collect()}
        assert freq == want, size


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert distinctive.term_scores(df).count() == 0 and frequency.term_frequencies(df).count() == 0


def test_beside_relevance(spark):
    postings = spark.createDataFrame([("pump", "a", 0, [1, 2]), ("valve", "a", 0, [3]), ("pump", "b", 0, [1])], "term string, path string, unit_ord int, positions array<int>")
    rows = spark.createDataFrame([(1, 0.5, "a", "Pump AND valve pump"), (2, 0.1, "b", "valve"), (3, None, None, "pump"), (4, 0.2, "a", None), (5, 0.3, "zzz", "pump")], "match_id bigint, relevance_score double, path string, query string")
    got = {r.match_id: (r.n_terms, round(r.distinct_score, 6)) for r in distinctive.beside_relevance(rows, postings).collect()}
    scores = {(r.path, r.term): r.score for r in distinctive.term_scores(postings).collect()}
    assert got == {1: (2, round(scores["a", "pump"] + scores["a", "valve"], 6)), 2: (1, 0.0), 3: (1, 0.0), 4: (0, 0.0), 5: (1, 0.0)}
    assert distinctive.beside_relevance(rows.limit(0), postings).count() == 0 and {r.distinct_score for r in distinctive.beside_relevance(rows, postings.limit(0)).collect()} == {0.0}
