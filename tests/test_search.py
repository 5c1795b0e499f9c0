"""Scan and index paths, snippets, ranking and shaping, with nulls, repeats, ties and empty tables."""

import re

import pytest
from pyspark.sql import functions as F

from folioscan.operators import index, search

DOCS = [
    ("/r/a.txt", 0, "/r", "The pump feeds the valve. Pump and valves."), ("/r/b.txt", 0, "/r", "A valve alone, état des vannes"), ("/r/c.txt", 0, "/r", "nothing here"), ("/r/d.txt", 0, "/r", None),
    ("/r/e.txt", 0, "/r", ""), ("/r/f.txt", 0, "/r", "𝄞 𝄞 pump " + "x " * 300 + "pump end"), ("/r/f.txt", 0, "/r/sub", "𝄞 𝄞 pump " + "x " * 300 + "pump end"),
]


@pytest.fixture(scope="module")
def units(spark):
    df = spark.createDataFrame(DOCS, "path string, unit_ord int, root_folder string, text string")
    return search.prepare_units(df.withColumn("query", F.lit("clash")).withColumn("leaf_0", F.lit(1))).cache()


def test_snippets(units):
    r = {(x.path, x.root_folder): x for x in search.search_units(units, "pump", context_size=5).collect()}
    assert r["/r/a.txt", "/r"].context == "he pump fe" and r["/r/a.txt", "/r"].hits == 2
    assert r["/r/f.txt", "/r"].context == "𝄞 𝄞 pump x"[1:] + " " and len(r) == 3
    every = search.search_units(units, "pump", context_size=4, occurrence_mode="all").filter("root_folder = '/r'")
    texts = [DOCS[0][3], DOCS[5][3].replace("  ", " ")]
    around = lambda t, s: t[max(0, s + 2 - 4) : s + 2 + 4]
    assert sorted(x.context for x in every.collect()) == sorted(around(t, m.start()) for t in texts for m in re.finditer("pump", t.lower()))
    assert every.count() == 4 and search.search_units(units, "pump", occurrence_mode="all", max_snippets=1).count() == 3
    stem_only = search.search_units(units, "vannes NOT pump", context_size=6).first()
    assert stem_only.hits == 0 and "vannes" in stem_only.context
    head = search.search_units(units, "NOT pump", context_size=7).filter("path = '/r/c.txt'").first()
    assert head.context == "nothing" and head.relevance_score == 0


def test_index_path_equals_scan(spark, units):
    postings = index.build_postings(units).cache()
    for q in ["pump", "pump valve", "pump OR alone", '"the valve" OR alone', "valve NEAR/3 pump", "(pump AND zebra) NEAR/2 the", "NOT pump", "val*", "val* AND pump", '"pump f*s"', "zebra", "", "etat", "pump NOT valve"]:
        scan = search.search_units(units, q).select("path", "root_folder", "relevance_score").collect()
        left = index.prefilter(units, postings, q)
        assert sorted(search.search_units(left, q).select("path", "root_folder", "relevance_score").collect()) == sorted(scan), q


def test_postings(spark, units):
    p = index.build_postings(units)
    rows = {(r.term, r.path): r.positions for r in p.filter("root_folder = '/r'").collect()}
    assert rows["valve", "/r/a.txt"] == [4] and rows["valves", "/r/a.txt"] == [7] and rows["valv", "/r/a.txt"] == [7]
    assert rows["pump", "/r/a.txt"] == [1, 5]
    assert {r.path for r in index.lookup(p, ["pump", "valve"]).collect()} == {"/r/a.txt"}
    assert {r.path for r in index.lookup(p, ["pump", "alone"], "OR").collect()} == {"/r/a.txt", "/r/b.txt", "/r/f.txt"}
    assert index.lookup(p, ["pump", "zebra"]).count() == 0 and index.lookup(p, []).count() == 0 and index.lookup(p, ["pu*"]).count() == 0
    assert index.statistics(p.limit(0)).first().asDict() == {"n_terms": 0, "n_docs": 0, "n_postings": 0, "per_doc": 0.0}
    assert {r.path for r in index.near_by_postings(p, "feeds", "pump", 0).collect()} == {"/r/a.txt"}
    gone = index.remove_paths(p, spark.createDataFrame([("/r/a.txt",)], "path string"))
    assert gone.filter("path = '/r/a.txt'").count() == 0
    assert index.update_paths(p, p.filter("path = '/r/a.txt'")).count() == p.count()


def test_store_and_read_postings(spark, units, tmp_path):
    p = index.build_postings(units)
    index.write_postings(p, str(tmp_path / "p"), 8)
    assert index.read_postings(spark, str(tmp_path / "p")).count() == p.count()
    assert {r.path for r in index.read_postings(spark, str(tmp_path / "p"), ["alone"], 8).collect()} == {"/r/b.txt"}


def test_ranking(spark, units):
    docs = units.select("path", "text")
    m = search.search_units(units, "valve")
    ranked = search.rank(m, docs, "valve").orderBy(*search.result_order()).collect()
    assert [r.path for r in ranked] == sorted((r.path for r in ranked), key=lambda p: -next(x.relevance_score for x in ranked if x.path == p))
    assert max(r.relevance_score for r in ranked) >= 0.5 and all(r.bm25_score is not None for r in ranked)
    single = search.rank(search.search_units(units, "alone"), docs, "alone").first()
    assert single.bm25_score is None and single.relevance_score < 0.5
    assert search.rank(search.search_units(units, "zebra"), docs, "zebra").count() == 0
    assert search.rank(m, docs, "valve", min_relevance=2).count() == 0
    assert search.rank(m, docs, "valve", ranker="bm25").count() == m.count()


def test_shaping(spark):
    rows = [("/a/x.pdf", 1, "1", "/a", "q", 0.5, "same", 1), ("/a/y.pdf", 1, "1", "/a", "q", 0.9, "same", 1), ("/b/z.csv", 2, "R1", "/b", "q", 0.5, "other", 1), ("/b/z.csv", 3, "R2", "/b", "q", 0.5, None, 1), ("/b/z.csv", 4, "R3", "/b", None, 0.5, None, 1)]
    m = spark.createDataFrame(rows, "path string, unit_ord int, location string, root_folder string, query string, relevance_score double, context string, hits bigint")
    assert sorted(r.path for r in search.dedup_context(m).filter("context = 'same'").collect()) == ["/a/y.pdf"] and search.dedup_context(m).count() == 4
    report = search.report_rows(m).orderBy("file_no", "match_no").collect()
    assert [(r.file_no, r.match_no, r.filename, r.score, r.position) for r in report] == [(1, 1, "y.pdf", "0.9000", "Page 1"), (2, 1, "z.csv", "0.5000", "Location R1"), (2, 2, "z.csv", "0.5000", "Location R2"), (2, 3, "z.csv", "0.5000", "Location R3")]
    parts = search.assign_chunks(m, 2).groupBy("part").count().orderBy("part").collect()
    assert [(r.part, r["count"]) for r in parts] == [(1, 2), (2, 2), (3, 1)]
    assert search.assign_chunks(m.limit(0), 2).count() == 0 and search.report_rows(m.limit(0)).count() == 0
    assert {(r.root_folder, r.n_files) for r in search.per_folder(m).collect()} == {("/a", 2), ("/b", 1)}
