import csv
import shutil
import time
import zipfile
from datetime import datetime
from pathlib import Path

import pytest

from folioscan import cli
from folioscan.api import clear_index, search_files, write_index
from folioscan.operators.pages import page_reader
from folioscan.operators.store import IndexStore
from folioscan.query.parser import Query
from folioscan.sinks import reports
from folioscan.sources import discovery, reading
from folioscan.sources.formats import read_xlsx
from folioscan.streaming import upsert


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    (base / "a.txt").write_text("The running pump meets the valve near São Paulo.")
    (base / "b.md").write_text("# Pumps\n\nA pump & valve table\n\n| valve | 3 |\n|---|---|\n")
    (base / "sub").mkdir()
    (base / "sub/c.csv").write_text("name;part\nx;pump valve\n")
    (base / "sub/d.docx").write_bytes(b"broken")
    (base / "sub/e.txt").write_text("nothing")
    return base


def test_search_files(spark, folder, tmp_path):
    r = search_files(spark, [str(folder)], "pump valve", min_relevance=0)
    assert {(Path(x.path).name, x.location) for x in r.matches.collect()} == {("a.txt", "1"), ("b.md", "2"), ("c.csv", "R2:C2"), ("c.csv", "R2")}
    assert {Path(x.path).name for x in r.skipped.collect()} == {"d.docx"}
    key = lambda x: (x.path, x.location, round(x.relevance_score, 9))
    at = str(tmp_path / "index")
    for _ in range(2):
        same = search_files(spark, str(folder), "pump valve", min_relevance=0, index_folder=at)
        assert sorted(map(key, same.matches.collect())) == sorted(map(key, r.matches.collect()))
        assert {Path(x.path).name for x in same.skipped.collect()} == {"d.docx"}
    assert search_files(spark, str(folder), "run", ["txt"], min_relevance=0).matches.count() == 1
    assert search_files(spark, str(folder), "run", ["txt"], min_relevance=0, use_stemming=False).matches.count() == 0
    assert search_files(spark, str(folder), "sao", ["txt"], min_relevance=0).matches.count() == 1
    assert search_files(spark, str(folder), "sao", ["txt"], min_relevance=0, accent_fold=False, use_stemming=False).matches.count() == 0
    assert search_files(spark, str(folder), "são", ["txt"], min_relevance=0, accent_fold=False, use_stemming=False).matches.count() == 1
    assert search_files(spark, str(folder), "pump", ["txt"], include_subfolders=False).matches.count() == 0  # one row: the raw score stays below 0.1
    assert search_files(spark, "/no/such", "pump").matches.count() == 0
    assert search_files(spark, str(folder), "a NEAR/1 b OR c").warnings


def test_reports(spark, folder, tmp_path):
    m = search_files(spark, str(folder), "pump valve", min_relevance=0).matches
    for fmt in ("html", "txt", "xlsx"):
        reports.write_report(m, str(tmp_path / f"r.{fmt}"))
    page = (tmp_path / "r.html").read_text()
    assert page.count("<h2>") == 3 and "<mark" in page and "&amp;" in page
    assert "1. " in (tmp_path / "r.txt").read_text()
    cells = read_xlsx((tmp_path / "r.xlsx").read_bytes())
    assert cells[0] == ("Results:1:1", "cell", "file_no") and zipfile.is_zipfile(tmp_path / "r.xlsx")
    reports.write_report(m, str(tmp_path / "out.csv"), "csv")
    rows = [r for p in (tmp_path / "out.csv").glob("*.csv") for r in csv.reader(p.open(), escapechar=None)]
    assert sum(r[:1] == ["file_no"] for r in rows) >= 1
    reports.write_report(m, str(tmp_path / "out.json"), "json")
    reports.write_per_folder(m, str(tmp_path / "folders"))
    assert [p.name for p in (tmp_path / "folders").glob("folder_name=*")] == [f"folder_name={folder.name}"]
    reports.write_chunks(m, str(tmp_path / "chunks"), 2)
    assert len(list((tmp_path / "chunks").glob("part=*"))) == 2
    with pytest.raises(ValueError):
        reports.write_report(m, str(tmp_path / "x.doc"))


def test_highlight():
    out = reports.highlight("São PAULO <b> sao", 'sao "paulo" p*')
    assert out.count("<mark") == 3 and ">São</mark>" in out and "&lt;b&gt;" in out and out.count(reports.COLOURS[0]) == 2
    assert reports.highlight(None, "x") == "" and reports.highlight("a", None) == "a" and reports.highlight("a", "") == "a"


def test_cli(spark, folder, tmp_path, capsys):
    assert cli.main(["pump NEAR/2 valve OR x", str(folder), "--types", "txt,md,csv,jsonl", "--min-relevance", "0", "--output", str(tmp_path / "c.txt")]) == 0
    said = capsys.readouterr().out
    assert "warning:" in said and "matches" in said and (tmp_path / "c.txt").exists()


def test_stored_index(spark, tmp_path):
    """Only what is new or changed is opened; what is gone is found no more; a dead writer's segment isn't read."""
    base = tmp_path / "files"
    base.mkdir()
    (base / "a.txt").write_text("the pump")
    (base / "b.md").write_text("# Valves\n\nthe pump")
    at = str(tmp_path / "ix")
    assert write_index(spark, [str(base)], at, ["txt", "md"]).first().n_docs == 2
    store = IndexStore(spark, at)
    scan = lambda: discovery.scan(spark, [str(base)], ["txt", "md"], content=False)
    assert store.refresh(scan()) == {"indexed": 0, "gone": 0} and store.segments() == [0]
    (base / "a.txt").write_text("the new turbine")
    (base / "b.md").unlink()
    (base / "c.txt").write_text("a pump too")
    assert store.refresh(scan()) == {"indexed": 2, "gone": 1} and store.segments() == [0, 1]
    paths = lambda rows: {Path(r.path).name for r in rows.collect()}
    assert paths(store.postings(["pump"])) == {"c.txt"} and paths(store.postings(["turbine"])) == {"a.txt"} and paths(store.units()) == {"a.txt", "c.txt"}
    shutil.copytree(f"{store.at}/units/segment=1", f"{store.at}/units/segment=2")  # written, never committed
    assert store.units().count() == 2
    assert paths(store.candidates(Query("new OR nothing"))) == {"a.txt"} and paths(store.candidates(Query("NOT pump"))) == {"a.txt", "c.txt"}
    clear_index(spark, at)
    assert store.segments() == [] and store.units().count() == 0


def test_pages_of_pdfs(spark, tmp_path):
    """A plugin's pages go through the page pipeline."""
    body = "Clean words of a page that is long enough to be no garbage at all, number {}, well-known and so on."
    pages = {i: f"Title\n{body.format(i)}\nPage {i} of 4" for i in (1, 2, 3)} | {4: ""}

    def extract(data):
        yield from ((str(i), "page", t) for i, t in pages.items())
        yield "2", "page", "short"

    asked = []

    def recognize(data, page):
        asked.append(page)
        return "Title\n" + body.format("four") + "\n4"

    rows = list(page_reader(extract, recognize=recognize)(b""))
    assert asked == [4] and [(r[0], r[1]) for r in rows] == [(str(i), k) for i in (1, 2, 3, 4) for k in ("page", "page-variant")]
    assert rows[0][2] == body.format(1) and rows[6][2] == body.format("four") and "well known" in rows[1][2]
    assert [r[0] for r in page_reader(extract, "never", recognize=recognize)(b"")][-1] == "4" and asked == [4]
    assert len(list(page_reader(extract, "always", 2, recognize)(b""))) and asked == [4, 1, 2]
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    r = search_files(spark, str(tmp_path), "known", ["pdf"], min_relevance=0, plugins={".pdf": lambda data: [("1", "page", "a well-known pump")]})
    assert [(x.location, x.unit_kind) for x in r.matches.collect()]


def test_deadline(spark):
    def slow(data):
        yield "1", "file", "first"
        time.sleep(0.3)
        yield "2", "file", "second"
        yield "3", "file", "third"

    files = spark.createDataFrame([("/x.zzz", ".zzz", "/", bytearray(b"x"))], "path string, ext string, root_folder string, content binary")
    rows = reading.read_units(files, {".zzz": slow}, 0.2).collect()
    assert [r.text for r in rows] == ["first", "second", None] and "TimeoutError" in rows[-1].error


def test_upsert(spark, tmp_path):
    at = str(tmp_path / "ix")
    schema = "path string, unit_ord int, root_folder string, modified timestamp, text string"
    one = spark.createDataFrame([("a", 0, "/", None, "old words"), ("b", 0, "/", None, "kept")], schema)
    two = spark.createDataFrame([("a", 0, "/", None, "new words"), ("a", 0, "/", None, "new words"), (None, 0, "/", None, "x")], schema)
    upsert.write_segment(one, 0, at)
    upsert.write_segment(two, 1, at)
    upsert.write_segment(two, 1, at)  # again, after a failure
    terms = sorted((r.term, r.path) for r in upsert.current_postings(spark, at).collect())
    assert [t for t in terms if t[0] in ("old", "new", "kept")] == [("kept", "b"), ("new", "a")]
    upsert.compact(spark, at, str(tmp_path / "ix2"))
    assert sorted((r.term, r.path) for r in upsert.current_postings(spark, str(tmp_path / "ix2")).collect()) == terms


def test_streams_of_one_index(spark, tmp_path):
    """Two runs over other files, each with a checkpoint of its own; then the first goes on."""
    at, schema = str(tmp_path / "ix"), "path string, unit_ord int, root_folder string, modified timestamp, text string"

    def deliver(run, path, text):
        source = str(tmp_path / f"in-{run}")
        spark.createDataFrame([(path, 0, "r", datetime(2026, 1, 1), text)], schema).coalesce(1).write.mode("append").parquet(source)
        upsert.index_stream(spark.readStream.schema(schema).parquet(source), at, f"{at}/checkpoint-{run}").awaitTermination()
        return sorted((r.path, r.term) for r in upsert.current_postings(spark, at).collect())

    assert deliver(1, "a", "old") == [("a", "old")]
    assert deliver(2, "b", "new") == [("a", "old"), ("b", "new")]
    assert deliver(2, "a", "mid") == [("a", "mid"), ("b", "new")]
    assert deliver(1, "a", "last") == [("a", "last"), ("b", "new")]
    assert sorted(r.batch for r in spark.read.parquet(f"{at}/manifest").collect()) == [0, 1, 2, 3]
    assert [upsert.segment_number(spark, at, f"{at}/checkpoint-{run}", batch) for run, batch in ((1, 0), (2, 0), (2, 1), (1, 1), (1, 1))] == [0, 1, 2, 3, 3]
