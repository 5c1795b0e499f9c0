import io
import json
import zipfile

from folioscan.queries import QUERIES
from folioscan.sources import formats as f
from folioscan.sources import reading


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_text_and_encodings():
    assert f.read_txt("é".encode()) == [("1", "file", "é")] and f.read_txt(b"\xff\xfea\x00") == [("1", "file", "a")] and f.read_txt(b"caf\xe9 x") == [("1", "file", "café x")] and f.read_txt(b"") == [("1", "file", "")]


def test_markdown():
    text = "# Head\nfirst line\nsecond\n\n- item one\n10. ordinary\n1. numbered\n```\ncode\n```\n| a | b |\n|---|:-:|\n| c | d |\n"
    assert f.markdown_blocks(text) == ["Head", "first line\nsecond", "item one", "10. ordinary", "numbered", "code", "a | b", "c | d"]


def test_csv():
    assert [f.sniff_delimiter(x) for x in ("a;b;c", "a\tb", "a|b", "", "a,b;c")] == [";", "\t", "|", ",", ","]
    assert list(f.csv_units('h1,h2\n"x\ny",\n\nz')) == [("R1:C1", "cell", "h1"), ("R1:C2", "cell", "h2"), ("R1", "row", "h1 | h2"), ("R2:C1", "cell", "x\ny"), ("R2", "row", "x\ny"), ("R4:C1", "cell", "z"), ("R4", "row", "z")]
    assert list(f.csv_units("")) == []
    broken = list(f.csv_units("ok,1\n" + "x" * 200_000))
    assert broken[0] == ("R1:C1", "cell", "ok") and broken[-1][:2] == ("1", "file")


def test_csv_of_all_texts(spark, tmp_path):
    """Against cells that are written out by hand, with every way of quoting."""
    rows = {
        1: [["name", "note"], ["a, b", 'say "hi"'], ["two\nlines", ""], ["", " x "]],
        2: [["p;q", "1"], ["r", 's"t'], ["", ""], ["u\r\nv", "w"]],
        3: [["plain", "c d"]],
    }
    text = lambda d, table: "\r\n".join(d.join('"' + v.replace('"', '""') + '"' for v in r) for r in table)
    texts = [(1, "csv", text(",", rows[1])), (2, "CSV", text("\t", rows[2])), (3, "csv", "plain|c d"), (4, "csv", None), (5, "txt", '"a",b')]
    want = set()
    for i, table in rows.items():
        for r, cells in enumerate(table, 1):
            want |= {(i, f"R{r}:C{c}", v.strip()) for c, v in enumerate(cells, 1) if v.strip()}
            if any(cells):
                want.add((i, f"R{r}", " | ".join(v.strip() for v in cells if v.strip())))
    spark.createDataFrame(texts, "doc_id bigint, ext string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in QUERIES["csv_cells_rows"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_json():
    assert f.json_text('{"a": {"b": [1, true, null, " x "]}, "c": ""}') == "a\nb\n1\nTrue\nx\nc"
    assert f.json_text("{bad") == "{bad"
    assert f.read_jsonl(b'{"a": 1}\nnot json\n\n[2]') == [("1", "file", "a\n1\nnot json\n2")]
    assert f.read_json(json.dumps({"k": "é"}).encode()) == [("1", "file", "k\né")]


def test_rdf():
    assert f.read_turtle(b"# c\n@prefix a: <b> .\n/* x\ny */a:b a:c \"lit\" .")[0][2] == "@prefix a: <b> .\n a:b a:c \"lit\" ."
    xml = b'<r xmlns:x="u"><a about="http://n" label="seen">text</a>tail</r>'
    assert f.read_rdf_xml(xml)[0][2] == "text\ntail\nseen" and f.read_rdf_xml(b"<bad")[0][2] == "<bad"


def test_turtle_of_all_texts(spark, tmp_path):
    texts = {1: "a b c .\n# note\nd e f .\n", 2: "a\x0b# note\x0cb\x1c#\x1dc\x1ed", 3: "a\u2028 # note\u2029b\x85#x", 4: "a\r\n#x\rb", 5: "/* x\ny */a # b\n", 6: ""}
    rows = [(i, "NT" if i % 2 else "ttl", t) for i, t in texts.items()] + [(7, "ttl", None), (8, "txt", "a")]
    spark.createDataFrame(rows, "doc_id bigint, ext string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in QUERIES["turtle_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "a b c .\nd e f .", 2: "a\nb\nc\nd", 3: "a\nb", 4: "a\nb", 5: " a # b", 6: ""}


def test_html():
    page = "<html><head><title>t</title></head><body><!-- c --><h1>Head</h1>lost<main><p>in <b>main</b><div>next</div></main><script>'</p>'</script><table><tr><td>a</td><th>b</th></tr><tr><td></td></tr></table><ul><li>one<li>two-part</ul><p>Head</p><p>x <img src='i/flat.gif'></body></html>"
    assert f.html_blocks(page) == ["Head", "a | b", "Head", "x ♭", "in main", "next", "one", "two-part"]
    units = f.html_units(page)
    assert [u for u in units if u[2] == "Head"] == [("1", "block", "Head")] and ("8", "block-variant", "two part") in units
    assert f.charset_of(b"\xef\xbb\xbfx") == "utf-8-sig" and f.charset_of(b'<meta charset="koi8-r">') == "koi8-r" and f.charset_of(b"\xe9 x") == "cp1252" and f.charset_of("é".encode()) == "utf-8"
    assert f.html_blocks("") == [] and f.html_text("<p>a</p>b<style>c</style>") == "a b"


def test_archives():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = archive(**{"word__document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:tbl><w:p><w:r><w:t>no</w:t></w:r></w:p></w:tbl><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'})
    assert f.read_docx(docx) == [("1", "paragraph", "one"), ("3", "paragraph", "two")]
    xlsx = archive(**{
        "xl__workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="i1"/></sheets></workbook>', "xl___rels__workbook.xml.rels": '<R><Relationship Id="i1" Target="worksheets/sheet1.xml"/></R>',
        "xl__sharedStrings.xml": "<sst><si><t>shared</t></si></sst>", "xl__worksheets__sheet1.xml": '<worksheet><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>3.5</v></c><c r="D2" t="b"><v>1</v></c></row></sheetData></worksheet>',
    })
    assert f.read_xlsx(xlsx) == [("S:2:2", "cell", "shared"), ("S:2:3", "cell", "3.5"), ("S:2:4", "cell", "True")]
    epub = archive(**{
        "META-INF__container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O__p.opf": '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "O__a.xhtml": "<html><body><p>first</p></body></html>", "O__b.xhtml": "<html><body><p>second</p></body></html>",
    })
    assert f.epub_text(epub) == "first\n\nsecond"
    assert f.epub_text(archive(**{"x.xhtml": "<p>only</p>"})) == "only"
    fb2 = "<FictionBook><body><title><p>T</p></title><section><p>para</p><v>verse</v></section></body></FictionBook>"
    assert f.fb2_text(fb2) == "T\nT\npara\nverse" and f.read_fb2_zip(archive(**{"b.fb2": fb2}))[0][2] == "T\nT\npara\nverse" and f.read_fb2_zip(archive(a="x")) == []


def test_read_units(spark):
    files = spark.createDataFrame([("/a.txt", ".txt", "/", b"hello"), ("/b.docx", ".docx", "/", b"broken"), ("/c.pdf", ".pdf", "/", b"PDF"), ("/d.png", ".png", "/", b"")], "path string, ext string, root_folder string, content binary")
    units = reading.read_units(files, {".pdf": lambda b: [("1", "page", b.decode()), ("2", "page", "more")]}).collect()
    assert {(u.path, u.unit_ord, u.text) for u in units if u.error is None} == {("/a.txt", 0, "hello"), ("/c.pdf", 0, "PDF"), ("/c.pdf", 1, "more")}
    assert {u.path for u in units if u.error} == {"/b.docx", "/d.png"}
    slow = reading.read_units(files.filter("ext = '.txt'"), file_timeout=1e-9)
    assert slow.filter("text = 'hello'").count() == 1 and reading.skipped(slow).count() == 1
    assert {(r.path, r.text) for r in reading.read_documents(files).collect()} == {("/a.txt", "hello"), ("/b.docx", ""), ("/c.pdf", ""), ("/d.png", "")}


def test_table_units(spark):
    t = spark.createDataFrame([(1, "x", None), (2, " ", None)], "k int, a string, b int")
    assert {tuple(r) for r in reading.table_units(t, "k", ["k", "a", "b"]).collect()} == {(1, "C1", "cell", "1"), (1, "C2", "cell", "x"), (1, "R", "row", "1 | x"), (2, "C1", "cell", "2"), (2, "R", "row", "2")}
