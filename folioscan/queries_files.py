"""Queries of the core over files: folders, readers, pages, the stored index and written reports.

The files are made from the tables on the way, so that SQL over the tables tells what must be read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sqltext as S
from .functions import text as T
from .functions import words
from .operators import index, pages, search
from .operators.store import IndexStore
from .plans.scratch import materialize, new_path
from .queries import _EXT, _KEYED, _PAGES, _QUALITY, SQL, _boolean, _find, _n, _pages, _texts, query, read, units
from .query.parser import Query
from .sinks import containers, reports
from .sources import discovery, reading

# Folders


def _write(spark, path: str, data: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data.encode()))
    out.close()


def _tree(spark, d) -> tuple[str, list]:
    """A folder for each region with a file for each nation (a fixed table of a few rows)."""
    root, rows = new_path(spark, "tree"), read(spark, d, "nation").toLocalIterator()
    made = [(f"{root}/{r.n_regionkey}/{r.n_name}{'.MD' if r.n_nationkey % 2 else '.txt'}", r) for r in rows]
    for path, r in made:
        _write(spark, path, r.n_name)
    return root, made


_FILE = "n_regionkey || '/' || n_name || case when n_nationkey % 2 = 1 then '.MD' else '.txt' end"


def _relative(root: str, c: str = "path"):
    return F.regexp_replace(c, "^.*/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")


@query(f"""with f as (select *, {_FILE} file, case when n_nationkey % 2 = 1 then '.md' else '.txt' end ext from nation)
select file, ext, length(n_name) size, 'all' of_root from f union all select file, ext, length(n_name), 'region' from f where n_regionkey = 0""")
def scan_recursive(spark, d):
    """Two roots, one within the other: its files are found for both."""
    root, _ = _tree(spark, d)
    found = discovery.scan(spark, [root, f"{root}/0", f"{root}/missing"], content=False)
    return found.select(_relative(root).alias("file"), "ext", "size", F.when(F.col("root_folder") == root, "all").otherwise("region").alias("of_root"))


@query(f"select {_FILE} file from nation where n_regionkey = 1")
def scan_flat(spark, d):
    """Direct children only: none of the root of all, all of a region's folder."""
    root, _ = _tree(spark, d)
    return discovery.scan(spark, [root, f"{root}/1"], recursive=False, content=False).select(_relative(root).alias("file"))


@query(f"select {_FILE} file, n_name text from nation where n_nationkey % 2 = 1")
def scan_types(spark, d):
    """Files of a type are chosen while listing, whatever the case of their extension."""
    root, _ = _tree(spark, d)
    return discovery.scan(spark, [root], ["md"]).select(_relative(root).alias("file"), F.decode("content", "UTF-8").alias("text"))


@query(f"select {_FILE} file from nation where n_regionkey <> 2")
def scan_skip(spark, d):
    root, _ = _tree(spark, d)
    files = discovery.scan(spark, [root], content=False)
    return discovery.skip(files, files.filter(F.col("path").contains("/2/"))).select(_relative(root).alias("file"))


def _store(spark, root: str, stemming: bool = True) -> tuple[IndexStore, object]:
    return IndexStore(spark, new_path(spark, "store"), stemming=stemming), lambda: discovery.scan(spark, [root], content=False)


@query(f"select {_FILE} file from nation where lower(n_name) in ('nation_1', 'nation_20', 'nation_3')")
def stored_index_search(spark, d):
    """A search over the units that a stored index leaves."""
    root, _ = _tree(spark, d)
    store, files = _store(spark, root, False)
    store.refresh(files())
    q = Query('nation_1 OR "Nation_20" OR (nation_3 nation_3) OR none', stemming=False)
    return search.search_units(store.candidates(q), q).select(_relative(root).alias("file"))


@query("""select 1 step, count(*) indexed, 0::bigint gone from nation union all select 2, count(*) filter (n_regionkey = 3), count(*) filter (n_regionkey = 4) from nation
union all select 3, 0, 0""")
def stored_index_refresh(spark, d):
    """All files; then the files of one region changed and those of another gone; then nothing to do."""
    root, made = _tree(spark, d)
    store, files = _store(spark, root)
    steps = [store.refresh(files())]
    for path, r in made:
        if r.n_regionkey == 3:
            _write(spark, path, r.n_name + " again")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/4")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    steps += [store.refresh(files()), store.refresh(files())]
    return spark.createDataFrame([(i, s["indexed"], s["gone"]) for i, s in enumerate(steps, 1)], "step int, indexed bigint, gone bigint")


# Readers, over the bytes of files made from rows


def _files(rows, key: str, ext, content):
    return rows.select(F.col(key).cast("string").alias("path"), ext.alias("ext"), F.lit(None).cast("string").alias("root_folder"), content.alias("content"))


def _units_of(rows, key: str, ext: str, content):
    found = reading.read_units(_files(rows, key, F.lit(ext), content))
    return found.select(F.col("path").cast("bigint").alias(key), "location", "text")


def _packed(make, *cols):
    return F.udf(make, "binary")(*cols)


def _bytes(*parts):
    return F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), "UTF-8")


@query("select doc_id, '1' \"location\", text from documents where text is not null")
def read_text_files(spark, d):
    """Texts of files in UTF-8, and in UTF-16 with its mark."""
    t = _texts(spark, d)
    return _units_of(t, "doc_id", ".txt", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8")))


_XML_TEXT = r"[\x00-\x08\x0b\x0c\x0e-\x1f\r\x{fffe}\x{ffff}]"


@query(rf"""with l as (select doc_id, string_split(regexp_replace(text, '{_XML_TEXT}', '', 'g'), chr(10)) ls from documents where text is not null)
select doc_id, i::varchar "location", ls[i] text from l, unnest(range(1, len(ls) + 1)) t(i) where not regexp_full_match(ls[i], '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]*')""")
def read_docx_files(spark, d):
    """Paragraphs, numbered with the blank ones."""
    lines = F.split(F.regexp_replace("text", _XML_TEXT, ""), "\n")
    return _units_of(_texts(spark, d), "doc_id", ".docx", _packed(containers.docx, lines))


@query("""select s_suppkey, 'Rows:1:1' "location", s_suppkey::varchar text from supplier union all select s_suppkey, 'Rows:1:3', s_name from supplier union all select s_suppkey, 'Rows:2:1', 'a & b' from supplier""")
def read_xlsx_files(spark, d):
    rows = F.array(F.array(F.col("s_suppkey").cast("string"), F.lit(" "), F.col("s_name")), F.array(F.lit("a & b")))
    return _units_of(read(spark, d, "supplier"), "s_suppkey", ".xlsx", _packed(lambda r: containers.xlsx("Rows", r), rows))


@query("select p_partkey, '1' \"location\", p_type || chr(10) || chr(10) || p_name || ' & more' text from part")
def read_epub_files(spark, d):
    """Chapters in the order of the spine, not of the archive."""
    make = lambda a, b: containers.epub([f"<html><head><title/><style>s</style></head><body><p>{a}</p></body></html>", f"<html><body>{b} &amp; more</body></html>"])
    return _units_of(read(spark, d, "part"), "p_partkey", ".epub", _packed(make, F.col("p_type"), F.col("p_name")))


@query("select p_partkey, '1' \"location\", p_brand || chr(10) || p_type || chr(10) || p_name || chr(10) || p_type text from part")
def read_fb2_files(spark, d):
    """By kind of element, plain and zipped: book titles, titles, paragraphs (those of titles too)."""
    book = F.concat(F.lit("<FictionBook><description><book-title>"), "p_brand", F.lit("</book-title></description><body><section><p>"), "p_name", F.lit("</p><title><p>"), "p_type", F.lit("</p></title></section></body></FictionBook>"))
    rows = read(spark, d, "part").withColumn("book", book).withColumn("zipped", F.col("p_partkey") % 2 == 0)
    plain = _units_of(rows.filter("not zipped"), "p_partkey", ".fb2", F.encode("book", "UTF-8"))
    return plain.unionByName(_units_of(rows.filter("zipped"), "p_partkey", ".fb2.zip", _packed(containers.zipped_fb2, F.col("book"))))


@query("select n_nationkey, '1' \"location\", n_name || chr(10) || n_regionkey || chr(10) || 'tail' text from nation")
def read_rdf_files(spark, d):
    """Element texts, tails and attribute values that are no addresses."""
    return _units_of(read(spark, d, "nation"), "n_nationkey", ".rdf", _bytes('<r:RDF xmlns:r="http://x"><r:D r:about="http://y" r:label="', F.col("n_name"), '"><r:t> ', F.col("n_regionkey"), "</r:t> tail</r:D></r:RDF>"))


@query("select n_nationkey, '1' \"location\", concat_ws(chr(10), 'n', n_name, 'k', n_regionkey, 'not json {', 'True', '1.5', 'deep', 'x') text from nation")
def read_jsonl_files(spark, d):
    """Line by line; a bad line stays as it is, nulls and blanks vanish."""
    return _units_of(read(spark, d, "nation"), "n_nationkey", ".jsonl", _bytes('{"n": "', F.col("n_name"), '", "k": ', F.col("n_regionkey"), '}\nnot json {\n\n[true, null, " ", 1.5, {"deep": {" ": "x"}}]'))


@query("""select n_nationkey, '1' "location", n_name || 'é' text from nation union all select n_nationkey, '2', 'a | ' || n_regionkey || chr(10) || 'b' from nation
union all select n_nationkey, '3', 'in-ner ' || n_name from nation union all select n_nationkey, '3', 'in ner ' || n_name from nation union all select n_nationkey, '5', 'B ♭' from nation""")
def read_html_files(spark, d):
    """Blocks of the body in the encoding the page names: noise and loose text left out, tables by rows, repeats once, variants beside."""
    page = F.concat(
        F.lit('<html><head><meta charset="windows-1252"><style>x</style></head><body>loose<!-- c --><h1>'), "n_name", F.lit("é</h1><script>z</script><table><tr><th>a</th><td>"), F.col("n_regionkey").cast("string"),
        F.lit("</td></tr><tr><td>b</td></tr></table><p>in-ner "), "n_name", F.lit("<div>in-ner "), "n_name", F.lit('</div><center><p>B<img src="/g/flat.gif"></p></center></body></html>'),
    )
    return _units_of(read(spark, d, "nation"), "n_nationkey", ".html", F.encode(page, "ISO-8859-1"))


_MD = ["# {}", "", "text one", "text two", "- item {}", "10. plain", "| a | {} |", "|---|:-:|", "```", "code", "```", "1) numbered"]


@query("""with n as (select n_nationkey, n_name from nation) select n_nationkey, i::varchar "location", [n_name, 'text one' || chr(10) || 'text two', 'item ' || n_name, '10. plain', 'a | ' || n_name, 'code', 'numbered'][i] text from n, unnest(range(1, 8)) t(i)""")
def read_md_files(spark, d):
    """Headings, items, rows and running text as blocks; fence lines vanish, their content stays."""
    return _units_of(read(spark, d, "nation"), "n_nationkey", ".md", F.encode(F.replace(F.lit("\n".join(_MD)), F.lit("{}"), F.col("n_name")), "UTF-8"))


@query("""select r_regionkey, unnest(['R1:C1', 'R1:C2', 'R1', '1']) "location", unnest([r_name, '1', r_name || ' | 1', r_name || ',1' || chr(10) || repeat('x', 200000)]) text from region""")
def read_broken_csv(spark, d):
    """What was read stays, and the whole text follows as one unit."""
    return _units_of(read(spark, d, "region"), "r_regionkey", ".csv", _bytes(F.col("r_name"), ",1\n" + "x" * 200_000))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'BadZipFile' else 'ValueError' end reason from nation")
def read_errors(spark, d):
    """Broken files and formats without a reader are rows, and stop nothing."""
    files = _files(read(spark, d, "nation"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, ".docx").otherwise(".xls"), _bytes("broken"))
    return reading.skipped(reading.read_units(files)).select(F.col("path").cast("int").alias("n_nationkey"), F.substring_index("reason", ":", 1).alias("reason"))


@query("select n_nationkey, 'a ' || n_name || chr(10) || chr(10) || 'b' text from nation")
def read_whole_texts(spark, d):
    """Markdown as ranking reads it: without code."""
    files = _files(read(spark, d, "nation"), "n_nationkey", F.lit(".md"), _bytes("a ", F.col("n_name"), "\n```\ncode\n```\nb"))
    return reading.read_documents(files).select(F.col("path").cast("int").alias("n_nationkey"), "text")


# Pages

_W = r"[\p{L}\p{N}_]+"


@query(rf"""with s as (select doc_id, regexp_replace(regexp_replace(regexp_replace({S.nfkc('text')}, '[\p{{Pd}}\x{{2212}}]', '-', 'g'), '\p{{Zs}}', ' ', 'g'), '\p{{Cf}}', '', 'g') t from documents where text is not null),
j as (select doc_id, replace(replace(regexp_replace(t, '({_W})-\s*\n\s*({_W})', '\1\2', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) t from s)
select doc_id, regexp_replace(nfc_normalize(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')), '^\s+|\s+$', '', 'g') page from j""")
def page_clean(spark, d):
    return _texts(spark, d).select("doc_id", pages.clean_page("text").alias("page"))


@query(f"with {_QUALITY} select doc_id, text = '' or n < 60 or alpha < 0.15 or uniq < 0.10 wanted from q")
def ocr_decision(spark, d):
    """Which texts would go to character recognition by themselves."""
    return _texts(spark, d).select("doc_id", pages.needs_ocr("text").alias("wanted"))


@query(f"""with {_QUALITY}, o as ({_QUALITY.split(' as (', 1)[1].rsplit(')', 1)[0].replace("from documents where text is not null", r"from (select doc_id, regexp_replace(text, '\p{Nd}+', '', 'g') text from documents where text is not null)")})
select q.doc_id, coalesce(not (o.n < 60 or o.alpha < 0.15 or o.uniq < 0.10) and round(o.n * (0.7 * o.alpha + 0.3 * o.uniq), 6) >= round(q.n * (0.7 * q.alpha + 0.3 * q.uniq), 6), false) or o.text = q.text accepted from q join o using (doc_id)""")
def ocr_accept(spark, d):
    """A second reading without digits is taken where it is no garbage and at least as good."""
    ocr = F.regexp_replace("text", r"\p{Nd}+", "")
    rows = _texts(spark, d).withColumn("ocr", ocr)
    return rows.select("doc_id", (pages.accept_ocr("text", "ocr") == F.col("ocr")).alias("accepted"))


@query("select p_brand path, p_size page, string_agg(p_name, chr(10) order by floor((p_partkey % 300) / 50), p_partkey // 300, p_partkey % 300, p_name) text from part group by p_brand, p_size")
def block_order(spark, d):
    """Blocks of a page by columns of 50 units, then downwards."""
    rows = read(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_size").alias("page"), (F.col("p_partkey") % 300).alias("x"), F.floor(F.col("p_partkey") / 300).alias("y"), F.col("p_name").alias("text"))
    return pages.order_blocks(rows)


_FURNITURE = r"""(list_contains({k}, trim({l})) or list_contains({k}, regexp_replace(trim({l}), '\p{{Nd}}+', '#', 'g')) or regexp_replace(trim({l}), '\p{{Nd}}+', '#', 'g') in ('page #', '#', 'p #')
 or regexp_full_match(trim({l}), '(?i)(?:page\s+)?\d{{1,4}}(?:\s+of\s+\d{{1,4}})?'))"""

SQL["header_footer_stripped"] = f"""with hf as ({SQL['header_footer_lines']}), {_PAGES},
k as (select path, list(line) filter (is_header) heads, list(line) filter (is_footer) feet from hf group by path),
l as (select path, page, string_split(text, chr(10)) ls, coalesce(heads, []) heads, coalesce(feet, []) feet from pg left join k using (path)),
h as (select path, page, feet, case when {_FURNITURE.format(k='heads', l='ls[1]')} then ls[2:] else ls end ls from l),
f as (select path, page, case when len(ls) > 0 and {_FURNITURE.format(k='feet', l='ls[-1]')} then ls[1:len(ls) - 1] else ls end ls from h)
select path, page::int page, coalesce(list_aggregate(ls, 'string_agg', chr(10)), '') text from f"""


# The query language and ranking

_boolean("open_quote", "'for the pump", f"{_n('for', 'the', 'pump')} > 0", _n("for", "the", "pump"))
_boolean("symbols", "pump && !tile || accord", f"({_n('pump')} > 0 and not {_n('tile')} > 0) or {_n('accord')} > 0", f"{_n('pump')} + {_n('tile')} + {_n('accord')}")


@query(r"""select query_id, (regexp_matches(query, '(?i)near/') and regexp_matches(query, '(?i)(^|\s)or(\s|$)|\|\|') and not regexp_matches(query, '[()]'))::int n from saved_queries where query is not null""")
def saved_query_warnings(spark, d):
    from .plans import planning

    rows = planning.plan_queries(read(spark, d, "saved_queries").filter("query is not null"))
    return rows.select("query_id", F.size("warnings").alias("n"))


@query(rf"with {S.UNITS} select doc_id, len(regexp_extract_all(norm, 'the(?:[\s\x{{a0}}]+|[-/])pump'))::bigint hits from u where {_n('the', 'pump')} > 0")
def phrase_hits(spark, d):
    """A phrase over running text, with flexible blanks."""
    return _find(spark, d, '"the pump"').select(F.col("unit_ord").alias("doc_id"), "hits")


@query(f"""with recursive {S.UNITS}, v as (select distinct unnest(tk) t from u), {S.STEMS},
w as (select doc_id, unnest(tk) t from u), h as (select distinct doc_id from w join stems using (t) where t = 'pumping' or stem = '{words.stem("pumping")}')
select doc_id, case when {_n('pumping')} > 0 then 1 else 0 end::int literal, left(norm, 50) head from u join h using (doc_id) where {_n('pumping')} = 0""")
def stem_only_snippet(spark, d):
    """What matches by its stem alone has no hit in the text: the snippet is its head."""
    found = _find(spark, d, "pumping", True, context_size=50).filter("hits = 0")
    return found.select(F.col("unit_ord").alias("doc_id"), F.lit(0).alias("literal"), F.col("context").alias("head"))


@query("select r_name path, round(ln(2) / ln(1001), 6) relevance_score, null::double bm25_score from region where r_name = 'ASIA'")
def rank_one_row(spark, d):
    """A single result keeps its own score."""
    u = search.prepare_units(read(spark, d, "region").select(F.col("r_name").alias("path"), F.col("r_name").alias("text")))
    r = search.rank(search.search_units(u, "asia"), u.select("path", "text"), "asia")
    return r.select("path", F.round("relevance_score", 6).alias("relevance_score"), "bm25_score")


_CORES = ["for the pump", "val*", "tile"]


@query(rf"""with {S.UNITS}, m as (select * from u where ({_n('for', 'the', 'pump')} > 0 or {_n('val*')} > 0) and not {_n('tile')} > 0),
f as (select path, lower(min(text)) t from m group by path), w as (select path, t, list_filter(string_split_regex(t, '[\s\x{{a0}}\x{{3000}}]+'), lambda x: x <> '') ws from f),
g as (select count(*) n, avg(greatest(1, len(ws))) avgdl, sum(contains(t, 'tile')::int) d2 from w)
select path, round(ln((n - d2 + 0.5) / (d2 + 0.5) + 1) * len(list_filter(ws, lambda x: x = 'tile')) * 2.5 / (len(list_filter(ws, lambda x: x = 'tile')) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)), 4) bm25_score from w, g""")
def bm25_cores(spark, d):
    """Phrases and patterns never equal a word, so they add nothing; a negated term counts like others."""
    u = materialize(units(spark, d, False), "units")
    q = Query('("for the pump" OR val*) AND NOT tile', stemming=False)
    assert q.ranking_cores == _CORES
    return search.rank(search.search_units(u, q), u.select("path", "text"), q).select("path", F.round("bm25_score", 4).alias("bm25_score")).distinct()


# The inverted index


@query(_KEYED + f"select distinct path from postings2 where term in ('pumping', '{words.stem('pumping')}')")
def index_stem_lookup(spark, d):
    return index.lookup(index.build_postings(units(spark, d)), ["pumping"], "AND")


_PLAIN = "term, path, unit_ord, positions, root_folder"


@query(f"select {_PLAIN} from postings where term in ('pump', 'valve', 'nothing-such')")
def index_stored_terms(spark, d):
    """Written by buckets of the term, and read back for a few terms."""
    folder = new_path(spark, "postings")
    index.write_postings(read(spark, d, "postings"), folder)
    return index.read_postings(spark, folder, ["pump", "valve", "nothing-such"]).select(*_PLAIN.split(", "))


_GONE = "(select path from documents where size is null and path is not null)"


@query(f"select path, count(*) n from postings where path not in {_GONE} group by path")
def index_remove(spark, d):
    gone = read(spark, d, "documents").filter("size is null and path is not null")
    return index.remove_paths(read(spark, d, "postings"), gone).groupBy("path").agg(F.count("*").alias("n"))


@query(f"select path, unit_ord, count(*) n, max(term) term from (select path, unit_ord, term from postings where path not in {_GONE} union all select distinct path, 0, 'new' from documents where path in {_GONE}) group by path, unit_ord")
def index_update(spark, d):
    """The postings of new versions in the place of the old ones."""
    new = read(spark, d, "documents").filter("size is null and path is not null").select(F.lit("new").alias("term"), "path", F.lit(0).alias("unit_ord"), F.array(F.lit(0)).alias("positions"), F.col("source").alias("root_folder")).dropDuplicates(["path"])
    rows = index.update_paths(read(spark, d, "postings").select(*_PLAIN.split(", ")), new)
    return rows.groupBy("path", "unit_ord").agg(F.count("*").alias("n"), F.max("term").alias("term"))


# Reports, written and read back

_LABEL = f"""concat(case when e = '.pdf' then 'Page' when e = '.docx' then 'Paragraph' when e in ('.html', '.htm') then 'Element' when e = '.md' then 'Block'
 when e in ('.xlsx', '.xls') then 'Cell' when e = '.csv' then 'Location' else 'Line' end, ' ', location)"""


@query(f"""with recursive r as ({SQL['report_table'].replace("select file_no,", "select k.match_id, file_no,")})
select r.file_no, r.filename, regexp_replace(m.path, '/[^/]*$', '') directory, m.path full_path, r.match_no, r.score, {_LABEL} "position", m.query, coalesce(m.context, '') context
from r join (select *, {_EXT} e from match_rows) m using (match_id)""")
def report_csv(spark, d):
    """All columns of a CSV report as they are read back; null and empty contexts are the same there."""
    folder = new_path(spark, "report")
    reports.write_report(read(spark, d, "match_rows"), folder, "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return back.select(F.col("file_no").cast("bigint").alias("file_no"), "filename", "directory", "full_path", F.col("match_no").cast("bigint").alias("match_no"), "score", "position", "query", F.coalesce("context", F.lit("")).alias("context"))


@query(r"""select coalesce(nullif(left(regexp_replace(regexp_extract(regexp_replace(root_folder, '[/\\]+$', ''), '([^/\\]*)$', 1), '[<>:"|?*]', '_', 'g'), 64), ''), 'root') folder_name, count(*) n from match_rows group by 1""")
def report_folders(spark, d):
    """A part for each root folder."""
    folder = new_path(spark, "folders")
    reports.write_per_folder(read(spark, d, "match_rows"), folder, dedup=False)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return back.groupBy(F.col("folder_name").cast("string").alias("folder_name")).agg(F.count("*").alias("n"))


@query("select ((i - 1) // 500)::int + 1 part, count(*) n from (select row_number() over () i from match_rows) group by 1")
def report_chunks(spark, d):
    folder = new_path(spark, "chunks")
    reports.write_chunks(read(spark, d, "match_rows"), folder, 500)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return back.groupBy("part").agg(F.count("*").alias("n"))
