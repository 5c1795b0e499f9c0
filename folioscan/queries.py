"""The queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import text as T
from .functions import words
from .operators import index, ledger, pages, search
from .plans import planning
from .plans.scratch import materialize, new_path, spread
from .query.parser import Query
from .sources import discovery, formats, reading
from .streaming import upsert

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_DONE = """with ok as (select run_id, max(started_at) s from index_runs where lower(trim(status)) = 'ok' group by run_id),
r as (select path, (s, run_id) token, size, mtime from manifest join ok using (run_id) where path is not null),
l as (select path, max((token, size, mtime)) last from r group by path),
w as (select o.doc_id, o.path, case when o.size = last[2] and o.modified = last[3] then 'done' else 'pending' end state
      from documents o left join l on o.path = l.path)
"""


@query(_DONE + "select doc_id from w where state = 'pending'")
def p3_found(spark, d):
    return ledger.files_to_process(read(spark, d, "documents"), read(spark, d, "manifest"), read(spark, d, "index_runs"))


@query(_DONE + "select t.state, count(w.state) n from (values ('pending'), ('leased'), ('done')) t(state) left join w using (state) group by t.state")
def p3_states(spark, d):
    return ledger.counts_by_state(ledger.work_items(read(spark, d, "documents"), read(spark, d, "manifest"), read(spark, d, "index_runs")))


# Text functions over whole documents

def _texts(spark, d):
    return spread(read(spark, d, "documents").filter("text is not null").select("doc_id", "text"))


@query(f"select doc_id, {S.clean('text')} clean, {S.fold('text')} folded from documents where text is not null")
def normalize_text(spark, d):
    return _texts(spark, d).select("doc_id", T.clean_extracted("text").alias("clean"), T.fold("text").alias("folded"))


_WORDS = r"[\p{L}\p{N}_]+"


@query(rf"""with s as (select doc_id, regexp_replace(regexp_replace({S.nfkc('text')}, '\x{{ad}}\s*', '', 'g'), '[\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]', '', 'g') t from documents where text is not null),
j as (select doc_id, replace(replace(regexp_replace(t, '({_WORDS})-\s*\n\s*({_WORDS})', '\1\2', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) t from s)
select doc_id, regexp_replace(nfc_normalize(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')), '^\s+|\s+$', '', 'g') shown from j""")
def display_text(spark, d):
    return _texts(spark, d).select("doc_id", T.clean_display("text").alias("shown"))


@query(f"select doc_id, len({S.tokens(S.fold('text'))}) n_tokens from documents where text is not null")
def tokenize_counts(spark, d):
    return _texts(spark, d).select("doc_id", F.size(T.tokenize(T.fold("text"))).cast("bigint").alias("n_tokens"))


@query(f"with {S.UNITS} select t term, count(*) n, count(distinct doc_id) docs from (select doc_id, unnest(tk) t from u) group by t")
def token_vocabulary(spark, d):
    words = units(spark, d, False).select("doc_id", F.explode("tokens").alias("term"))
    per_doc = words.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"with recursive {S.UNITS}, v as (select distinct unnest(tk) t from u), {S.STEMS} select t term, stem from stems")
def stem_vocabulary(spark, d):
    return units(spark, d, False).select(F.explode("tokens").alias("term")).distinct().select("term", T.stem("term").alias("stem"))


@query(f"with recursive {S.UNITS}, v as (select distinct unnest(tk) t from u), {S.STEMS} select t term, unnest(case when stem <> t and stem <> '' then [t, stem] else [t] end) index_key from stems")
def expand_keys(spark, d):
    words = units(spark, d, False).select(F.explode("tokens").alias("term")).distinct()
    stem = T.stem("term")
    return words.withColumn("stem", stem).select("term", F.explode(F.array_distinct(F.array("term", "stem"))).alias("index_key"))


@query(r"select doc_id, regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])[-/]([\p{L}\p{N}_])', '\1 \2', 'g'), '([\p{L}\p{N}_])[-/]([\p{L}\p{N}_])', '\1 \2', 'g') variant from documents where text is not null")
def hyphen_variant(spark, d):
    return _texts(spark, d).select("doc_id", T.hyphen_variant("text").alias("variant"))


@query(r"select doc_id, regexp_replace(text, '\p{Nd}+', '#', 'g') masked from documents where text is not null")
def mask_digits(spark, d):
    return _texts(spark, d).select("doc_id", T.mask_digits("text").alias("masked"))


@query("""select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') escaped from documents where text is not null""")
def html_escape(spark, d):
    return _texts(spark, d).select("doc_id", T.html_escape("text").alias("escaped"))


@query("select doc_id, md5(text) digest from documents where text is not null")
def content_digest(spark, d):
    return _texts(spark, d).select("doc_id", T.fingerprint("text").alias("digest"))


_EXT = r"case when lower(path) like '%.fb2.zip' then '.fb2.zip' else regexp_extract(lower(path), '[^/\\.][^/\\]*?(\.[^./\\]*)$', 1) end"


@query(f"select doc_id, {_EXT} extension from documents where path is not null")
def file_extension(spark, d):
    return read(spark, d, "documents").filter("path is not null").select("doc_id", T.extension("path").alias("extension"))


_TYPE = "case " + " ".join(f"when e in ({', '.join(repr(x) for x in xs)}) then '{k}'" for k, xs in T.FILE_TYPES.items()) + " end"


@query(f"select file_type, count(*) n from (select {_TYPE} file_type from (select {_EXT} e from documents)) where file_type is not null group by 1")
def file_type_gate(spark, d):
    docs = read(spark, d, "documents").select(T.type_of(T.extension("path")).alias("file_type"))
    return docs.filter("file_type is not null").groupBy("file_type").agg(F.count("*").alias("n"))


@query(f"""select match_id, concat(case when e = '.pdf' then 'Page' when e = '.docx' then 'Paragraph' when e in ('.html', '.htm') then 'Element' when e = '.md' then 'Block'
 when e in ('.xlsx', '.xls') then 'Cell' when e = '.csv' then 'Location' else 'Line' end, ' ', location) "position" from (select *, {_EXT} e from match_rows)""")
def position_labels(spark, d):
    return read(spark, d, "match_rows").select("match_id", F.concat_ws(" ", T.position_label(T.extension("path")), "location").alias("position"))


@query(r"""select root_folder, coalesce(nullif(left(regexp_replace(regexp_extract(regexp_replace(root_folder, '[/\\]+$', ''), '([^/\\]*)$', 1), '[<>:"|?*]', '_', 'g'), 64), ''), 'root') folder_name from roots""")
def folder_names(spark, d):
    return read(spark, d, "roots").select("root_folder", T.safe_name("root_folder").alias("folder_name"))


@query("""select p.doc_id, r.root_folder from documents p join roots r on starts_with(p.path, r.root_folder || '/')""")
def scan_roots(spark, d):
    """A file below nested roots is found once for each root."""
    return discovery.files_under_roots(read(spark, d, "documents").select("doc_id", "path"), read(spark, d, "roots").select("root_folder")).select("doc_id", "root_folder")


@query("""select doc_id, max_by(r.root_folder, length(r.root_folder)) root_folder from documents p join roots r on starts_with(p.path, r.root_folder || '/') group by doc_id""")
def root_of_file(spark, d):
    return discovery.longest_root(read(spark, d, "documents").select("doc_id", "path"), read(spark, d, "roots").select("root_folder"), "doc_id")


@query(r"""select source, count(*) n from documents where regexp_full_match(path, '.*/[^/]*') and array_length(string_split(replace(path, source || '/', ''), '/')) = 1 and starts_with(path, source || '/') group by source""")
def flat_scan(spark, d):
    """Only the direct children of a root."""
    rest = F.substr(F.col("path"), F.length("source") + 2)
    direct = F.startswith("path", F.concat("source", F.lit("/"))) & ~F.contains(rest, F.lit("/"))
    return read(spark, d, "documents").filter(direct).groupBy("source").agg(F.count("*").alias("n"))


# Queries over units: each document is one unit

def units(spark, d, stemming=True):
    docs = read(spark, d, "documents")
    rows = docs.select("path", F.col("doc_id").alias("unit_ord"), F.col("source").alias("root_folder"), "text")
    return search.prepare_units(rows, stemming=stemming).filter("norm != ''").withColumn("doc_id", F.col("unit_ord"))


def _find(spark, d, text, stemming=False, **options):
    return search.search_units(units(spark, d, stemming), Query(text, stemming=stemming), **options)


def _scored(spark, d, text, stemming=False):
    return _find(spark, d, text, stemming).select(F.col("unit_ord").alias("doc_id"), F.round("relevance_score", 6).alias("relevance_score"))


def _boolean(name: str, text: str, condition: str, occurrences: str) -> None:
    def f(spark, d):
        return _scored(spark, d, text)

    f.__name__ = name
    query(S.matches(condition, occurrences))(f)


def _n(*parts: str) -> str:
    return f"len({S.leaf(*parts)})"


_boolean("term_exact", "pump", f"{_n('pump')} > 0", _n("pump"))
_boolean("wildcard_star", "val*", f"{_n('val*')} > 0", _n("val*"))
_boolean("wildcard_inner", "p*p", f"{_n('p*p')} > 0", _n("p*p"))
_boolean("wildcard_qmark", "p?mp", f"{_n('p?mp')} > 0", _n("p?mp"))
_boolean("phrase", '"for the pump"', f"{_n('for', 'the', 'pump')} > 0", _n("for", "the", "pump"))
_boolean("phrase_wildcard", '"the p*p ?f"', f"{_n('the', 'p*p', '?f')} > 0", _n("the", "p*p", "?f"))
_boolean("and_query", "pump AND valve", f"{_n('pump')} > 0 and {_n('valve')} > 0", f"{_n('pump')} + {_n('valve')}")
_boolean("or_query", "pump || accord", f"{_n('pump')} > 0 or {_n('accord')} > 0", f"{_n('pump')} + {_n('accord')}")
_boolean("not_query", "the NOT pump", f"{_n('the')} > 0 and not {_n('pump')} > 0", f"{_n('the')} + {_n('pump')}")
_boolean("implicit_and", "pump index", f"{_n('pump')} > 0 and {_n('index')} > 0", f"{_n('pump')} + {_n('index')}")
_boolean("grouped", "(pump or valve) AND !tile", f"({_n('pump')} > 0 or {_n('valve')} > 0) and not {_n('tile')} > 0", f"{_n('pump')} + {_n('valve')} + {_n('tile')}")
_boolean("precedence", "tile OR pump valve", f"{_n('tile')} > 0 or ({_n('pump')} > 0 and {_n('valve')} > 0)", f"{_n('tile')} + {_n('pump')} + {_n('valve')}")
_boolean("pure_not", "~the", f"not {_n('the')} > 0", _n("the"))
_boolean("repeated_leaf", "pump pump", f"{_n('pump')} > 0", f"2 * {_n('pump')}")
_boolean("accent_query", "ação", f"{_n('acao')} > 0", _n("acao"))
_boolean("near_terms", "pump NEAR/3 the", S.near(S.leaf("pump"), S.leaf("the"), 3), f"{_n('pump')} + {_n('the')}")
_boolean("near_default", "the NEAR/ pump", S.near(S.leaf("the"), S.leaf("pump"), 1), f"{_n('pump')} + {_n('the')}")
_boolean("near_wildcards", "val* NEAR/4 in*", S.near(S.leaf("val*"), S.leaf("in*"), 4), f"{_n('val*')} + {_n('in*')}")
_boolean("near_phrase", '"the pump" NEAR/2 valve', S.near(S.leaf("the", "pump"), S.leaf("valve"), 2, 2), f"{_n('the', 'pump')} + {_n('valve')}")
_boolean("near_grouped", "pump NEAR/2 (valve OR index)", f"({S.near(S.leaf('pump'), S.leaf('valve'), 2)} or {S.near(S.leaf('pump'), S.leaf('index'), 2)})", f"{_n('pump')} + {_n('valve')} + {_n('index')}")
_boolean("near_half_and", "(gutter AND the) NEAR/1 pump", f"({S.near(S.leaf('gutter'), S.leaf('pump'), 1)} or {S.near(S.leaf('the'), S.leaf('pump'), 1)})", f"{_n('gutter')} + {_n('the')} + {_n('pump')}")
_boolean("near_chained", "the NEAR/2 pump NEAR/3 valve", "false", "0")
_boolean("near_not", "NOT the NEAR/2 pump", "false", "0")
_boolean("unbalanced", "(pump AND valve", f"{_n('pump')} > 0 and {_n('valve')} > 0", f"{_n('pump')} + {_n('valve')}")


@query(f"""with recursive {S.UNITS}, v as (select distinct unnest(tk) t from u), {S.STEMS},
w as (select doc_id, unnest(tk) t from u), h as (select doc_id, count(*) n from w join stems using (t) where t = 'pumps' or stem = '{words.stem("pumps")}' group by doc_id)
select doc_id, {S.score("n")} relevance_score from u join h using (doc_id)""")
def term_stem(spark, d):
    return _scored(spark, d, "pumps", True)


@query(f"with {S.UNITS} select doc_id, {_n('pump')} hits from u where {_n('pump')} > 0")
def hit_count(spark, d):
    return _find(spark, d, "pump").select(F.col("unit_ord").alias("doc_id"), "hits")


_AT = S.first_word_at("valve")


@query(f"with {S.UNITS} select doc_id, {S.window('text', 's', 's + 5', 60)} context from (select *, {_AT} s from u where {_n('valve')} > 0)")
def snippet_first(spark, d):
    return _find(spark, d, "valve", context_size=60).select(F.col("unit_ord").alias("doc_id"), "context")


_OTHER = S.first_word_at("tile")


@query(f"""with {S.UNITS} select doc_id, case when {_n('valve')} > 0 then {S.window('norm', _AT, _AT + ' + 5', 40)} when {_n('tile')} > 0 then {S.window('norm', _OTHER, _OTHER + ' + 4', 40)} else left(norm, 40) end context
from u where {_n('valve')} > 0 or {_n('tile')} > 0""")
def snippet_complex(spark, d):
    return _find(spark, d, "valve OR tile", context_size=40).select(F.col("unit_ord").alias("doc_id"), "context")


@query(f"with {S.UNITS} select doc_id, left(norm, 50) context from u where not {_n('the')} > 0")
def snippet_head(spark, d):
    return _find(spark, d, "NOT the", context_size=50).select(F.col("unit_ord").alias("doc_id"), "context")


_ALL = rf"""with {S.UNITS}, p as (select doc_id, text, string_split_regex('#' || norm || '#', '\bvalve\b') ps from u where {_n('valve')} > 0),
h as (select doc_id, text, k, (list_sum(list_transform(ps[1:k], lambda x: length(x))) + 5 * (k - 1) - 1)::bigint s from p, unnest(range(1, len(ps))) t(k))
select doc_id, {S.window('text', 's', 's + 5', 30)} context from h"""


@query(_ALL)
def snippet_all_hits(spark, d):
    return _find(spark, d, "valve", context_size=30, occurrence_mode="all").select(F.col("unit_ord").alias("doc_id"), "context")


@query(_ALL + " where k <= 2")
def snippet_capped(spark, d):
    return _find(spark, d, "valve", context_size=30, occurrence_mode="all", max_snippets=2).select(F.col("unit_ord").alias("doc_id"), "context")


@query("select query_id, allowed, case when allowed then op end op from saved_queries")
def saved_query_plans(spark, d):
    """Which saved queries the index may narrow by term sets, and how."""
    return planning.plan_queries(read(spark, d, "saved_queries")).select("query_id", "allowed", F.when(F.col("allowed"), F.col("op")).alias("op"))


# The inverted index

_KEYED = f"""with recursive {S.UNITS}, v as (select distinct unnest(tk) t from u), {S.STEMS},
w as (select doc_id, path, source, unnest(tk) t, unnest(range(0, len(tk))) pos from u),
k as (select distinct doc_id, path, source, pos, unnest(case when stem <> t and stem <> '' then [t, stem] else [t] end) term from w join stems using (t)),
postings2 as (select term, path, doc_id unit_ord, list(pos order by pos) positions, source root_folder from k group by term, path, doc_id, source)
"""


@query(_KEYED + "select term, path, unit_ord, positions, root_folder from postings2")
def index_postings(spark, d):
    return index.build_postings(units(spark, d))


@query("select distinct path from postings where term in ('pump') intersect select distinct path from postings where term in ('valve')")
def index_lookup_and(spark, d):
    return index.lookup(read(spark, d, "postings"), ["pump", "valve"], "AND", stemming=False)


@query("select distinct path from postings where term in ('pump', 'accord')")
def index_lookup_or(spark, d):
    return index.lookup(read(spark, d, "postings"), ["pump", "accord"], "OR", stemming=False)


@query("select count(distinct term) n_terms, count(distinct path) n_docs, coalesce(sum(len(positions)), 0)::bigint n_postings, round(sum(len(positions)) / count(distinct path), 6) per_doc from postings where positions is not null")
def index_statistics(spark, d):
    return index.statistics(read(spark, d, "postings").filter("positions is not null"))


@query("""select distinct a.path, a.unit_ord from postings a join postings b on a.path = b.path and a.unit_ord = b.unit_ord
where a.term = 'pump' and b.term = 'the' and len(list_filter(a.positions, lambda p: len(list_filter(b.positions, lambda q: abs(p - q) - 1 <= 2)) > 0)) > 0""")
def index_near(spark, d):
    return index.near_by_postings(read(spark, d, "postings"), "pump", "the", 2)


@query(S.matches(f"{_n('for', 'the', 'pump')} > 0 or {_n('accord')} > 0", f"{_n('for', 'the', 'pump')} + {_n('accord')}"))
def index_path_search(spark, d):
    """A search over the units that the index leaves: equal to the scan."""
    u = materialize(units(spark, d), "units")
    q = Query('"for the pump" OR accord', stemming=False)
    left = index.prefilter(u, index.build_postings(u), q)
    found = search.search_units(left, q)
    return found.select(F.col("unit_ord").alias("doc_id"), F.round("relevance_score", 6).alias("relevance_score"))


@query("select doc_id from documents where path not in (select path from manifest where path is not null)")
def manifest_antijoin(spark, d):
    docs = read(spark, d, "documents").filter("path is not null")
    return docs.join(read(spark, d, "manifest"), "path", "left_anti").select("doc_id")


# Ranking

_BM25 = rf"""with {S.UNITS}, m as (select *, {S.score(f"{_n('pump')} + {_n('valve')}")} base from u where {_n('pump')} > 0 or {_n('valve')} > 0),
f as (select path, min(text) text from m group by path),
w as (select path, lower(text) t, list_filter(string_split_regex(lower(text), '[\s\x{{a0}}\x{{3000}}]+'), lambda x: x <> '') ws from f),
g as (select count(*) n, avg(greatest(1, len(ws))) avgdl, sum(contains(t, 'pump')::int) d0, sum(contains(t, 'valve')::int) d1 from w),
s as (select path, (ln((n - d0 + 0.5) / (d0 + 0.5) + 1) * t0 * 2.5 / (t0 + 1.5 * (0.25 + 0.75 * l / avgdl)) + ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * t1 * 2.5 / (t1 + 1.5 * (0.25 + 0.75 * l / avgdl))) bm25
  from (select path, len(ws) l, len(list_filter(ws, lambda x: x = 'pump')) t0, len(list_filter(ws, lambda x: x = 'valve')) t1 from w), g),
r as (select m.doc_id, m.path, m.source, m.norm, bm25 bm25_score, 0.5 * base + 0.5 * least(1, bm25 / (select max(bm25) from s)) relevance_score from m join s using (path))
"""


def _ranked(spark, d, **options):
    u = materialize(units(spark, d, False), "units")
    q = Query("pump OR valve", stemming=False)
    return search.rank(search.search_units(u, q, context_size=40), u.select("path", "text"), q, **options)


@query(_BM25 + "select doc_id, round(bm25_score, 4) bm25_score from r")
def bm25_scores(spark, d):
    return _ranked(spark, d).select(F.col("unit_ord").alias("doc_id"), F.round("bm25_score", 4).alias("bm25_score"))


@query(_BM25 + "select doc_id, round(relevance_score, 4) relevance_score from r")
def bm25_blend(spark, d):
    return _ranked(spark, d).select(F.col("unit_ord").alias("doc_id"), F.round("relevance_score", 4).alias("relevance_score"))


@query(_BM25 + "select doc_id from r where relevance_score >= 0.3")
def min_relevance(spark, d):
    return _ranked(spark, d, min_relevance=0.3).select(F.col("unit_ord").alias("doc_id"))


@query(_BM25 + "select row_number() over (order by round(relevance_score, 9) desc, path, doc_id)::bigint place, doc_id from r")
def ranked_results(spark, d):
    rows = _ranked(spark, d).withColumn("relevance_score", F.round("relevance_score", 9))
    numbered = search.number_rows(rows.select("relevance_score", "path", "unit_ord"), [F.desc("relevance_score"), F.asc("path"), F.asc("unit_ord")], "place")
    return numbered.select("place", F.col("unit_ord").alias("doc_id"))


# Shaping of results, over the rows that searches left

_ORDER = "relevance_score desc, path, unit_ord, root_folder nulls first, context nulls first, query nulls first"
_KEPT = f"k as (select * from (select *, row_number() over (partition by coalesce(context, ''), coalesce(query, '') order by {_ORDER}, match_id) n from match_rows) where n = 1)"


@query(f"with {_KEPT} select coalesce(context, '') context, coalesce(query, '') query, path, unit_ord from k")
def dedup_context(spark, d):
    kept = search.dedup_context(read(spark, d, "match_rows"))
    return kept.select(F.coalesce("context", F.lit("")).alias("context"), F.coalesce("query", F.lit("")).alias("query"), "path", "unit_ord")


@query("select path, max(relevance_score) best, count(*) n_matches, row_number() over (order by max(relevance_score) desc, path)::bigint file_no from match_rows group by path")
def file_rank(spark, d):
    return search.rank_files(read(spark, d, "match_rows"))


@query("select match_id, row_number() over (partition by path order by relevance_score desc, unit_ord, match_id)::bigint match_no from match_rows")
def match_rank(spark, d):
    rows = read(spark, d, "match_rows").select("match_id", "path", "unit_ord", "relevance_score")
    return search.number_rows(rows, [F.desc("relevance_score"), F.asc("unit_ord"), F.asc("match_id")], "match_no", "path").select("match_id", "match_no")


@query("""select root_folder, regexp_extract(root_folder, '([^/]*)$', 1) folder_name, count(*) n_matches, count(distinct path) n_files from match_rows group by root_folder""")
def per_folder_counts(spark, d):
    return search.per_folder(read(spark, d, "match_rows"))


@query("select match_id, ((row_number() over (order by relevance_score desc, match_id) - 1) // 500)::bigint + 1 part from match_rows")
def chunk_parts(spark, d):
    rows = search.number_rows(read(spark, d, "match_rows").select("match_id", "relevance_score"), [F.desc("relevance_score"), F.asc("match_id")], "row")
    return rows.select("match_id", (F.floor((F.col("row") - 1) / 500) + 1).cast("bigint").alias("part"))


@query(f"""with {_KEPT}, f as (select path, row_number() over (order by max(relevance_score) desc, path)::bigint file_no from k group by path)
select file_no, regexp_extract(path, '([^/]*)$', 1) filename, path full_path, row_number() over (partition by path order by {_ORDER})::bigint match_no, printf('%.4f', relevance_score) score from k join f using (path)""")
def report_table(spark, d):
    rows = read(spark, d, "match_rows")
    return search.report_rows(rows).select("file_no", "filename", "full_path", "match_no", "score")


# Readers, over the texts of files with their extensions

def _of_type(spark, d, *exts):
    return read(spark, d, "documents").filter(F.lower("ext").isin(*exts) & F.col("text").isNotNull()).select("doc_id", "text")


@query("""with c as (select doc_id, [length(h) - length(replace(h, x, '')) for x in [',', ';', chr(9), '|']] n from (select doc_id, left(text, 8192) h from documents where text is not null))
select doc_id, case when list_max(n) = 0 then ',' else [',', ';', chr(9), '|'][list_position(n, list_max(n))] end delimiter from c""")
def csv_delimiter(spark, d):
    return _texts(spark, d).select("doc_id", T.delimiter_of("text").alias("delimiter"))


# a cell is quoted, then perhaps followed by more, or goes up to the next delimiter or line end; both end with one
@query(r"""with c as (select doc_id, text, [length(h) - length(replace(h, x, '')) for x in [',', ';', chr(9), '|']] n from (select doc_id, text, left(text, 8192) h from documents where lower(ext) = 'csv' and text is not null)),
x as (select doc_id, text, case when list_max(n) = 0 then ',' else [',', ';', chr(9), '|'][list_position(n, list_max(n))] end x from c),
t as (select doc_id, x, regexp_extract_all(text || chr(10), '(?:"(?:[^"]|"")*"[^' || x || '\r\n]*|[^' || x || '\r\n]*)(?:[' || x || ']|\r?\n|\r)') ts from x),
e as (select doc_id, i, ts[i] w, x from t, unnest(range(1, len(ts) + 1)) u(i)),
r as (select doc_id, i, w, x, 1 + coalesce(sum((right(w, 1) <> x)::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) r from e),
q as (select doc_id, r, i - min(i) over (partition by doc_id, r) + 1 c, regexp_replace(w, '(' || case when x = '|' then '\|' else x end || '|\r?\n|\r)$', '') v from r),
f as (select doc_id, r, c, regexp_replace(case when starts_with(v, '"') then replace(regexp_replace(v, '^"((?:[^"]|"")*)"', '\1'), '""', '"') else v end, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g') v from q)
select doc_id, 'R' || r || ':C' || c "location", v text from f where v <> ''
union all select doc_id, 'R' || r, string_agg(v, ' | ' order by c) from f where v <> '' group by doc_id, r""")
def csv_cells_rows(spark, d):
    return reading.units_of_texts(_of_type(spark, d, "csv"), formats.csv_units).select("doc_id", "location", "text")


@query()
def markdown_blocks(spark, d):
    return reading.units_of_texts(_of_type(spark, d, "md"), lambda t: [(str(i), "block", b) for i, b in enumerate(formats.markdown_blocks(t), 1)])


@query()
def html_blocks(spark, d):
    page = F.concat(F.lit("<html><head><style>p {}</style></head><body><p>"), F.replace(T.html_escape("text"), F.lit("\n\n"), F.lit("</p>\n<p>")), F.lit("</p><script>var a = '</p>';</script></body></html>"))
    return reading.units_of_texts(_texts(spark, d).select("doc_id", page.alias("text")), formats.html_units)


@query(r"select doc_id, regexp_replace(regexp_replace(text, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g').trim() text from documents where lower(ext) in ('html', 'htm') and text is not null")
def html_strip(spark, d):
    return _of_type(spark, d, "html", "htm").select("doc_id", T.strip_tags("text").alias("text"))


@query("select event_id, 'k' || chr(10) || (props->>'k') text from events where props is not null")
def json_flatten(spark, d):
    rows = read(spark, d, "events").filter("props is not null").select("event_id", F.col("props").alias("text"))
    return reading.units_of_texts(rows, lambda t: [("1", "file", formats.json_text(t))], "event_id").select("event_id", "text")


@query()
def json_documents(spark, d):
    return reading.units_of_texts(_of_type(spark, d, "json", "jsonl"), lambda t: [("1", "file", formats.json_text(t))])


@query(r"""with l as (select doc_id, regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'), '\r\n|[\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g') t from documents where lower(ext) in ('ttl', 'nt') and text is not null)
select doc_id, coalesce(list_aggregate(list_filter(string_split(regexp_replace(t, '\n$', ''), chr(10)), lambda x: not regexp_matches(x, '^\s*#')), 'string_agg', chr(10)), '') text from l""")
def turtle_text(spark, d):
    return reading.units_of_texts(_of_type(spark, d, "ttl", "nt"), lambda t: [("1", "file", formats.turtle_text(t))]).select("doc_id", "text")


@query("""with r as (select n_nationkey, [n_nationkey::varchar, n_name, n_regionkey::varchar] c from nation)
select n_nationkey, 'C' || i "location", 'cell' unit_kind, c[i] text from r, unnest([1, 2, 3]) t(i) union all select n_nationkey, 'R', 'row', c[1] || ' | ' || c[2] || ' | ' || c[3] from r""")
def table_cells_rows(spark, d):
    return reading.table_units(read(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])


@query("""select o_orderkey, 2 n_hits from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'""")
def table_search(spark, d):
    """A phrase with a wildcard over the cells and rows of a table: a hit in the row, and one in its cell."""
    cells = reading.table_units(read(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    rows = cells.select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("unit_kind") == "row", 0).otherwise(1).alias("unit_ord"), "location", "unit_kind", "text")
    units = search.prepare_units(rows, stemming=False)
    hit = search.search_units(units, Query('"1 urg*"', stemming=False))
    both = search.search_units(units, Query('f "1 urg*"', stemming=False)).select("path")
    return hit.join(both, "path", "left_semi").groupBy("path").agg(F.count("*").cast("int").alias("n_hits")).select(F.col("path").cast("bigint").alias("o_orderkey"), "n_hits")


# Quality of page texts; the paragraphs of a document stand for its pages

_QUALITY = r"""q as (select doc_id, text, n, case when n > 0 then len(regexp_extract_all(text, '\p{L}')) / n else 0 end alpha, case when len(ws) > 0 then len(list_distinct(ws)) / len(ws) else 0 end uniq
from (select doc_id, text, length(text) n, regexp_extract_all(text, '[\p{L}\p{N}_]+') ws from documents where text is not null))"""


@query(f"with {_QUALITY} select doc_id, round(alpha, 6) alpha, round(uniq, 6) uniq, n < 60 or alpha < 0.15 or uniq < 0.10 garbage, n < 120 or alpha < 0.15 poor from q")
def text_quality(spark, d):
    return _texts(spark, d).select("doc_id", F.round(T.alpha_share("text"), 6).alias("alpha"), F.round(T.unique_share("text"), 6).alias("uniq"), T.is_garbage("text").alias("garbage"), T.is_poor("text").alias("poor"))


def _pages(spark, d):
    docs = _texts(spark, d)
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)


_PAGES = "pg as (select doc_id::varchar path, i page, ps[i] text from (select doc_id, string_split(text, chr(10) || chr(10)) ps from documents where text is not null), unnest(range(1, len(ps) + 1)) t(i))"


@query(rf"""with {_PAGES}, c as (select path, page, 0 k, text from pg union all select path, page, 1, regexp_replace(text, '\p{{Nd}}+', '', 'g') from pg),
s as (select *, coalesce(length(text), 0) n, len(regexp_extract_all(text, '\p{{L}}')) a, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') ws from c),
v as (select path, page, k, case when n > 0 then n * (0.7 * (a / n) + 0.3 * case when len(ws) > 0 then len(list_distinct(ws)) / len(ws) else 0 end) else 0 end score from s)
select path, page::int page, (arg_max(k, (round(score, 9), -k)))::int source_ord from v group by path, page""")
def best_candidates(spark, d):
    p = _pages(spark, d)
    both = p.select("path", "page", F.lit(0).alias("source_ord"), "text").unionByName(p.select("path", "page", F.lit(1).alias("source_ord"), F.regexp_replace("text", r"\p{Nd}+", "").alias("text")))
    return pages.best_candidate(both).select("path", "page", "source_ord")


@query(rf"""with {_PAGES}, l as (select path, page, list_filter([trim(x) for x in string_split(text, chr(10))], lambda x: x <> '') ls from pg),
e as (select path, unnest([ls[1], regexp_replace(ls[1], '\p{{Nd}}+', '#', 'g'), ls[-1], regexp_replace(ls[-1], '\p{{Nd}}+', '#', 'g')]) line, unnest([1, 1, 0, 0]) h from l where len(ls) > 0),
n as (select path, count(*) k from pg group by path having count(*) >= 3)
select path, line, sum(h) >= greatest(1, floor(0.7 * any_value(k))) is_header, sum(1 - h) >= greatest(1, floor(0.7 * any_value(k))) is_footer from e join n using (path) group by path, line
having sum(h) >= greatest(1, floor(0.7 * any_value(k))) or sum(1 - h) >= greatest(1, floor(0.7 * any_value(k)))""")
def header_footer_lines(spark, d):
    return pages.running_lines(_pages(spark, d))


@query()
def header_footer_stripped(spark, d):
    return pages.strip_running_lines(_pages(spark, d)).select("path", "page", "text")


@query(r"""with pg as (select path, i page, ps[i] text from (select path, string_split(min(text), chr(10) || chr(10)) ps from documents where text is not null and path is not null group by path), unnest(range(1, len(ps) + 1)) t(i)),
h as (select path, string_agg(text, chr(10) order by page) head from pg where page <= 2 group by path),
f as (select distinct path, lower(regexp_extract(path, '\.[^./]*$')) e from documents where path is not null)
select path from f left join h using (path) where e in ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp', '.gif', '.webp')
or e = '.pdf' and (length(trim(coalesce(head, ''))) < 120 or len(regexp_extract_all(trim(head), '\p{L}')) / length(trim(head)) < 0.15)""")
def ocr_candidates(spark, d):
    docs = read(spark, d, "documents").filter("path is not null")
    files = docs.select("path", T.extension("path").alias("ext")).distinct()
    texts = docs.filter("text is not null").groupBy("path").agg(F.min("text").alias("text"))
    paged = texts.select("path", F.posexplode(F.split("text", "\n\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return discovery.ocr_candidates(files, paged)


@query(_KEYED + "select term, count(*) n_units, sum(len(positions))::bigint n_positions from postings2 group by term")
def stream_index_upsert(spark, d):
    """The index that a stream of documents, every one delivered twice, has built in the end."""
    folder = new_path(spark, "stream-index")
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/documents.parquet").schema).parquet(_stream_source(d))
    rows = stream.select(F.concat_ws("#", "path", "doc_id").alias("path"), F.col("doc_id").alias("unit_ord"), F.col("source").alias("root_folder"), "modified", "text")
    for run in (1, 2):
        upsert.index_stream(rows, folder, f"{folder}/checkpoint-{run}").awaitTermination()
    found = upsert.current_postings(spark, folder)
    return found.groupBy("term").agg(F.count("*").alias("n_units"), F.sum(F.size("positions")).alias("n_positions"))


def _stream_source(d: str) -> str:
    """A pattern for the table's file or folder, as streams take no single file."""
    return f"{d}/documents.parque[t]"
