"""The queries of this subpackage and the SQL that tells their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import distinctive, encoding, frequency, lookalike, packing, scans, spans, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair_fields(_read(spark, d, "match_rows"), encoding.fit_on(_read(spark, d, "documents")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_repaired(spark, d).select("match_id", "field")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(_read(spark, d, "postings")).select("path", "term")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    s = distinctive.term_scores(_read(spark, d, "postings"))
    return s.select("path", "term", "tf", "df", "file_len", F.round("score", 6).alias("score"))


def p2_beside(spark: SparkSession, d: str) -> DataFrame:
    rows = distinctive.beside_relevance(_read(spark, d, "match_rows"), _read(spark, d, "postings"))
    return rows.select("match_id", "relevance_score", "n_terms", F.round("distinct_score", 5).alias("distinct_score"))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    rows, docs = _read(spark, d, "match_rows"), _read(spark, d, "documents")
    return scans.restore_fields(rows, *scans.fit_on(docs, rows))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_restored(spark, d).select("match_id", "field")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(_read(spark, d, "postings")).filter("mark is not null").select("term", "mark")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(_read(spark, d, "postings"))


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "match_rows")
    return lookalike.unify_fields(rows, lookalike.fit_on(rows), encoding.fit_on(_read(spark, d, "documents")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_unified(spark, d).select("match_id", "field")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_read(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids, compared with the texts: a length and an equality for each document."""
    docs = _read(spark, d, "documents")
    back = tokens.decode_ids(tokens.encode_corpus(docs)).withColumnRenamed("text", "back")
    same = F.coalesce("text", F.lit("")) == F.col("back")
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", F.length("back").cast("bigint").alias("n_chars"), same.alias("same"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_read(spark, d, "documents"), _read(spark, d, "pack_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and share of room used for each capacity."""
    packed = p8_pack(spark, d).groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    specs = _read(spark, d, "pack_specs")
    sums = packed.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    fill = F.round(F.col("n_tokens") / (F.col("containers") * F.col("capacity_tokens")), 4)
    return sums.join(specs, "spec_id").select("spec_id", "capacity_tokens", "containers", "n_tokens", "fullest", fill.alias("fill"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_read(spark, d, "documents"))


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    return spans.shared_share(docs, spans.shared_spans(docs))


def p9_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return spans.repeated_paragraphs(_read(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_scores, p2_beside, p4_found, p4_restored, p5_found, p5_frequencies, p6_found, p6_unified, p7_ids, p7_roundtrip, p8_pack, p8_fill, p9_found, p9_share, p9_paragraphs)}

_COUNTED = """unit as (select lower(trim(term)) term, path, unit_ord, max(len(positions)) n from postings
  where trim(term) <> '' and positions is not null and path is not null group by all),
tf as (select term, path, sum(n)::bigint tf from unit group by all),
df as (select term, count(*) df from tf group by term)"""

_SCORED = f"""{_COUNTED},
files as (select path, sum(tf)::bigint file_len from tf group by path),
whole as (select count(*) n, avg(file_len) average from files),
scored as (select path, term, tf, df, file_len, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * file_len / average)) score
from tf join df using (term) join files using (path), whole)"""

_SCORES = f"with {_SCORED} select path, term, tf, df, file_len, round(score, 6) score from scored"

_WORDS = r"list_filter(list_distinct(regexp_extract_all(lower(coalesce(query, '')), '\p{L}+')), lambda w: w not in ('and', 'or', 'not', 'near'))"

_BESIDE = f"""with {_SCORED},
m as (select match_id, relevance_score, path, {_WORDS} words from match_rows),
w as (select match_id, path, unnest(words) term from m),
t as (select match_id, sum(score) x from w join scored using (path, term) group by match_id)
select match_id, relevance_score, len(words) n_terms, round(coalesce(x, 0), 5) distinct_score from m left join t using (match_id)"""

_FREQ = f"""with {_COUNTED},
whole as (select count(distinct path) n from tf),
s as (select term, sum(tf)::bigint occurrences, count(*) files from tf group by term)
select term, occurrences, files, n n_files, case when files = 1 then 'rare' when files > 0.2 * n then 'common' end mark from s, whole"""

SQL: dict[str, str] = {
    "p2_found": f"with {_COUNTED} select path, term from tf join df using (term) where tf >= 4 and df <= 5",
    "p2_scores": _SCORES,
    "p2_beside": _BESIDE,
    "p5_found": f"select term, mark from ({_FREQ}) where mark is not null",
    "p5_frequencies": _FREQ,
    "p7_roundtrip": "select doc_id, coalesce(length(text), 0) n_chars, true same from documents",
    "p9_paragraphs": r"""with u as (select doc_id, unnest(range(1, len(ps) + 1)) i, ps from (select doc_id, string_split(text, chr(10) || chr(10)) ps from documents where text is not null)),
p as (select doc_id, ps[i] part, coalesce(list_sum(list_transform(ps[1:i-1], lambda x: length(x) + 2)), 0)::bigint unit_start from u),
n as (select doc_id, unit_start, length(part) n, sha256(lower(trim(regexp_replace(part, '\s+', ' ', 'g')))) digest from p where length(part) >= 200),
k as (select digest, min((doc_id, unit_start)) keep, count(*) m from n group by digest)
select doc_id, unit_start, unit_start + n unit_end, keep[1] keeper_doc, keep[2] keeper_start from n join k using (digest)
where m > 1 and (keep[1] <> doc_id or keep[2] <> unit_start)""",
}
