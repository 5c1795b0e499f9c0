"""Problem 2: how much a term sets a file apart from the whole index (probabilistic relevance weighting)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .postings import term_file_counts

K1, B = 1.2, 0.75


def term_scores(postings: DataFrame, k1: float = K1, b: float = B, least_tf: int = 0) -> DataFrame:
    """``(path, term, tf, df, n_files, file_len, average_len, score)`` of every term of every file.

    ``score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * file_len / average file_len))`` with
    ``idf = ln(1 + (n_files - df + 0.5) / (df + 0.5))``. All statistics cover the whole table; which rows
    count is told in :mod:`.postings`. A file whose counted positions are all empty has ``tf`` 0 and score 0.
    An empty table gives no rows. Rows of fewer than ``least_tf`` occurrences are left out, though they count in
    all statistics.

    The counts per (term, path) are written once; document frequencies and file lengths come from it by
    pre-aggregated groupings, and the two joins are left to Spark: sort-merge joins whose hot keys
    adaptive execution splits, or broadcasts of a side whose size Spark has measured.
    """
    tf = materialize(term_file_counts(postings), "term-file-counts")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    lengths = tf.groupBy("path").agg(F.sum("tf").alias("file_len"))
    whole = lengths.agg(F.count("*"), F.avg("file_len")).first()
    n_files, average = whole[0], whole[1] or 1.0
    n = F.lit(n_files).cast("bigint")
    rows = tf.filter(F.col("tf") >= least_tf).join(df, "term").join(lengths, "path")
    score = F.coalesce(idf(n, F.col("df")) * weight(F.col("tf"), F.col("file_len") / average, k1, b), F.lit(0.0))
    return rows.select("path", "term", "tf", "df", n.alias("n_files"), "file_len", F.lit(float(average)).alias("average_len"), score.alias("score"))


def idf(n_files: Column, df: Column) -> Column:
    """What a term in ``df`` of the files weighs: the fewer, the more."""
    return F.log(1 + (n_files - df + 0.5) / (df + 0.5))


def weight(tf: Column, length: Column, k1: float, b: float) -> Column:
    """How far ``tf`` occurrences count in a file of ``length`` average files: more and more slowly, less in a long file."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))


def distinctive_terms(postings: DataFrame, least_tf: int = 4, most_files: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """The terms of each file that its score sets apart: rows of :func:`term_scores` with at least the score that
    ``least_tf`` occurrences of a term of ``most_files`` files would have in that file, counted for each file and term
    so that neither part makes up for the other: the term must weigh as much as one in ``most_files`` files, and its
    score be that of ``least_tf`` occurrences or more. Both weights only fall or rise with their counts, so these are
    the terms of at least ``least_tf`` occurrences in at most ``most_files`` files; rows with fewer, whose score can't
    reach that bound, are left out before the joins.
    """
    rows = term_scores(postings, k1, b, least_tf)
    n, own = F.col("n_files"), idf(F.col("n_files"), F.col("df"))
    least = own * weight(F.lit(least_tf).cast("bigint"), F.col("file_len") / F.col("average_len"), k1, b)
    return rows.filter((own >= idf(n, F.lit(most_files).cast("bigint"))) & (F.col("score") >= least))


def beside_relevance(rows: DataFrame, postings: DataFrame) -> DataFrame:
    """``(match_id, relevance_score, n_terms, distinct_score)``: how characteristic the words of a match's query are of its file.

    The sum of the scores of the query's words (letters, lower-cased, each once, AND, OR, NOT and NEAR left out) in
    the file; 0 for words it hasn't. Rows with a null path or query keep 0. One row for each row of ``rows``.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1)))
    words = F.filter(words, lambda w: ~w.isin("and", "or", "not", "near"))
    asked = rows.select("match_id", "relevance_score", "path", words.alias("words"))
    # few (path, word) pairs however many rows ask for them: scored once each, and taken back by the pair
    each = asked.select("match_id", "path", F.explode("words").alias("term"))
    pairs = each.select("path", "term").distinct()
    scored = pairs.join(term_scores(postings).select("path", "term", "score"), ["path", "term"])
    sums = each.join(scored, ["path", "term"]).groupBy("match_id").agg(F.sum("score").alias("s"))
    out = asked.join(sums, "match_id", "left")
    return out.select("match_id", "relevance_score", F.size("words").cast("bigint").alias("n_terms"), F.coalesce("s", F.lit(0.0)).alias("distinct_score"))
