"""Units to matches: evaluation, ranking and the shaping of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..plans.compile import all_hits, base_score, compile_query, hit_count, snippet, window_at
from ..plans.scratch import fixed_columns, materialize, spread
from ..query.parser import Query


def prepare_units(df: DataFrame, accent_fold: bool = True, stemming: bool = True) -> DataFrame:
    """Raw units ``(path, unit_ord, location, unit_kind, root_folder, text)`` with ``norm``, ``tokens`` and ``stems``.

    Missing columns get defaults: unit 0, location '1', kind 'file', a null root. Null texts count as empty.
    Worth writing once: everything that follows stays in the JVM.
    """
    default = {"unit_ord": F.lit(0), "location": F.lit("1"), "unit_kind": F.lit("file"), "root_folder": F.lit(None).cast("string")}
    cols = [F.col(c) if c in df.columns else default[c].alias(c) for c in ("path", "unit_ord", "location", "unit_kind", "root_folder")]
    raw = spread(df.select(*cols, F.coalesce("text", F.lit("")).alias("text")))
    out = raw.withColumn("text", T.clean_extracted("text", accent_fold))
    out = fixed_columns(out.withColumn("norm", T.fold("text", accent_fold)), tokens=T.tokenize("norm"))
    return out.withColumn("stems", T.stems("tokens")) if stemming else out


def search_units(units: DataFrame, query: Query | str, context_size: int = 150, occurrence_mode: str = "page", max_snippets: int = 0, strict_near: bool = False) -> DataFrame:
    """``(path, unit_ord, location, unit_kind, root_folder, query, relevance_score, context, hits)`` of the units that match.

    ``occurrence_mode='all'`` gives simple queries one row for each hit, at most ``max_snippets`` for a unit (0: all).
    Empty texts never match, not even a query of NOT alone; an empty query matches nothing.
    """
    q = Query(query) if isinstance(query, str) else query
    plan = compile_query(q, strict_near)
    keep = ["path", "unit_ord", "location", "unit_kind", "root_folder"]
    cols = [*keep, "text", "norm", "tokens", *(["stems"] if q.stemming else [])]
    leaves = fixed_columns(units.select(*cols), **plan.leaves) if plan.leaves else units.select(*cols)
    found = leaves.filter(plan.matched).withColumn("relevance_score", base_score(plan.occurrences, F.col("tokens")))
    found = found.withColumns({"query": F.lit(q.original), "hits": hit_count(q)})
    out = [*keep, "query", "relevance_score", "context", "hits"]
    if occurrence_mode == "all" and q.is_simple and q.terms[0].core:
        spans = all_hits(q)
        spans = F.slice(spans, 1, max_snippets) if max_snippets else spans
        per_hit = found.select("*", F.explode_outer(spans).alias("hit"))
        at_hit = window_at(F.col("text"), F.col("hit.s"), F.col("hit.e"), context_size)
        return per_hit.withColumn("context", F.when(F.col("hit").isNull(), snippet(q, context_size)).otherwise(at_hit)).select(*out)
    return found.withColumn("context", snippet(q, context_size)).select(*out)


def file_bm25(matches: DataFrame, documents: DataFrame, query: Query, ranker: str = "compat", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(path, bm25_score)`` of the matched files, which are also the collection.

    The text of a file is its document, else the snippet of its first row. ``ranker='compat'``: a term counts
    where it equals a word cut at blanks, and is in a document that has it as a substring; ``'bm25'``: both by tokens.
    The collection's statistics are one row of numbers.
    """
    cores = query.ranking_cores
    first = matches.groupBy("path").agg(F.min_by("context", F.struct("unit_ord", "root_folder")).alias("snippet"))
    # a semi-join keeps the other documents out before anything is computed of their texts
    docs = documents.join(first.select("path"), "path", "left_semi").groupBy("path").agg(F.min("text").alias("doc"))
    texts = first.join(docs, "path", "left").select("path", F.lower(F.when(F.col("doc") != "", F.col("doc")).otherwise(F.coalesce("snippet", F.lit("")))).alias("t"))
    if ranker == "compat":
        ws = F.filter(F.split("t", T.SPACE + "+"), lambda w: w != "")
        inside = lambda c: F.contains("t", F.lit(c))
    else:
        ws = T.tokenize("t")
        inside = lambda c: F.array_contains("ws", c)
    counts = texts.select("path", "t", ws.alias("ws"))
    n = F.size("ws")
    count_of = lambda c: F.size(F.filter("ws", lambda w: w == F.lit(c)))
    tfs = [count_of(c).alias(f"tf{i}") for i, c in enumerate(cores)]
    ins = [inside(c).cast("int").alias(f"in{i}") for i, c in enumerate(cores)]
    counts = materialize(counts.select("path", n.alias("n"), *tfs, *ins), "bm25")
    stats = counts.agg(F.count("*").alias("N"), F.avg(F.greatest("n", F.lit(1))).alias("avg"), *[F.sum(f"in{i}").alias(f"df{i}") for i in range(len(cores))]).first()
    total = F.lit(0.0)
    for i in range(len(cores)):
        df = stats[f"df{i}"] or 0
        idf = F.log(F.lit((stats["N"] - df + 0.5) / (df + 0.5) + 1.0))
        tf = F.col(f"tf{i}")
        total = total + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / (stats["avg"] or 1.0)))
    return counts.select("path", total.alias("bm25_score"))


def rank(matches: DataFrame, documents: DataFrame, query: Query | str, min_relevance: float = 0.0, ranker: str = "compat") -> DataFrame:
    """Matches with ``bm25_score`` and the blended ``relevance_score``, those of at least ``min_relevance``.

    Half the base score, half the file's BM25 by the greatest of all. With fewer than two rows, or no term to
    rank by, scores stay as they are and ``bm25_score`` is null. Order by :func:`result_order`.
    """
    q = Query(query) if isinstance(query, str) else query
    matches = materialize(matches, "matches")
    if q.ranking_cores and matches.limit(2).count() > 1:
        scores = file_bm25(matches, documents, q, ranker)
        top = scores.agg(F.max("bm25_score")).first()[0] or 0.0
        top = top if top > 0 else 1.0
        out = matches.join(scores, "path", "left")
        blend = 0.5 * F.col("relevance_score") + 0.5 * F.least(F.lit(1.0), F.coalesce("bm25_score", F.lit(0.0)) / top)
        out = out.withColumn("relevance_score", blend)
    else:
        out = matches.withColumn("bm25_score", F.lit(None).cast("double"))
    return out.filter(F.col("relevance_score") >= min_relevance) if min_relevance > 0 else out


def result_order() -> list:
    return [F.desc("relevance_score"), F.asc("path"), F.asc("unit_ord"), F.asc("root_folder"), F.asc("context"), F.asc("query")]


# Shaping


def dedup_context(matches: DataFrame) -> DataFrame:
    """One row of those with equal context and query (across files): the best ranked. Null contexts count as ''.

    A grouping with its minimum taken on the map side, as rows without context may be one large group.
    """
    order = [F.coalesce(-F.col("relevance_score"), F.lit(float("inf"))).alias("_0"), *[F.col(c) for c in ("path", "unit_ord", "root_folder", "context")]]
    row = F.struct(*[matches[c] for c in matches.columns]).alias("row")
    best = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], row)).alias("best")
    keys = [F.coalesce("context", F.lit("")).alias("_c"), F.coalesce("query", F.lit("")).alias("_q")]
    return matches.groupBy(*keys).agg(best).select("best.row.*")


def rank_files(matches: DataFrame) -> DataFrame:
    """``(path, best, n_matches, file_no)``: files by their best score, numbered from 1.

    The numbering sorts one row for each file by range, and adds the sizes of the ranges before; no task gets all files.
    """
    files = matches.groupBy("path").agg(F.max("relevance_score").alias("best"), F.count("*").alias("n_matches"))
    return number_rows(files, [F.desc("best"), F.asc("path")], "file_no")


def number_rows(df: DataFrame, order: list, name: str, within: str | None = None) -> DataFrame:
    """Rows numbered from 1 in a total order, over all or ``within`` each value of a column.

    Distributed even if one value holds most rows: sorted by range, numbered within each range, and moved by the
    sizes of the ranges before, of which there are as many as shuffle partitions (for each value that spans several).
    """
    group = F.col(within) if within else F.lit(0)
    ranged = df.withColumn("_group", group)
    ranged = materialize(ranged.repartitionByRange(F.col("_group"), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_group", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_group", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part", "_group").orderBy(*order))
    numbered = ranged.withColumn(name, local).join(sizes.withColumnsRenamed({"_group": "_g", "_part": "_p"}), F.col("_part").eqNullSafe(F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    return numbered.withColumn(name, F.col(name) + F.col("_before")).drop("_group", "_part", "_g", "_p", "_before")


def report_rows(matches: DataFrame, dedup: bool = True) -> DataFrame:
    """Rows of a report: files by best score, matches within a file by score, both numbered from 1."""
    kept = dedup_context(matches) if dedup else matches
    kept = materialize(kept, "report")
    rows = number_rows(kept, result_order(), "match_no", "path").join(rank_files(kept).select("path", "file_no"), "path")
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    folder = F.regexp_replace("path", r"[/\\]?[^/\\]*$", "")
    label = F.concat_ws(" ", T.position_label(T.extension("path")), "location")
    return rows.select("file_no", name.alias("filename"), folder.alias("directory"), F.col("path").alias("full_path"), F.col("match_no").cast("bigint").alias("match_no"), F.format_number("relevance_score", 4).alias("score"), label.alias("position"), "query", "context", "root_folder")


def per_folder(matches: DataFrame) -> DataFrame:
    """``(root_folder, folder_name, n_matches, n_files)``: what each output of a report split by root holds."""
    out = matches.groupBy("root_folder").agg(F.count("*").alias("n_matches"), F.countDistinct("path").alias("n_files"))
    return out.select("root_folder", T.safe_name("root_folder").alias("folder_name"), "n_matches", "n_files")


def assign_chunks(matches: DataFrame, size: int) -> DataFrame:
    """Matches in rank order cut into parts of ``size`` rows; ``part`` counts from 1."""
    rows = number_rows(matches, result_order(), "_row")
    return rows.withColumn("part", F.floor((F.col("_row") - 1) / size).cast("bigint") + 1).drop("_row")

