"""The inverted index: postings at the level of units, lookups, statistics and the sound prefilter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import index_keys, stem
from ..query.parser import Op, Query, Term, is_wildcard


def build_postings(units: DataFrame, stemming: bool = True) -> DataFrame:
    """``(term, path, unit_ord, positions, root_folder)`` of units with ``tokens`` (and ``stems``).

    A word stands under itself and, if that differs, its stem. Positions ascend, each once. Units without words give none.
    """
    # a unit is one row, so its words are complete there: they are grouped batch by batch, without a shuffle
    cols = ["path", "unit_ord", "root_folder", "tokens", *(["stems"] if stemming else [])]
    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    return units.select(*cols).mapInArrow(_postings_of_units, f"term string, path {kinds['path']}, unit_ord {kinds['unit_ord']}, positions array<int>, root_folder {kinds['root_folder']}")


#: Units whose words are grouped at once; a unit gives about a hundred rows, so this bounds a task's memory.
UNITS_AT_ONCE = 500


def _postings_of_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, UNITS_AT_ONCE) for b in batches for k in range(0, b.num_rows, UNITS_AT_ONCE)):
        tokens = batch.column(3)
        sizes = tokens.value_lengths().fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        words = tokens.flatten()
        if batch.num_columns > 4:  # a stem stands beside its word where it differs and is not empty
            stems = batch.column(4).flatten()
            other = pc.fill_null(pc.and_(pc.not_equal(stems, words), pc.not_equal(stems, "")), False)
            extra = np.flatnonzero(other.to_numpy(zero_copy_only=False))
            words = pa.concat_arrays([words, stems.take(pa.array(extra))])
            row, pos = np.concatenate([row, row[extra]]), np.concatenate([pos, pos[extra]])
        if not len(row):
            continue
        coded = words.dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((pos, term, row))
        row, term, pos = row[order], term[order], pos[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        begin = np.flatnonzero(new)
        positions = pa.ListArray.from_arrays(pa.array([*begin, len(row)], pa.int32()), pa.array(pos, pa.int32()))
        unit = pa.array(row[begin])
        yield pa.record_batch([coded.dictionary.take(pa.array(term[begin])), batch.column(0).take(unit), batch.column(1).take(unit), positions, batch.column(2).take(unit)], names=["term", "path", "unit_ord", "positions", "root_folder"])


def write_postings(postings: DataFrame, folder: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Parquet partitioned by a hash of the term, so that a lookup reads one folder of ``buckets`` for each term."""
    rows = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # a hot bucket is spread over several files by the path
    rows.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(4))).sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(folder)


def read_postings(spark, folder: str, terms: list[str] | None = None, buckets: int = 64) -> DataFrame:
    df = spark.read.parquet(folder)
    if terms is None:
        return df
    return df.filter(F.col("bucket").isin(bucket_numbers(spark, terms, buckets)) & F.col("term").isin(terms))


def bucket_numbers(spark, terms: list[str], buckets: int = 64) -> list[int]:
    """The buckets that hold these terms, all hashed in one select."""
    if not terms:
        return []
    row = spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms])).first()
    return sorted(set(row[0]))


def lookup_keys(term: str, accent_fold: bool = True, stemming: bool = True) -> list[str]:
    """Index keys of a query term: none for a pattern, else the word and its stem."""
    core = term.strip().strip('"').strip("'")
    if not core or is_wildcard(core):
        return []
    keys = index_keys(core, accent_fold, stemming)
    if stemming and stem(core) not in keys and stem(core):
        keys.append(stem(core))
    return keys


def lookup(postings: DataFrame, terms: list[str], operator: str = "AND", accent_fold: bool = True, stemming: bool = True) -> DataFrame:
    """``(path)``: files with all (AND) or any (OR) of the terms; a term is found under any of its keys.

    An unknown term is an empty set; patterns have no keys and are such. No terms: no files. One scan of the postings
    of all keys, one grouping.
    """
    sets = [lookup_keys(t, accent_fold, stemming) for t in terms if t]
    flat = sorted({k for keys in sets for k in keys})
    if not sets or not flat or (operator.upper() == "AND" and not all(sets)):
        return postings.select("path").limit(0)
    hits = postings.filter(F.col("term").isin(flat))
    if operator.upper() == "OR":
        return hits.select("path").distinct()
    has = [F.max(F.col("term").isin(keys).cast("int")).alias(f"t{i}") for i, keys in enumerate(sets)]
    return hits.groupBy("path").agg(*has).filter(reduce(lambda a, b: a & b, [F.col(f"t{i}") == 1 for i in range(len(sets))])).select("path")


def statistics(postings: DataFrame) -> DataFrame:
    """One row: terms, documents, postings (positions), postings per document. All 0 for an empty index."""
    out = postings.agg(F.countDistinct("term").alias("n_terms"), F.countDistinct("path").alias("n_docs"), F.coalesce(F.sum(F.size("positions")), F.lit(0)).cast("bigint").alias("n_postings"))
    return out.withColumn("per_doc", F.round(F.when(F.col("n_docs") > 0, F.col("n_postings") / F.col("n_docs")).otherwise(F.lit(0.0)), 6))


def candidate_units(postings: DataFrame | Callable[[list[str]], DataFrame], query: Query | str, accent_fold: bool = True, stemming: bool = True) -> DataFrame | None:
    """``(path, unit_ord)`` that may match, a superset; None where the index can't narrow (NOT, patterns).

    ``postings`` may be a function that gives those of a list of terms. A phrase needs all its words. NEAR needs a span on both sides, and a span of an AND is one of either operand.
    """
    q = Query(query, accent_fold, stemming) if isinstance(query, str) else query
    of = postings if callable(postings) else lambda terms: postings.filter(F.col("term").isin(terms))
    if q.tree is None:
        return of([]).select("path", "unit_ord").limit(0)

    groups: list[list[str]] = []

    def need(keys: list[str]) -> str:
        groups.append(keys)
        return f"g{len(groups) - 1}"

    def word(part: str):
        return need(lookup_keys(part, accent_fold, stemming)) if not is_wildcard(part) else None

    def both(parts: list):
        known = [p for p in parts if p is not None]
        return "(" + " and ".join(known) + ")" if known else None

    def either(parts: list):
        return None if any(p is None for p in parts) else "(" + " or ".join(parts) + ")"

    def spans(node) -> str | None:
        """Condition for the node to have any span."""
        if isinstance(node, Term):
            return both([word(p) for p in node.parts]) if node.parts else "false"
        if isinstance(node, Op) and node.name in ("AND", "OR"):
            return either([spans(a) for a in node.args])
        return "false"

    def truth(node) -> str | None:
        if node is None:
            return "false"
        if isinstance(node, Term):
            return spans(node)
        if node.name == "NOT":
            return None
        if node.name == "NEAR":
            return both([spans(a) for a in node.args])
        return (both if node.name == "AND" else either)([truth(a) for a in node.args])

    condition = truth(q.tree)
    if condition is None:
        return None
    flat = sorted({k for g in groups for k in g})
    hits = of(flat).groupBy("path", "unit_ord")
    flags = [F.max(F.col("term").isin(g).cast("int")) == 1 for g in groups]
    if not flags:
        return of([]).select("path", "unit_ord").limit(0)
    return hits.agg(*[f.alias(f"g{i}") for i, f in enumerate(flags)]).filter(condition).select("path", "unit_ord")


def prefilter(units: DataFrame, postings: DataFrame, query: Query | str) -> DataFrame:
    """Units that may match: a left-semi join with :func:`candidate_units`; all of them where the index can't narrow."""
    found = candidate_units(postings, query)
    return units if found is None else units.join(found, ["path", "unit_ord"], "left_semi")


def near_by_postings(postings: DataFrame, left: str, right: str, distance: int) -> DataFrame:
    """``(path, unit_ord)`` with the two words at most ``distance`` words apart, from positions alone.

    An equi-join on the unit; the range test runs over the two position lists of the row.
    """
    a = postings.filter(F.col("term").isin(lookup_keys(left))).select("path", "unit_ord", F.col("positions").alias("p"))
    b = postings.filter(F.col("term").isin(lookup_keys(right))).select("path", "unit_ord", F.col("positions").alias("q"))
    close = F.exists("p", lambda x: F.exists("q", lambda y: F.abs(x - y) - 1 <= distance))
    return a.join(b, ["path", "unit_ord"]).filter(close).select("path", "unit_ord").distinct()


def remove_paths(postings: DataFrame, paths: DataFrame) -> DataFrame:
    return postings.join(paths.select("path"), "path", "left_anti")


def update_paths(postings: DataFrame, new: DataFrame) -> DataFrame:
    """Postings with those of the files in ``new`` in the place of the old ones."""
    return remove_paths(postings, new.select("path").distinct()).unionByName(new)
