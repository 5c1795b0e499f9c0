"""Searching folders from end to end: scan, read, index or not, evaluate, rank, filter."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions.text import clean_extracted
from .operators import pages, search
from .operators.store import IndexStore
from .plans.scratch import materialize
from .query.parser import Query
from .shipping import ship
from .sources import discovery, reading

DEFAULT_TYPES = ("txt", "md", "csv", "docx", "html", "excel", "pdf", "image", "json", "ttl", "ebook")


@dataclass
class SearchResult:
    """Matches in no order (see ``ordered``), files that couldn't be read, and warnings about the query."""

    matches: DataFrame
    skipped: DataFrame
    warnings: list[str]

    @property
    def ordered(self) -> DataFrame:
        return self.matches.orderBy(*search.result_order())


def search_files(
    spark: SparkSession, directories: str | Iterable[str], query: str, types: Iterable[str] = DEFAULT_TYPES, *, include_subfolders: bool = True, min_relevance: float = 0.1,
    context_size: int = 150, occurrence_mode: str = "page", max_snippets: int = 0, index_folder: str | None = None, use_stemming: bool = True, accent_fold: bool = True,
    skip_paths: DataFrame | None = None, plugins: Mapping[str, Callable] | None = None, file_timeout: float = 0, ranker: str = "compat", strict_near: bool = False,
    ocr_mode: str = "auto", max_ocr_pages: int = 150, recognize: Callable[[bytes, int], str] | None = None,
) -> SearchResult:
    """Boolean search over the files below ``directories``.

    With ``index_folder`` the stored index there is brought up to date (only new and changed files are opened), narrows
    the units by the query's terms and gives them ready for evaluation; the result is the same.

    ``ocr_mode`` ('auto', 'always', 'never') and ``max_ocr_pages`` decide which pages go to ``recognize``, a function of a
    file's bytes and a page number; see :func:`.operators.pages.page_units`, which PDFs read by a plugin go through.
    """
    ship(spark)
    q = Query(query, accent_fold, use_stemming)
    roots = [directories] if isinstance(directories, str) else list(directories)
    plugins = {ext: pages.page_reader(f, ocr_mode, max_ocr_pages, recognize) if ext == ".pdf" else f for ext, f in (plugins or {}).items()}
    files = discovery.scan(spark, roots, types, include_subfolders, content=False)
    if skip_paths is not None:
        files = discovery.skip(files, skip_paths)
    if index_folder:
        store = IndexStore(spark, index_folder, accent_fold, use_stemming)
        store.refresh(files, plugins, file_timeout)
        # the index may hold more than this search asks for
        units = store.candidates(q).join(files.select("path", "root_folder"), ["path", "root_folder"], "left_semi")
        skipped = store.skipped().join(files.select("path"), "path", "left_semi")
    else:
        raw = materialize(reading.read_units(reading.fetch(files), plugins, file_timeout), "raw-units")
        units = search.prepare_units(raw.filter("text is not null"), accent_fold, use_stemming)
        skipped = reading.skipped(raw)
    matches = materialize(search.search_units(units, q, context_size, occurrence_mode, max_snippets, strict_near), "found")
    # which files matched is known before any is opened again
    matched = files.select("path", "ext", "root_folder").dropDuplicates(["path"]).join(matches.select("path").distinct(), "path", "left_semi")
    documents = reading.read_documents(reading.fetch(matched)).select("path", clean_extracted("text", accent_fold).alias("text"))
    return SearchResult(search.rank(matches, documents, q, min_relevance, ranker), skipped, q.warnings)


def write_index(spark: SparkSession, directories: Iterable[str], folder: str, types: Iterable[str] = DEFAULT_TYPES, use_stemming: bool = True, accent_fold: bool = True, plugins: Mapping[str, Callable] | None = None) -> DataFrame:
    """Bring the stored index of folders up to date, as a search with ``index_folder`` does; returns its statistics."""
    ship(spark)
    store = IndexStore(spark, folder, accent_fold, use_stemming)
    store.refresh(discovery.scan(spark, directories, types, content=False), plugins)
    return store.statistics()


def clear_index(spark: SparkSession, folder: str, use_stemming: bool = True, accent_fold: bool = True) -> None:
    IndexStore(spark, folder, accent_fold, use_stemming).clear()
