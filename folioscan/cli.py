"""python -m folioscan.cli QUERY DIR... : search folders and write a report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .api import DEFAULT_TYPES, search_files
from .sinks.reports import FORMATS, write_chunks, write_per_folder, write_report

_ALIASES = {"epub": "ebook", "fb2": "ebook", "rdf": "ttl", "owl": "ttl", "nt": "ttl", "n3": "ttl", "jsonl": "json", "xlsx": "excel", "xls": "excel", "htm": "html", "log": "txt"}


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscan", description=__doc__)
    p.add_argument("query")
    p.add_argument("directories", nargs="+")
    p.add_argument("--types", default="txt,pdf,docx,html,image", help=f"comma-separated, of {', '.join(DEFAULT_TYPES)} or their extensions")
    p.add_argument("--output", default="results.html")
    p.add_argument("--format", choices=sorted(FORMATS))
    p.add_argument("--min-relevance", type=float, default=0.1)
    p.add_argument("--context-size", type=int, default=150)
    p.add_argument("--no-subfolders", action="store_true")
    p.add_argument("--no-stemming", action="store_true")
    p.add_argument("--keep-accents", action="store_true")
    p.add_argument("--all-occurrences", action="store_true")
    p.add_argument("--max-snippets", type=int, default=0)
    p.add_argument("--index", help="folder of a stored index, which is brought up to date and searched")
    p.add_argument("--ocr", choices=("auto", "always", "never"), default="auto")
    p.add_argument("--max-ocr-pages", type=int, default=150)
    p.add_argument("--per-folder", action="store_true", help="one part for each root folder")
    p.add_argument("--chunk", type=int, default=0, help="rows for each part")
    p.add_argument("--file-timeout", type=float, default=0)
    return p


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("folioscan").getOrCreate()
    types = {_ALIASES.get(t, t) for t in a.types.split(",") if t}
    found = search_files(
        spark, a.directories, a.query, types, include_subfolders=not a.no_subfolders, min_relevance=a.min_relevance, context_size=a.context_size, occurrence_mode="all" if a.all_occurrences else "page",
        max_snippets=a.max_snippets, index_folder=a.index, ocr_mode=a.ocr, max_ocr_pages=a.max_ocr_pages, use_stemming=not a.no_stemming, accent_fold=not a.keep_accents, file_timeout=a.file_timeout,
    )
    for w in found.warnings:
        print("warning:", w)
    if a.per_folder:
        write_per_folder(found.matches, a.output)
    elif a.chunk:
        write_chunks(found.matches, a.output, a.chunk)
    else:
        write_report(found.matches, a.output, a.format)
    print(f"{found.matches.count()} matches, {found.skipped.count()} files skipped: {a.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
