"""Writing results: tables by Spark, readable reports row by row from the driver without holding them."""

from __future__ import annotations

import html
import re
import textwrap
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..functions.words import strip_accents
from ..operators.search import assign_chunks, report_rows
from ..query.parser import Query, Term

COLUMNS = ["file_no", "filename", "directory", "full_path", "match_no", "score", "position", "query", "context"]
#: Colours of highlighted terms, in turn.
COLOURS = ["#ffe08a", "#b5e8c3", "#a9d3ff", "#ffc2d1", "#d9c8ff", "#ffd0b0", "#b8ecec", "#e6e6a0"]


def write_csv(rows: DataFrame, folder: str, partition_by: str | None = None) -> None:
    """CSV with a header; one folder per value of ``partition_by``. Scales with the cluster."""
    w = rows.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (w.partitionBy(partition_by) if partition_by else w).csv(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def _ordered(rows: DataFrame) -> Iterator:
    return rows.select(*COLUMNS).orderBy("file_no", "match_no").toLocalIterator()


def _words_of(term: Term) -> str:
    """A term as a pattern over text without accents."""
    pieces = {"*": r"\w*", "?": r"\w"} | ({" ": r"\s+"} if term.is_phrase else {})
    inner = "".join(pieces.get(c) or re.escape(c) for c in term.core)
    return inner if term.is_phrase else rf"(?<!\w){inner}(?!\w)"


def highlight(context: str | None, query: str | None) -> str:
    """The context as HTML with the query's terms marked, whatever their accents; where marks overlap, the earlier wins.

    One pass with one pattern: a group for each term, so that the group that matched tells the colour.
    """
    context = context or ""
    letters = [(strip_accents(c), i) for i, c in enumerate(context)]
    flat = "".join(x for x, _ in letters)
    origin = [i for x, i in letters for _ in x]
    patterns = dict.fromkeys(_words_of(t) for t in Query(query).terms if t.core)
    if not patterns:
        return html.escape(context)
    out, at = [], 0
    for m in re.finditer("|".join(f"({p})" for p in patterns), flat, re.I):
        if m.group():
            s, e = origin[m.start()], origin[m.end() - 1] + 1
            if s >= at:
                colour = COLOURS[(m.lastindex - 1) % len(COLOURS)]
                out.append(f'{html.escape(context[at:s])}<mark style="background:{colour}">{html.escape(context[s:e])}</mark>')
                at = e
    return "".join(out) + html.escape(context[at:])


def write_txt(rows: DataFrame, path: str) -> None:
    """A plain report: files by rank, contexts wrapped at 74 columns."""
    with open(path, "w", encoding="utf-8") as f:
        last = None
        for r in _ordered(rows):
            if r.file_no != last:
                last = r.file_no
                f.write(f"\n{r.file_no}. {r.filename}\n   {r.full_path}\n")
            f.write(f"\n  [{r.match_no}] {r.position} | score {r.score} | {r.query}\n")
            for p in (r.context or "").split("\n"):
                f.write(textwrap.fill(p, 74, initial_indent="      ", subsequent_indent="      ") + "\n")


def write_html(rows: DataFrame, path: str, title: str = "Search results") -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font:15px/1.5 sans-serif;max-width:60em;margin:2em auto}}mark{{color:#111;padding:0 .1em}}small{{color:#666}}</style><h1>{html.escape(title)}</h1>\n")
        last = None
        for r in _ordered(rows):
            if r.file_no != last:
                last = r.file_no
                f.write(f"<h2>{r.file_no}. <a href='{html.escape(Path(r.full_path).as_uri() if r.full_path.startswith('/') else r.full_path)}'>{html.escape(r.filename)}</a></h2>\n")
            f.write(f"<p>{highlight(r.context, r.query)}<br><small>{r.match_no}. {html.escape(r.position or '')}, score {r.score}</small></p>\n")


def write_xlsx(rows: DataFrame, path: str) -> None:
    """One sheet with a frozen header row, strings inline."""
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v if v is not None else "")))}</t></is></c>'
    ns = "http://schemas.openxmlformats.org"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets><sheet name="Results" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData><row>{"".join(map(cell, COLUMNS))}</row>'.encode())
            for r in _ordered(rows):
                f.write(f"<row>{''.join(map(cell, r))}</row>".encode())
            f.write(b"</sheetData></worksheet>")


FORMATS = {"csv": write_csv, "json": write_json, "txt": write_txt, "html": write_html, "xlsx": write_xlsx}


def write_report(matches: DataFrame, path: str, fmt: str | None = None, dedup: bool = True) -> None:
    """In the format given, else the one of the path's extension; failures raise."""
    fmt = (fmt or Path(path).suffix.lstrip(".") or "html").lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    FORMATS[fmt](report_rows(matches, dedup), path)


def write_per_folder(matches: DataFrame, folder: str, dedup: bool = True) -> None:
    """CSV parts by root folder, under names safe for files, in one distributed write."""
    rows = report_rows(matches, dedup)
    write_csv(rows.withColumn("folder_name", safe_name("root_folder")).drop("root_folder"), folder, "folder_name")


def write_chunks(matches: DataFrame, folder: str, size: int) -> None:
    """CSV parts of ``size`` rows in rank order, one folder each."""
    write_csv(assign_chunks(matches, size).select("path", "location", "query", "relevance_score", "context", F.col("part")), folder, "part")
