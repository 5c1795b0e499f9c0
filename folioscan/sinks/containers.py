"""Minimal office and book files from text, as bytes: what the readers of :mod:`~folioscan.sources.formats` read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text.encode())
    return out.getvalue()


def docx(paragraphs: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def xlsx(sheet: str, rows: list[list[str]]) -> bytes:
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in row) + "</row>" for row in rows)
    ns = "http://schemas.openxmlformats.org"
    return _zipped({
        "xl/workbook.xml": f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>',
    })


def epub(chapters: list[str]) -> bytes:
    """Chapters of XHTML, read in the order given."""
    items = "".join(f'<item id="c{i}" href="c{i}.xhtml"/>' for i in range(len(chapters)))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    parts = {"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o/p.opf": f"<package><manifest>{items}</manifest><spine>{spine}</spine></package>"}
    return _zipped(parts | {f"o/c{i}.xhtml": c for i, c in reversed(list(enumerate(chapters)))})


def zipped_fb2(text: str) -> bytes:
    return _zipped({"book.fb2": text})
