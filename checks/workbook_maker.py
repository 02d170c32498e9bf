"""Minimal .xlsx bytes for checks: the library reads workbooks but does not write them."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pandas as pd

BOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
LINKS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
    'Target="worksheets/sheet1.xml"/></Relationships>'
)


STYLES = (
    '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts>'
    '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>'
)


def workbook_bytes(names, rows) -> bytes:
    def cell(value):
        if value is None:
            return "<c/>"
        if isinstance(value, datetime):
            return f'<c s="1"><v>{(value - datetime(1899, 12, 30)).total_seconds() / 86400!r}</v></c>'
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>"

    lines = "".join(f'<row r="{i}">{"".join(map(cell, r))}</row>' for i, r in enumerate([names, *rows], 1))
    sheet = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{lines}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", BOOK)
        book.writestr("xl/_rels/workbook.xml.rels", LINKS)
        book.writestr("xl/styles.xml", STYLES)
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def pack(batches):
    """mapInPandas helper: each batch of rows becomes one workbook."""
    for at, batch in enumerate(batches):
        rows = [[v.item() if hasattr(v, "item") else v.to_pydatetime() if hasattr(v, "to_pydatetime") else v for v in r] for r in batch.itertuples(index=False)]
        yield pd.DataFrame({"path": [f"part-{at}.xlsx"], "content": [workbook_bytes(list(batch.columns), rows)]})
