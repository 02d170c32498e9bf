"""Folders of .xlsx workbooks: the first sheet of every file, one file per task."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, time, timedelta
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import written
from .csv_files import infer_column_types
from .names import clean_names

ROWS_PER_BATCH = 5_000
READ_AT_ONCE = 1 << 16
DATES_KEPT = 10_000
ROW_SCHEMA = "file string, row long, names array<string>, cells array<string>"
OFFICE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROW, VALUE, TEXT = (OFFICE + x for x in ("row", "v", "t"))
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


# Built-in number formats that show dates or times, and the first days of the two calendars.
DATE_STYLES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DAY_ZERO = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}


def read_workbooks(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """All workbooks of a folder as one typed table; sheets may name their columns in any order.

    Cells shown as dates become ISO text, which the date steps read; repeated names of a sheet are
    numbered ``name.1``, ``name.2``.
    """
    return parse_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder))


def parse_workbooks(files: DataFrame) -> DataFrame:
    """The table in ``files`` (columns ``path, content``). Each file is parsed once, its rows are written; typing is one pass over those."""
    rows = written(files.select("path", "content").mapInArrow(_parse_files, ROW_SCHEMA), "workbook-rows")
    # Column names in the order in which sheets list them; a header's worth of text.
    headers = rows.select("names").distinct().select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
    names = [r["name"] for r in headers.orderBy("at", "name").collect()]
    if not names:
        raise ValueError("no data in the workbooks")
    # Names of a sheet differ; place 0 is a sheet without the column, so its cells are missing.
    table = rows.select(*[F.get("cells", F.array_position("names", n).cast("int") - 1).alias(n) for n in names])
    return infer_column_types(clean_names(table))


def _parse_files(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            header, numbers, out = None, [], []
            for number, cells in _sheet_rows(content):
                if header is None:
                    header = _numbered({i: v for i, v in cells.items() if v})
                    continue
                numbers.append(number)
                out.extend(map(cells.get, header))
                if len(numbers) == ROWS_PER_BATCH:
                    yield _rows(path, numbers, list(header.values()), out)
                    numbers, out = [], []
            if numbers:
                yield _rows(path, numbers, list(header.values()), out)


def _rows(path: str, numbers: list[int], names: list[str], cells: list[str | None]) -> pa.RecordBatch:
    """Rows of one sheet; ``cells`` has those of all rows one after another."""
    ends = pa.array(range(0, len(names) * len(numbers) + 1, len(names)) if names else [0] * (len(numbers) + 1), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.string())) for x in (names * len(numbers), cells)]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(numbers), pa.string()), pa.array(numbers, pa.int64()), *lists], names=["file", "row", "names", "cells"])


def _numbered(header: dict[int, str]) -> dict[int, str]:
    out: dict[int, str] = {}
    for i, name in header.items():
        new, n = name, 0
        while new in out.values():
            n += 1
            new = f"{name}.{n}"
        out[i] = new
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    dated = set(DATE_STYLES)
    for form in root.iter(OFFICE + "numFmt"):
        # Quoted text, escaped characters and colours or conditions in brackets show no date.
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", form.get("formatCode", ""))
        if re.search("[ymdhs]", code, re.IGNORECASE):
            dated.add(int(form.get("numFmtId")))
    styles = root.find(OFFICE + "cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in dated}


def _day_zero(book: zipfile.ZipFile) -> datetime:
    facts = ElementTree.parse(book.open("xl/workbook.xml")).getroot().find(OFFICE + "workbookPr")
    return DAY_ZERO[facts is not None and facts.get("date1904") in ("1", "true")]


def _sheet_rows(content: bytes):
    """Row number and ``{column index: text}`` of each row of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot():
                shared.append("".join(t.text or "" for t in item.iter(OFFICE + "t")))
        dated, zero = _date_styles(book), _day_zero(book)
        text = _cell_reader(shared, dated, zero)
        places: dict[str, int | None] = {}
        for row in _row_elements(book):
            cells = {}
            for i, cell in enumerate(row):
                place = cell.get("r")
                if place:
                    letters = place.rstrip("0123456789")
                    if letters not in places:
                        places[letters] = _column(letters)
                    at = places[letters]
                    i = i if at is None else at
                cells[i] = text(cell)
            yield int(row.get("r", 0)), cells


def _row_elements(book: zipfile.ZipFile):
    """The rows of the first sheet as its XML comes in: the parser builds them without a Python step for each element, and they go once they are read."""
    builder = ElementTree.TreeBuilder()
    parser = ElementTree.XMLParser(target=builder)
    with book.open(_first_sheet(book)) as stream:
        rows = None
        while chunk := stream.read(READ_AT_ONCE):
            parser.feed(chunk)
            if rows is None:
                # The builder hands out the element at the top while it goes on.
                top = builder.close()
                rows = top.find(OFFICE + "sheetData") if top is not None else None
            if rows is not None and len(rows) > 1:
                # The last one may be open.
                done = rows[:-1]
                del rows[:-1]
                yield from (row for row in done if row.tag == ROW)
        rows = parser.close().find(OFFICE + "sheetData")
        yield from (row for row in (rows if rows is not None else ()) if row.tag == ROW)


def _cell_reader(shared: list[str], dated: set[int], zero: datetime):
    """What makes a cell's text of its element; the latest dates are kept, as columns repeat them."""

    @lru_cache(DATES_KEPT)
    def day(value: str) -> str:
        # To the second: a day's fraction is stored as binary floating point.
        at = zero + timedelta(seconds=round(float(value) * 86400))
        return at.isoformat(" ") if at.time() != time.min else at.date().isoformat()

    def text(cell) -> str | None:
        kind = cell.get("t")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(TEXT))
        value = cell.findtext(VALUE)
        if value is None:
            return None
        if kind == "s":
            return shared[int(value)]
        if kind in (None, "n"):
            return day(value) if int(cell.get("s", 0)) in dated else value
        return {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value

    return text


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.parse(book.open("xl/workbook.xml")).getroot().find(f"{OFFICE}sheets/{OFFICE}sheet")
    links = ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()
    target = next(link.get("Target") for link in links if link.get("Id") == sheet.get(RELATION))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column(place: str) -> int | None:
    """Index of the column that a cell's place begins with."""
    letters = re.match(r"[A-Z]+", place)
    if not letters:
        return None
    index = 0
    for letter in letters[0]:
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1
