"""CSV folders in and out."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import blank_nan, quoted
from ..functions.order import written
from ..functions.text import parse_number
from .csv_records import split_states, whole_records
from .names import clean_names

# Texts that mean "missing" in a data file.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
WHOLE_NUMBER = r"^[+-]?[0-9]+$"
# Byte-order marks of UTF-16, and of UTF-8, at the start of a file.
WIDE_MARKS, PLAIN_MARK = (b"\xff\xfe", b"\xfe\xff"), b"\xef\xbb\xbf"
# Files whose headers are broadcast at most.
BROADCAST_FILES = 100_000


@dataclass(frozen=True)
class _Kind:
    """Files with one header line and one encoding."""

    names: tuple[str, ...]
    encoding: str
    header: bytes
    valid: bool


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Every CSV file below ``path`` as one typed table.

    Each file is read by its own header, so files may hold columns in another order; a column that
    a file lacks is NULL there. Rows with too few fields are kept and filled with NULL, rows with
    too many are left out, but for one empty field at their end. Without ``encoding`` each file is checked: UTF-16 by its mark, else
    UTF-8 if valid, else ISO-8859-1. Quoted fields may hold line breaks, commas and doubled quotes;
    files stay splittable all the same (but UTF-16 ones). Only the distinct headers come to the
    driver, and the names of UTF-16 files.
    """
    files = written(_file_kinds(spark, path), "csv-files")
    states = None
    if not (encoding or "").upper().startswith("UTF-16") and files.where("quotes").limit(1).count():
        states = written(split_states(spark, path, files.where("quotes")).where("broken"), "csv-broken")
        states = states if states.limit(1).count() else None
    if states is not None:
        broken = states.select("file").distinct()
        records = whole_records(spark, path, states)
        records = written(records.join(files.select("file", "valid"), "file"), "csv-whole")
        files = files.join(broken, "file", "left_anti")
    tables = []
    kinds = _kinds(files, encoding)
    plain = [k for k in kinds if k.encoding != "UTF-16"]
    if plain:
        tables.append(_read_plain(spark, path, files, plain, len(plain) < len(kinds) or states is not None))
    for kind in kinds:
        if kind.encoding == "UTF-16":
            names = files.where(F.col("header") == F.lit(kind.header)).select("file").collect()
            tables.append(_read_positions(spark, [unquote(r["file"]) for r in names], kind.names, "UTF-16", True))
    if states is not None:
        headers = records.where("first").select("file", F.col("record").alias("header"), "valid")
        tables += [_read_records(records, headers, k) for k in _kinds(headers, encoding)]
    if not tables:
        raise ValueError(f"no data in {path}")
    table = tables[0]
    for other in tables[1:]:
        table = table.unionByName(other, allowMissingColumns=True)
    return infer_column_types(clean_names(table))


def _file_kinds(spark, path) -> DataFrame:
    """A row per file: ``file``, ``header`` (bytes of the first line), whether all lines are valid UTF-8, and whether any has quotes."""
    first = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("ok"), F.col("value").contains('"').alias("quoted"), first.alias("at")
    )
    found = lines.groupBy("file").agg(F.min_by("line", "at").alias("header"), F.every("ok").alias("valid"), F.some("quoted").alias("quotes")).where("header IS NOT NULL")
    wide = F.lit(False)
    for mark in WIDE_MARKS:
        wide = wide | F.startswith("header", F.lit(mark))
    return found.withColumn("quotes", F.col("quotes") & ~wide)


def _kinds(files: DataFrame, encoding: str | None) -> list[_Kind]:
    """Different headers and encodings, in the order of the first file of each."""
    return [_kind(bytes(r["header"]), r["valid"], encoding) for r in files.groupBy("header", "valid").agg(F.min("file").alias("f")).orderBy("f").collect()]


def _read_records(records: DataFrame, headers: DataFrame, kind: _Kind) -> DataFrame:
    """The records of all files of one kind, parsed by position."""
    mine = headers.where((F.col("header") == F.lit(kind.header)) & (F.col("valid") == kind.valid)).select("file")
    width = len(kind.names)
    schema = ", ".join(f"f{i} string" for i in range(width + 1))
    # A cast does not fail on bytes of other kinds, which a filter may meet before the files are told apart.
    text = F.col("record").cast("string") if kind.encoding.upper() == "UTF-8" else F.decode("record", kind.encoding)
    fields = F.from_csv(text, schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}).alias("f")
    rows = records.where("NOT first").join(mine, "file", "left_semi").select(fields)
    return rows.where(f"f.f{width} IS NULL").select(*[F.col(f"f.f{i}").alias(n) for i, n in enumerate(kind.names)])


def _kind(header: bytes, valid: bool, encoding: str | None) -> _Kind:
    if (encoding or "").upper().startswith("UTF-16") or encoding is None and header.startswith(WIDE_MARKS):
        kept = header.removesuffix(b"\r") if len(header) % 2 else header
        return _Kind(_fields(kept.decode("utf-16", "ignore")), "UTF-16", header, valid)
    used = encoding or ("UTF-8" if valid else "ISO-8859-1")
    return _Kind(_fields(header.removeprefix(PLAIN_MARK).decode(used, "replace")), used, header, valid)


def _fields(line: str) -> tuple[str, ...]:
    """Header names; repeated ones are numbered ``name.1``, ``name.2``."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([line.strip("\r\n")]), [])):
        name, base, n = name or f"_c{i}", name or f"_c{i}", 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return tuple(out)


def _raw(spark, paths, width: int, encoding: str, multiline: bool) -> DataFrame:
    """Fields by position, one more than any header has; the reader leaves out the first line of each file."""
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(width + 1)])
    options = {"header": True, "enforceSchema": True, "encoding": encoding, "multiLine": multiline, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    return spark.read.schema(schema).options(**options).csv(paths)


def _read_positions(spark, paths, names, encoding, multiline) -> DataFrame:
    raw = _raw(spark, paths, len(names), encoding, multiline)
    return raw.where(F.col(f"f{len(names)}").isNull()).select(*[F.col(f"f{i}").alias(n) for i, n in enumerate(names)])


def _read_plain(spark, path, files, kinds: list[_Kind], others: bool) -> DataFrame:
    """All files of single-byte separators in one scan; with several kinds each row learns its file's."""
    if len(kinds) == 1 and not others:
        return _read_positions(spark, path, kinds[0].names, kinds[0].encoding, False)
    # Read as ISO-8859-1, bytes stay what they are, and each field is decoded by its file's encoding.
    width = max(len(k.names) for k in kinds)
    raw = _raw(spark, path, width, "ISO-8859-1", False).withColumn("file", F.col("_metadata.file_path"))
    number = F.coalesce(*[F.when((F.col("header") == F.lit(k.header)) & (F.col("valid") == k.valid), i) for i, k in enumerate(kinds)])
    known = files.select("file", number.alias("kind")).where("kind IS NOT NULL")
    if known.count() <= BROADCAST_FILES:
        known = F.broadcast(known)
    raw = raw.join(known, "file")
    names = list(dict.fromkeys(n for k in kinds for n in k.names))

    def field(k: _Kind, i: int) -> Column:
        c = F.col(f"f{i}")
        return c if k.encoding == "ISO-8859-1" else F.decode(F.encode(c, "ISO-8859-1"), k.encoding)

    columns = []
    for name in names:
        value = F.lit(None).cast("string")
        for number_, k in enumerate(kinds):
            if name in k.names:
                value = F.when(F.col("kind") == number_, field(k, k.names.index(name))).otherwise(value)
        columns.append(value.alias(name))
    fits = F.lit(False)
    for number_, k in enumerate(kinds):
        fits = fits | ((F.col("kind") == number_) & F.col(f"f{len(k.names)}").isNull())
    return raw.where(fits).select(*columns)


def infer_column_types(df: DataFrame) -> DataFrame:
    """Text table to a typed one: whole numbers, numbers and truth values where every value fits.

    One pass looks at all columns. Whole numbers beyond 64 bits become DECIMAL(38,0), still wider
    ones stay text, so no two ids ever become one. Dates stay text, as their format is for the
    cleaning steps to find.
    """
    texts = {c: F.when(~quoted(c).isin(MISSING_TEXTS), quoted(c)) for c in df.columns}
    seen = {r["column"]: r for r in _fitting(df).collect()}
    out = []
    for name, value in texts.items():
        row = seen.get(name)
        if row and row["whole"] == row["n"]:
            if row["wide"] == row["n"]:
                value = F.trim(value).try_cast("bigint" if row["long"] == row["n"] else "decimal(38,0)")
        elif row and row["number"] == row["n"]:
            value = parse_number(value)
        elif row and row["truth"] == row["n"]:
            value = F.lower(F.trim(value)).try_cast("boolean")
        out.append(value.alias(name))
    return df.select(*out)


def _fitting(df: DataFrame) -> DataFrame:
    """``column, n, whole, long, wide, number, truth``: how many texts a column has and how many of them fit each type; one row per column and task is shuffled."""
    value, plain = F.col("value"), F.col("plain")
    missing = (F.octet_length(value) <= max(map(len, MISSING_TEXTS))) & value.isin(MISSING_TEXTS)
    cells = df.select(*[quoted(c) for c in df.columns]).unpivot([], [quoted(c) for c in df.columns], "column", "value").where(value.isNotNull() & ~missing)
    # The generators keep the derived values from being made again for every count below.
    cells = cells.select("column", "value", F.explode(F.array(F.trim(value))).alias("plain"))
    cells = cells.select("column", "value", "plain", F.explode(F.array(plain.rlike(WHOLE_NUMBER))).alias("whole"))
    # Casts and parsing are dear; every whole number of up to 18 characters fits all three types.
    short = F.col("whole") & (F.octet_length(plain) <= 18)
    return cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("whole").alias("whole"),
        F.count_if(short | (F.col("whole") & plain.try_cast("bigint").isNotNull())).alias("long"),
        F.count_if(short | (F.col("whole") & plain.try_cast("decimal(38,0)").isNotNull())).alias("wide"),
        F.count_if(short | parse_number(value).isNotNull()).alias("number"),
        F.count_if(plain.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias("truth"),
    )


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Header, no index, missing values empty; one file per partition."""
    df.write.mode("errorifexists").options(
        header=True, encoding=encoding, quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    blank_nan(df).write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(path)
