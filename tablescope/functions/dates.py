"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import quoted
from .text import strip

_DAY, _SLASHES = "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
_CLOCK, _SHORT_CLOCK = "[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(?:[.][0-9]{3}(?:[0-9]{3})?)?", "[0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2})?"
_ZONE = "(?:[A-Z]|[+-][0-9]{2}:[0-9]{2})"

# The outlines of dates; no two fit the same text. All-digit values are numbers, never dates.
SHAPES = [
    _DAY,
    f"{_DAY} {_CLOCK}",
    f"{_DAY}[A-Z]{_CLOCK}",
    f"{_DAY} [0-9]{{1,2}}:[0-9]{{1,2}}",
    "[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}",
    _SLASHES,
    "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}",
    "[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}",
    "[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}",
    "[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}",
    "[A-Z][a-z]{2} [0-9]{4}",
    f"{_DAY}[A-Z]{_CLOCK}{_ZONE}",
    f"{_DAY} {_CLOCK}{_ZONE}",
    f"{_SLASHES} {_SHORT_CLOCK}",
    f"{_SLASHES} {_SHORT_CLOCK} [A-Z]{{2}}",
    "[0-9]{1,2}-[A-Z][a-z]{2}-[0-9]{4}",
    "[A-Z][a-z]{3,8} [0-9]{1,2}, [0-9]{4}",
    "[0-9]{1,2} [A-Z][a-z]{3,8} [0-9]{4}",
]
# What a text must also have to be worth parsing, as refusals of the parser are dear: a month from 1 to 12 in its place, or
# the one full name of a month that is as short as the others' abbreviations.
_MONTH_FIRST, _MONTH_SECOND, _ANY = "^(?:0?[1-9]|1[0-2])[-/]", "^[0-9]{1,2}[-/.](?:0?[1-9]|1[0-2])[-/.]", ""
_FULL_NAME = "May|[a-z]{3}"

# Accepted text forms of a date, in order of preference: the places in SHAPES of the outlines they have, and the guard.
DATE_FORMATS = [
    ("yyyy-M-d", ([0], _ANY)),
    ("yyyy-M-d H:m:s[.SSSSSS]", ([1], _ANY)),
    ("yyyy-M-d'T'H:m:s[.SSSSSS]", ([2], _ANY)),
    ("yyyy-M-d H:m", ([3], _ANY)),
    ("yyyy/M/d", ([4], _ANY)),
    ("M/d/yyyy", ([5], _MONTH_FIRST)),
    ("d/M/yyyy", ([5], _MONTH_SECOND)),
    ("M-d-yyyy", ([6], _MONTH_FIRST)),
    ("d-M-yyyy", ([6], _MONTH_SECOND)),
    ("d.M.yyyy", ([7], _MONTH_SECOND)),
    ("d MMM yyyy", ([8], _ANY)),
    ("MMM d, yyyy", ([9], _ANY)),
    ("MMM yyyy", ([10], _ANY)),
    ("yyyy-M-d'T'H:m:s[.SSSSSS]XXX", ([11], _ANY)),
    ("yyyy-M-d H:m:s[.SSSSSS]XXX", ([12], _ANY)),
    ("M/d/yyyy H:m[:s]", ([13], _MONTH_FIRST)),
    ("d/M/yyyy H:m[:s]", ([13], _MONTH_SECOND)),
    ("M/d/yyyy h:m[:s] a", ([14], _MONTH_FIRST)),
    ("d-MMM-yyyy", ([15], _ANY)),
    ("MMMM d, yyyy", ([9, 16], _FULL_NAME)),
    ("d MMMM yyyy", ([8, 17], _FULL_NAME)),
]


def parse_date(c: Column, fmt: str) -> Column:
    """Text in one listed format to timestamp without time zone; everything else is NULL."""
    text = strip(c.cast("string"))
    return parse_shaped_date(text, date_shape(text), fmt)


def date_shape(text: Column) -> Column:
    """The place in ``SHAPES`` of the outline that a text has, NULL if none."""
    # Numbers and prose are refused by their first characters, before the outlines are tried.
    likely = F.length(text).between(8, 35) & text.rlike("^[0-9A-Z][0-9a-z]{0,8}[-/ ]|^[0-9]{1,2}[.][0-9]{1,2}[.]")
    found = F.when(text.rlike(f"^{SHAPES[0]}$"), 0)
    for i, outline in enumerate(SHAPES[1:], 1):
        found = found.when(text.rlike(f"^{outline}$"), i)
    return F.when(likely, found)


def parse_shaped_date(text: Column, shape: Column, fmt: str) -> Column:
    """``parse_date`` for stripped text whose shape is known. Text of another shape never meets the parser."""
    shapes, guard = dict(DATE_FORMATS)[fmt]
    fits = shape.isin(shapes) & text.rlike(guard) if guard else shape.isin(shapes)
    return F.try_to_timestamp(F.when(fits, text), F.lit(fmt)).cast("timestamp_ntz")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is made once per row, however often it is used.

    A generator: filters on the column are not pushed below it and projections are not merged with it, either of which
    would make the value again in each place, in generated methods too long to be compiled.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def with_shape(df: DataFrame, c: Column, text: str, shape: str) -> DataFrame:
    """``df`` with the stripped text of ``c`` and its date shape as two more columns, each made once."""
    return once(once(df, text, strip(c.cast("string"))), shape, date_shape(quoted(text)))


def with_dates(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a text column parsed by the form that fits most of its values; other types stay.

    One pass counts the forms. Text that the form does not fit becomes NULL.
    """
    if not isinstance(df.schema[name].dataType, T.StringType):
        return df
    text, shape = F.col("_date_text"), F.col("_date_shape")
    shaped = with_shape(df.select(quoted(name)), quoted(name), "_date_text", "_date_shape")
    counts = shaped.agg(*[F.count(parse_shaped_date(text, shape, fmt)).alias(f"n{i}") for i, (fmt, _) in enumerate(DATE_FORMATS)]).first()
    fmt = DATE_FORMATS[counts.index(max(counts))][0]
    shaped = with_shape(df, quoted(name), "_date_text", "_date_shape")
    return once(shaped, name, parse_shaped_date(text, shape, fmt)).drop("_date_text", "_date_shape")


def month_end(c: Column) -> Column:
    return F.last_day(c.cast("date"))


def month_label(c: Column) -> Column:
    return F.date_format(c, "MMM yyyy")
