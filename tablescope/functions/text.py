"""Text expressions. All are native Spark columns; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and vocabularies that decide how text is understood.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SYMBOL_PATTERN = r"(?U:[$,€£¥%\s])"
# Text of these characters alone may be a number between symbols; the others need no replacement to be refused.
NUMBER_AND_SYMBOLS = r"(?U)^[0-9+.eE$,€£¥%\s\x1c-\x1f-]*$"
NON_PRINTABLE_PATTERN = r"[^\x20-\x7E]"
BOOLEAN_WORDS = ["yes", "no", "true", "false", "1", "0", "y", "n"]
TRUE_WORDS = ["yes", "true", "1", "y", "t"]
FALSE_WORDS = ["no", "false", "0", "n", "f"]


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def parse_number(c: Column) -> Column:
    """Text to double; anything that is not a plain finite decimal number becomes NULL."""
    return parse_stripped_number(strip(c.cast("string")))


def parse_stripped_number(trimmed: Column) -> Column:
    """``parse_number`` for stripped text."""
    value = F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def drop_symbols(c: Column) -> Column:
    """Remove currency signs, thousands separators, percent signs and white space."""
    return F.regexp_replace(c, SYMBOL_PATTERN, "")


def parse_number_with_symbols(c: Column) -> Column:
    """``parse_number`` of text without its symbols."""
    return F.when(c.rlike(NUMBER_AND_SYMBOLS), parse_number(drop_symbols(c)))


def drop_non_printable(c: Column) -> Column:
    return strip(F.regexp_replace(c, NON_PRINTABLE_PATTERN, ""))


def has_non_printable(c: Column) -> Column:
    return c.rlike(NON_PRINTABLE_PATTERN)


def title_case(c: Column) -> Column:
    """Stripped text with a capital after every character that is not a cased letter."""
    words = F.split(F.lower(strip(c)), r"(?<=[^\p{Lu}\p{Ll}\p{Lt}])(?=[\p{Lu}\p{Ll}\p{Lt}])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), w.substr(F.lit(2), F.length(w)))), "")


def is_boolean_word(c: Column, stripped: bool = False) -> Column:
    word = c if stripped else strip(c.cast("string"))
    return (F.octet_length(word) <= max(map(len, BOOLEAN_WORDS))) & F.lower(word).isin(BOOLEAN_WORDS)


def parse_boolean(c: Column) -> Column:
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def human_number(c: Column) -> Column:
    """1234567.8 -> 1.23M, 1234.5 -> 1.2K, 12 -> 12.00."""
    x = c.cast("double")
    return (
        F.when(F.abs(x) >= 1_000_000, F.concat(_fixed(x / 1_000_000, 2), F.lit("M")))
        .when(F.abs(x) >= 1_000, F.concat(_fixed(x / 1_000, 1), F.lit("K")))
        .when(x.isNotNull(), F.format_number(F.round(x, 2), 2))
    )


def plain_number(c: Column) -> Column:
    """Thousands separators; two decimals unless the value is whole."""
    x = c.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e12)
    return F.when(whole, F.format_number(x, 0)).otherwise(F.format_number(F.round(x, 2), 2))


def _fixed(x: Column, places: int) -> Column:
    return F.round(x, places).cast(f"decimal(30,{places})").cast("string")
