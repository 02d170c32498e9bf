"""Numeric text turned into numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import quoted
from ..functions.text import parse_number_with_symbols


def numeric_repair(df: DataFrame, threshold: float = 0.70, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Replace text columns that are mostly numbers by doubles; other values there become NULL.

    One pass reads the parse ratio of all text columns; the result is a single projection.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    if not names:
        return df
    parsed = {c: parse_number_with_symbols(quoted(c)) for c in names}
    ratios = df.agg(
        *[F.try_divide(F.count(parsed[c]).cast("double"), F.count(quoted(c)).cast("double")).alias(f"r{i}") for i, c in enumerate(names)]
    ).first()
    numeric = {c for c, ratio in zip(names, ratios) if ratio is not None and ratio >= threshold}
    return df.select(*[parsed[c].alias(c) if c in numeric else quoted(c) for c in df.columns])
