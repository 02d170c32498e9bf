"""Per-column evidence: what the values of every column look like.

Cells are seen as ``column, value`` rows, which are summed up by column where they lie, so no
cell is shuffled for patterns, types and dates. Numbers of distinct values come from a second pass
over 96-bit hashes. Columns of a stored table that have few distinct values, and those found to be
categories, have their values counted as text; then each value is looked at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.dates import DATE_FORMATS, date_shape, parse_shaped_date
from ..functions.numbers import DATE_TYPES, INTEGER_TYPES, NUMERIC_TYPES, blank_nan, quoted

# Thresholds of the type decision.
DATE_SHARE = 0.7
NUMBER_SHARE = 0.8
CATEGORY_RATIO = 0.2
CATEGORY_VALUES = 20
# Distinct values of a text column up to which a stored table's values are counted before they are looked at.
COUNTED_VALUES = 200_000


def type_label(kind: T.DataType) -> str:
    """The reader-facing label of a Spark type."""
    if isinstance(kind, INTEGER_TYPES):
        return "integer"
    if isinstance(kind, NUMERIC_TYPES):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "datetime" if isinstance(kind, DATE_TYPES) else "string"


def value_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n``: every distinct value (as text, NULL included) and its frequency."""
    frame = blank_nan(df)
    names = columns or frame.columns
    texts = frame.select(*[quoted(c).cast("string").alias(c) for c in names])
    return texts.unpivot([], [quoted(c) for c in names], "column", "value").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """``column, unique_count``: distinct values per column, NULL left out, told apart by two hashes (96 bits).

    A row is shuffled for each value that is distinct in its task: the column's number and the two hashes.
    """
    frame = blank_nan(df)
    texts = [quoted(c).cast("string") for c in frame.columns]
    hashed = F.array(*[F.when(t.isNotNull(), F.struct(F.lit(i).alias("at"), F.xxhash64(t).alias("a"), F.hash(t).alias("b"))) for i, t in enumerate(texts)])
    counted = frame.select(F.inline(hashed)).where("at IS NOT NULL").distinct().groupBy("at").agg(F.count(F.lit(1)).alias("unique_count"))
    return counted.select(F.element_at(F.array(*[F.lit(c) for c in frame.columns]), F.col("at") + 1).alias("column"), "unique_count")


def _plain_patterns(frame: DataFrame, names: list[str]) -> DataFrame:
    """Patterns of columns that are no text, by aggregates on the columns themselves: none of them is ever made text."""
    seen, rows = [F.count(F.lit(1)).alias("rows")], []
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    for i, name in enumerate(names):
        kind = frame.schema[name].dataType
        seen.append(F.count(quoted(name)).alias(f"n{i}"))
        whole = isinstance(kind, INTEGER_TYPES) or isinstance(kind, T.DecimalType) and kind.scale == 0
        truth = F.col(f"n{i}") > 0 if isinstance(kind, T.BooleanType) else no
        if whole:
            seen.append(F.coalesce(F.every(quoted(name).isin(0, 1)), no).alias(f"t{i}"))
            truth = F.col(f"t{i}")
        fields = [
            F.lit(name).alias("column"), F.col("rows").alias("rows"), (F.col("rows") - F.col(f"n{i}")).alias("missing_count"), truth.alias("boolean_words"),
            zero.alias("number_count"), no.alias("whole_numbers"), zero.alias("padded_count"), zero.alias("special_count"),
        ]
        rows.append(F.struct(*fields, *[zero.alias(f"date{j}") for j in range(len(DATE_FORMATS))]))
    return frame.agg(*seen).select(F.inline(F.array(*rows)))


def _cells(frame: DataFrame, names: list[str]) -> DataFrame:
    """``column, value, n``: the cells of text columns, each for itself."""
    return frame.select(*[quoted(c) for c in names]).unpivot([], [quoted(c) for c in names], "column", "value").withColumn("n", F.lit(1).cast("bigint"))


def _text_patterns(cells: DataFrame) -> DataFrame:
    """Patterns of text columns: ``column, value, n`` rows, summed up where they lie."""
    value, plain = F.col("value"), F.col("plain")
    # The generators keep the derived values from being made again for every count below.
    derived = F.struct(text.strip(value).alias("plain"), text.has_non_printable(value).alias("special"))
    cells = cells.select("column", "value", "n", F.inline(F.array(derived)))
    shaped = F.struct(text.is_boolean_word(plain, stripped=True).alias("truth"), text.parse_stripped_number(plain).alias("number"), date_shape(plain).alias("shape"))
    cells = cells.select("column", "value", "n", "plain", "special", F.inline(F.array(shaped)))

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0).cast("bigint"))

    dates = [total(parse_shaped_date(plain, F.col("shape"), fmt).isNotNull()).alias(f"date{i}") for i, (fmt, _) in enumerate(DATE_FORMATS)]
    return cells.groupBy("column").agg(
        F.sum("n").alias("rows"),
        total(value.isNull()).alias("missing_count"),
        F.coalesce(F.every("truth"), F.lit(False)).alias("boolean_words"),
        total(F.col("number").isNotNull()).alias("number_count"),
        F.coalesce(F.every(F.col("number") == F.floor("number")), F.lit(False)).alias("whole_numbers"),
        total(value != plain).alias("padded_count"),
        total(F.col("special")).alias("special_count"),
        *dates,
    )


def column_patterns(df: DataFrame, counted: set[str] = frozenset()) -> DataFrame:
    """One row per column, in table order: counts of what its values look like.

    Only one row per column and task is shuffled, and for the text columns among ``counted`` each value that is distinct in its task.
    """
    frame, fields = blank_nan(df), df.schema.fields
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    others = [f.name for f in fields if not isinstance(f.dataType, T.StringType)]
    few, many = [c for c in texts if c in counted], [c for c in texts if c not in counted]
    parts = [_text_patterns(made(frame, names)) for made, names in ((_cells, many), (value_pairs, few)) if names]
    parts += [_plain_patterns(frame, others)] if others else []
    seen = reduce(DataFrame.unionByName, parts)
    columns = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), type_label(f.dataType)) for i, f in enumerate(fields)],
        "position int, column string, raw_type string, label string",
    )
    counts = [c for c in seen.columns if c not in ("column", "boolean_words", "whole_numbers")]
    joined = columns.join(seen, "column", "left").fillna(0, counts).fillna(False, ["boolean_words", "whole_numbers"])
    best, fmt = _best_date()
    return joined.withColumns({"date_count": best, "date_format": fmt}).drop(*[f"date{i}" for i in range(len(DATE_FORMATS))])


def column_evidence(df: DataFrame, stored: bool = False) -> DataFrame:
    """The patterns of every column, its number of distinct values and its inferred type; zero counts for an empty table.

    Of a table that is ``stored`` as files the distinct values are counted at once: columns that have few are then looked at by value.
    """
    distinct, few = distinct_counts(df), set()
    if stored:
        found = distinct.collect()
        distinct = df.sparkSession.createDataFrame(found, distinct.schema)
        few = set(df.columns) - {r["column"] for r in found if r["unique_count"] > COUNTED_VALUES}
    joined = column_patterns(df, few).join(distinct, "column", "left").fillna(0, ["unique_count"])
    return joined.withColumn("inferred_type", _inferred())


def _best_date() -> tuple[Column, Column]:
    """How many values the best date format fits, and which it is."""
    parsed = [F.col(f"date{i}") for i in range(len(DATE_FORMATS))]
    best = F.greatest(*parsed)
    chosen = F.when(F.lit(False), "")
    for (fmt, _), count in zip(DATE_FORMATS, parsed):
        chosen = chosen.when((best > 0) & (count == best), fmt)
    return best, chosen


def _inferred() -> Column:
    present = F.col("rows") - F.col("missing_count")
    share = F.try_divide(F.col("date_count").cast("double"), present.cast("double"))
    numeric = F.try_divide(F.col("number_count").cast("double"), present.cast("double"))
    variety = F.try_divide(F.col("unique_count").cast("double"), present.cast("double"))
    return (
        F.when(present == 0, "string")
        .when(F.col("boolean_words"), "boolean")
        .when(F.col("label").isin("datetime", "integer", "float"), F.col("label"))
        .when(share >= DATE_SHARE, "datetime")
        .when((numeric >= NUMBER_SHARE) & F.col("whole_numbers"), "integer")
        .when(numeric >= NUMBER_SHARE, "float")
        .when((variety < CATEGORY_RATIO) | (F.col("unique_count") <= CATEGORY_VALUES), "categorical")
        .otherwise("string")
    )


def label_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, plain_labels, folded_labels``: distinct stripped values, and those regardless of case.

    Meant for the columns found to be categories or truth values, whose distinct values are few.
    """
    plain = text.strip(F.col("value"))
    labels = value_pairs(df, columns).where("value is not null").select("column", plain.alias("label")).distinct()
    folded = labels.groupBy("column", F.lower("label").alias("folded")).agg(F.count(F.lit(1)).alias("spellings"))
    return folded.groupBy("column").agg(F.sum("spellings").alias("plain_labels"), F.count(F.lit(1)).alias("folded_labels"))


def infer_types(df: DataFrame) -> DataFrame:
    """``column, raw_type, label, inferred_type`` and the counts behind the decision."""
    return column_evidence(df).select(
        "column", "raw_type", "label", "inferred_type", "rows", "missing_count", "unique_count",
        "boolean_words", "number_count", "date_count", "date_format",
    )
