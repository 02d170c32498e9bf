"""Row filters, option lists, previews, repeatable samples and type-based projection."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import with_dates
from ..functions.numbers import numeric_columns, percent, quoted, text_columns


@dataclass(frozen=True)
class Filter:
    """What to keep. A part left out does not restrict anything."""

    regions: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    dates: tuple[date, date] | None = None
    amounts: tuple[float, float] | None = None


def membership(column: str, allowed) -> Column:
    """Value is one of ``allowed``; an empty list allows everything."""
    return quoted(column).isin(list(allowed)) if allowed else F.lit(True)


def date_range(column: str, first, last) -> Column:
    """Calendar day within the inclusive range; missing dates drop out.

    The bounds are put on the column itself, so the scan can skip row groups by them.
    """
    c = quoted(column)
    return (c >= F.lit(first).cast("date")) & (c < F.date_add(F.lit(last).cast("date"), 1))


def amount_range(column: str, low, high) -> Column:
    return quoted(column).between(low, high)


def predicate(
    wanted: Filter, *, region: str | None = None, product: str | None = None, day: str | None = None, amount: str | None = None
) -> Column:
    """All given parts of ``wanted`` at once, as one expression Catalyst can split and push down."""
    parts = []
    if wanted.regions:
        parts.append(membership(region, wanted.regions))
    if wanted.products:
        parts.append(membership(product, wanted.products))
    if wanted.dates:
        parts.append(date_range(day, *wanted.dates))
    if wanted.amounts:
        parts.append(amount_range(amount, *wanted.amounts))
    out = F.lit(True)
    for part in parts:
        out = out & part
    return out


def apply_filter(df: DataFrame, wanted: Filter, **columns) -> DataFrame:
    """The rows wanted. A date column of text is compared by its dates and stays text."""
    day = columns.get("day")
    if not wanted.dates or day is None or not isinstance(df.schema[day].dataType, T.StringType):
        return df.where(predicate(wanted, **columns))
    dated = with_dates(df.withColumn("__day", quoted(day)), "__day")
    return dated.where(predicate(wanted, **{**columns, "day": "__day"})).drop("__day")


def retention(df: DataFrame, wanted: Filter, **columns) -> DataFrame:
    """One row: rows kept, rows in all, percentage kept."""
    if wanted.dates and columns.get("day"):
        df = with_dates(df, columns["day"])
    kept = F.count_if(F.coalesce(predicate(wanted, **columns), F.lit(False)))
    return df.agg(
        kept.alias("rows_kept"),
        F.count(F.lit(1)).alias("rows_total"),
        F.coalesce(percent(kept, F.count(F.lit(1))), F.lit(0.0)).alias("pct_kept"),
    )


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values as text."""
    return (
        df.where(quoted(column).isNotNull())
        .select(quoted(column).cast("string").alias("value"))
        .distinct()
        .orderBy("value")
    )


def range_options(df: DataFrame, day: str, amount: str) -> DataFrame:
    """First and last calendar day, lowest and highest amount."""
    df = with_dates(df, day)
    c, x = quoted(day), quoted(amount).cast("double")
    return df.agg(
        F.min(c).cast("date").alias("first_day"),
        F.max(c).cast("date").alias("last_day"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
    )


def preview(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` rows by ``keys``; Spark rows have no order of their own."""
    return df.orderBy(*[quoted(k).asc() for k in keys]).limit(n)


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of the key: the same rows on every run and any partitioning."""
    ticket = F.md5(F.concat(quoted(key).cast("string"), F.lit(str(seed))))
    return df.where(quoted(key).isNotNull()).orderBy(ticket, quoted(key)).limit(n)


def fraction_sample(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """A repeatable share of the rows by key hash, without a sort; for samples of any size."""
    slots = 1_000_000
    return df.where(F.pmod(F.xxhash64(quoted(key), F.lit(seed)), F.lit(slots)) < int(fraction * slots))


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in numeric_columns(df)])


def text_only(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in text_columns(df)])
