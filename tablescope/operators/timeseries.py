"""Monthly series. Only the first step reads the table; the rest works on one row per month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.dates import month_end, month_label, with_dates
from ..functions.numbers import quoted, total
from ..functions.quantiles import quantiles
from .aggs import extreme_group, require


def by_month() -> WindowSpec:
    """Ordered by month: used on one row per calendar month only, never on the table."""
    return Window.orderBy("month")


def monthly(df: DataFrame, day: str, value: str) -> DataFrame:
    """``month, revenue``: sum per calendar month, months without rows filled with 0. Dates may be text."""
    require(df, day, value)
    sums = (
        with_dates(df, day).where(quoted(day).isNotNull())
        .groupBy(month_end(quoted(day)).alias("month"))
        .agg(total(quoted(value)).alias("made"))
    )
    # Each month also stands for the empty months up to the next one, so the table is read only once.
    start = F.trunc("month", "month")
    until = F.coalesce(F.add_months(F.trunc(F.lead("month").over(by_month()), "month"), -1), start)
    spans = sums.select("month", "made", F.sequence(start, until, F.expr("interval 1 month")).alias("starts"))
    filled = spans.select("month", "made", F.explode("starts").alias("start")).withColumn("end", F.last_day("start"))
    return filled.select(
        F.col("end").alias("month"), F.when(F.col("end") == F.col("month"), F.col("made")).otherwise(0.0).alias("revenue")
    )


def moving_average(series: DataFrame, months: int = 3) -> DataFrame:
    return series.withColumn("ma3", F.avg("revenue").over(by_month().rowsBetween(1 - months, 0)))


def growth(series: DataFrame) -> DataFrame:
    """Change on the month before in percent; NULL for the first month and after a zero month."""
    before = F.lag("revenue").over(by_month())
    return series.withColumn("mom_growth", F.try_divide(F.col("revenue") - before, before) * 100)


def trend(df: DataFrame, day: str, value: str) -> DataFrame:
    """``month, revenue, ma3, mom_growth``."""
    return growth(moving_average(monthly(df, day, value)))


def changes(series: DataFrame) -> DataFrame:
    """Add ``change`` on the month before (NULL for the first), ``direction``, and the place from either end."""
    change = F.col("revenue") - F.lag("revenue").over(by_month())
    return series.select(
        "month", "revenue", change.alias("change"),
        F.when(change > 0, "up").otherwise("down").alias("direction"),
        F.row_number().over(by_month()).alias("place"),
        F.row_number().over(Window.orderBy(F.desc("month"))).alias("age"),
    )


def latest_delta(series: DataFrame) -> DataFrame:
    """One row: last month, its revenue, change on the month before (0 without one) and direction."""
    return changes(series).where("age = 1").select(
        "month", "revenue", F.coalesce("change", F.lit(0.0)).alias("delta"), "direction"
    )


def last_months(series: DataFrame, n: int = 6) -> DataFrame:
    return (
        series.orderBy(F.desc("month")).limit(n)
        .withColumn("label", month_label(F.col("month")))
        .orderBy("month")
    )


def peak_and_trough(series: DataFrame) -> DataFrame:
    """First month of the highest and of the lowest revenue: ``kind, month, revenue``."""
    ends = series.agg(
        F.min(F.struct((-F.col("revenue")).alias("score"), "month", "revenue")).alias("high"),
        F.min(F.struct(F.col("revenue").alias("score"), "month", "revenue")).alias("low"),
    ).where("high is not null")
    return ends.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(f"{end}.month").alias("month"), F.col(f"{end}.revenue").alias("revenue"))
        for kind, end in (("peak", "high"), ("trough", "low"))
    ])))


def forecast(series: DataFrame) -> DataFrame:
    """Mean of the last three months plus half the last change; no row below two months."""
    age = series.orderBy(F.desc("month")).limit(3).withColumn("age", F.row_number().over(Window.orderBy(F.desc("month"))))
    last, previous = (F.max(F.when(F.col("age") == k, F.col("revenue"))) for k in (1, 2))
    return (
        age.agg(F.avg("revenue").alias("recent_mean"), (last - previous).alias("change"), F.count(F.lit(1)).alias("months"))
        .where("months >= 2")
        .select("recent_mean", "change", (F.col("recent_mean") + F.col("change") * 0.5).alias("forecast"))
    )


def median_instant(df: DataFrame, day: str):
    """Exact median of a date column in microseconds since 1970 (UTC)."""
    micros = F.unix_micros(quoted(day).cast("timestamp"))
    return quantiles(df, {"at": micros}, [0.5])["at"].quantiles[0.5]


def half_changes(df: DataFrame, group: str, day: str, value: str) -> DataFrame:
    """Per group: revenue up to and after the median date and the change. One pass after the median."""
    require(df, group, day, value)
    df = with_dates(df, day)
    middle = median_instant(df, day)
    early = F.unix_micros(quoted(day).cast("timestamp")) <= F.lit(middle)
    x = quoted(value)
    return (
        df.where(quoted(group).isNotNull() & quoted(day).isNotNull())
        .groupBy(quoted(group).alias("key"))
        .agg(
            total(F.when(early, x)).alias("first_half"),
            total(F.when(~early, x)).alias("second_half"),
            F.count_if(early).alias("n_first"),
            F.count_if(~early).alias("n_second"),
        )
        .where("n_first > 0 and n_second > 0")
        .select("key", "first_half", "second_half", (F.col("second_half") - F.col("first_half")).alias("value"))
    )


def declining_group(df: DataFrame, group: str, value: str, day: str | None) -> DataFrame:
    """The group with the most negative change; without dates the group with the lowest total."""
    if day is None:
        return extreme_group(df, group, value, highest=False)
    return half_changes(df, group, day, value).orderBy(F.asc("value"), F.asc("key")).limit(1).select("key", "value")
