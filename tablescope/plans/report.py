"""The tables of a business report, without page layout.

Sections with several parts come as ``part, rank, label, value, extra``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.numbers import percent, quoted, total
from ..functions.order import written
from ..functions.quantiles import quantiles
from ..operators import aggs, kpi, stats, timeseries
from ..operators.profile import completeness
from ..operators.roles import Roles
from .answers import _shape


def _part(name: str, frame: DataFrame) -> DataFrame:
    return frame.select(F.lit(name).alias("part"), "rank", "label", "value", "extra")


def _ranked(top: DataFrame, extra=None, descending: bool = True) -> DataFrame:
    return _shape(aggs.ranked(top, descending), F.col("rank"), F.col("key"), F.col("value"), extra)


def summary(df: DataFrame, r: Roles) -> DataFrame:
    """``item, value``: size, completeness and the headline figures that exist."""
    items = [
        "total_rows", "total_columns", "completeness_pct", "total_revenue", "total_orders", "average_order_value",
        "unique_customers", "unique_products", "unique_regions",
    ]
    row = kpi.kpis(df, r).select(*[F.col(i).cast("double").alias(i) for i in items])
    return row.unpivot([], items, "item", "value").where("value is not null")


def revenue(df: DataFrame, r: Roles) -> DataFrame:
    """Totals; the top region with its share; five regions and five products.

    The few columns that count are written once, so the table itself is read once.
    """
    df = written(df.select(*[quoted(c) for c in dict.fromkeys([r.sales, r.region, r.product]) if c]), "revenue")
    x = quoted(r.sales)
    median = quantiles(df, {"x": x}, [0.5])["x"].quantiles[0.5]
    facts = df.agg(total(x).alias("total"), numbers.mean(x).alias("mean")).withColumn("median", F.lit(median).cast("double"))
    figures = facts.unpivot([], ["total", "mean", "median"], "label", "value")
    out = _part("figures", _shape(figures, F.lit(None), F.col("label"), F.col("value")))
    if r.region:
        grouped = aggs.by_group(df, r.region, r.sales)
        whole = df.agg(total(x)).scalar()
        best = aggs.ranked(aggs.ordered(grouped).limit(1)).withColumn("whole", whole)
        out = out.unionByName(_part("top region", _shape(best, F.col("rank"), F.col("key"), F.col("value"), percent(F.col("value"), F.col("whole")))))
        out = out.unionByName(_part("regions", _ranked(aggs.ordered(grouped).limit(5))))
    if r.product:
        out = out.unionByName(_part("products", _ranked(aggs.top_groups(df, r.product, r.sales, n=5))))
    return out


def customers(df: DataFrame, r: Roles) -> DataFrame:
    """Distinct customers, share of the top five, the top five."""
    count = df.agg(F.count_distinct(quoted(r.customer)).alias("n"))
    out = _part("figures", _shape(count, F.lit(None), F.lit("unique customers"), F.col("n")))
    if r.sales:
        share = aggs.top_share(df, r.customer, r.sales, 5)
        out = out.unionByName(_part("figures", _shape(share, F.lit(None), F.lit("top 5 share"), F.col("share_pct"))))
        out = out.unionByName(_part("customers", _ranked(aggs.top_groups(df, r.customer, r.sales, n=5))))
    return out


def products(df: DataFrame, r: Roles) -> DataFrame:
    """Distinct products, the most frequent one, the top five by units."""
    count = df.agg(F.count_distinct(quoted(r.product)).alias("n"))
    out = _part("figures", _shape(count, F.lit(None), F.lit("unique products"), F.col("n")))
    out = out.unionByName(_part("most frequent", _ranked(aggs.value_counts(df, r.product, 1))))
    if r.quantity:
        out = out.unionByName(_part("units", _ranked(aggs.top_groups(df, r.product, r.quantity, n=5))))
    return out


def regions(df: DataFrame, r: Roles) -> DataFrame:
    """Top three with whole percentages, the lowest, and up to 15 regions with shares."""
    grouped = aggs.by_group(df, r.region, r.sales)
    whole = grouped.agg(total(F.col("value"))).scalar()

    def shares(n, places):
        rows = aggs.ranked(aggs.ordered(grouped).limit(n)).withColumn("whole", whole)
        return _shape(rows, F.col("rank"), F.col("key"), F.col("value"), percent(F.col("value"), F.col("whole"), places))

    lowest = _ranked(aggs.ordered(grouped, descending=False).limit(1), descending=False)
    return (
        _part("top", shares(3, 0)).unionByName(_part("lowest", lowest)).unionByName(_part("regions", shares(15, 1)))
    )


def trends(df: DataFrame, r: Roles) -> DataFrame:
    """Peak, trough, last change with its direction, and the first 14 months."""
    months = timeseries.changes(timeseries.monthly(df, r.date, r.sales))
    # One row per month: windows over all of them are small, and one reading of the table serves all parts.
    everywhere = Window.partitionBy()
    high = F.min(F.struct((-F.col("revenue")).alias("score"), "month")).over(everywhere)["month"]
    low = F.min(F.struct(F.col("revenue").alias("score"), "month")).over(everywhere)["month"]
    marked = months.withColumn("high", high).withColumn("low", low)

    def row(when, name, rank, label, value):
        cells = F.struct(
            F.lit(name).alias("part"), rank.cast("long").alias("rank"), label.alias("label"), value.alias("value"),
            F.lit(None).cast("double").alias("extra"),
        )
        return F.when(when, cells)

    c, none = F.col, F.lit(None)
    long_name, short_name = F.date_format("month", "MMMM yyyy"), F.date_format("month", "MMM yyyy")
    parts = F.array(
        row(c("month") == c("high"), "peak", none, long_name, c("revenue")),
        row(c("month") == c("low"), "trough", none, long_name, c("revenue")),
        row((c("age") == 1) & c("change").isNotNull(), "change", none, c("direction"), c("change")),
        row(c("place") <= 14, "months", c("place"), short_name, c("revenue")),
    )
    return marked.select(F.inline(F.array_compact(parts)))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The six strongest pairs."""
    return stats.ranked_pairs(df, 6, columns)


def recommendations(df: DataFrame, r: Roles) -> DataFrame:
    """``advice, subject, value``: only what the figures support."""

    def advice(frame, kind, subject, value, when=None):
        kept = frame if when is None else frame.where(when)
        return kept.select(F.lit(kind).alias("advice"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))

    whole = completeness(df)
    pct = F.col("completeness_pct")
    out = advice(whole, "improve data collection", F.lit("(dataset)"), pct, pct < 95)
    if r.region and r.sales:
        grouped = aggs.by_group(df, r.region, r.sales)
        best = aggs.ordered(grouped).limit(1).withColumn("whole", grouped.agg(total(F.col("value"))).scalar())
        out = out.unionByName(advice(best, "prioritise region", F.col("key"), percent(F.col("value"), F.col("whole"), 0)))
        worst = aggs.ordered(grouped, descending=False).limit(1)
        out = out.unionByName(advice(worst, "investigate region", F.col("key"), F.col("value")))
    if r.product and r.sales:
        best = aggs.extreme_group(df, r.product, r.sales)
        out = out.unionByName(advice(best, "protect supply", F.col("key"), F.col("value")))
    if r.customer and r.sales:
        share = aggs.top_share(df, r.customer, r.sales, 5)
        held = F.col("share_pct")
        out = out.unionByName(advice(share, "retain top customers", F.lit("top 5"), held, held > 20))
    return out
