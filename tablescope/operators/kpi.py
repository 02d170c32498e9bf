"""Headline figures of a sales table from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import blank_nan, percent, quoted
from .filters import Filter, apply_filter
from .roles import Roles
from .timeseries import changes, monthly


def role_totals(df: DataFrame, roles: Roles) -> DataFrame:
    """``role, key, revenue, units, rows, missing``: every order, customer, product and region.

    The role columns are turned into rows and summed map-side before the only shuffle. The role
    ``all`` carries the table totals, so one scan serves every headline figure.
    """
    clean = blank_nan(df)
    named = {r: getattr(roles, r) for r in ("order", "customer", "product", "region") if getattr(roles, r)}
    zero = F.lit(0).cast("decimal(18,2)")
    slim = clean.select(
        F.lit("").alias("all"),
        *[quoted(c).cast("string").alias(r) for r, c in named.items()],
        (quoted(roles.sales) if roles.sales else zero).alias("x"),
        (quoted(roles.quantity) if roles.quantity else zero).alias("u"),
        sum((quoted(c).isNull().cast("int") for c in clean.columns), F.lit(0)).alias("gaps"),
    )
    long = slim.unpivot(["x", "u", "gaps"], ["all", *named], "role", "key")
    return (
        long.where("key is not null").groupBy("role", "key")
        .agg(F.sum("x").alias("revenue"), F.sum("u").alias("units"), F.count(F.lit(1)).alias("rows"), F.sum("gaps").alias("missing"))
    )


def _of(role: str, value: Column) -> Column:
    return F.when(F.col("role") == role, value)


def _extreme(role: str, highest: bool = True) -> Column:
    """Struct ``score, key`` of the extreme group; equal sums give the smallest key."""
    money = F.coalesce(F.col("revenue"), F.lit(0))
    return F.min(_of(role, F.struct((-money if highest else money).alias("score"), F.col("key"))))


def kpis(df: DataFrame, roles: Roles) -> DataFrame:
    """One row of headline figures; figures whose role is absent are NULL."""
    width = len(df.columns)
    facts = role_totals(df, roles).agg(
        *[F.coalesce(F.max(_of("all", F.col(c))), F.lit(0)).alias(c) for c in ("rows", "missing")],
        F.coalesce(F.max(_of("all", F.col("revenue"))).cast("double"), F.lit(0.0)).alias("revenue"),
        *[F.count_if(F.col("role") == r).alias(r) for r in ("order", "customer", "product", "region")],
        _extreme("region").alias("best_region"),
        _extreme("product").alias("best_product"),
    )
    orders = F.col("order") if roles.order else F.col("rows")
    filled = 1 - F.try_divide(F.col("missing").cast("double"), F.greatest(F.col("rows") * width, F.lit(1)).cast("double"))

    def given(role, value):
        return value if getattr(roles, role) else F.lit(None).cast("long")

    def money(value):
        return value if roles.sales else F.lit(None).cast("double")

    def best(role, part):
        return part if roles.sales and getattr(roles, role) else F.lit(None)

    return facts.select(
        F.col("rows").alias("total_rows"),
        F.lit(width).cast("long").alias("total_columns"),
        F.round(filled * 100, 1).alias("completeness_pct"),
        money(F.col("revenue")).alias("total_revenue"),
        money(F.try_divide(F.col("revenue"), F.greatest(orders, F.lit(1)).cast("double"))).alias("average_order_value"),
        orders.alias("total_orders"),
        *[given(r, F.col(r)).alias(f"unique_{r}s") for r in ("customer", "product", "region")],
        best("region", F.col("best_region.key")).cast("string").alias("top_region"),
        best("region", -F.col("best_region.score").cast("double")).cast("double").alias("top_region_revenue"),
        best("product", F.col("best_product.key")).cast("string").alias("top_product"),
        best("product", -F.col("best_product.score").cast("double")).cast("double").alias("top_product_revenue"),
        *[
            F.lit(getattr(roles, r)).cast("string").alias(f"{r}_column")
            for r in ("sales", "quantity", "customer", "product", "order", "region", "date")
        ],
    )


def kpis_filtered(df: DataFrame, roles: Roles, wanted: Filter) -> DataFrame:
    """Headline figures of the rows that pass ``wanted``."""
    kept = apply_filter(df, wanted, region=roles.region, product=roles.product, day=roles.date, amount=roles.sales)
    return kpis(kept, roles)


def insight_cards(df: DataFrame, roles: Roles) -> DataFrame:
    """``card, label, value, extra``: best and worst groups, totals and the latest monthly change."""
    facts = role_totals(df, roles).agg(
        F.max(_of("all", F.col("rows"))).alias("rows"),
        F.max(_of("all", F.col("revenue"))).cast("double").alias("revenue"),
        F.max(_of("all", F.col("units"))).cast("double").alias("units"),
        F.sum(_of("region", F.col("revenue"))).cast("double").alias("regional"),
        _extreme("region").alias("top_region"),
        _extreme("region", highest=False).alias("low_region"),
        _extreme("product").alias("top_product"),
        _extreme("customer").alias("top_customer"),
    )
    nothing = F.lit(None).cast("double")

    def card(name, label, value, extra=nothing):
        return F.struct(
            F.lit(name).alias("card"), label.cast("string").alias("label"), value.cast("double").alias("value"),
            extra.cast("double").alias("extra"),
        )

    cards = []
    if roles.sales:
        cards.append(card("total_revenue", F.lit(None), F.col("revenue"), F.col("rows")))
    if roles.sales and roles.region:
        top = -F.col("top_region.score").cast("double")
        cards.append(card("top_region", F.col("top_region.key"), top, percent(top, F.col("regional"), 0)))
        cards.append(card("lowest_region", F.col("low_region.key"), F.col("low_region.score")))
    if roles.sales and roles.product:
        cards.append(card("best_product", F.col("top_product.key"), -F.col("top_product.score").cast("double")))
    if roles.sales and roles.customer:
        cards.append(card("top_customer", F.col("top_customer.key"), -F.col("top_customer.score").cast("double")))
    if roles.quantity:
        cards.append(card("total_units", F.lit(None), F.col("units")))
    shown = facts.select(F.inline(F.array(*cards)))
    if not (roles.date and roles.sales):
        return shown
    change = changes(monthly(df, roles.date, roles.sales)).where("age = 1 and change is not null").select(
        F.lit("latest_trend").alias("card"), F.col("direction").alias("label"), F.col("change").alias("value"), nothing.alias("extra")
    )
    return shown.unionByName(change)
