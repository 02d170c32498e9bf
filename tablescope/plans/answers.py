"""Answers to named business questions, one by one or for a whole table of questions.

Every answer is a frame ``rank, label, value, extra``; each function says what ``extra`` holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.dates import month_label
from ..functions.numbers import quoted, total
from ..functions.order import dealt, prefix_sums, written
from ..operators import aggs, stats, timeseries
from ..operators.roles import Roles
from .lookup import ANSWER, expanded
from .tagging import tag_answers

def _shape(df: DataFrame, rank: Column, label: Column, value: Column, extra: Column | None = None, *keys: str) -> DataFrame:
    return df.select(
        *keys, rank.cast("long").alias("rank"), label.cast("string").alias("label"), value.cast("double").alias("value"),
        (F.lit(None) if extra is None else extra).cast("double").alias("extra"),
    )


def _listed(top: DataFrame, descending: bool = True) -> DataFrame:
    return _shape(aggs.ranked(top, descending), F.col("rank"), F.col("key"), F.col("value"))


def _ranked(top: DataFrame) -> DataFrame:
    return _shape(top, F.col("rank"), F.col("key"), F.col("value"))


def _single(df: DataFrame, label: str, made: Column, extra: Column | None = None) -> DataFrame:
    columns = [made.alias("value")] + ([extra.alias("extra")] if extra is not None else [])
    row = df.agg(*columns)
    return _shape(row, F.lit(1), F.lit(label), F.col("value"), F.col("extra") if extra is not None else None)


def total_revenue(df, r: Roles):
    return _single(df, "total", total(quoted(r.sales)))


def average_price(df, r: Roles):
    return _single(df, "mean", numbers.mean(quoted(r.sales)))


def highest_city(df, r: Roles):
    return _listed(aggs.extreme_group(df, r.region, r.sales))


def lowest_city(df, r: Roles):
    return _listed(aggs.extreme_group(df, r.region, r.sales, highest=False))


def highest_product(df, r: Roles):
    return _listed(aggs.extreme_group(df, r.product, r.sales))


def sales_by_city(df, r: Roles):
    """Every city; a full listing carries no rank."""
    listing = aggs.ordered(aggs.by_group(df, r.region, r.sales))
    return _shape(listing, F.lit(None), F.col("key"), F.col("value"))


def revenue_by_product(df, r: Roles):
    return _listed(aggs.top_groups(df, r.product, r.sales, n=5))


def total_quantity(df, r: Roles):
    return _single(df, "total", total(quoted(r.quantity)))


def average_order_value(df, r: Roles):
    """Mean per row; the headline figures divide by distinct orders instead."""
    return _single(df, "mean", numbers.mean(quoted(r.sales)))


def top_n_customers(df, r: Roles, n: int = 5):
    """By revenue; by number of rows when there is no measure."""
    return _ranked(aggs.ranked_groups(df, r.customer, r.sales, n))


def correlation(df, r: Roles, columns: list[str] | None = None):
    """The five strongest pairs."""
    order = Window.orderBy(F.abs("r").desc(), "col_a", "col_b")
    label = F.concat_ws(" ", F.concat_ws(" ~ ", "col_a", "col_b"), "strength", "direction")
    return _shape(stats.ranked_pairs(df, 5, columns), F.row_number().over(order), label, F.col("r"))


def sales_trend(df, r: Roles):
    """The last six months, then the change of the last one with its direction."""
    recent = timeseries.changes(timeseries.monthly(df, r.date, r.sales)).where("age <= 6")
    shown = F.least(F.col("place") + F.col("age") - 1, F.lit(6))
    month = F.struct((shown - F.col("age") + 1).alias("rank"), month_label(F.col("month")).alias("label"), F.col("revenue").alias("value"))
    change = F.struct(F.lit(7).alias("rank"), F.col("direction").alias("label"), F.coalesce("change", F.lit(0.0)).alias("value"))
    rows = recent.select(F.inline(F.array_compact(F.array(month, F.when(F.col("age") == 1, change)))))
    return _shape(rows, F.col("rank"), F.col("label"), F.col("value"))


def declining_region(df, r: Roles):
    return _listed(timeseries.declining_group(df, r.region, r.sales, r.date), descending=False)


def most_frequent_product(df, r: Roles):
    return _listed(aggs.value_counts(df, r.product, 5))


def unique_customers(df, r: Roles):
    """``extra`` is the number of rows."""
    return _single(df, "distinct", F.count_distinct(quoted(r.customer)), F.count(F.lit(1)))


def spend_curve(df, r: Roles) -> DataFrame:
    """``key, value, rank, upto``: customers by falling revenue, with the revenue of all up to each.

    Ranks and sums are prefix sums over ranges of the totals, so no task sees all customers.
    """
    spend = aggs.by_group(df, r.customer, r.sales)
    order = [F.desc_nulls_last("value"), F.asc("key")]
    sums = {"rank": F.lit(1).cast("bigint"), "upto": F.coalesce(F.col("value"), F.lit(0))}
    return written(prefix_sums(dealt(spend, order, "spend"), order, sums).select("key", "value", "rank", "upto"), "spend-curve")


def percentile_shares(curve: DataFrame, percents: DataFrame) -> DataFrame:
    """``pct, rank, label, value, extra`` for every ``pct``, however many there are, by looking its rank up in the curve."""
    whole = curve.agg(F.count("*").alias("n"), total(F.col("value")).cast("double").alias("sum"))
    count, all_spend = whole.select("n").scalar(), whole.select("sum").scalar()
    cuts = percents.select("pct", count.alias("_count"), all_spend.alias("_all")).withColumn("_n", F.greatest(F.lit(1), F.floor(F.col("_count") * F.col("pct") / 100)))
    held = cuts.withColumn("rank", F.least("_n", "_count")).join(curve.select("rank", F.col("upto").cast("double").alias("upto")), "rank")
    share = F.when(F.col("_all") > 0, F.try_divide("upto", "_all") * 100).otherwise(0.0)
    heads = _shape(held, F.lit(0), F.lit("share"), share, F.col("_n"), "pct")
    first = cuts.select("pct", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("_n", F.lit(5)))).alias("rank"))
    listed = first.join(curve.where("rank <= 5").select("rank", "key", "value"), "rank")
    return heads.unionByName(_shape(listed, F.col("rank"), F.col("key"), F.col("value"), None, "pct"))


def top_percentile_customers(df, r: Roles, pct: float = 5.0):
    """Rank 0: the share of revenue held by the top ``pct`` percent (``extra``: how many); then the top five."""
    asked = df.sparkSession.createDataFrame([(float(pct),)], "pct double")
    return percentile_shares(spend_curve(df, r), asked).drop("pct")


def revenue_share(df, r: Roles):
    """Top five of the product column (else the region column); ``extra`` is the percentage of the whole."""
    grouped = aggs.by_group(df, r.product or r.region, r.sales)
    whole = grouped.agg(F.sum("value")).scalar()
    top = aggs.ranked(aggs.ordered(grouped).limit(5)).withColumn("whole", whole)
    return _shape(top, F.col("rank"), F.col("key"), F.col("value"), numbers.percent(F.col("value"), F.col("whole")))


def sales_distribution(df, r: Roles):
    """Five percentiles and the skew, whose label names the shape."""
    row = stats.deciles(df, r.sales)
    parts = [("p10", "p10"), ("p25", "p25"), ("median", "median"), ("p75", "p75"), ("p90", "p90")]
    items = [F.struct(F.lit(i).alias("rank"), F.lit(n).alias("label"), F.col(c).alias("value")) for i, (n, c) in enumerate(parts, 1)]
    items.append(F.struct(F.lit(6).alias("rank"), F.col("skew_label").alias("label"), F.col("skew").alias("value")))
    return _shape(row.select(F.inline(F.array(*items))), F.col("rank"), F.col("label"), F.col("value"))


def top_categories(df, r: Roles, n: int = 5):
    return _ranked(aggs.ranked_groups(df, r.product or r.region, r.sales, n))


def forecast_next_month(df, r: Roles):
    row = timeseries.forecast(timeseries.monthly(df, r.date, r.sales))
    items = [
        F.struct(F.lit(i).alias("rank"), F.lit(c).alias("label"), F.col(c).alias("value"))
        for i, c in enumerate(["recent_mean", "change", "forecast"], 1)
    ]
    return _shape(row.select(F.inline(F.array(*items))), F.col("rank"), F.col("label"), F.col("value"))


# Intent, function, roles it cannot do without, and the parameter it takes from the question.
ANSWERS = {
    "total_revenue": (total_revenue, ["sales"], None),
    "average_price": (average_price, ["sales"], None),
    "highest_sales_city": (highest_city, ["region", "sales"], None),
    "lowest_sales_city": (lowest_city, ["region", "sales"], None),
    "highest_selling_product": (highest_product, ["product", "sales"], None),
    "sales_by_city": (sales_by_city, ["region", "sales"], None),
    "revenue_by_product": (revenue_by_product, ["product", "sales"], None),
    "total_quantity_sold": (total_quantity, ["quantity"], None),
    "average_order_value": (average_order_value, ["sales"], None),
    "top_n_customers": (top_n_customers, ["customer"], "n"),
    "correlation": (correlation, [], None),
    "sales_trend": (sales_trend, ["date", "sales"], None),
    "declining_region": (declining_region, ["region", "sales"], None),
    "most_frequent_product": (most_frequent_product, ["product"], None),
    "unique_customer_count": (unique_customers, ["customer"], None),
    "top_percentile_customers": (top_percentile_customers, ["customer", "sales"], "pct"),
    "revenue_share_category": (revenue_share, ["sales"], None),
    "sales_distribution": (sales_distribution, ["sales"], None),
    "top_categories": (top_categories, [], "n"),
    "forecast_next_month": (forecast_next_month, ["date", "sales"], None),
}


#: The parameter of questions without one.
NO_PARAM = -1.0


def _missing(roles: Roles, needs: list[str]) -> list[str]:
    return [n for n in needs if getattr(roles, n) is None]


def answer_tables(
    questions: DataFrame, facts: DataFrame, roles: Roles, *, id_column: str = "question_id", text_column: str = "question",
    columns: list[str] | None = None, whole_words: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(tags, answers): what each question asks for, and every answer once.

    ``tags``: ``id, intent, param, most, status``; its answer is the rows of ``answers`` (``intent, param, rank, label,
    value, extra``) with the same intent and parameter, up to rank ``most``. Rankings go up to the largest N asked for;
    the shares of all percentages come from one curve. The driver sees one row per intent.
    """
    tagged = tag_answers(questions, text_column, whole_words).select(quoted(id_column).alias("id"), "intent", "n", "pct")
    asked = {row["intent"]: row["n"] for row in tagged.groupBy("intent").agg(F.max("n").alias("n")).collect()}
    answers = facts.sparkSession.createDataFrame([], ANSWER)
    status, param, most = F.lit("answered"), F.lit(NO_PARAM), F.lit(None).cast("bigint")
    for intent, n in sorted(asked.items()):
        is_it = F.col("intent") == intent
        if intent not in ANSWERS:
            status = F.when(is_it, "no question" if intent == "empty" else "not understood").otherwise(status)
            continue
        work, needs, takes = ANSWERS[intent]
        lacking = _missing(roles, needs)
        if lacking:
            status = F.when(is_it, f"no column for: {', '.join(lacking)}").otherwise(status)
            continue
        made = None
        if takes == "pct":
            percents = tagged.where(is_it).select("pct").distinct()
            made = percentile_shares(spend_curve(facts, roles), percents).withColumnRenamed("pct", "param")
            param = F.when(is_it, F.col("pct")).otherwise(param)
        elif takes == "n":
            made = work(facts, roles, n)
            most = F.when(is_it, F.col("n")).otherwise(most)
        else:
            made = work(facts, roles, columns) if intent == "correlation" else work(facts, roles)
        if "param" not in made.columns:
            made = made.withColumn("param", F.lit(NO_PARAM))
        answers = answers.unionByName(made.withColumn("intent", F.lit(intent)))
    return tagged.select("id", "intent", param.alias("param"), most.alias("most"), status.alias("status")), answers


def answer_questions(questions: DataFrame, facts: DataFrame, roles: Roles, **options) -> DataFrame:
    """``id, intent, status, rank, label, value, extra`` for every question; options as for :func:`answer_tables`.

    Empty and unknown questions get one row with a status and no answer. The result repeats an answer for each
    question that asks for it; :func:`answer_tables` gives both sides without that product.
    """
    return expanded(*answer_tables(questions, facts, roles, **options))
