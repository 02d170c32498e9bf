"""The data behind charts, without the drawing, one by one or for a whole table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import numeric_columns, percent, quoted
from ..operators import aggs, stats, timeseries
from ..operators.roles import Roles
from .answers import NO_PARAM, _shape
from .lookup import ANSWER, expanded
from .tagging import tag_charts


# Fixed value: the most boxes that a chart shows side by side.
MOST_BOXES = 20


def trend(df: DataFrame, r: Roles) -> DataFrame:
    """``month, revenue, ma3``."""
    return timeseries.moving_average(timeseries.monthly(df, r.date, r.sales))


def growth_bars(df: DataFrame, r: Roles) -> DataFrame:
    """``month, mom_growth`` of the months that have a growth figure."""
    series = timeseries.growth(timeseries.monthly(df, r.date, r.sales))
    return series.where("mom_growth is not null").select("month", "mom_growth")


def top_bars(df: DataFrame, group: str, value: str | None, n: int = 10, ascending: bool = False) -> DataFrame:
    """``rank, key, value``: top or bottom groups by sum, by frequency without a measure."""
    if value is None:
        ascending = False
    return aggs.ranked_groups(df, group, value, n, not ascending)


def pie(df: DataFrame, group: str, value: str, n: int = 8) -> DataFrame:
    """``rank, key, value, share_pct``: top groups with their share of the shown groups."""
    return aggs.with_shown_share(aggs.ranked(aggs.top_groups(df, group, value, n=n)))


def average_bars(df: DataFrame, group: str, value: str, n: int = 15) -> DataFrame:
    return aggs.ranked(aggs.top_groups(df, group, value, "mean", n))


def frequency_bars(df: DataFrame, group: str, n: int = 15) -> DataFrame:
    return aggs.ranked(aggs.value_counts(df, group, n))


def frequency_pie(df: DataFrame, group: str, n: int = 10) -> DataFrame:
    return aggs.with_shown_share(frequency_bars(df, group, n))


def funnel(df: DataFrame, group: str, value: str, n: int = 8) -> DataFrame:
    """``rank, key, value, pct_of_first``."""
    steps = aggs.ranked(aggs.top_groups(df, group, value, n=n))
    return steps.withColumn("pct_of_first", percent(F.col("value"), F.max("value").over(Window.partitionBy())))


def region_share(df: DataFrame, r: Roles) -> DataFrame:
    """Every region with its share of the whole."""
    return aggs.with_share(aggs.by_group(df, r.region, r.sales))


def _split(r: Roles) -> str | None:
    return r.region or r.product or r.customer


def _box_split(df: DataFrame, r: Roles) -> str | None:
    """The category of a box chart; none, so one box for all rows, if it has more values than a chart can show."""
    by = _split(r)
    if by and df.where(quoted(by).isNotNull()).select(quoted(by)).distinct().limit(MOST_BOXES + 1).count() > MOST_BOXES:
        return None
    return by


def _chart_rows(df: DataFrame, r: Roles, intent: str, n: int, ascending: bool, key: str | None) -> DataFrame | None:
    """One chart as ``rank, label, value, extra``; None when the table lacks a needed column."""
    if intent == "trend" and r.date and r.sales:
        series = trend(df, r)
        return _shape(series, F.row_number().over(timeseries.by_month()), F.col("month"), F.col("revenue"), F.col("ma3"))
    group = {"top_customers": r.customer, "top_products": r.product, "top_regions": r.region}.get(intent)
    if group:
        return _shape(top_bars(df, group, r.sales, n, ascending), F.col("rank"), F.col("key"), F.col("value"))
    if intent == "pie" and (r.product or _split(r)) and r.sales:
        return _shape(pie(df, r.product or _split(r), r.sales), F.col("rank"), F.col("key"), F.col("value"), F.col("share_pct"))
    if intent == "histogram" and r.sales:
        # Edges are rounded once, for the label: 52950.295000000006 is 52,950.30, but 52,950.29 if rounded to 52950.295 first.
        bars = stats.histogram(df, r.sales, 30, places=None)
        return _shape(bars, F.col("bin") + 1, F.format_number("low", 2), F.col("n"), F.col("high"))
    if intent == "correlation" and len(numeric_columns(df)) > 1:
        cells = stats.correlation_matrix(df)
        return _shape(cells, F.lit(None), F.concat_ws(" ~ ", "col_a", "col_b"), F.col("r"))
    if intent == "scatter" and len([c for c in numeric_columns(df) if c != key]) > 1:
        if key is None:
            # Equal rows have equal keys, so it does not matter which of them are drawn.
            key, texts = "_row", [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in df.columns]
            df = df.withColumn(key, F.md5(F.concat_ws("\x1f", *texts)))
        x, y = [c for c in numeric_columns(df) if c != key][:2]
        points = stats.scatter_points(df, key, x, y, _split(r))
        return _shape(points, F.lit(None), quoted(_split(r)) if _split(r) else F.lit(None), quoted(x), quoted(y))
    if intent == "box" and r.sales:
        boxes = stats.box_stats(df, r.sales, _box_split(df, r))
        parts = ["whisker_low", "q1", "median", "q3", "whisker_high"]
        cells = boxes.select("category", F.posexplode(F.array(*[F.col(p).cast("double") for p in parts])).alias("at", "value"), "outliers")
        return _shape(cells, F.col("at") + 1, F.col("category"), F.col("value"), F.col("outliers"))
    if intent == "avg_bar" and _split(r) and r.sales:
        return _shape(average_bars(df, _split(r), r.sales), F.col("rank"), F.col("key"), F.col("value"))
    if intent == "customer_freq" and r.customer:
        return _shape(frequency_bars(df, r.customer), F.col("rank"), F.col("key"), F.col("value"))
    return None


def chart_tables(
    questions: DataFrame, facts: DataFrame, roles: Roles, *, id_column: str = "question_id", text_column: str = "question",
    sample_key: str | None = None, whole_words: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(tags, charts) as in :func:`tablescope.plans.answers.answer_tables`; ``param`` of a ranking is 1 from the bottom, 0 from the top.

    Each kind and direction of chart is computed once, rankings up to the largest N asked for. Without ``sample_key``
    the points of a scatter chart are drawn by a hash of the whole row.
    """
    tagged = tag_charts(questions, text_column, whole_words).select(quoted(id_column).alias("id"), "intent", "n", "ascending")
    ranking = F.col("intent").startswith("top_")
    tagged = tagged.withColumn("param", F.when(ranking, F.col("ascending").cast("double")).otherwise(NO_PARAM))
    charts = facts.sparkSession.createDataFrame([], ANSWER)
    status = F.lit("charted")
    for row in tagged.groupBy("intent", "param").agg(F.max("n").alias("n")).collect():
        intent, param = row["intent"], row["param"]
        made = _chart_rows(facts, roles, intent, row["n"], param == 1, sample_key)
        if made is None:
            status = F.when(F.col("intent") == intent, {"empty": "no question", "unknown": "not understood"}.get(intent, "no fitting column")).otherwise(status)
            continue
        if intent == "box" and _split(roles) and not _box_split(facts, roles):
            status = F.when(F.col("intent") == intent, f"charted, one box for more than {MOST_BOXES} values").otherwise(status)
        charts = charts.unionByName(made.withColumns({"intent": F.lit(intent), "param": F.lit(param)}))
    return tagged.select("id", "intent", "param", F.when(ranking, F.col("n")).alias("most"), status.alias("status")), charts


def chart_questions(questions: DataFrame, facts: DataFrame, roles: Roles, **options) -> DataFrame:
    """``id, intent, status, rank, label, value, extra``: the chart data of every question; options as for :func:`chart_tables`."""
    return expanded(*chart_tables(questions, facts, roles, **options))
