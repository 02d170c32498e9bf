"""Keyword tags for whole tables of business questions, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# The words that stand for each notion in a question to be answered.
ANSWER_WORDS = {
    "sales": ["sales", "revenue", "income", "earning", "turnover", "amount", "price", "value"],
    "highest": ["highest", "top", "most", "maximum", "max", "best", "greatest", "largest", "leading"],
    "lowest": ["lowest", "bottom", "least", "minimum", "min", "worst", "smallest", "weakest", "poor"],
    "average": ["average", "mean", "avg", "typical", "median"],
    "total": ["total", "sum", "overall", "aggregate", "combined", "all", "entire"],
    "city": ["city", "region", "location", "area", "zone", "place", "district", "state", "branch"],
    "product": ["product", "item", "goods", "merchandise", "sku", "category", "brand"],
    "customer": ["customer", "client", "buyer", "user", "consumer", "account", "purchaser"],
    "quantity": ["quantity", "units", "count", "volume", "pieces", "amount sold", "sold"],
    "trend": ["trend", "over time", "monthly", "daily", "weekly", "growth", "progress", "timeline"],
    "forecast": ["forecast", "predict", "next month", "projection", "future", "estimate", "expected"],
    "correlation": ["correlation", "relationship", "related", "depend", "link", "association", "between"],
    "distribution": ["distribution", "spread", "range", "histogram", "breakdown", "split"],
    "unique": ["unique", "distinct", "different", "how many"],
    "share": ["share", "percentage", "percent", "portion", "proportion", "contribution", "%"],
    "percentile": ["percentile", "top 5%", "top 10%", "elite", "vip", "premium", "top percent"],
    "declining": ["declining", "falling", "drop", "decrease", "worst performing", "underperform", "losing"],
    "frequent": ["frequent", "popular", "common", "mostly", "mainly", "often", "repeat"],
    "order": ["order", "transaction", "purchase", "deal", "invoice"],
    "order word": ["order"],
}

# Label and the notions a question must all touch; the first line that fits wins.
# A line names alternatives for one notion with "|".
ANSWER_LADDER = [
    ("forecast_next_month", ["forecast"]),
    ("correlation", ["correlation"]),
    ("declining_region", ["declining"]),
    ("top_percentile_customers", ["percentile"]),
    ("sales_trend", ["trend"]),
    ("sales_distribution", ["distribution"]),
    ("revenue_share_category", ["share", "product|city"]),
    ("unique_customer_count", ["unique", "customer"]),
    ("average_order_value", ["order", "average"]),
    ("total_quantity_sold", ["total", "quantity"]),
    ("total_revenue", ["total", "sales"]),
    ("average_price", ["average", "sales|order word"]),
    ("highest_sales_city", ["highest", "city"]),
    ("lowest_sales_city", ["lowest", "city"]),
    ("highest_selling_product", ["highest", "product"]),
    ("most_frequent_product", ["frequent", "product"]),
    ("revenue_by_product", ["sales", "product"]),
    ("sales_by_city", ["sales", "city"]),
    ("top_n_customers", ["customer", "highest"]),
    ("total_quantity_sold", ["quantity"]),
    ("unique_customer_count", ["customer"]),
    ("most_frequent_product", ["product"]),
    ("sales_by_city", ["city"]),
    ("total_revenue", ["sales|total"]),
    ("average_price", ["average"]),
]

# The same two tables for questions that ask for a chart.
CHART_WORDS = {
    "sales": ["revenue", "sales", "income", "amount", "price", "earning", "total", "spend"],
    "top": ["top", "best", "highest", "most", "leading", "greatest", "maximum", "rank"],
    "low": ["lowest", "worst", "least", "bottom", "minimum", "declining", "poor"],
    "average": ["average", "mean", "avg", "typical"],
    "trend": ["trend", "over time", "monthly", "time series", "growth", "timeline", "month"],
    "distribution": ["distribution", "spread", "histogram", "range", "frequency", "how many"],
    "correlation": ["correlation", "relationship", "heatmap", "related", "between", "matrix"],
    "pie": ["share", "pie", "proportion", "percentage", "contribution", "percent", "breakdown"],
    "customer": ["customer", "client", "buyer", "user", "consumer", "cust"],
    "product": ["product", "item", "goods", "sku", "merchandise", "category", "cat"],
    "region": ["city", "region", "state", "location", "area", "zone", "district", "place"],
    "box": ["box", "boxplot", "quartile", "outlier", "iqr", "median"],
    "scatter": ["scatter", "compare", "vs", "versus", "against", "plot"],
}
CHART_LADDER = [
    ("correlation", ["correlation"]),
    ("trend", ["trend"]),
    ("box", ["box"]),
    ("scatter", ["scatter"]),
    ("pie", ["pie"]),
    ("histogram", ["distribution"]),
    ("top_customers", ["top|low", "customer"]),
    ("top_products", ["top|low", "product"]),
    ("top_regions", ["top|low", "region"]),
    ("top_customers", ["customer", "sales"]),
    ("top_products", ["product", "sales"]),
    ("top_regions", ["region", "sales"]),
    ("avg_bar", ["average"]),
    ("customer_freq", ["customer"]),
    ("top_products", ["product"]),
    ("top_regions", ["region|sales"]),
]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def normalise(question: Column) -> Column:
    """Lower case, punctuation other than % to blanks, runs of white space to one blank."""
    letters = F.regexp_replace(strip(F.lower(question)), r"[^\p{L}\p{N}_\s%]", " ")
    return F.regexp_replace(letters, r"\s+", " ")


def _mentions(q: Column, words: list[str], whole_words: bool) -> Column:
    if whole_words:
        return q.rlike(r"(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])")
    hit = F.lit(False)
    for word in words:
        hit = hit | q.contains(word)
    return hit


def _tag(frame: DataFrame, words: dict, ladder: list, whole_words: bool) -> DataFrame:
    """Add ``intent`` from column ``q``. Each notion is looked up once per row, then the ladder reads flags."""
    flags = {notion: f"has {notion}" for notion in words}
    marked = frame.withColumns({flags[n]: _mentions(F.col("q"), w, whole_words) for n, w in words.items()})
    label = F.when(F.col("q").isNull() | (F.trim("q") == ""), "empty")
    for intent, notions in ladder:
        fits = F.lit(True)
        for choice in notions:
            fits = fits & F.greatest(*[F.col(f"`{flags[n]}`") for n in choice.split("|")], F.lit(False))
        label = label.when(fits, intent)
    return marked.withColumn("intent", label.otherwise("unknown")).drop(*flags.values())


def top_n(q: Column, default: int) -> Column:
    """The number after "top", as digits or as a word up to ten."""
    digits = F.regexp_extract(q, r"top\s+([0-9]+)", 1).try_cast("bigint")
    word = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for value, name in enumerate(NUMBER_WORDS, 1):
        word = word.when(q.contains(f"top {name}"), F.lit(value).cast("bigint"))
    return F.coalesce(digits, word, F.lit(default).cast("bigint"))


def top_percent(q: Column, default: float = 5.0) -> Column:
    return F.coalesce(F.regexp_extract(q, r"top\s+([0-9]+)\s*%", 1).try_cast("double"), F.lit(default))


def tag_answers(questions: DataFrame, text_column: str = "question", whole_words: bool = False) -> DataFrame:
    """Add ``q, intent, n, pct`` for the answer tables."""
    frame = questions.withColumn("q", normalise(F.col(text_column)))
    return _tag(frame, ANSWER_WORDS, ANSWER_LADDER, whole_words).withColumns({"n": top_n(F.col("q"), 5), "pct": top_percent(F.col("q"))})


def tag_charts(questions: DataFrame, text_column: str = "question", whole_words: bool = False) -> DataFrame:
    """Add ``q, intent, n, ascending`` for the chart tables."""
    frame = questions.withColumn("q", normalise(F.col(text_column)))
    low = F.coalesce(_mentions(F.col("q"), CHART_WORDS["low"], whole_words), F.lit(False))
    return _tag(frame, CHART_WORDS, CHART_LADDER, whole_words).withColumns({"n": top_n(F.col("q"), 10), "ascending": low})
