"""Findings about a table: rules over small per-column frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import numeric_columns, percent, quoted, text_columns
from ..functions.order import written
from ..functions.text import strip
from ..operators.evidence import value_pairs
from ..operators.profile import completeness
from ..operators.stats import notable_pairs, numeric_insight
from ..session import intermediate


def _label_counts(df: DataFrame) -> DataFrame:
    """``column, value, n`` over the stripped values of the text columns."""
    names = text_columns(df)
    texts = df.select(*[strip(quoted(c).cast("string")).alias(c) for c in names])
    return value_pairs(texts).where("value is not null")


def _most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent values per column; each task keeps only its own best before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def categorical_insight(df: DataFrame) -> DataFrame:
    """Per text column: distinct values, rows, most frequent value and share, top ten, concentration."""
    counts = _label_counts(df)
    whole = counts.groupBy("column").agg(F.count("value").alias("unique_count"), F.sum("n").alias("total"))
    top = _most_frequent(counts, 10).groupBy("column").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("top_value"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("top_count"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))), lambda s: F.concat_ws("=", s["value"], s["n"].cast("string"))),
            "; ",
        ).alias("top_10"),
    )
    share = percent(F.col("top_count"), F.col("total"))
    variety = F.col("unique_count") / F.col("total")
    concentration = (
        F.when(variety > 0.9, "highly unique").when(share > 60, "dominated by one category")
        .when(share > 30, "moderately concentrated").otherwise("well distributed")
    )
    return whole.join(F.broadcast(top), "column").select(
        "column", "unique_count", "total", "top_value", share.alias("top_pct"), "top_10", concentration.alias("concentration")
    )


def top_values(df: DataFrame, n: int = 5) -> DataFrame:
    """``column, rank, value, n`` for every text column."""
    return _most_frequent(_label_counts(df), n).select("column", F.col("rank").cast("long").alias("rank"), "value", "n")


def dataset_summary(df: DataFrame) -> DataFrame:
    return completeness(df).select(
        "rows",
        F.lit(len(df.columns)).cast("long").alias("cols"),
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_count"),
        F.lit(len(text_columns(df))).cast("long").alias("categorical_count"),
        "completeness_pct",
    )


def completeness_band(df: DataFrame) -> DataFrame:
    pct = F.col("completeness_pct")
    band = F.when(pct >= 98, "excellent").when(pct >= 90, "good").when(pct >= 75, "moderate").otherwise("low")
    return completeness(df).select("completeness_pct", band.alias("band"))


def findings_numeric(df: DataFrame, columns: list[str] | None = None, insight: DataFrame | None = None) -> DataFrame:
    """Per numeric column the notes that apply, as flags."""
    frame = insight if insight is not None else numeric_insight(df, columns)
    gap = F.abs(F.col("mean") - F.col("median")) / F.greatest(F.abs("median"), F.lit(1.0))
    return frame.select(
        "column", "min", "max", "mean", "median", "skew_label", "outliers", "cv",
        (F.col("outliers") > 0).alias("has_outliers"),
        F.coalesce(F.col("cv") > 100, F.lit(False)).alias("high_variability"),
        F.coalesce(F.col("cv") < 15, F.lit(False)).alias("low_variability"),
        (gap > 0.2).alias("mean_median_apart"),
    )


def findings_categorical(df: DataFrame, insight: DataFrame | None = None) -> DataFrame:
    frame = insight if insight is not None else categorical_insight(df)
    imbalance = F.col("top_pct") > 80
    return frame.select(
        "column", "unique_count", "concentration", "top_value", "top_pct",
        imbalance.alias("imbalance"), (~imbalance & (F.col("unique_count") > 50)).alias("high_cardinality"),
    )


def findings_correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The notable pairs; ``redundant`` marks the strong ones."""
    return notable_pairs(df, columns).withColumn("redundant", F.col("strength").isin("very strong", "strong"))


def _finding(frame: DataFrame, when: Column, kind: str, subject: Column, value: Column) -> DataFrame:
    return frame.where(when).select(F.lit(kind).alias("finding"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))


def findings_anomalies(df: DataFrame, columns: list[str] | None = None, stored: bool = False) -> DataFrame:
    """``finding, subject, value``; a single "none" row when nothing stands out. Unless ``stored`` as files, the table is read once and written for the passes."""
    if not stored:
        with intermediate(df.sparkSession):
            return findings_anomalies(written(df, "findings"), columns, stored=True)
    numeric, texts, whole = numeric_insight(df, columns), categorical_insight(df), completeness(df)
    c = F.col
    share = F.round(c("outliers") / c("count") * 100, 1)
    found = (
        _finding(numeric, share > 10, "many outliers", c("column"), share)
        .unionByName(_finding(numeric, c("std") == 0, "no variance", c("column"), c("std")))
        .unionByName(_finding(numeric, (c("min") < 0) & F.lower("column").contains("price"), "negative price", c("column"), c("min")))
        .unionByName(_finding(texts, (c("top_pct") > 95) & (c("unique_count") > 1), "almost one value", c("column"), c("top_pct")))
        .unionByName(_finding(whole, c("completeness_pct") < 80, "low completeness", F.lit("(dataset)"), c("completeness_pct")))
    )
    return _or_none(found)


def findings_recommendations(df: DataFrame, columns: list[str] | None = None, stored: bool = False) -> DataFrame:
    """``finding, subject, value``: what to look at next; a single "none" row when the table is ready. Reads the table as :func:`findings_anomalies` does."""
    if not stored:
        with intermediate(df.sparkSession):
            return findings_recommendations(written(df, "findings"), columns, stored=True)
    numeric, texts, whole = numeric_insight(df, columns), categorical_insight(df), completeness(df)
    strong = findings_correlation(df, columns).where("redundant")
    c = F.col
    width = len(columns or numeric_columns(df))
    found = (
        _finding(numeric, c("outliers") > 0, "investigate outliers", c("column"), c("outliers"))
        .unionByName(_finding(numeric, F.abs("skew") > 1, "transform skewed column", c("column"), c("skew")))
        .unionByName(_finding(texts, c("unique_count") > 50, "group many categories", c("column"), c("unique_count")))
        .unionByName(_finding(strong, F.lit(True), "drop a redundant column", F.concat_ws(" ~ ", "col_a", "col_b"), c("r")))
        .unionByName(_finding(whole, F.lit(width >= 3), "review correlations", F.lit("(dataset)"), F.lit(width)))
        .unionByName(_finding(whole, c("completeness_pct") < 95, "review missing values", F.lit("(dataset)"), c("completeness_pct")))
    )
    return _or_none(found)


def _or_none(found: DataFrame) -> DataFrame:
    """The findings, made once, or one "none" row; decided from their number, which is a few per column."""
    found = written(found, "found", outside=True)
    nothing = found.sparkSession.createDataFrame([("none", None, None)], "finding string, subject string, value double")
    return nothing if found.limit(1).count() == 0 else found
