"""Distributions, correlations, histograms and box statistics, always over all rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import adjusted_skew, blank_nan, correlation, numeric_columns, quoted, text_columns
from ..functions.products import correlations
from ..functions.quantiles import grouped_quantiles, quantiles
from .aggs import by_group, require
from .filters import hash_sample

# Pairs that are aggregates of one row at most.
MOST_PAIRS = 400
BOX_PROBS = [0.25, 0.5, 0.75]


def fences(q1: float | None, q3: float | None, guard: bool) -> tuple[float, float] | None:
    """Tukey fences; with ``guard`` a zero spread has none."""
    if q1 is None or (guard and q3 == q1):
        return None
    reach = 1.5 * (q3 - q1)
    return q1 - reach, q3 + reach


def outside(c: Column, bounds: tuple[float, float] | None) -> Column:
    if bounds is None:
        return F.lit(False)
    return (c < bounds[0]) | (c > bounds[1])


def numeric_summary(df: DataFrame, columns: dict[str, Column], skew: bool = True) -> list[dict]:
    """Moments, quartiles and outlier counts of several columns: three or four passes for all of them.

    The result is one small record per column. Columns without values are left out; so is the skew (NULL) where it is not asked for.
    """
    found = quantiles(df, columns, BOX_PROBS)
    made, present = [], []
    for i, (name, c) in enumerate(columns.items()):
        summary = found[name]
        if summary.count == 0:
            continue
        present.append((i, name, summary))
        x = F.col(f"x{i}")
        loose = fences(summary.quantiles[0.25], summary.quantiles[0.75], guard=False)
        made += [
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            (adjusted_skew(x) if skew else F.lit(None).cast("double")).alias(f"skew{i}"),
            F.count_if(outside(x, loose)).alias(f"out{i}"),
        ]
    # The columns are computed once per row, then shared by their aggregates.
    slim = df.select(*[columns[name].cast("double").alias(f"x{i}") for i, name, _ in present])
    row = slim.agg(*made).first() if made else None
    return [
        {
            "column": name,
            "count": s.count,
            "mean": row[f"mean{i}"],
            "median": s.quantiles[0.5],
            "std": row[f"std{i}"],
            "min": s.low,
            "max": s.high,
            "q1": s.quantiles[0.25],
            "q3": s.quantiles[0.75],
            "skew": row[f"skew{i}"],
            "outliers_unguarded": row[f"out{i}"],
            "outliers": row[f"out{i}"] if s.quantiles[0.25] != s.quantiles[0.75] else 0,
        }
        for i, name, s in present
    ]


SUMMARY_SCHEMA = (
    "column string, count long, mean double, median double, std double, min double, max double, "
    "q1 double, q3 double, skew double, outliers_unguarded long, outliers long"
)


def summary_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``numeric_summary`` of the numeric columns as a frame of one row per column."""
    clean = blank_nan(df)
    names = columns or numeric_columns(clean)
    rows = numeric_summary(clean, {c: quoted(c) for c in names}) if names else []
    order = [f.split()[0] for f in SUMMARY_SCHEMA.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[k] for k in order) for r in rows], SUMMARY_SCHEMA)


def distribution_metrics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    rounded = ["mean", "median", "std", "min", "max", "q1", "q3", "skew"]
    frame = summary_frame(df, columns)
    return frame.select("column", "count", *[F.round(c, 4).alias(c) for c in rounded], "outliers")


def numeric_insight(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distribution metrics plus spread, skew label and variation; outliers without a spread guard."""
    frame = summary_frame(df, columns)
    skew = F.col("skew")
    label = (
        F.when(skew.isNull(), None)
        .when(F.abs(skew) < 0.5, "approximately symmetric")
        .when(skew > 1, "heavily right-skewed")
        .when(skew > 0.5, "slightly right-skewed")
        .when(skew < -1, "heavily left-skewed")
        .otherwise("slightly left-skewed")
    )
    rounded = ["mean", "median", "std", "min", "max", "q1", "q3"]
    return frame.select(
        "column",
        "count",
        *[F.round(c, 4).alias(c) for c in rounded],
        F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"),
        F.round(skew, 4).alias("skew"),
        label.alias("skew_label"),
        F.col("outliers_unguarded").alias("outliers"),
        F.round(F.try_divide(F.col("std"), F.col("mean")) * 100, 2).alias("cv"),
    )


def deciles(df: DataFrame, column: str) -> DataFrame:
    """One row: p10, p25, median, p75, p90, skew and its label."""
    require(df, column)
    clean = blank_nan(df)
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    found = quantiles(clean, {column: quoted(column)}, probs)[column].quantiles
    skew = F.col("skew")
    label = F.when(skew > 0.5, "right-skewed").when(skew < -0.5, "left-skewed").when(skew.isNotNull(), "approximately symmetric")
    names = ["p10", "p25", "median", "p75", "p90"]
    return clean.agg(adjusted_skew(quoted(column)).alias("skew")).select(
        *[F.lit(found[p]).cast("double").alias(n) for p, n in zip(probs, names)], "skew", label.alias("skew_label")
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``col_a, col_b, r`` for every pair of numeric columns, ``col_a`` before ``col_b`` in the table.

    One scan. The pairs of a few columns are aggregates of one row; those of wide tables are products of column
    blocks, merged by block, and never come to the driver.
    """
    clean = blank_nan(df)
    names = columns or numeric_columns(clean)
    pairs = list(combinations(names, 2))
    if len(pairs) > MOST_PAIRS:
        return correlations(clean, names)
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    made = [correlation(quoted(a), quoted(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    rows = [(a, b, r) for (a, b), r in zip(pairs, clean.agg(*made).first())]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The full square in long form, rounded to 3 places; the diagonal is 1 unless the column is constant."""
    clean = blank_nan(df)
    names = columns or numeric_columns(clean)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    upper = correlation_pairs(clean, names)
    lower = upper.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    varied = clean.agg(*[(F.min(quoted(c)) < F.max(quoted(c))).alias(f"v{i}") for i, c in enumerate(names)]).first()
    ones = df.sparkSession.createDataFrame(
        [(c, c, 1.0 if v else None) for c, v in zip(names, varied)], "col_a string, col_b string, r double"
    )
    return upper.unionByName(lower).unionByName(ones).withColumn("r", F.round("r", 3))


def strength(r: Column, limits=(0.8, 0.6, 0.4)) -> Column:
    size = F.abs(r)
    return (
        F.when(size > limits[0], "very strong").when(size > limits[1], "strong").when(size > limits[2], "moderate").otherwise("weak")
    )


def direction(r: Column) -> Column:
    return F.when(r > 0, "positive").otherwise("negative")


def ranked_pairs(df: DataFrame, n: int, columns: list[str] | None = None) -> DataFrame:
    """The ``n`` strongest pairs with strength and sign."""
    r = F.col("r")
    return (
        correlation_pairs(df, columns)
        .withColumn("r", F.round("r", 3))
        .where("r is not null")
        .orderBy(F.abs(r).desc(), "col_a", "col_b")
        .limit(n)
        .select("col_a", "col_b", "r", strength(r).alias("strength"), direction(r).alias("direction"))
    )


def notable_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairs with an absolute r of at least 0.2, in bands that include their lower limit."""
    size = F.abs("r")
    band = F.when(size >= 0.8, "very strong").when(size >= 0.6, "strong").when(size >= 0.4, "moderate").otherwise("weak")
    return (
        correlation_pairs(df, columns)
        .where(size >= 0.2)
        .select("col_a", "col_b", F.round("r", 2).alias("r"), band.alias("strength"), direction(F.col("r")).alias("direction"))
    )


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None, places: int | None = 4) -> DataFrame:
    """Equal-width bins: ``bin, low, high, n`` (and ``category``); empty bins are included. Without ``places`` the edges are not rounded.

    The range is a scalar subquery and the bins partially aggregate, so one row per bin is shuffled.
    """
    require(df, column, *([by] if by else []))
    x = quoted(column).cast("double")
    clean = blank_nan(df).where(quoted(column).isNotNull())
    if by:
        clean = clean.where(quoted(by).isNotNull())
    edges = clean.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    at = F.floor(F.try_divide((x - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    placed = clean.withColumn("lo", lo).withColumn("hi", hi).select(
        *([quoted(by).cast("string").alias("category")] if by else []),
        F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin"),
    )
    keys = ["category", "bin"] if by else ["bin"]
    counted = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("counted"))
    if by:
        slots = counted.select("category").distinct()
    else:
        slots = edges.where("lo is not null").select(F.lit(0).alias("zero"))
    spine = slots.select(*(["category"] if by else []), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    filled = spine.join(counted, keys, "left").withColumn("lo", lo).withColumn("hi", hi)
    width = (F.col("hi") - F.col("lo")) / bins
    low, high = F.col("lo") + width * F.col("bin"), F.col("lo") + width * (F.col("bin") + 1)
    return filled.select(
        *keys,
        (low if places is None else F.round(low, places)).alias("low"),
        (high if places is None else F.round(high, places)).alias("high"),
        F.coalesce("counted", F.lit(0)).cast("long").alias("n"),
    )


def small_category(df: DataFrame, most: int = 15) -> str | None:
    """The first text column with at most ``most`` distinct values."""
    for name in text_columns(df):
        seen = df.select(quoted(name)).where(quoted(name).isNotNull()).distinct().limit(most + 1).count()
        if seen <= most:
            return name
    return None


def histogram_by_category(df: DataFrame, column: str, bins: int = 25, category: str | None = None) -> DataFrame:
    return histogram(df, column, bins, category or small_category(df))


def box_stats(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Quartiles, whisker ends and outlier count, overall or for every value of ``by``."""
    require(df, column, *([by] if by else []))
    clean = blank_nan(df)
    x = quoted(column).cast("double")
    if by:
        # One row per value of ``by``; Spark broadcasts it only while it is small.
        found = grouped_quantiles(clean, quoted(by).cast("string"), x, BOX_PROBS)
        edges = found.select(F.col("g").alias("category"), F.col("p0").alias("q1"), F.col("p1").alias("median"), F.col("p2").alias("q3"))
        width = F.col("q3") - F.col("q1")
        boxes = edges.select("*", (F.col("q1") - width * 1.5).alias("low_fence"), (F.col("q3") + width * 1.5).alias("high_fence"))
    else:
        s = quantiles(clean, {"x": x}, BOX_PROBS)["x"]
        q1, q2, q3 = (s.quantiles[p] for p in BOX_PROBS)
        rows = [(None, q1, q2, q3, *fences(q1, q3, guard=False))] if s.count else []
        boxes = F.broadcast(df.sparkSession.createDataFrame(rows, "category string, q1 double, median double, q3 double, low_fence double, high_fence double"))
    slim = clean.where(x.isNotNull()).select((quoted(by).cast("string") if by else F.lit("")).alias("k"), x.alias("x"))
    inside = F.when(F.col("x").between(F.col("low_fence"), F.col("high_fence")), F.col("x"))
    return (
        slim.join(boxes, F.col("k") == F.coalesce("category", F.lit("")))
        .groupBy("category", "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(inside).alias("whisker_low"),
            F.max(inside).alias("whisker_high"),
            F.count_if(inside.isNull()).alias("outliers"),
        )
    )


def group_total_box(df: DataFrame, group: str, value: str) -> DataFrame:
    """Box statistics of the per-group totals."""
    return box_stats(by_group(df, group, value), "value")


def outlier_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values outside the fences per numeric column; 0 below four values or with zero spread."""
    frame = summary_frame(df, columns)
    return frame.select("column", F.when(F.col("count") < 4, 0).otherwise(F.col("outliers")).cast("long").alias("outliers"))


def normalised_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every numeric value scaled to 0..1 by its column's range, as ``column, normalised``."""
    clean = blank_nan(df)
    names = columns or numeric_columns(clean)
    made = [f(quoted(c).cast("double")).alias(f"{w}{i}") for i, c in enumerate(names) for w, f in (("lo", F.min), ("hi", F.max))]
    row = clean.agg(*made).first()
    scaled = [
        ((quoted(c).cast("double") - F.lit(row[f"lo{i}"])) / (F.lit(row[f"hi{i}"]) - F.lit(row[f"lo{i}"]) + 1e-9)).alias(c)
        for i, c in enumerate(names)
    ]
    return clean.select(*scaled).unpivot([], names, "column", "normalised")


def normalised_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column the distribution of its scaled values, the input of a violin plot."""
    clean = blank_nan(df)
    names = columns or numeric_columns(clean)
    found = {r["column"]: r for r in numeric_summary(clean, {c: quoted(c) for c in names})}
    rows = []
    for name, r in found.items():
        scale = lambda v: (v - r["min"]) / (r["max"] - r["min"] + 1e-9)  # noqa: B023, E731
        rows.append((name, r["count"], scale(r["q1"]), scale(r["median"]), scale(r["q3"]), scale(r["mean"])))
    return df.sparkSession.createDataFrame(rows, "column string, n long, q1 double, median double, q3 double, mean double")


def scatter_points(df: DataFrame, key: str, x: str, y: str, category: str | None = None, n: int = 10_000) -> DataFrame:
    """Two numeric columns of a repeatable sample, with an optional category."""
    wanted = [c for c in (key, x, y, category) if c]
    require(df, *wanted)
    return hash_sample(df.select(*[quoted(c) for c in wanted]), n, key)
