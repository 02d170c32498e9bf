"""Grouped and whole-table aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.numbers import percent, quoted, total
from ..functions.order import dealt, prefix_sums, written

#: Groups that are sorted in one task at most.
MOST_LISTED = 10_000
#: Rows whose values are told apart in one task, on average.
DISTINCT_AT_ONCE = 1_000_000


def require(df: DataFrame, *columns: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"no such column: {', '.join(map(repr, absent))}")


def measure(how: str, c: Column) -> Column:
    """The named aggregate; an unknown name means sum."""
    known = {
        "sum": total(c),
        "mean": numbers.mean(c),
        "count": F.count(c),
        "max": F.max(c).cast("double"),
        "min": F.min(c).cast("double"),
    }
    return known.get(how, known["sum"])


def by_group(df: DataFrame, group: str, value: str | None, how: str = "sum") -> DataFrame:
    """``key, value`` per non-missing group, unordered. Without a value column: row counts."""
    require(df, *[c for c in (group, value) if c])
    made = measure(how, quoted(value)) if value else F.count(F.lit(1))
    return (
        df.where(quoted(group).isNotNull())
        .groupBy(quoted(group).alias("key"))
        .agg(made.alias("value"))
    )


def ordered(grouped: DataFrame, descending: bool = True) -> DataFrame:
    """Sort by value, ties by key."""
    return grouped.orderBy(F.desc_nulls_last("value") if descending else F.asc_nulls_last("value"), F.asc("key"))


def top_groups(
    df: DataFrame, group: str, value: str | None, how: str = "sum", n: int = 15, descending: bool = True
) -> DataFrame:
    return ordered(by_group(df, group, value, how), descending).limit(n)


def ranked(top: DataFrame, descending: bool = True) -> DataFrame:
    """Add ``rank`` 1..n to an already limited ``key, value`` frame (a handful of rows)."""
    order = [F.desc_nulls_last("value") if descending else F.asc_nulls_last("value"), F.asc("key")]
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "key", "value")


def ranked_groups(df: DataFrame, group: str, value: str | None, n: int, descending: bool = True) -> DataFrame:
    """``rank, key, value`` of the first ``n`` groups. Long lists are ranked by prefix sums over ranges, so no task holds them whole."""
    if n <= MOST_LISTED:
        return ranked(top_groups(df, group, value, n=n, descending=descending), descending)
    order = [F.desc_nulls_last("value") if descending else F.asc_nulls_last("value"), F.asc("key")]
    places = prefix_sums(dealt(by_group(df, group, value), order, "groups"), order, {"rank": F.lit(1).cast("bigint")})
    return places.where(F.col("rank") <= n).select("rank", "key", "value")


def extreme_group(df: DataFrame, group: str, value: str, highest: bool = True) -> DataFrame:
    """Key and sum of the highest or lowest group; ties go to the smallest key."""
    return top_groups(df, group, value, n=1, descending=highest)


def totals(df: DataFrame, value: str) -> DataFrame:
    c = quoted(value)
    return df.agg(total(c).alias("total"), numbers.mean(c).alias("mean"), F.count(c).alias("n"))


def distinct_values(df: DataFrame, column: str, at_once: int = DISTINCT_AT_ONCE) -> DataFrame:
    """``value``: the distinct values of one column, NULL left out, of a table stored as files.

    Values are dealt by hash to as many tasks as the rows need, so what one task holds does not grow with the table.
    """
    values = df.select(quoted(column).alias("value")).where("value IS NOT NULL")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // at_once))
    return values.repartition(parts, "value").distinct()


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Distinct non-missing values per column as ``column, distinct_count``."""
    require(df, *columns)
    if approx:
        made = [F.approx_count_distinct(quoted(c)).alias(c) for c in columns]
        return df.agg(*made).unpivot([], columns, "column", "distinct_count")
    texts = df.select(*[quoted(c).cast("string").alias(c) for c in columns])
    return (
        texts.unpivot([], columns, "column", "value")
        .groupBy("column")
        .agg(F.count_distinct("value").alias("distinct_count"))
    )


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """``key, value`` = value and its frequency, most frequent first."""
    counted = ordered(by_group(df, column, None))
    return counted if n is None else counted.limit(n)


def with_share(grouped: DataFrame, name: str = "share_pct", places: int = 1) -> DataFrame:
    """Add each value's percentage of the total of the frame.

    The total is a scalar subquery over the grouped rows, so no window gathers all groups.
    """
    whole = grouped.agg(F.sum(F.col("value").cast("double"))).scalar()
    return grouped.withColumn(name, percent(F.col("value"), whole, places))


def with_shown_share(top: DataFrame, name: str = "share_pct") -> DataFrame:
    """Add each value's percentage of the shown rows, for a frame already limited to a handful of rows."""
    return top.withColumn(name, percent(F.col("value"), F.sum(F.col("value").cast("double")).over(Window.partitionBy())))


def top_share(df: DataFrame, group: str, value: str, n: int = 5) -> DataFrame:
    """One row: sum of the top ``n`` groups, of all groups, and the percentage."""
    grouped = by_group(df, group, value)
    whole = grouped.agg(total(F.col("value"))).scalar()
    return (
        ordered(grouped).limit(n)
        .agg(total(F.col("value")).alias("top_total"))
        .withColumn("grand_total", whole)
        .withColumn("share_pct", percent(F.col("top_total"), F.col("grand_total")))
    )


def two_measures(df: DataFrame, group: str, first: str, second: str, n: int = 10) -> DataFrame:
    """Two sums per group, top ``n`` by the first."""
    require(df, group, first, second)
    return (
        df.where(quoted(group).isNotNull())
        .groupBy(quoted(group).alias("key"))
        .agg(total(quoted(first)).alias("value"), total(quoted(second)).alias("second"))
        .orderBy(F.desc("value"), F.asc("key"))
        .limit(n)
    )


def pair_sums(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    require(df, outer, inner, value)
    return (
        df.where(quoted(outer).isNotNull() & quoted(inner).isNotNull())
        .groupBy(quoted(outer).alias("outer"), quoted(inner).alias("inner"))
        .agg(F.sum(quoted(value)).alias("part"))
    )


def hierarchy(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Sums per pair plus totals per outer key and overall: ``outer, inner, level, value``.

    The pairs are summed first, so the rollup expands the small pair frame and not the table.
    Level 0 is a pair, 1 an outer total, 3 the grand total.
    """
    return (
        pair_sums(df, outer, inner, value)
        .rollup("outer", "inner")
        .agg(F.grouping_id().cast("long").alias("level"), total(F.col("part")).alias("value"))
    )


def heatmap(df: DataFrame, rows: str, columns: str, value: str, top_rows: int = 8, top_columns: int = 6) -> DataFrame:
    """Top rows by total, then top columns within those rows; one wide row per row key.

    The column names are at most ``top_columns`` values, read first because a pivot needs them.
    """
    pairs = pair_sums(df, rows, columns, value)
    best_rows = (
        pairs.groupBy("outer").agg(total(F.col("part")).alias("value"))
        .orderBy(F.desc("value"), F.asc("outer")).limit(top_rows).select("outer")
    )
    kept = pairs.join(best_rows, "outer", "left_semi")
    best_columns = [
        r["inner"]
        for r in kept.groupBy("inner").agg(total(F.col("part")).alias("value"))
        .orderBy(F.desc("value"), F.asc("inner")).limit(top_columns).collect()
    ]
    wide = kept.groupBy("outer").pivot("inner", best_columns).agg(F.sum("part").cast("double"))
    return wide.fillna(0.0, subset=best_columns)


def heatmap_cells(df: DataFrame, rows: str, columns: str, value: str, top_rows: int = 8, top_columns: int = 6) -> DataFrame:
    """The heat-map as ``row_key, column_key, value``; empty cells hold 0. The table is read once, and nothing comes to the driver."""
    pairs = written(pair_sums(df, rows, columns, value), "pairs")
    best = lambda frame, key, n: frame.groupBy(key).agg(total(F.col("part")).alias("value")).orderBy(F.desc("value"), F.asc(key)).limit(n)
    best_rows = best(pairs, "outer", top_rows).select("outer")
    kept = pairs.join(best_rows, "outer", "left_semi")
    # A handful of names, repeated in every row.
    names = best(kept, "inner", top_columns).agg(F.collect_list("inner").alias("names")).scalar()
    grid = kept.select("outer").distinct().select("outer", F.explode(names).alias("inner"))
    return grid.join(kept, ["outer", "inner"], "left").select(
        F.col("outer").alias("row_key"), F.col("inner").alias("column_key"), F.coalesce(F.col("part").cast("double"), F.lit(0.0)).alias("value")
    )

