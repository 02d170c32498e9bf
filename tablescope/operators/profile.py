"""Column and table profiles and quality scores."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import NUMERIC_TYPES, blank_nan, percent, quoted
from ..functions.text import parse_number
from ..functions.order import written
from ..session import intermediate
from .evidence import column_evidence, distinct_counts, label_variants
from .stats import SUMMARY_SCHEMA, numeric_summary


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``rows, duplicate_rows``; missing values count as equal."""
    return _row_facts(df).select("rows", "duplicate_rows")


def _row_facts(df: DataFrame) -> DataFrame:
    """One row: rows, duplicate rows, missing cells, from one scan.

    Rows meet as two 64-bit hashes through one partially aggregated shuffle, so cells are not
    shuffled and a row copied very often does not fill one task.
    """
    frame = blank_nan(df)
    # Hashes pass over NULL, so each column is joined by whether it is one.
    parts = [x for c in frame.columns for x in (quoted(c), quoted(c).isNull())]
    gaps = sum((quoted(c).isNull().cast("long") for c in frame.columns), F.lit(0).cast("long"))
    hashed = frame.select(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"), gaps.alias("gaps"))
    copies = hashed.groupBy("a", "b", "gaps").agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("copies") - F.count(F.lit(1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("gaps") * F.col("copies")), F.lit(0)).alias("total_missing"),
    )


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, cells, missing cells, percentage complete. One scan, no shuffle of rows."""
    frame = blank_nan(df)
    width = len(frame.columns)
    missing = sum((F.count_if(quoted(c).isNull()) for c in frame.columns), F.lit(0))
    rows = F.count(F.lit(1))
    share = F.try_divide(missing.cast("double"), F.greatest(rows * width, F.lit(1)).cast("double"))
    return frame.agg(
        rows.alias("rows"),
        (rows * width).alias("cells"),
        missing.cast("long").alias("missing_cells"),
        F.round((1 - share) * 100, 1).alias("completeness_pct"),
    )


def profile_columns(df: DataFrame, stored: bool = False) -> DataFrame:
    """One row per column: evidence, inferred type and, for numeric columns, statistics.

    The passes do not depend on the number of columns: patterns, distinct counts, spellings of the
    category columns, and for the numeric ones a rank sketch, the ranks and the moments. Unless
    the table is ``stored`` as files already, it is written once, and the passes read that copy, which is deleted at the end. Only
    per-column records come to the driver, where the inferred types choose which columns get
    statistics; the returned frame is built from them and costs nothing to reuse.
    """
    if not stored:
        with intermediate(df.sparkSession):
            return profile_columns(written(df, "profile"), stored=True)
    spark = df.sparkSession
    evidence = column_evidence(df, stored=True)
    rows = evidence.collect()
    numeric = {}
    for r in rows:
        if r["inferred_type"] in ("integer", "float"):
            numeric[r["column"]] = parse_number(quoted(r["column"])) if r["label"] == "string" else quoted(r["column"])
    summaries = _summaries(df, numeric) if numeric else []
    order = [f.split()[0] for f in SUMMARY_SCHEMA.split(", ")]
    stats = spark.createDataFrame([tuple(s[k] for k in order) for s in summaries], SUMMARY_SCHEMA)
    facts = spark.createDataFrame(rows, evidence.schema)
    labelled = [r["column"] for r in rows if r["label"] == "string" and r["inferred_type"] in ("categorical", "boolean")]
    spellings = label_variants(df, labelled).collect() if labelled else []
    variants = spark.createDataFrame(spellings, "column string, plain_labels long, folded_labels long")
    total, missing = F.col("rows"), F.col("missing_count")
    distinct_with_null = F.col("unique_count") + F.when(missing > 0, 1).otherwise(0)
    joined = facts.join(F.broadcast(stats), "column", "left").join(F.broadcast(variants), "column", "left")
    return joined.select(
        *facts.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("plain_labels", "folded_labels")],
        F.coalesce(percent(missing, total), F.lit(0.0)).alias("missing_pct"),
        F.coalesce(percent(total - missing, total), F.lit(0.0)).alias("completeness_pct"),
        (distinct_with_null <= 1).alias("is_constant"),
        (missing == total).alias("is_empty"),
        *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")],
        F.col("min").alias("min"),
        F.col("max").alias("max"),
        F.when(F.col("count") < 4, 0).otherwise(F.col("outliers")).alias("outliers"),
    )


def _summaries(df: DataFrame, numeric: dict[str, Column]) -> list[dict]:
    """:func:`numeric_summary` of columns; numbers that are held as text are parsed and written once, for all its passes."""
    if all(isinstance(df.schema[c].dataType, NUMERIC_TYPES) for c in numeric):
        return numeric_summary(blank_nan(df), numeric, skew=False)
    with intermediate(df.sparkSession):
        parsed = written(blank_nan(df).select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(numeric.values())]), "numbers")
        return numeric_summary(parsed, {name: F.col(f"x{i}") for i, name in enumerate(numeric)}, skew=False)


# The public profile table; the frame above also carries the evidence the issue rules read.
PROFILE_COLUMNS = [
    "column", "raw_type", "inferred_type", "missing_count", "missing_pct", "unique_count", "completeness_pct",
    "is_constant", "is_empty", "mean", "median", "std", "min", "max",
]


def profile_dataset(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate rows, missing cells."""
    width = F.lit(len(df.columns)).cast("long")
    return _row_facts(df).select("rows", width.alias("columns"), "duplicate_rows", "total_missing")


def smallest_values(df: DataFrame, most: int = 3) -> DataFrame:
    """``column, values``: the ``most`` smallest values of each column as text, in byte order.

    Each task keeps that many of every column while its batches pass, so a row per column, task and place is shuffled.
    """
    frame = blank_nan(df)
    names = frame.columns

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        least = [pa.array([], pa.string()) for _ in names]
        for batch in batches:
            for i, column in enumerate(batch.columns):
                if len(least[i]) == most:
                    column = column.filter(pc.less(column, least[i][-1]))
                found = pc.unique(pa.concat_arrays([least[i], column.cast(pa.string())])).drop_null()
                least[i] = found.take(pc.array_sort_indices(found))[:most]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.to_pylist() for x in least], pa.list_(pa.string()))], names=["column", "values"])

    texts = frame.select(*[quoted(c).cast("string").alias(f"x{i}") for i, c in enumerate(names)])
    kept = texts.mapInArrow(keep, "column string, values array<string>").select("column", F.explode("values").alias("value")).distinct()
    first = Window.partitionBy("column").orderBy("value")
    ranked = kept.withColumn("at", F.row_number().over(first)).where(F.col("at") <= most)
    return ranked.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))


def column_summary(df: DataFrame) -> DataFrame:
    """Missing, distinct and complete figures per column and its three smallest values as text; nothing for a table without rows."""
    frame = blank_nan(df)
    rows, names = F.count(F.lit(1)), frame.columns
    counts = frame.agg(rows.alias("rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)]).where("rows > 0")
    counted = counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("rows").alias("rows"), (F.col("rows") - F.col(f"n{i}")).alias("missing_count")) for i, c in enumerate(names)
    ])))
    smallest = smallest_values(df).select("column", F.array_join("values", ", ").alias("sample"))
    return counted.join(distinct_counts(df), "column", "left").join(smallest, "column", "left").select(
        "column",
        "missing_count",
        percent(F.col("missing_count"), F.col("rows")).alias("missing_pct"),
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
        percent(F.col("rows") - F.col("missing_count"), F.col("rows")).alias("completeness_pct"),
        F.substring(F.coalesce("sample", F.lit("")), 1, 60).alias("sample_values"),
    )


def quality_label(score: Column) -> Column:
    return F.when(score >= 80, "Good").when(score >= 60, "Fair").when(score >= 40, "Poor").otherwise("Critical")


def _score(df: DataFrame, raw: Column) -> DataFrame:
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw, 0))).cast("long")
    return df.withColumn("score", F.when(F.col("rows") > 0, score).otherwise(F.lit(0))).select(
        "score", F.when(F.col("rows") > 0, quality_label(F.col("score"))).otherwise("No Data").alias("label")
    )


def _penalised(table: DataFrame) -> DataFrame:
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1)).cast("double")
    duplicates = F.try_divide(F.col("duplicate_rows").cast("double"), F.greatest("rows", F.lit(1)).cast("double"))
    return table.withColumn("base", 100 - F.col("total_missing") / cells * 40 - duplicates * 20)


def quality_score(df: DataFrame) -> DataFrame:
    """0-100 from missing cells, duplicate rows and constant columns, with a label."""
    frame = blank_nan(df)
    constants = [F.coalesce(F.min(quoted(c)) == F.max(quoted(c)), F.lit(True)).cast("int") for c in frame.columns]
    constant = frame.agg(sum(constants, F.lit(0)).alias("constant")).scalar()
    table = _penalised(profile_dataset(df)).withColumn("constant", constant)
    return _score(table, F.col("base") - F.col("constant") * 5)


def quality_score_from_issues(df: DataFrame, issues: DataFrame) -> DataFrame:
    """0-100 from missing cells, duplicate rows and the number of High and Medium issues."""
    return score_of_issues(profile_dataset(df), issues)


def score_of_issues(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """:func:`quality_score_from_issues` of a table whose one row of facts is known."""
    high, medium = (issues.agg(F.count_if(F.col("severity") == s)).scalar() for s in ("High", "Medium"))
    table = _penalised(facts).withColumn("high", high).withColumn("medium", medium)
    return _score(table, F.col("base") - F.col("high") * 5 - F.col("medium") * 2)
