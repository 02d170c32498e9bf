"""Data-quality issues and cleaning suggestions, as rules over the column profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import written
from ..session import intermediate
from .profile import duplicate_rows, profile_columns, profile_dataset, score_of_issues

DATASET = "(dataset)"
ISSUE_FIELDS = "issue_at int, issue_type string, severity string, description string, affected_count bigint"


def _issue(at: int, when: Column, kind: str, severity, text: Column | str, affected: Column) -> Column:
    grade = F.lit(severity) if isinstance(severity, str) else severity
    words = F.lit(text) if isinstance(text, str) else text
    return F.when(
        when,
        F.struct(
            F.lit(at).alias("issue_at"),
            F.lit(kind).alias("issue_type"),
            grade.alias("severity"),
            words.alias("description"),
            affected.cast("long").alias("affected_count"),
        ),
    )


def _rules() -> list[Column]:
    """One expression per issue kind over a profile row; each is NULL where the issue is absent."""
    c = F.col
    present = c("rows") - c("missing_count")
    filled = ~c("is_empty")
    is_text = c("label") == "string"
    wordy = filled & c("inferred_type").isin("string", "categorical")
    category = filled & (c("inferred_type") == "categorical")
    numeric = filled & c("inferred_type").isin("integer", "float")
    dated = filled & is_text & (c("inferred_type") == "datetime")
    boolean = filled & (c("inferred_type") == "boolean")
    missing_grade = F.when(c("missing_pct") > 30, "High").when(c("missing_pct") > 5, "Medium").otherwise("Low")
    variants = c("plain_labels") - c("folded_labels")
    invalid = present - c("date_count")
    return [
        _issue(1, c("is_empty"), "Empty Column", "High", "No values.", c("rows")),
        _issue(2, filled & c("is_constant"), "Constant Column", "Medium", "One value only.", c("rows")),
        _issue(
            3, filled & (c("missing_count") > 0), "Missing Values", missing_grade,
            F.concat(c("missing_count").cast("string"), F.lit(" values missing.")), c("missing_count"),
        ),
        _issue(
            4, wordy & (c("padded_count") > 0), "Leading/Trailing Whitespace", "Low",
            F.concat(c("padded_count").cast("string"), F.lit(" values padded with white space.")), c("padded_count"),
        ),
        _issue(
            5, numeric & is_text, "Numeric Stored as String", "High", "Numbers held as text.",
            F.greatest(c("missing_count"), F.lit(1)),
        ),
        _issue(6, dated, "Date Stored as Text", "Medium", "Dates held as text.", present),
        _issue(
            7, boolean & (c("folded_labels") > 2), "Boolean Inconsistency", "Medium",
            F.concat(c("folded_labels").cast("string"), F.lit(" spellings of two truth values.")), present,
        ),
        _issue(
            8, category & (variants > 0), "Category Inconsistency", "Medium",
            F.concat(variants.cast("string"), F.lit(" labels differ by case only.")), variants,
        ),
        _issue(
            9, category & (c("unique_count") > 50), "High Cardinality Categorical", "Low",
            F.concat(c("unique_count").cast("string"), F.lit(" different labels.")), c("unique_count"),
        ),
        _issue(
            10, numeric & (c("outliers") > 0), "Outliers Detected (IQR)", "Medium",
            F.concat(c("outliers").cast("string"), F.lit(" values outside the quartile fences.")), c("outliers"),
        ),
        _issue(
            11, wordy & (c("special_count") > 0), "Special/Invisible Characters", "Low",
            F.concat(c("special_count").cast("string"), F.lit(" values with non-printable or accented characters.")),
            c("special_count"),
        ),
        _issue(
            12, dated & (invalid > 0), "Invalid Date Format", "Medium",
            F.concat(invalid.cast("string"), F.lit(" values are no dates.")), invalid,
        ),
    ]


@dataclass(frozen=True)
class Examined:
    """What is known of a table: the stored copy that all passes read, its columns, its size and gaps (one row), and its issues."""

    table: DataFrame
    columns: DataFrame
    facts: DataFrame
    issues: DataFrame

    def score(self) -> DataFrame:
        return score_of_issues(self.facts, self.issues)

    def steps(self) -> DataFrame:
        return suggest(self.columns, self.issues)


def examine(df: DataFrame, stored: bool = False) -> Examined:
    """Profile, issues and what follows from them, from one copy of the table (none, if it is ``stored`` as files already).

    Only per-column records come to the driver, so columns, facts and issues cost nothing to reuse; they outlive the copy.
    """
    table = df if stored else written(df, "examined")
    columns = profile_columns(table, stored=True)
    row = profile_dataset(table)
    facts = df.sparkSession.createDataFrame(row.collect(), row.schema)
    return Examined(table, columns, facts, detect_issues(table, columns, facts=facts))


def detect_issues(df: DataFrame, profile: DataFrame | None = None, stored: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """``column, issue_type, severity, description, affected_count`` plus ``position, issue_at`` for order; ``facts`` as :func:`profile_dataset` gives them."""
    if profile is None:
        if not stored:
            with intermediate(df.sparkSession):
                return examine(df).issues
        profile = profile_columns(df, stored=True)
    per_column = profile.select(
        "column", "position", F.explode(F.array_compact(F.array(*_rules()))).alias("issue")
    ).select("column", "position", "issue.*")
    dup = F.col("duplicate_rows")
    whole = (duplicate_rows(df) if facts is None else facts).where(dup > 0).select(
        F.lit(DATASET).alias("column"),
        F.lit(-1).alias("position"),
        F.lit(0).alias("issue_at"),
        F.lit("Duplicate Rows").alias("issue_type"),
        F.when(dup > 10, "High").otherwise("Medium").alias("severity"),
        F.concat(dup.cast("string"), F.lit(" rows repeat an earlier row.")).alias("description"),
        dup.cast("long").alias("affected_count"),
    )
    return whole.unionByName(per_column)


def issues_by_severity(issues: DataFrame) -> DataFrame:
    """All three severities with their number of issues."""
    counted = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    levels = issues.sparkSession.createDataFrame([("High",), ("Medium",), ("Low",)], "severity string")
    return levels.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# Rule number, issue that calls for it (None: a property of the column), inferred
# types it applies to (None: any), action, whether it is switched on, and what it does.
SUGGESTION_RULES = [
    (1, "Duplicate Rows", None, "remove_duplicates", True, "Remove repeated rows"),
    (2, "Empty Column", None, "drop_empty_column", True, "Drop the empty column"),
    (3, "Constant Column", None, "drop_constant_column", False, "Drop the constant column"),
    (4, "Missing Values", ["integer", "float"], "fill_missing_median", True, "Fill gaps with the median"),
    (5, "Missing Values", ["integer", "float"], "fill_missing_mean", False, "Fill gaps with the mean"),
    (6, "Missing Values", ["integer", "float"], "fill_missing_zero", False, "Fill gaps with 0"),
    (7, "Missing Values", ["datetime"], "drop_missing_rows", False, "Drop rows without a date"),
    (8, "Missing Values", ["boolean"], "fill_missing_mode", True, "Fill gaps with the most frequent value"),
    (9, "Missing Values", ["string", "categorical"], "fill_missing_unknown", True, "Fill gaps with Unknown"),
    (10, "Missing Values", ["string", "categorical"], "fill_missing_notprovided", False, "Fill gaps with Not_Provided"),
    (11, "Leading/Trailing Whitespace", None, "trim_whitespace", True, "Trim white space"),
    (12, "Numeric Stored as String", None, "convert_to_numeric", True, "Convert text to numbers"),
    (13, "Date Stored as Text", None, "convert_to_datetime", True, "Convert text to dates"),
    (14, "Boolean Inconsistency", None, "standardize_boolean", True, "Use one pair of truth values"),
    (15, "Category Inconsistency", None, "standardize_categories", True, "Use one spelling per category"),
    (16, "Special/Invisible Characters", None, "remove_special_chars", True, "Remove special characters"),
    (17, "Outliers Detected (IQR)", None, "cap_outliers", True, "Cap outliers at the fences"),
    (18, "Outliers Detected (IQR)", None, "remove_outliers", False, "Remove rows with outliers"),
    (19, "No Missing Values", ["string", "categorical"], "standardize_case", False, "Use title case"),
]


def suggest(profile: DataFrame, issues: DataFrame) -> DataFrame:
    """``step, column, action, description, enabled`` in the order in which to apply them.

    The rules are a small frame joined to the issues; nothing here reads the table again.
    """
    spark = profile.sparkSession
    rules = spark.createDataFrame(
        SUGGESTION_RULES,
        "rule int, issue_type string, types array<string>, action string, enabled boolean, description string",
    )
    # The last rule reacts to the absence of an issue on text columns.
    gapless = profile.where("missing_count = 0 and not is_empty").select("column", "position", F.lit("No Missing Values").alias("issue_type"))
    found = issues.select("column", "position", "issue_type").unionByName(gapless)
    typed = found.join(F.broadcast(profile.select("column", "inferred_type")), "column", "left")
    applies = F.col("types").isNull() | F.array_contains("types", F.col("inferred_type"))
    matched = typed.join(F.broadcast(rules), "issue_type").where(F.coalesce(applies, F.lit(False)))
    step = F.row_number().over(Window.orderBy("position", "rule"))
    return matched.select(step.alias("step"), "column", "action", "description", "enabled")
