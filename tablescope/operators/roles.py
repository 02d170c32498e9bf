"""Business roles of columns, found by name and kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import quoted
from .evidence import DATE_SHARE, column_patterns, type_label

# Role, accepted kind of column, whether the first column of that kind stands in
# when no name matches, and the name parts in order of preference.
ROLE_WORDS = [
    ("sales", "numeric", True, ["price", "sales", "revenue", "amount", "total", "value"]),
    ("quantity", "numeric", True, ["quantity", "qty", "units", "volume"]),
    ("customer", "categorical", False, ["customer", "client", "buyer", "user", "cust"]),
    ("product", "categorical", False, ["product", "item", "goods", "sku", "category"]),
    ("order", "identifier", False, ["order", "order_id", "invoice", "transaction"]),
    ("region", "categorical", False, ["city", "region", "location", "state", "area", "zone"]),
    ("date", "datetime", True, ["date", "time", "month", "year", "day"]),
]


@dataclass(frozen=True)
class Roles:
    """The columns an analysis works on; None where the table has none."""

    sales: str | None = None
    quantity: str | None = None
    customer: str | None = None
    product: str | None = None
    order: str | None = None
    region: str | None = None
    date: str | None = None


def column_roles(df: DataFrame, style: str = "contains") -> DataFrame:
    """``role, column, rank, candidates, ambiguous, fallback``: every candidate of every role.

    ``contains`` ranks by keyword, then column position. ``prefix`` prefers an exact name, then a
    name that starts with a keyword, then one that contains it. A text column can only hold the
    date role when its values parse, which is read from the data. A role without a match has no
    candidates; it falls back to the first column of its kind where ``fallback`` is true.
    """
    spark = df.sparkSession
    words = spark.createDataFrame(
        [(r, kind, i, w) for r, kind, _, ws in ROLE_WORDS for i, w in enumerate(ws)],
        "role string, kind string, word_at int, word string",
    )
    roles = spark.createDataFrame([(r, kind, fb) for r, kind, fb, _ in ROLE_WORDS], "role string, kind string, falls_back boolean")
    # Column names only: as many rows as the table has columns.
    names = _named(df)
    kinds = names.select(
        "*",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("label").isin("integer", "float"), "numeric"),
                    F.when(F.col("label").isin("string", "boolean"), "categorical"),
                    F.when(F.col("label") != "datetime", "identifier"),
                    F.when((F.col("label") == "datetime") | F.col("parses"), "datetime"),
                )
            )
        ).alias("kind"),
    )
    matched = words.join(F.broadcast(kinds), "kind").where(F.contains("name", "word"))
    closeness = (
        F.when(F.lit(style == "contains"), 0)
        .when(F.col("name") == F.col("word"), 0)
        .when(F.startswith("name", "word"), 1)
        .otherwise(2)
    )
    # A real date column always comes before text that looks like dates.
    texty = F.when((F.col("kind") == "datetime") & (F.col("label") != "datetime"), 1).otherwise(0)
    best = matched.groupBy("role", "column").agg(F.min(F.struct(texty, closeness, "word_at", "position")).alias("preference"))
    counted = best.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy("preference"))).withColumn(
        "found", F.collect_list("column").over(
            Window.partitionBy("role").orderBy("preference").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
    )
    first = (
        roles.where("falls_back").join(F.broadcast(kinds), "kind")
        .where((F.col("kind") != "datetime") | (F.col("label") == "datetime"))
        .groupBy("role").agg(F.min_by("column", "position").alias("spare"))
    )
    return (
        roles.join(first, "role", "left").join(counted, "role", "left")
        .select(
            "role",
            F.coalesce("column", "spare").alias("column"),
            F.coalesce(F.col("rank"), F.lit(1)).cast("int").alias("rank"),
            F.coalesce("found", F.array().cast("array<string>")).alias("candidates"),
            (F.coalesce(F.size("found"), F.lit(0)) > 1).alias("ambiguous"),
            (F.col("column").isNull() & F.col("spare").isNotNull()).alias("fallback"),
        )
    )


def _named(df: DataFrame) -> DataFrame:
    """``position, column, name, label, parses``: whether a text column's values are dates is read from the data where its name fits the date role."""
    fields = df.schema.fields
    rows = [(i, f.name, f.name.lower(), type_label(f.dataType)) for i, f in enumerate(fields)]
    names = df.sparkSession.createDataFrame(rows, "position int, column string, name string, label string")
    hints = [w for _, kind, _, words in ROLE_WORDS if kind == "datetime" for w in words]
    texts = [name for _, name, low, label in rows if label == "string" and any(w in low for w in hints)]
    if not texts:
        return names.withColumn("parses", F.lit(False))
    present = F.col("rows") - F.col("missing_count")
    parses = F.try_divide(F.col("date_count").cast("double"), present.cast("double")) >= DATE_SHARE
    seen = column_patterns(df.select(*[quoted(c) for c in texts])).select("column", parses.alias("parses"))
    return names.join(seen, "column", "left").withColumn("parses", F.coalesce("parses", F.lit(False)))


def resolve_roles(df: DataFrame, style: str = "contains", **given: str) -> Roles:
    """The best column per role; columns given by the caller are kept."""
    picked = {r["role"]: r["column"] for r in column_roles(df, style).where("rank = 1").collect()}
    return Roles(**{**picked, **given})
