"""Aggregate expressions with the missing-value rules used everywhere in the library.

NULL is the only missing marker; NaN is turned into NULL where a table enters the library.
Decimal columns are summed as decimals, so money totals do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def blank_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL (and -0.0 into 0.0) in every floating-point column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[_blank(name).alias(name) if name in floats else quoted(name) for name in df.columns])


def _blank(name: str) -> Column:
    c = quoted(name)
    return F.when(~F.isnan(c), c + F.lit(0.0).cast("float"))


def quoted(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    """Text and boolean columns, the ones treated as categories."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATE_TYPES)]


def total(c: Column) -> Column:
    """Sum as double; the sum of nothing is 0."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def whole_total(c: Column) -> Column:
    """Sum of whole numbers of 64 bits as DECIMAL(38,0), which no number of rows overflows."""
    return F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)")


def narrowed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with these DECIMAL(38,0) columns as BIGINT, each where all its values fit; one pass over ``df``."""
    unfit = df.agg(*[F.count_if(quoted(n).isNotNull() & quoted(n).try_cast("bigint").isNull()).alias(f"n{i}") for i, n in enumerate(names)]).first()
    return df.withColumns({n: quoted(n).cast("bigint") for i, n in enumerate(names) if not unfit[f"n{i}"]})


def mean(c: Column) -> Column:
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, places)


def adjusted_skew(c: Column) -> Column:
    """Bias-adjusted sample skewness: NULL below three values, 0 for a constant column."""
    x = c.cast("double")
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.when(F.min(x) == F.max(x), 0.0).otherwise(factor * g1))


def correlation(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are present; NULL when either is constant there."""
    both = a.isNotNull() & b.isNotNull()
    x = F.when(both, a.cast("double"))
    y = F.when(both, b.cast("double"))
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), spread))
