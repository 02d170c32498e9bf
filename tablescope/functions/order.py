"""Positions in a global order, without any task that sees more than a range of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def written(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, columns can be read singly. ``outside``: not in the run folder that is open."""
    path = scratch_path(df.sparkSession, name, outside)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Deal rows out by ranges of ``order`` and write them with their range number ``_part``."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(count, *order).withColumn("_part", F.spark_partition_id()), name)


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add to rows with ``_part`` (see :func:`dealt`) the global sums of all rows before and including each.

    Each range is summed by itself; the sums before it come from one row per range, so no task
    sees more than a range and the broadcast side has as many rows as there are ranges.
    ``order`` must be a total order.
    """
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_part").agg(*[F.sum(v).alias(f"_of_{k}") for k, v in sums.items()])
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_of_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums])
    summed = df.withColumns({k: F.sum(v).over(inside) for k, v in sums.items()})
    placed = summed.join(F.broadcast(offsets), "_part")
    return placed.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums}).drop(*[f"_before_{k}" for k in sums])
