"""What several operators share: reading tables, cutting lineage, positions in a global order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablescope.session import scratch_path

#: One of the six white-space characters that end a word, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, columns can be read singly. ``outside``: not in the run folder that is open."""
    path = scratch_path(df.sparkSession, name, outside)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of some ``size`` bytes for what runs meanwhile, where rows are large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Deal rows out by ranges of ``order`` and write them with their range number ``_part``."""
    count = partitions(df.sparkSession)
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


def for_each_text(docs: DataFrame, key: str, text: str, fields: str, start: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """``key`` and the columns ``fields`` that a function makes of each whole text.

    ``start`` is called once per task and returns the function. Keys pass through untouched, so
    nulls and large numbers stay as they are; texts come in Arrow batches of bounded bytes.
    """
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *made.fields])
    kinds = [to_arrow_type(f.dataType) for f in made.fields]

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one = start()
        for batch in batches:
            rows = [one(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text").mapInArrow(work, schema)
