"""The flat sales table and its defective copy, as lazy views over the star-schema files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sales(spark: SparkSession, folder: str, money: bool = True) -> DataFrame:
    """One row per line item. ``money`` types the price as DECIMAL(18,2), so its sums are exact.

    No join is hinted: Spark broadcasts the dimension tables only while their files are small.
    """
    line, orders, customer, part, nation, region = (
        _table(spark, folder, n) for n in ("lineitem", "orders", "customer", "part", "nation", "region")
    )
    price = F.col("l_extendedprice")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    buyer = customer.join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders.join(buyer, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            (
                F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 1009
                + F.col("l_suppkey") * 17 + F.col("l_linenumber")
            ).alias("rid"),
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("c_name").alias("customer"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("product"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("region"),
            F.col("l_quantity").alias("quantity"),
            (price.cast("decimal(18,2)") if money else price).alias("price"),
            F.col("l_discount").alias("discount"),
        )
    )


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """The sales rows with injected defects; one row in 101 appears twice."""
    rid = F.col("rid")
    amount = F.col("price").cast("string")
    day = F.col("order_date").cast("date").cast("string")
    every = lambda k: rid % k == 0
    base = sales(spark, folder).select(
        "rid",
        "customer",
        F.when(every(50), None).when(every(31), "missing").when(every(7), F.concat(F.lit("$"), amount))
        .otherwise(amount).alias("amount_txt"),
        F.when(every(40), None).when(every(29), "not a date").otherwise(day).alias("order_date_txt"),
        F.when(every(37), None).when(every(11), F.concat(F.lit("  "), F.lower("region")))
        .when(every(13), F.concat("region", F.lit(" "))).when(every(17), F.concat("region", F.lit("é")))
        .otherwise(F.col("region")).alias("region_txt"),
        F.when(rid % 6 == 0, "Yes").when(rid % 6 == 1, "no").when(rid % 6 == 2, "TRUE")
        .when(rid % 6 == 3, "false").when(rid % 6 == 4, "Y").alias("flag_txt"),
        F.when(rid % 3 != 0, None).when(rid % 2 == 0, "ok").otherwise("late").alias("note_txt"),
        F.lit("USD").alias("currency"),
        F.lit(None).cast("string").alias("empty_col"),
        F.when(every(997), F.col("quantity") * 1000).when(every(43), None).otherwise(F.col("quantity")).alias("qty"),
    )
    copies = F.when(every(101), F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(1)))
    return base.withColumn("copy", F.explode(copies)).drop("copy")
