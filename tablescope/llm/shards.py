"""Contiguous shards of nearly equal bytes, from global prefix sums of the document sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, prefix_sums, written


def shard_by_bytes(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Documents are put in the order of ``key`` (nulls first; ties by size, checksum, then place in
    the input). A document belongs to the shard in which the middle of its bytes falls when the
    whole corpus is cut at ``shards`` equal targets, so a shard's bytes differ from the target by
    half a document at each end at most. ``slot`` counts from 0 without gaps inside a shard.

    ``size`` is the UTF-8 length plus 1; a null text has size 1 and checksum 0, as an empty one.
    Repeated rows are documents of their own. A document larger than the target may leave shards
    empty. An empty table gives no rows. Other columns are not read.
    """
    slim = written(
        docs.select(
            F.col(key).alias("_key"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("_size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("bigint").alias("_crc"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-sizes",
    )
    order = [F.col("_key").asc_nulls_first(), F.col("_size"), F.col("_crc"), F.col("_row")]
    ranged = dealt(slim, order, "shard-ranges")
    placed = prefix_sums(ranged, order, {"_end": F.col("_size"), "_rank": F.lit(1).cast("bigint")})
    total = ranged.agg(F.sum("_size")).first()[0] or 1
    # Twice the middle of the document against twice the total: whole numbers only.
    cut = placed.withColumn("_shard", F.expr(f"((2 * _end - _size) * {int(shards)}) div {2 * total}").cast("int"))
    cut = written(cut.select("_key", "_size", "_crc", "_shard", "_rank"), "shard-cuts")
    firsts = cut.groupBy("_shard").agg(F.min("_rank").alias("_first"))
    return cut.join(F.broadcast(firsts), "_shard").select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_rank") - F.col("_first")).alias("slot"),
    )
