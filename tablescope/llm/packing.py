"""Best-fit packing of documents into sequences, in rounds over distributed tables of lengths and gaps."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, for_each_text, prefix_sums, written
from .tokens import Encoder


def token_pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, end: int = 0, keep_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: key, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``).

    A document is the ids of its whole text, none for a null text, and the id ``end``. Longer ones
    are cut so that every piece but the first is full. Texts of any length are encoded whole; an
    empty table gives no rows; other columns are not read.
    """

    def start():
        encoder = Encoder(path)

        def one(value: str | None) -> tuple:
            ids = np.append(encoder.encode(value), np.uint32(end)).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            rows = []
            for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                row = {"piece": number, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())}
                rows.append(row | {"ids": ids[a:b].tolist()} if keep_ids else row)
            return (rows,)

        return one

    fields = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + ",ids:array<bigint>" * keep_ids
    made = for_each_text(docs, key, text, f"_pieces array<struct<{fields}>>", start)
    return made.select(F.col(key), F.explode("_pieces").alias("_piece")).select(F.col(key), "_piece.*")


def best_fit(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Put items (``uid`` distinct long >= 0, ``length`` 1 to ``capacity``) into bins: rows ``uid``, ``bin``.

    Items of more than half a bin open one each, named by their own uid; two of them never share.
    Then rounds: gaps and unplaced items are sorted together by size downwards, gaps first, over
    all partitions. Read that way, a gap opens and an item closes a bracket; matching brackets
    gives each item the smallest gap that is large enough and not taken by a larger item (the
    successor sweep; items that want the same gap are ranked by size, then uid). A bracket's depth
    is a global prefix sum, and brackets of one depth alternate, so a window by depth finds the
    pairs; it holds two rows for each distinct size at most. Gaps shrink, and the rest go on.

    A gap larger than the largest item left is offered as several slots, as many as there may be
    items for. New bins open for what fits no gap, and as many as the sizes need at least. The
    largest item is always placed, so rounds end; only sums, counts and extremes come to the driver.
    No items give no rows; the pieces of a long text are items like others.
    """
    spark = items.sparkSession
    half = F.col("length") * 2 > capacity
    parts = [items.where(half).select("uid", F.col("uid").alias("bin"))]
    left = written(items.where(~half).select("uid", "length"), "pack-items")
    bins = items.where(half & (F.col("length") < capacity)).select(F.col("uid").alias("bin"), (F.lit(capacity) - F.col("length")).alias("gap"))
    bins, opened = written(bins, "pack-bins"), 0
    while True:
        n, total, longest, shortest = left.agg(F.count("*"), F.sum("length"), F.max("length"), F.min("length")).first()
        if not n:
            break
        bins = bins.where(F.col("gap") >= shortest)
        usable, room, widest = bins.agg(F.count("*"), F.coalesce(F.sum("gap"), F.lit(0)), F.coalesce(F.max("gap"), F.lit(0))).first()
        homeless = left.where(F.col("length") > widest).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] if longest > widest else 0
        more = max(math.ceil(homeless / capacity), math.ceil((total - room) / capacity), 0)
        if more:
            fresh = spark.range(opened, opened + more).select((-F.col("id") - 1).alias("bin"), F.lit(capacity).cast("bigint").alias("gap"))
            bins, opened, usable = bins.unionByName(fresh), opened + more, usable + more
        most = math.ceil(2 * n / usable)
        bins = bins.withColumn("_k", F.expr(f"greatest(1, least(gap div {longest}, {most}))"))
        slots = bins.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_k").cast("int") - 1))).select(
            F.when(F.col("_slot") == 0, F.expr("gap - (gap div _k) * (_k - 1)")).otherwise(F.expr("gap div _k")).alias("size"),
            F.lit(1).cast("bigint").alias("step"), F.col("bin").alias("id"), "_slot",
        )
        closers = left.select(F.col("length").alias("size"), F.lit(-1).cast("bigint").alias("step"), F.col("uid").alias("id"), F.lit(0).alias("_slot"))
        order = [F.col("size").desc(), F.col("step").desc(), F.col("id"), F.col("_slot")]
        deep = prefix_sums(dealt(slots.unionByName(closers), order, "pack-sweep"), order, {"depth": F.col("step")})
        level = Window.partitionBy("_level").orderBy(*order)
        pairs = deep.withColumn("_level", F.when(F.col("step") > 0, F.col("depth")).otherwise(F.col("depth") + 1)).select(
            "step", "id", "size", F.lag("step").over(level).alias("_step"), F.lag("id").over(level).alias("bin")
        )
        placed = written(pairs.where("step < 0 AND _step > 0").select(F.col("id").alias("uid"), "bin", F.col("size").alias("length")), "pack-placed")
        parts.append(placed.select("uid", "bin"))
        taken = placed.groupBy("bin").agg(F.sum("length").alias("_taken"))
        bins = written(bins.join(taken, "bin", "left").select("bin", (F.col("gap") - F.coalesce("_taken", F.lit(0))).alias("gap")), "pack-bins")
        left = written(left.join(placed.select("uid"), "uid", "left_anti"), "pack-items")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, end: int = 0, keep_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset`` there, gapless from 0.

    A null or empty text is a document of the id ``end`` alone. Repeated rows are packed each for
    itself; full pieces are sequences of their own; an empty table gives no rows; columns other
    than ``key`` and ``text`` are not read. ``path`` is the tokenizer's file.
    """
    pieces = written(token_pieces(docs, capacity, path, end, keep_ids, key, text).withColumn("_uid", F.monotonically_increasing_id()), "pack-pieces")
    put = best_fit(pieces.select(F.col("_uid").alias("uid"), "length"), capacity).where("uid <> bin").select(F.col("uid").alias("_uid"), F.col("bin").alias("_bin"))
    order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "_uid").rowsBetween(Window.unboundedPreceding, 0)
    return (
        pieces.join(put, "_uid", "left")
        .withColumn("sequence_id", F.coalesce("_bin", "_uid"))
        .withColumn("offset", F.sum("length").over(order) - F.col("length"))
        .drop("_uid", "_bin")
    )
