"""A mix of sources by target weights: blocks of equal tokens, apportioned by highest quotients and chosen by seed.

Seat k of a source with target t has the quotient t / (2k - 1) (Sainte-Laguë). All quotients of at least half a block
get their seat, so a source has its target in blocks, rounded; cut at equal steps of the divisor, the same order gives
each shard of the mix its whole-numbered quota of every source. A source's documents lie in an order drawn by seed,
its seats go round its blocks in another, so a block is taken once before any is taken again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, prefix_sums, written

WORD = r"[^\x20\x09-\x0D]+"


def _strides(count: int = 16) -> list[int]:
    """The largest primes below a million. Any four have a product beyond 64 bits, so they cannot all divide one number of blocks."""
    found, n = [], 999_999
    while len(found) < count:
        if all(n % d for d in range(3, 1000, 2)):
            found.append(n)
        n -= 2
    return found


STRIDES = _strides()


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in their order, ``repeats`` of a source at most, ``block`` words, ``shards`` of the mix."""

    weights: tuple[int, ...] = (1, 2, 3)
    repeats: int = 3
    block: int = 32
    shards: int = 8
    seed: int = 20240101


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def sizes(docs: DataFrame, mix: Mix, key: str, text: str, source: str) -> DataFrame:
    """A row per document without its text: ``key``, ``source``, ``size`` in words, ``_draw`` and ``_content`` that order it."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    draw = F.xxhash64(F.lit(mix.seed), F.col(key).cast("string"))
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size"), draw.alias("_draw"), F.xxhash64(F.col(text)).alias("_content"))


def targets(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``start`` (words of the sources before) and ``target`` of rows ``source``, ``size``.

    A target is weight times a level, but ``repeats`` times its source at most; the level is the one at which they sum
    to all words: what is cut off is shared again by weight until none is above. It is found by prefix sums over the
    sources in the order in which a rising level reaches their limits, so there may be any number of them.
    """
    found = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = [F.col("source").asc_nulls_last()]
    placed = prefix_sums(dealt(found, order, "source-order"), order, {"_rank": F.lit(1).cast("bigint"), "_end": F.col("source_size")})
    cycle = F.array(*[F.lit(w).cast("bigint") for w in mix.weights])
    weight = F.element_at(cycle, (F.pmod(F.col("_rank") - 1, F.lit(len(mix.weights))) + 1).cast("int"))
    placed = written(placed.select("source", "source_size", "_rank", (F.col("_end") - F.col("source_size")).alias("start"), weight.alias("weight")), "weights")

    real = placed.where("source_size > 0").withColumn("_limit", mix.repeats * F.col("source_size"))
    all_words, all_weight = real.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("_rank")]
    reached = prefix_sums(dealt(real, order, "limits"), order, {"_limits": F.col("_limit"), "_weights": F.col("weight")})
    # Words and weight that are left for a source and those after it when all before it are at their limits.
    left = reached.withColumns({"_words": F.lit(all_words) - F.col("_limits") + F.col("_limit"), "_left": F.lit(all_weight) - F.col("_weights") + F.col("weight")})
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    free = left.where(exact("_words") * exact("weight") <= exact("_limit") * exact("_left"))
    level = free.agg(F.min_by(F.struct("_words", "_left"), F.struct(F.col("source_size") / F.col("weight"), F.col("_rank")))).first()[0]
    share = F.lit(float(level[0])) / F.lit(float(level[1])) if level else F.lit(0.0)
    target = F.least((mix.repeats * F.col("source_size")).cast("double"), F.col("weight") * share)
    return placed.select("source", "source_size", "weight", "start", target.alias("target"))


def quotas(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """To sources with ``target``: ``blocks``, ``seats``, ``quota`` (seats in each shard of the mix), ``stride`` and ``shift`` (the order of blocks).

    Seats are counted in blocks of the source's own mean size, as its last one may be short: three times a source is three times its blocks.
    """
    blocks = _div(F.col("source_size") + (mix.block - 1), F.lit(mix.block).cast("bigint"))
    seats = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("bigint")
    until = lambda j: F.floor(F.col("seats") * F.lit(j) / F.lit(mix.shards) + 0.5).cast("bigint")
    draw = lambda n: F.pmod(F.xxhash64(F.lit(mix.seed + n), "source"), F.lit(1 << 20))
    # A prime that does not divide the number of blocks leads to each of them once.
    fit = F.filter(F.array(*[F.lit(p).cast("bigint") for p in STRIDES]), lambda p: F.col("blocks") % p != 0)
    out = sources.withColumn("blocks", blocks).withColumn("seats", seats)
    return out.withColumns({
        "quota": F.array(*[until(j + 1) - until(j) for j in range(mix.shards)]),
        "stride": F.when(F.col("blocks") > 0, F.element_at(fit, (draw(1) % F.size(fit) + 1).cast("int"))), "shift": draw(2),
    })


def mix_blocks(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per document: ``key``, ``size``, ``source_size``, ``target`` of its source, and ``parts``, what the mix takes of it.

    A part is ``shard`` of the mix, ``seat`` of the source, and ``first`` (from 0) and ``words`` of the document. The
    parts of a source sum to its target but for half a block and the short last block; each word is taken ``repeats``
    times at most.

    A null text has no words, an empty one neither; such documents have no parts. A null source is a source of its
    own, the last. Repeated rows are documents of their own; rows equal in key and text are interchangeable. Null keys
    are drawn alike. The same rows give the same mix, whatever their order or partitions. An empty table gives no
    rows; other columns are not read. Texts are read once and never moved; very long ones are many blocks.
    """
    rows = written(sizes(docs, mix, key, text, source), "mix-sizes")
    sources = written(quotas(targets(rows, mix), mix), "quotas")
    order = [F.col("source").asc_nulls_last(), F.col("_draw"), F.col("key"), F.col("size"), F.col("_content")]
    placed = prefix_sums(dealt(rows, order, "mix-order"), order, {"_end": F.col("size")}).select("key", "source", "size", "_end")
    # Equal null sources meet, too.
    named = lambda: (F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name"))
    joined = placed.select("key", "size", "_end", *named()).join(sources.select(*named(), "source_size", "target", "start", "blocks", "seats", "quota", "stride", "shift"), ["_null", "_name"])
    joined = joined.withColumn("_at", F.col("_end") - F.col("size") - F.col("start"))
    block = mix.block
    ends = "aggregate(quota, named_struct('sum', 0L, 'shard', 0), (s, q) -> named_struct('sum', s.sum + q, 'shard', s.shard + if(s.sum + q <= seat, 1, 0))).shard"
    seats = f"""flatten(transform(sequence(_at div {block}, (_at + size - 1) div {block}), b ->
        transform(sequence(0, {mix.repeats - 1}), e -> named_struct('seat', e * blocks + (b * stride + shift) % blocks,
            'first', greatest(b * {block} - _at, 0L), 'words', least(b * {block} + {block} - _at, size) - greatest(b * {block} - _at, 0L)))))"""
    parts = F.expr(f"filter(if(size = 0, array(), {seats}), p -> p.seat < seats)")
    shard = f"transform(_parts, p -> named_struct('shard', {ends.replace('seat,', 'p.seat,')}, 'seat', p.seat, 'first', p.first, 'words', p.words))"
    return joined.withColumn("_parts", parts).select(F.col("key").alias(key), "size", "source_size", "target", F.expr(shard).alias("parts"))


def taken(mixed: DataFrame) -> Column:
    """Words that the mix takes of a document of :func:`mix_blocks`, repeats counted."""
    return F.aggregate(mixed["parts"], F.lit(0).cast("bigint"), lambda s, p: s + p["words"])
