"""Correlations of many columns from one scan: products of column blocks, merged by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbers import quoted

#: Columns whose pairs with all others travel and are merged together.
BLOCK = 32
#: A spread this small against the column's own is rounding: the column is constant on the rows of a pair.
ROUNDING = 1e-24


def pair_sums(x: np.ndarray) -> np.ndarray:
    """For all pairs of columns, over the rows where both are present: number, mean of each, squares about the mean of each, products about the means."""
    there = ~np.isnan(x)
    some = there.any(0)
    low, high = (f(np.where(there, x, fill), axis=0, initial=fill) for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
    middle = np.divide(np.where(there, x, 0).sum(0), there.sum(0), out=np.zeros(x.shape[1]), where=some)
    # A constant column is moved to exact zeros.
    move = np.where(some, np.where(low == high, low, middle), 0)
    mask, z = there.astype(float), np.where(there, x - move, 0)
    n, sums = mask.T @ mask, z.T @ mask
    safe = np.maximum(n, 1)
    mean = move[:, None] + sums / safe
    spread = np.maximum((z * z).T @ mask - sums**2 / safe, 0)
    return np.stack([n, mean, mean.T, spread, spread.T, z.T @ z - sums * sums.T / safe])


def merged(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The sums of two sets of rows together."""
    n = s[0] + t[0]
    away = [np.where((s[0] > 0) & (t[0] > 0), t[k] - s[k], 0) for k in (1, 2)]
    weight = t[0] / np.maximum(n, 1)
    both = s[0] * weight
    first = [np.where(s[0] > 0, s[k], t[k]) for k in (1, 2)]
    return np.stack([
        n, first[0] + away[0] * weight, first[1] + away[1] * weight, s[3] + t[3] + away[0] ** 2 * both, s[4] + t[4] + away[1] ** 2 * both, s[5] + t[5] + away[0] * away[1] * both,
    ])


def _blocks(sums: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows of a block of columns, and one more of each column by itself."""
    own = np.stack([np.diagonal(s) for s in sums])[:, None, :]
    for at in range(0, sums.shape[1], BLOCK):
        yield at // BLOCK, np.concatenate([sums[:, at : at + BLOCK], own], 1).tobytes()


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """``col_a, col_b, r`` of every pair of columns, in table order; NULL without spread.

    One scan, whatever the number of pairs. A task sends one row for each block of columns, and the blocks are merged
    by as many tasks; no pair comes to the driver. Numbers are doubles; NaN is missing.
    """
    spark, width = df.sparkSession, len(names)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros((6, width, width))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1) if batch.num_rows else np.empty((0, width))
            sums = merged(sums, pair_sums(x.astype(float)))
        made = list(_blocks(sums))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], names=["block", "sums"])

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums = np.frombuffer(data).reshape(6, -1, width)
                held[block] = merged(held[block], sums) if block in held else sums
        for block, sums in held.items():
            a = np.arange(block * BLOCK, block * BLOCK + sums.shape[1] - 1)
            own = sums[3, -1] / np.maximum(sums[0, -1], 1)
            n, _, _, spread_a, spread_b, product = sums[:, :-1]
            varied = (spread_a > ROUNDING * n * own[a][:, None]) & (spread_b > ROUNDING * n * own[None, :])
            r = np.divide(product, np.sqrt(spread_a) * np.sqrt(spread_b), out=np.full(product.shape, np.nan), where=varied)
            row, b = np.nonzero(np.arange(width)[None, :] > a[:, None])
            value = r[row, b]
            name = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays([name.take(pa.array(a[row])), name.take(pa.array(b)), pa.array(value, mask=np.isnan(value))], names=["col_a", "col_b", "r"])

    slim = df.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    # A row without values: every block exists, even if the table is empty.
    none = spark.range(1).select(*[F.lit(None).cast("double").alias(f"x{i}") for i in range(width)])
    parts = slim.unionByName(none).mapInArrow(scan, "block int, sums binary")
    blocks = -(-width // BLOCK)
    return parts.repartition(blocks, "block").mapInArrow(finish, "col_a string, col_b string, r double")
