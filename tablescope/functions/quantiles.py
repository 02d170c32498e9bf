"""Exact quantiles that never gather a whole column in one task.

Spark's ``percentile`` keeps every distinct value of a group in one reducer. Here mergeable KLL
sketches of bounded size first bracket the wanted ranks; a later pass counts the rows below the
bracket, and where a rank lies inside, the few rows there meet so large a sketch that it holds them
all, unless there are more, and then the bracket gets narrower. So memory is bounded whatever the
table size, and the result is exact: every rank is checked against the counts before it is used.

Sketches are merged per share of the input partitions and then once more, so no task merges those
of the whole table, and only two bounds for each column and probability come to the driver.
Quantiles per group rank all rows by range partitions instead, so there may be any number of groups
of any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import dealt, prefix_sums, written

#: Values that a first sketch of many columns holds, and any other sketch; up to so many values a sketch is exact.
FIRST_HELD = 4096
HELD = 60_000
#: Columns whose first sketches may be large.
FEW = 8
SHARES = 64
MOST_ROUNDS = 40
#: Columns or brackets that one pass sketches.
AT_ONCE = 200


@dataclass
class _Target:
    """One column and the ranks wanted there (0-based, by ascending value); without bounds, all values are inside."""

    first: int
    last: int
    low: float
    high: float

    def tighten(self, bounds: tuple[float | None, float | None]) -> None:
        self.low, self.high = (old if new is None else new for old, new in zip((self.low, self.high), bounds))


@dataclass
class ColumnSummary:
    """Count, extremes and order statistics of one column."""

    count: int = 0
    low: float | None = None
    high: float | None = None
    quantiles: dict[float, float | None] = field(default_factory=dict)


def quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float]) -> dict[str, ColumnSummary]:
    """Linear-interpolation quantiles of ``columns``, by name."""

    def between(p):
        return lambda n, floor, ceil: (floor(p * (n - 1)), ceil(p * (n - 1)))

    summaries, ranks = _order_statistics(df, columns, {p: between(p) for p in probs})
    for key, summary in summaries.items():
        for p in probs:
            pair = ranks.get((key, p))
            if pair is None:
                summary.quantiles[p] = None
                continue
            at = p * (summary.count - 1)
            summary.quantiles[p] = _interpolate(pair[0], pair[1], at - math.floor(at))
    return summaries


def grouped_quantiles(df: DataFrame, group: Column, value: Column, probs: list[float]) -> DataFrame:
    """``g, count, p0, p1, ...``: linear-interpolation quantiles for every non-NULL group.

    All rows are ranked once by (group, value) over range partitions; a group's own ranks follow
    from its first one. Only the wanted ranks are kept, two rows a group and probability.
    """
    slim = df.select(group.alias("g"), value.cast("double").alias("x")).where("g IS NOT NULL AND x IS NOT NULL")
    slim = slim.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("g"), F.col("x"), F.col("tie")]
    ranked = prefix_sums(dealt(slim, order, "ranks"), order, {"at": F.lit(1).cast("long")}).select("g", "x", "at")
    groups = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first"))
    places = ranked.join(groups, "g").withColumn("at", F.col("at") - F.col("first"))
    picks = []
    for i, p in enumerate(probs):
        spot = F.lit(p) * (F.col("count") - 1)
        picks += [F.max(F.when(F.col("at") == F.floor(spot), F.col("x"))).alias(f"a{i}"), F.max(F.when(F.col("at") == F.ceil(spot), F.col("x"))).alias(f"b{i}")]
    near = F.lit(False)
    for p in probs:
        spot = F.lit(p) * (F.col("count") - 1)
        near = near | (F.col("at") == F.floor(spot)) | (F.col("at") == F.ceil(spot))
    found = places.where(near).groupBy("g", "count").agg(*picks)
    out = []
    for i, p in enumerate(probs):
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        t = F.lit(p) * (F.col("count") - 1) - F.floor(F.lit(p) * (F.col("count") - 1))
        out.append(F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t).alias(f"p{i}"))
    return found.select("g", "count", *out)


def kth_largest(df: DataFrame, value: Column, k: int) -> float | None:
    """The k-th largest value (1-based) of one column; NULLs do not count."""
    count = df.agg(F.count(value)).first()[0]
    if not 1 <= k <= count:
        return None
    rank = count - k
    _, ranks = _order_statistics(df, {"value": value}, {k: lambda n, floor, ceil: (rank, rank)})
    return ranks[("value", k)][0]


def _interpolate(a: float, b: float, t: float) -> float:
    return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def _order_statistics(df: DataFrame, columns: dict[str, Column], wanted: dict) -> tuple[dict, dict]:
    """Summaries by column, and by (column, key of ``wanted``) the values at the two ranks that it makes of a count."""
    names = list(columns)
    slim = df.select(*[columns[n].cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    summaries, targets, found = {name: ColumnSummary() for name in names}, {}, {}
    held = HELD if len(names) <= FEW else FIRST_HELD
    for part in _portions(names):
        sums = {}
        for s, name in enumerate(part):
            x = F.col(f"x{names.index(name)}")
            sums |= {f"in{s}": (F.count(x), F.sum), f"lo{s}": (F.min(x), F.min), f"hi{s}": (F.max(x), F.max), f"q{s}": _sketch(x, held)}
        whole = _summed(slim, sums)
        row = whole.select(*[name for name in sums if not name.startswith("q")]).first()
        reads = _Reads(whole)
        for s, name in enumerate(part):
            n = row[f"in{s}"] or 0
            if not n:
                continue
            summaries[name].count, summaries[name].low, summaries[name].high = n, row[f"lo{s}"], row[f"hi{s}"]
            for key, ranks in wanted.items():
                target = targets[(name, key)] = _Target(*ranks(n, math.floor, math.ceil), row[f"lo{s}"], row[f"hi{s}"])
                reads.ask((name, key), s, n, target.first, target.last, held)
        for key, exact, values in reads.answers():
            if exact:
                found[key] = values
            else:
                targets[key].tighten(values)
    for _ in range(MOST_ROUNDS):
        open_ = [k for k in targets if k not in found]
        if not open_:
            return summaries, found
        for part in _portions(open_):
            found |= _narrowed(slim, names, summaries, {k: targets[k] for k in part})
    raise RuntimeError(f"ranks still open after {MOST_ROUNDS} passes: {sorted(k for k in targets if k not in found)}")


def _portions(keys: list) -> list[list]:
    return [keys[at : at + AT_ONCE] for at in range(0, len(keys), AT_ONCE)]


def _sketch(x: Column, held: int) -> tuple[Column, object]:
    """A sketch of a column, and how sketches are put together."""
    return F.call_function("kll_sketch_agg_double", x, F.lit(held)), lambda c: F.call_function("kll_merge_agg_double", c, F.lit(held))


def _summed(slim: DataFrame, sums: dict) -> DataFrame:
    """Aggregates, made per share of the input partitions and then put together, as one stored row."""
    shares = slim.groupBy(F.pmod(F.spark_partition_id(), F.lit(SHARES)).alias("share")).agg(*[made.alias(name) for name, (made, _) in sums.items()])
    return written(shares.agg(*[join(F.col(name)).alias(name) for name, (_, join) in sums.items()]), "sketches")


class _Reads:
    """Values at ranks of stored sketches, read together."""

    def __init__(self, whole: DataFrame):
        self.whole, self.asked, self.columns = whole, [], []

    def ask(self, key, s: int, n: int, first: int, last: int, held: int) -> None:
        """The values at two ranks among the ``n`` of sketch ``s`` if it holds them all; else bounds that surely lie around them."""
        exact = n <= held
        slack = 0 if exact else math.ceil(n * 7 / held**0.97) + 2
        ranks = (first + 0.5, last + 0.5) if exact else (first - slack, last + 1 + slack)
        self.asked.append((key, exact))
        self.columns += [
            (F.call_function("kll_sketch_get_quantile_double", F.col(f"q{s}"), F.lit(r / n)) if 0 < r < n else F.lit(None).cast("double")).alias(f"v{len(self.columns) + i}") for i, r in enumerate(ranks)
        ]

    def answers(self):
        """(key, whether exact, the two values; None beyond either end)."""
        row = self.whole.select(*self.columns).first() if self.columns else ()
        return [(key, exact, (row[2 * i], row[2 * i + 1])) for i, (key, exact) in enumerate(self.asked)]


def _zones(slim: DataFrame, names: list[str], edges: dict[str, list[float]]) -> dict[str, list[int]]:
    """For each column how many values lie below the first edge, on it, between it and the next, and so on."""
    places = {name: sum((F.col(f"x{names.index(name)}") > e).cast("int") + (F.col(f"x{names.index(name)}") >= e).cast("int") for e in marks) for name, marks in edges.items()}
    marked = slim.select(*[place.alias(str(names.index(name))) for name, place in places.items()])
    counted = marked.unpivot([], marked.columns, "s", "zone").where("zone IS NOT NULL").groupBy("s", "zone").agg(F.count(F.lit(1)).alias("n"))
    found = {(names[int(r["s"])], r["zone"]): r["n"] for r in counted.collect()}
    return {name: [found.get((name, z), 0) for z in range(2 * len(marks) + 1)] for name, marks in edges.items()}


def _narrowed(slim: DataFrame, names: list[str], summaries: dict, targets: dict) -> dict:
    """A pass that counts around brackets, and one over the rows inside those that hold a rank: the values where a sketch holds all of them; other brackets become narrower."""
    edges: dict[str, list[float]] = {}
    for (name, _), target in targets.items():
        edges[name] = sorted({*edges.get(name, []), target.low, target.high})
    zones = _zones(slim, names, edges)
    sums, done, open_ = {}, {}, []
    for s, (key, target) in enumerate(targets.items()):
        counts, (low, high) = zones[key[0]], (2 * edges[key[0]].index(e) + 1 for e in (target.low, target.high))
        below, inside = sum(counts[:low]), sum(counts[low + 1 : high])
        at_low, at_high = counts[low], counts[high] if high > low else 0
        first, last = (r - below - at_low for r in (target.first, target.last))
        if first < -at_low or last >= inside + at_high:
            target.low, target.high = summaries[key[0]].low, summaries[key[0]].high
        elif all(r < 0 or r >= inside for r in (first, last)):
            done[key] = tuple(target.low if r < 0 else target.high for r in (first, last))
        else:
            open_.append((key, s, inside, first, last))
    if not open_:
        return done
    # Each update of a sketch is dear, also with NULL, so only rows inside a bracket meet them. The generator keeps the
    # filter from being pushed below the columns, where each comparison would make its column again.
    near = F.lit(False)
    for key, s, *_ in open_:
        x = F.col(f"x{names.index(key[0])}")
        within = (x > targets[key].low) & (x < targets[key].high)
        near, sums[f"q{s}"] = near | within, _sketch(F.when(within, x), HELD)
    made = slim.select(F.inline(F.array(F.struct(*slim.columns))))
    reads = _Reads(_summed(made.where(near), sums))
    for asked in open_:
        reads.ask(*asked, HELD)
    for key, exact, (a, b) in reads.answers():
        if exact:
            done[key] = (targets[key].low if a is None else a, targets[key].high if b is None else b)
        else:
            targets[key].tighten((a, b))
    return done
