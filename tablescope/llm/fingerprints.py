"""Document fingerprints from prefix polynomial hashes.

The hash of a text c_0 ... c_{n-1} is the sum of (c_j + 1) * B**j modulo a prime, kept for every
prefix. Differences of two entries give the hash of any span, so equality of spans and longest
common extensions cost a few look-ups. Two primes near 2**31 together make 62 bits.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Fixed primes and bases of the two hashes.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 747796405)
#: Prefix and suffix lengths that a fingerprint keeps grow by this factor.
STEP = 2 ** 0.5
#: Different pieces that a fingerprint keeps, those of the smallest hashes.
KEPT = 48
#: Spans of this length whose hash is a multiple of ``EVERY`` begin a piece, if the one before is as far away at least.
GRAM = 16
EVERY = 32


class Powers:
    """Powers of the bases and of their inverses, grown as texts need them."""

    def __init__(self):
        self.size = 0
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]
        self.grid = np.empty(0, np.int64)

    def reach(self, n: int) -> None:
        while len(self.up[0]) <= n:
            have = len(self.up[0])
            for k, p in enumerate(PRIMES):
                for arrays, base in ((self.up, BASES[k]), (self.down, pow(BASES[k], -1, p))):
                    arrays[k] = np.concatenate([arrays[k], arrays[k] * np.uint64(pow(base, have, p)) % np.uint64(p)])
        if not len(self.grid) or self.grid[-1] < n:
            lengths, at = [], 1.0
            while at <= 2 * n + 2:
                lengths.append(int(at))
                at = max(at * STEP, int(at) + 1)
            self.grid = np.array(lengths, np.int64)


POWERS = Powers()


class Prefixes:
    """Prefix hashes of a text, or of the head of one text followed by the head of another."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        POWERS.reach(self.n)
        self.sums = []
        for k, p in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * POWERS.up[k][: self.n] % np.uint64(p), out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    def prefix(self, lengths: np.ndarray, k: int) -> np.ndarray:
        return self.sums[k][lengths]

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans, the same wherever a span stands."""
        out = np.zeros(np.shape(start), np.uint64)
        for k, p in enumerate(PRIMES):
            p = np.uint64(p)
            moved = (self.prefix(end, k) + p - self.prefix(start, k)) % p * POWERS.down[k][start] % p
            out = out << np.uint64(31) | moved
        return out


class Joined(Prefixes):
    """The first ``head`` code points of one text and the first ``tail`` of another, from their prefix hashes alone."""

    def __init__(self, first: Prefixes, head: int, second: Prefixes, tail: int):
        self.first, self.head, self.second, self.n = first, head, second, head + tail
        POWERS.reach(self.n)

    def prefix(self, lengths: np.ndarray, k: int) -> np.ndarray:
        p = np.uint64(PRIMES[k])
        inside, beyond = np.minimum(lengths, self.head), np.maximum(lengths - self.head, 0)
        return (self.first.prefix(inside, k) + POWERS.up[k][self.head] * self.second.prefix(beyond, k) % p) % p


def equal_spans(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    return bool(a.span(np.array(i), np.array(i + length)) == b.span(np.array(j), np.array(j + length)))


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common piece that starts at ``i`` in one text and at ``j`` in the other, by binary search."""
    most = min(a.n - i, b.n - j)
    low, high = 0, min(1, most)
    # Doubling first: most extensions are short.
    while high < most and equal_spans(a, i, b, j, high):
        low, high = high, min(2 * high, most)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def common_ends(a: Prefixes, b: Prefixes) -> tuple[int, int]:
    """Lengths of the longest common beginning and, beyond it, the longest common end."""
    head = common_extension(a, 0, b, 0)
    most = min(a.n, b.n) - head
    low, high = 0, min(1, most)
    while high < most and equal_spans(a, a.n - high, b, b.n - high, high):
        low, high = high, min(2 * high, most)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, a.n - middle, b, b.n - middle, middle):
            low = middle
        else:
            high = middle - 1
    return head, low


def pieces(text: Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces between places that the content alone defines, from the prefix hashes; they cover the text."""
    found = np.empty(0, np.int64)
    if text.n > GRAM:
        p = np.uint64(PRIMES[1])
        sums = text.prefix(np.arange(text.n + 1), 1)
        grams = (sums[GRAM:] + p - sums[:-GRAM]) % p * POWERS.down[1][: text.n - GRAM + 1] % p
        found = np.nonzero(grams % np.uint64(EVERY) == 0)[0]
        # Also where a short pattern repeats, the places are apart; which ones stay depends on the content before them alone.
        found = found[np.diff(found, prepend=-GRAM) >= GRAM]
    borders = np.unique(np.concatenate([[0], found, [text.n]]))
    return borders[:-1], borders[1:]


def _packed(words: np.ndarray) -> str:
    return base64.b64encode(words.astype("<u4").tobytes()).decode()


def _unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def fingerprint(text: Prefixes) -> str:
    """Length, hash of the whole, 32 bits for each prefix and each suffix whose length is on the grid, then the pieces.

    Of the different pieces those with the ``KEPT`` smallest hashes are kept, each with 32 bits of hash and the code
    points that all its copies hold together. So a fingerprint has a bounded size, whatever the length of the text.
    """
    n = text.n
    grid = POWERS.grid[: np.searchsorted(POWERS.grid, n, "right")]
    zero = np.zeros(len(grid), np.int64)
    # The low 31 bits are the second hash; the lowest bit of the first one fills the word.
    both = [text.span(zero, grid), text.span(n - grid, np.full(len(grid), n))]
    whole = int(text.span(np.array(0), np.array(n)))
    start, end = pieces(text)
    hashes, copy = np.unique(text.span(start, end) & np.uint64(0xFFFFFFFF), return_inverse=True)
    held = np.bincount(copy, end - start, len(hashes)).astype(np.uint64)
    few = np.stack([hashes[:KEPT], np.minimum(held[:KEPT], np.uint64(0xFFFFFFFF))])
    return f"{n:x}.{whole:016x}.{len(hashes):x}." + ".".join([*(_packed(v & np.uint64(0xFFFFFFFF)) for v in both), _packed(few)])


def _common_pieces(a: np.ndarray, b: np.ndarray, whole: bool, n_a: int, n_b: int) -> float:
    """Code points in common pieces; from all pieces, or estimated by the smallest hashes of both texts together."""
    every = np.union1d(a[0], b[0])
    every = every if whole else every[:KEPT]
    held = []
    for side in (a, b):
        at = np.minimum(np.searchsorted(side[0], every), max(0, len(side[0]) - 1))
        held.append(np.where(side[0][at] == every, side[1][at], 0).astype(float) if len(side[0]) else np.zeros(len(every)))
    least, most = np.minimum(*held).sum(), np.maximum(*held).sum()
    # Of code points held by either text, those held by both; together the two texts have n_a + n_b.
    return float(least / (least + most) * (n_a + n_b)) if most else 0.0


def likeness(a: str, b: str) -> float:
    """Share of the longer text, from 0 to 1, that is common: pieces wherever they stand, or, if that is more, beginning and end by the grid."""
    n_a, whole_a, count_a, *parts_a, inner_a = a.split(".")
    n_b, whole_b, count_b, *parts_b, inner_b = b.split(".")
    if n_a == n_b and whole_a == whole_b:
        return 1.0
    shortest, longest = sorted((int(n_a, 16), int(n_b, 16)))
    edges = 0
    for x, y in zip(map(_unpacked, parts_a), map(_unpacked, parts_b)):
        # Equality of prefixes is monotone, so the last equal entry is found by halving.
        low, high = 0, min(len(x), len(y))
        while low < high:
            middle = (low + high + 1) // 2
            if x[middle - 1] == y[middle - 1]:
                low = middle
            else:
                high = middle - 1
        if low:
            edges += int(POWERS.grid[low - 1])
    whole = max(int(count_a, 16), int(count_b, 16)) <= KEPT
    inside = _common_pieces(_unpacked(inner_a).reshape(2, -1), _unpacked(inner_b).reshape(2, -1), whole, int(n_a, 16), int(n_b, 16))
    # Different texts are never wholly alike.
    return min(max(edges, inside), shortest, longest - 1) / longest


def _neighbours(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows (_pid, _guest, _key, _text) in ranges of descending key, each range followed by the row that comes after it.

    Only the keys are read to cut the ranges; bounds and the first key of each range, one value a
    range, come to the driver. Texts are shuffled once, and a task looks at two of them at a time.
    """
    count = partitions(docs.sparkSession)
    lowest = -(2**63)
    keys = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(lowest)).alias("_k"))
    cuts = keys.agg(F.percentile_approx("_k", [i / count for i in range(1, count)], 20 * count)).first()[0] if count > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    # Range 0 has the largest keys.
    def range_of(values: np.ndarray) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, values, "right")

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(range_of(k.to_numpy(np.int64)).astype(np.int32))

    first = {r["_r"]: r["_m"] for r in keys.groupBy(place("_k").alias("_r")).agg(F.max("_k").alias("_m")).collect()}
    order = sorted(first)
    # The range before a range of the order; the last one is followed by the first.
    before = {first[r]: order[i - 1] for i, r in enumerate(order)}

    @F.pandas_udf("int")
    def guest(k: pd.Series) -> pd.Series:
        return pd.Series([before.get(v, -1) for v in k.tolist()], dtype=np.int32)

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(F.col(key).cast("bigint"), F.lit(lowest)).alias("_k"))
    rows = rows.select("*", place("_k").alias("_own"), guest("_k").alias("_also"))
    own = F.struct(F.col("_own").alias("_pid"), F.lit(False).alias("_guest"))
    also = F.struct(F.col("_also").alias("_pid"), F.lit(True).alias("_guest"))
    at = F.explode(F.when(F.col("_also") >= 0, F.array(own, also)).otherwise(F.array(own)))
    placed = rows.select(at.alias("_at"), "_key", "_text").select("_at._pid", "_at._guest", "_key", "_text")
    sort = [F.col("_pid"), F.col("_guest"), F.col("_key").desc_nulls_last(), F.col("_text").asc_nulls_first()]
    return placed.repartitionById(len(bounds) + 1, "_pid").sortWithinPartitions(*sort), len(bounds) + 1


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: fingerprints of the text and of an edited text, and how like they and the next document are.

    ``next_head`` and ``next_tail`` are the longest common extensions with the next document from the beginning and,
    beyond that, from the end, found by binary search on span hashes. A fingerprint has some 2,000 characters at most.

    The next document has the next smaller integer ``key`` (equal keys by text); nulls come last,
    and after the last comes the first, which may be the document itself. In the edited text the
    last floor(n / 2) code points give way to the first as many of the next document. A null text
    counts as empty; two empty texts are alike (1.0). Fingerprints are functions of the text, so
    repeated rows have equal ones. An empty table gives no rows; other columns are not read.
    """
    rows, _ = _neighbours(docs, key, text)
    schema = (
        f"`{key}` {docs.schema[key].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double, next_head bigint, next_tail bigint"
    )

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def finish(row: tuple, after: tuple) -> tuple:
            k, value, own, print_ = row
            _, next_value, next_own, next_print = after
            n = len(value)
            tail = min(n // 2, len(next_value))
            edited = value[: n - n // 2] + next_value[:tail]
            made = fingerprint(Joined(own, n - n // 2, next_own, tail))
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return k, n, digest, print_, made, likeness(print_, made), likeness(print_, next_print), *common_ends(own, next_own)

        waiting, at = None, None
        for batch in batches:
            out = []
            for pid, guest, k, value in zip(*[c.to_pylist() for c in batch.columns]):
                if at is not None and pid != at:
                    waiting = None
                at = pid
                if guest and waiting is None:
                    continue
                own = Prefixes(value or "")
                row = (k, value or "", own, fingerprint(own))
                if waiting is not None:
                    out.append(finish(waiting, row))
                waiting = None if guest else row
            kinds = [out_key, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    out_key = to_arrow_type(docs.schema[key].dataType)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_head", "next_tail"]
    return rows.mapInArrow(work, schema)
