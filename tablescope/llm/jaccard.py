"""Exact Jaccard join of word-shingle sets, and its groups.

Sets are put into bands of sizes. Two sets of similarity t differ in at most
H = floor((a + b)(1 - t) / (1 + t)) elements, so when the space of hashes is cut into more than H
parts, some part holds the same elements of both. A tile is the sets that agree in one part of
one band. In a tile, bitmaps that hold the parity of hashed elements are compared first: each bit
that differs is owed to an element in one set alone, so the count of differing bits bounds the
overlap from above. Bitmaps of one size say nothing of long sets, so what passes is compared by
bitmaps that grow with the sets, and what is left is settled by the intersection of sorted arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.session import intermediate

from .common import batches_of, partitions, written
from .components import components

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a parity bitmap.
BITMAP = 128
#: Sets in a block; a tile with more of them is settled block against block.
BLOCK = 512
#: Documents whose signatures are handed on together.
SIGNED_AT_ONCE = 500
#: Bits of the filter of shared signatures at most, as a power of two: 32 MB; and of a part of it.
FILTER_BITS, FILTER_CHUNK = 28, 16
#: Bytes of the batches in which arrays are compared.
BATCH = 4 << 20
#: Keys that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Join:
    """Shingles of ``words`` words, linked when 100 * intersection >= ``percent`` * union; bands grow by ``band``."""

    words: int = 5
    percent: int = 80
    band: float = 1.5

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; the whole sequence is one if it is shorter; none without words."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = min(self.words, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for j in range(n):
            out *= GOLD
            out += hashes[j : len(words) - n + 1 + j]
        return np.unique(mixed(out))

    def differ(self, a: int, b: int) -> int:
        """The most elements that linked sets of these sizes do not share."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    @cached_property
    def _bands(self) -> list[int]:
        return [1]

    def bands_of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, parts, spare) of every band whose sets can be the smaller partner of a set of size ``n``, or the set itself.

        More than ``spare`` parts of linked sets agree.
        """
        low = self._bands
        while low[-1] <= n:
            low.append(max(low[-1] + 1, -int(-low[-1] * self.band // 1)))
        k = next(i for i in range(len(low) - 2, -1, -1) if low[i] <= n)
        out = []
        while k >= 0:
            top = low[k + 1] - 1
            if 100 * top // self.percent < n:
                break
            most = self.differ(top, 100 * top // self.percent)
            spare = 1 + most // 10 if most else 0
            out.append((k, most + 1 + spare, spare))
            k -= 1
        return out

    def signatures(self, found: np.ndarray) -> np.ndarray:
        """One 64-bit word for each part of each band.

        Parts without elements are left out, unless the set has more of them than a band has to
        spare: linked sets share an agreeing part that is not empty, or both state their empty ones.
        """
        sums = np.zeros(len(found) + 1, np.uint64)
        np.cumsum(found, out=sums[1:])
        out = []
        for band, parts, spare in self.bands_of(len(found)):
            cuts = np.array([-(-(j << 64) // parts) for j in range(1, parts)], dtype=np.uint64) if parts not in CUTS else CUTS[parts]
            CUTS[parts] = cuts
            at = np.concatenate([[0], np.searchsorted(found, cuts), [len(found)]])
            name = mixed(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 32))
            words = mixed((sums[at[1:]] - sums[at[:-1]]) ^ name)
            full = at[1:] > at[:-1]
            out.append(words if parts - int(full.sum()) > spare else words[full])
        return np.concatenate(out).view(np.int64)


#: Places where the space of hashes is cut, by the number of parts.
CUTS: dict[int, np.ndarray] = {}


def bitmap(found: np.ndarray) -> bytes:
    places = (found * GOLD >> np.uint64(64 - (8 * BITMAP).bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=8 * BITMAP) & 1).astype(np.uint8)).tobytes()


def wide_bitmap(found: np.ndarray) -> bytes:
    """A parity bitmap that grows with the set: four bits or more for each element, a power of two of them, ``BITMAP`` bytes at least."""
    size = max(8 * BITMAP, 1 << (4 * len(found) - 1).bit_length())
    places = (found & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=size) & 1).astype(np.uint8)).tobytes()


def wide_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Differing bits of two wide bitmaps, as words; the halves of the longer one are laid upon each other until it is as long as the other."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def set_id(found: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def first_word(sid: bytes) -> int:
    return int.from_bytes(sid[:8], "little", signed=True)


def _bit_rows(column) -> np.ndarray:
    """A column of bitmaps as rows of words, without a copy."""
    if not len(column):
        return np.empty((0, BITMAP // 8), np.uint64)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + len(column) * BITMAP].view(np.uint64).reshape(-1, BITMAP // 8)


def _arrays(column) -> Iterator[np.ndarray]:
    """The arrays of 64-bit words in a column, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield data[start:end].view(np.uint64)


def _sets(docs: DataFrame, join: Join, key: str, text: str) -> DataFrame:
    """A row per document: row number, key, text hash, size, set id, its first word and bitmap."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("content"), F.col(text).alias("text"))
    key_type = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            out = []
            for value in batch.column(3).to_pylist():
                found = join.shingles(value)
                if len(found):
                    sid = set_id(found)
                    out.append((len(found), sid, first_word(sid), bitmap(found)))
                else:
                    out.append((0, None, None, None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["row", "key", "content", "n", "sid", "head", "bits"])

    return rows.mapInArrow(work, f"row bigint, key {key_type}, content bigint, n bigint, sid binary, head bigint, bits binary")


def _signed(docs: DataFrame, join: Join, text: str, shared: Filter | None = None) -> DataFrame:
    """``word``, ``head``: every signature of every set, with the first word of the set's id; a set that a task meets again is signed once.

    They are made anew for each use: that costs less than keeping them, as they outweigh the texts.
    With ``shared`` only those that may be in it are handed on.
    """
    sent = None if shared is None else docs.sparkSession.sparkContext.broadcast(shared)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[bytes] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, SIGNED_AT_ONCE):
                words, heads = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for value in batch.column(0).slice(start, SIGNED_AT_ONCE):
                    found = join.shingles(value.as_py())
                    if not len(found):
                        continue
                    sid = set_id(found)
                    if sid in seen:
                        continue
                    seen.add(sid)
                    made = join.signatures(found)
                    if sent is not None:
                        made = made[sent.value.may_hold(made)]
                    words.append(made)
                    heads.append(np.full(len(made), first_word(sid)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(words)), pa.array(np.concatenate(heads))], names=["word", "head"])

    return docs.select(F.col(text).alias("text")).mapInArrow(work, "word bigint, head bigint")


class Filter:
    """Bits that tell of a word whether it is surely not in a table of words."""

    def __init__(self, bits: bytes, size: int):
        self.bits, self.size = bits, size

    def may_hold(self, words: np.ndarray) -> np.ndarray:
        place = (words.view(np.uint64) >> np.uint64(64 - self.size)).astype(np.int64)
        return np.frombuffer(self.bits, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0


def _filter(words: DataFrame) -> Filter:
    """Some sixteen bits for each word, ``FILTER_BITS`` at most: of a larger table more words pass that are not in it, which are joined away afterwards."""
    size = int(min(FILTER_BITS, max(FILTER_CHUNK, (16 * words.count()).bit_length())))

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - size)).astype(np.int64)
            order = np.argsort(place)
            chunks, firsts = np.unique(place[order] >> FILTER_CHUNK, return_index=True)
            for chunk, mine in zip(chunks.tolist(), np.split(place[order], firsts[1:])):
                held.setdefault(chunk, np.zeros(1 << FILTER_CHUNK, bool))[mine & ((1 << FILTER_CHUNK) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], pa.binary())], names=["chunk", "bits"])

    # Words of a part of the filter meet in one task; words are hashes, so their first bits say where.
    part = F.shiftrightunsigned("word", 64 - size + FILTER_CHUNK) if size > FILTER_CHUNK else F.lit(0)
    parts = words.select("word").repartition(partitions(words.sparkSession), part).mapInArrow(mark, "chunk bigint, bits binary")
    out = np.zeros(1 << (size - 3), np.uint8)
    for row in written(parts, "filter").toLocalIterator():
        at = row["chunk"] << (FILTER_CHUNK - 3)
        out[at : at + (1 << (FILTER_CHUNK - 3))] = np.frombuffer(row["bits"], np.uint8)
    return Filter(out.tobytes(), size)


def _semi(big: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``big`` with (or without) a key, nulls equal; the keys are broadcast only after counting them."""
    keys = written(keys.distinct(), "keys")
    renamed = keys.select(*[F.col(c).alias(f"_k_{c}") for c in on])
    if keys.count() <= BROADCAST_KEYS:
        renamed = F.broadcast(renamed)
    condition = F.lit(True)
    for c in on:
        condition = condition & big[c].eqNullSafe(renamed[f"_k_{c}"])
    return big.join(renamed, condition, how)


def _made(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, join: Join, key: str, text: str, make: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
    """``node``, ``n``, ``made``: what ``make`` gives of the sorted array of each node in the pairs, written as ``name``."""
    wanted = written(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "key", "content", "sid"), "wanted")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, SIGNED_AT_ONCE):
                node, sid, text_ = (batch.column(c).slice(start, SIGNED_AT_ONCE) for c in range(3))
                found = [join.shingles(t.as_py()) for t in text_]
                # Another text may have the key and the hash.
                mine = pa.array([set_id(f) == s.as_py() for f, s in zip(found, sid)], pa.bool_())
                made = [pa.array([len(f) for f in found], pa.int64()), pa.array([make(f) for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([node, *made], names=["node", "n", "made"]).filter(mine)

    # The texts meet the few nodes in question by key and hash where they are, so what is made moves for the pairs alone.
    few = wanted.select(F.col("node").alias("_node"), F.col("sid").alias("_sid"), F.col("key").alias("_key"), F.col("content").alias("_content"))
    if wanted.count() <= BROADCAST_KEYS:
        few = F.broadcast(few)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("content"))
    met = texts.join(few, texts["key"].eqNullSafe(few["_key"]) & (texts["content"] == few["_content"])).select("_node", "_sid", "text")
    return written(met.mapInArrow(work, "node bigint, n bigint, made binary"), name)


def _settle(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, join: Join, key: str, text: str) -> DataFrame:
    """Those of the pairs (``a``, ``b``) of nodes that are linked: bitmaps first, then wide ones, then sorted arrays of the sets still in question."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def bound(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
                apart = np.bitwise_count(_bit_rows(batch.column(4)) ^ _bit_rows(batch.column(5))).sum(1)
                good = (apart <= (n_a + n_b) * (100 - join.percent) // (100 + join.percent)) & (100 * np.minimum(n_a, n_b) >= join.percent * np.maximum(n_a, n_b))
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    open_ = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    open_ = written(open_.mapInArrow(bound, "a bigint, b bigint"), "bounded")
    wide = _made(open_, nodes, docs, join, key, text, wide_bitmap, "wide")

    def bound_wide(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            apart = np.fromiter(map(wide_apart, _arrays(batch.column(4)), _arrays(batch.column(5))), np.int64, len(a))
            good = apart <= (n_a + n_b) * (100 - join.percent) // (100 + join.percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    side = lambda c: wide.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("made").alias(f"wide_{c}"))
    both = open_.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
    with batches_of(docs.sparkSession, BATCH):
        # Rows equal in key and text give a pair again.
        open_ = written(both.mapInArrow(bound_wide, "a bigint, b bigint").distinct(), "closer")
    arrays = _made(open_, nodes, docs, join, key, text, np.ndarray.tobytes, "arrays")

    def intersect(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good = []
            for a, b in zip(_arrays(batch.column(2)), _arrays(batch.column(3))):
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * common >= join.percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    array = lambda c: arrays.select(F.col("node").alias(c), F.col("made").alias(f"found_{c}"))
    both = open_.join(array("a"), "a").join(array("b"), "b").select("a", "b", "found_a", "found_b")
    with batches_of(docs.sparkSession, BATCH):
        return written(both.mapInArrow(intersect, "a bigint, b bigint").distinct(), "linked")


def _tile_pairs(members: DataFrame, join: Join) -> DataFrame:
    """Pairs of different components within tiles that sizes and bitmaps leave possible.

    ``members``: ``word``, ``node``, ``root``, ``n``, ``bits``, and ``size``, the sets in the tile. A large
    tile is cut into blocks by hash, and each pair of blocks is a unit of its own.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    own = members.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    units = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "word", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "node", "root", "n", "bits"
    )
    units = units.repartition(partitions(members.sparkSession), "word", "i", "j").sortWithinPartitions("word", "i", "j")

    def compare(rows: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one unit; columns of ``rows`` as selected below."""
        i, j = rows[0, 1:3]
        left = np.flatnonzero(rows[:, 3] == i)
        right = left if i == j else np.flatnonzero(rows[:, 3] == j)
        node, root, n = rows[right, 4], rows[right, 5], rows[right, 6]
        right_bits = bits[right]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, row in enumerate(left.tolist()):
            start = at + 1 if i == j else 0
            mine, size = rows[row, 4], rows[row, 6]
            ok = (root[start:] != rows[row, 5]) & (100 * np.minimum(n[start:], size) >= join.percent * np.maximum(n[start:], size))
            apart = np.bitwise_count(right_bits[start:] ^ bits[row]).sum(1)
            hits = node[start:][ok & (apart <= (n[start:] + size) * (100 - join.percent) // (100 + join.percent))]
            a.append(np.minimum(hits, mine))
            b.append(np.maximum(hits, mine))
        return np.concatenate(a), np.concatenate(b)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows, bits = np.empty((0, 7), np.int64), np.empty((0, BITMAP // 8), np.uint64)

        def give(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate([rows, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(7)], 1)])
            bits = np.concatenate([bits, _bit_rows(batch.column(7))])
            # The last unit may go on in the next batch.
            borders = [0, *(np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(1)) + 1).tolist()]
            if len(borders) > 1:
                yield give([compare(rows[x:y], bits[x:y]) for x, y in zip(borders, borders[1:])])
                rows, bits = rows[borders[-1] :], bits[borders[-1] :]
        if len(rows):
            yield give([compare(rows, bits)])

    return units.select("word", "i", "j", "own", "node", "root", "n", "bits").mapInArrow(work, "a bigint, b bigint").distinct()


def _members(docs: DataFrame, join: Join, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of the documents, a node for each different set, and the nodes of every signature that different sets share."""
    sets = written(_sets(docs, join, key, text), "sets")
    some = sets.where("n > 0")
    nodes = written(
        some.groupBy("sid", "head", "n", "bits").agg(
            F.min("row").alias("node"), F.min("key").alias("key"), F.min_by("content", F.struct(F.col("key").isNull(), "key")).alias("content")
        ), "nodes"
    )
    shared = _signed(docs, join, text).groupBy("word").agg(F.min("head").alias("_a"), F.max("head").alias("_b")).where("_a < _b").select("word")
    shared = written(shared, "shared")
    words = _signed(docs, join, text, _filter(shared))
    # Sets that agree in the first word of their ids alone both come along; they are told apart when pairs are settled.
    members = words.join(shared, "word").distinct().join(nodes.select("head", "node"), "head").select("word", "node")
    members = written(members, "members")
    return sets, nodes, members


def groups(docs: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): rows ``key``, ``content``, ``row``, ``n``, ``component``; and linked pairs between different sets.

    Equal sets are one node from the start, so a text copied a million times is compared once.
    In every tile the node whose parts are most widely shared leads, and all others are compared
    with it first: a large group of near copies falls together after as many comparisons as it has
    members. Only tiles that then still hold different components are compared pair by pair, in
    blocks, by bitmaps; nothing is dropped, so components are exact. ``links`` are those found,
    enough to connect every component, not all pairs within it; :func:`link_counts` finds all.

    ``component`` is the smallest key reachable by links. A document without words (null, empty
    or blank text) has size 0 and is its own component. Equal keys may stand in several rows; a
    null key is never the smallest unless all are null. Shingles are told apart by 64-bit hashes.
    Texts are read whole, however long; other columns are not read, whatever their names; an empty
    table gives no rows.
    """
    sets, nodes, members = _members(docs, join, key, text)
    sizes = members.groupBy("word").agg(F.count("*").alias("size"))
    weight = members.join(sizes, "word").groupBy("node").agg(F.sum("size").alias("_weight"))
    lead = members.join(weight, "node").groupBy("word").agg(F.max(F.struct(F.col("_weight"), (-F.col("node")).alias("_n"))).alias("_best"))
    lead = lead.select("word", (-F.col("_best._n")).alias("_lead"))
    star = members.join(lead, "word").where("node <> _lead").select(F.least("node", "_lead").alias("a"), F.greatest("node", "_lead").alias("b")).distinct()
    star = written(star, "star")
    links = _settle(star, nodes, docs, join, key, text)

    found = components(links)
    rooted = members.select("word", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_tiles = rooted.groupBy("word").agg(F.count("*").alias("size"), F.min("root").alias("_a"), F.max("root").alias("_b"))
    mixed_tiles = mixed_tiles.where("_a < _b AND size > 2").select("word", "size")
    open_members = rooted.join(mixed_tiles, "word").join(nodes.select("node", "n", "bits"), "node")
    pairs = _tile_pairs(open_members, join).join(star, ["a", "b"], "left_anti")
    more = _settle(written(pairs, "pairs"), nodes, docs, join, key, text)
    links = links.unionByName(more)

    found = components(links)
    labelled = nodes.select("node", "sid", "key").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("key").alias("component"))
    label = labelled.join(least, "root").select("sid", "root", "component")
    out = sets.select("key", "content", "row", "n", "sid").join(label, "sid", "left").select(
        "key", "content", "row", "n", F.coalesce("root", "row").alias("root"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component")
    )
    return out, links


def link_counts(docs: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): rows ``key``, ``content``, ``row``, ``n``, ``n_links``; and every linked pair of different sets.

    All members of every tile are compared, whatever their components, so no link is lost; the
    pairs grow with the square of a group of different near copies. ``n_links`` counts the other
    rows whose set is linked or equal; a document without words (null, empty or blank) has none. An
    empty table gives no rows.
    """
    sets, nodes, members = _members(docs, join, key, text)
    sizes = members.groupBy("word").agg(F.count("*").alias("size")).where("size > 1")
    every = members.join(sizes, "word").join(nodes.select("node", "n", "bits"), "node").withColumn("root", F.col("node"))
    links = _settle(written(_tile_pairs(every, join), "pairs"), nodes, docs, join, key, text)
    copies = sets.where("n > 0").groupBy("sid").agg(F.count("*").alias("_copies")).join(nodes.select("sid", "node"), "sid")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(copies.select(F.col("node").alias("b"), "_copies"), "b").groupBy("a").agg(F.sum("_copies").alias("_others"))
    counts = copies.join(others.withColumnRenamed("a", "node"), "node", "left").select("sid", (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("_links"))
    return sets.join(counts, "sid", "left").select("key", "content", "row", "n", F.coalesce("_links", F.lit(0)).alias("n_links")), links


def keep_one(docs: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all columns, one row of each group: the one with the smallest key.

    Only the rows that go are joined with the documents, by key and text hash. Rows equal in key
    and text are one document; if there are such, one of them stays. Documents without words all stay,
    null texts too; a null key stays only if all of its group are null. Long texts are compared whole;
    an empty table stays empty.
    """
    with intermediate(docs.sparkSession):
        gone, twice = _going(docs, join, key, text)
    columns = docs.columns
    marked = docs.select(F.struct(*[docs[c] for c in columns]).alias("_doc"), docs[key].alias("key"), F.xxhash64(docs[text]).alias("content"))
    kept = _semi(marked, gone, ["key", "content"], "left_anti")
    if twice.limit(1).count():
        single = _semi(kept, twice, ["key", "content"]).dropDuplicates(["key", "content"])
        kept = _semi(kept, twice, ["key", "content"], "left_anti").unionByName(single)
    return kept.select("_doc.*")


def _going(docs: DataFrame, join: Join, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``key``, ``content`` of the documents that go, and of those of which one of several equal rows stays; all else that is written on the way is deleted."""
    rows, _ = groups(docs, join, key, text)
    rows = written(rows, "groups")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("_null"), "key", "row")).alias("_first"))
    gone = rows.where("n > 0").join(first, "root").where(F.col("row") != F.col("_first.row"))
    stay = rows.join(first, "root").where(F.col("row") == F.col("_first.row")).select("key", "content")
    gone = written(gone.select("key", "content"), "gone")
    # A row that goes may equal the one that stays in key and text.
    twice = written(_semi(stay, gone, ["key", "content"]), "twice", outside=True)
    return written(_semi(gone, twice, ["key", "content"], "left_anti"), "gone", outside=True), twice
