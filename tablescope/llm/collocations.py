"""Phrases whose words stand together more often than their parts apart would, from a weighted de Bruijn graph.

Every word of a piece starts one row: the edge of four words that leads from the node of the first three to the node
of the last three, or the shorter end of the piece. Edges meet by their first two words, so the flow through a node of
three or two words (all rows that begin with it: its edges and the ends there) is summed where they lie. A node that
one edge alone leaves, with no piece ending there, is compacted with that edge into one path row. No shorter phrase is
ever counted in the texts. Edges travel as columns of word numbers, packed by part of a task and bucket.

A first pass keeps a sketch of word pairs of fixed size. A pair whose cell holds fewer occurrences than a phrase needs
cannot be in any phrase; pieces are cut there, which leaves the count of every phrase that matters as it is. Pairs in
cells that hold very much are dealt out by their next words too, and their flows are added up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, partitions, written

#: Words of the longest phrase, and so of an edge.
LONGEST = 4
#: Bytes of text handled at once; a longer single text is handled by itself.
AT_ONCE = 4 << 20
#: Edges of a bucket, about; a bucket is summed in memory.
IN_BUCKET = 1 << 20
#: Bytes of packed edges that reach a task together.
BATCH = 8 << 20
#: Cells of the sketch that travel together.
CHUNK = 1 << 16
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Phrases:
    """Phrases of ``least`` occurrences; one inside a longer phrase with ``inside`` percent of its occurrences goes; ``top`` for each language."""

    least: int = 30
    inside: int = 80
    top: int = 2000
    sketch_bits: int = 24


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _table(values: dict[int, int], rest: list[int]) -> np.ndarray:
    out = np.array(rest, np.uint8)
    for k, v in values.items():
        out[k] = v
    return out


#: Bytes in lower case, and what a byte is: 0 part of a word, 1 between words, 2 end of a piece.
LOWER = _table({k: k + 32 for k in range(0x41, 0x5B)}, list(range(256)))
KIND = _table({0x20: 1, 0x09: 1} | {k: 2 for k in [*b".,;:!?", *range(0x0A, 0x0E)]}, [0] * 256)


class Words:
    """The words of a column of texts: ``codes`` into ``names`` with their ``hashes``, ``row`` of each, and ``new`` where a piece begins."""

    def __init__(self, texts) -> None:
        import pyarrow as pa

        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        begins = ends[:-1] - ends[0]
        kind = KIND[data]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        head = begins[begins < len(data)]
        first[head] = inside[head]
        at = np.flatnonzero(first)
        bytes_before = np.cumsum(inside, dtype=np.int32)
        cuts = np.append(bytes_before[at] - 1, bytes_before[-1] if len(data) else 0).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(LOWER[data[inside]])).dictionary_encode()
        self.codes, self.names = found.indices.to_numpy().astype(np.int64), found.dictionary
        self.row = np.searchsorted(begins, at, "right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[at]
        self.new = np.ones(len(at), bool)
        self.new[1:] = (self.row[1:] != self.row[:-1]) | (piece[1:] != piece[:-1])
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        """64 bits for each different word; they only deal rows out, they do not stand for the word."""
        if not len(self.names):
            return np.empty(0, np.uint64)
        ends = np.frombuffer(self.names.buffers()[1], np.int32)[: len(self.names) + 1]
        data = np.frombuffer(self.names.buffers()[2], np.uint8)[: ends[-1]]
        sizes = np.diff(ends)
        powers = np.cumprod(np.full(int(sizes.max()), GOLD | np.uint64(1)), dtype=np.uint64)
        place = np.arange(len(data)) - np.repeat(ends[:-1], sizes)
        return _mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], ends[:-1]))


def _lang_hashes(langs) -> tuple[np.ndarray, list[str], np.ndarray]:
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    return coded.indices.to_numpy().astype(np.int64), names, np.array([xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) for n in names], np.uint64)


def _parts(batches: Iterator) -> Iterator[tuple]:
    """Languages and texts of bounded bytes."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
            yield batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)
            start = stop


def _pairs(words: Words, lang: np.ndarray, lang_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word but the last: hash of it and the next in its language, and whether they are in one piece."""
    h = words.hashes[words.codes]
    return _mixed(h[:-1] * GOLD + h[1:] + lang_hash[lang[words.row[:-1]]]), ~words.new[1:]


def _sketch(docs: DataFrame, rules: Phrases) -> tuple[bytes, np.ndarray, int]:
    """Of all word pairs: a bit for every cell that holds fewer than ``least``, the hot cells, which hold a good part of a task's rows, and their number.

    The bits are 2 ** ``sketch_bits`` whatever the corpus, and at most 8 hot cells for each shuffle partition exist, so both may be sent to all tasks.
    """
    spark = docs.sparkSession
    shift, cells, many = np.uint64(64 - rules.sketch_bits), 1 << rules.sketch_bits, 4 * partitions(spark)
    least = min(rules.least, 255)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, total = np.zeros(cells, np.uint8), 0
        large: dict[int, int] = {}
        for langs, texts in _parts(batches):
            lang, _, lang_hash = _lang_hashes(langs)
            words = Words(texts)
            if len(words.codes) < 2:
                continue
            pair, one = _pairs(words, lang, lang_hash)
            cell, n = np.unique((pair[one] >> shift).astype(np.uint32), return_counts=True)
            seen[cell] = np.minimum(255, seen[cell] + n)
            total += int(n.sum())
            # Cells below half their part everywhere are below it altogether.
            for k in np.flatnonzero(2 * many * n >= n.sum()):
                large[int(cell[k])] = large.get(int(cell[k]), 0) + int(n[k])
        for k in range(-(-cells // CHUNK)):
            chunk = seen[k * CHUNK : (k + 1) * CHUNK]
            if chunk.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([pa.compress(chunk.tobytes(), "zstd", asbytes=True)])], names=["chunk", "cell", "n", "seen"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(large) + 1, pa.int64()), pa.array([*large, -1]), pa.array([*large.values(), total]), pa.nulls(len(large) + 1, pa.binary())], names=["chunk", "cell", "n", "seen"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(pa.decompress(packed, min(CHUNK, cells), "zstd", asbytes=True), np.uint8)
                sums[k] = np.minimum(255, sums[k].astype(np.uint16) + more).astype(np.uint8) if k in sums else more
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int64()), pa.array([np.packbits(s < least).tobytes() for s in sums.values()], pa.binary())], names=["chunk", "rare"])

    counted = written(docs.mapInArrow(count, "chunk bigint, cell bigint, n bigint, seen binary"), "pair-sketch")
    summed = counted.where("chunk IS NOT NULL").select("chunk", "seen").repartition(partitions(spark), "chunk").mapInArrow(add, "chunk bigint, rare binary")
    rare = np.full(-(-cells // 8), 255, np.uint8)
    for k, bits in written(summed, "pair-sketch-bits").toLocalIterator():
        rare[k * CHUNK // 8 : k * CHUNK // 8 + len(bits)] = np.frombuffer(bits, np.uint8)
    cell_sums = counted.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n"))
    total = cell_sums.where("cell = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = cell_sums.where((F.col("cell") >= 0) & (F.col("n") * 2 * many >= total)).select("cell").toLocalIterator()
    return rare.tobytes(), np.sort(np.array([r[0] for r in hot], np.int64)), total


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones and so on: so they pack well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, count).T.copy().view("<u4").ravel()


def _packed(names, rows: np.ndarray) -> tuple[int, int, int, bytes]:
    """Rows (language, four word numbers from 1 with 0 for none, count) and the words they use: number of words, of rows and of bytes, and those packed."""
    import pyarrow as pa

    used = np.zeros(len(names) + 1, bool)
    used[rows[1:5]] = True
    used[0] = False
    number = np.cumsum(used)
    number[0] = 0
    words = names.take(pa.array(np.flatnonzero(used) - 1))
    ends = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    text = words.buffers()[2].to_pybytes()[: ends[-1]]
    raw = _planes(np.diff(ends)) + b"".join(_planes(c) for c in (rows[0], *number[rows[1:5]], rows[5])) + text
    return len(words), rows.shape[1], len(raw), pa.compress(raw, "zstd", asbytes=True)


def _unpacked(words: int, rows: int, size: int, data: bytes):
    """The words and rows of :func:`_packed`."""
    import pyarrow as pa

    raw = pa.decompress(data, size, "zstd", asbytes=True)
    ends = np.append(0, np.cumsum(_unplaned(raw[: 4 * words], words))).astype(np.int32)
    at = 4 * words
    columns = [_unplaned(raw[at + 4 * rows * k : at + 4 * rows * (k + 1)], rows) for k in range(6)]
    return pa.StringArray.from_buffers(words, pa.py_buffer(ends), pa.py_buffer(raw[at + 24 * rows :])), np.stack(columns)


EDGES = "bucket bigint, hot boolean, langs array<string>, words int, rows int, size int, packed binary"


def _edges(docs: DataFrame, rules: Phrases) -> DataFrame:
    """Edges and piece ends, counted within parts of a task: a row for each part, bucket and whether its pairs are hot."""
    spark = docs.sparkSession
    rare, hot_cells, total = _sketch(docs, rules)
    buckets = max(partitions(spark), total // IN_BUCKET)
    sent = spark.sparkContext.broadcast((rare, hot_cells))
    shift = np.uint64(64 - rules.sketch_bits)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits, hot = np.frombuffer(sent.value[0], np.uint8), sent.value[1]
        for langs, texts in _parts(batches):
            lang, lang_names, lang_hash = _lang_hashes(langs)
            words = Words(texts)
            size = len(words.codes)
            if not size:
                continue
            pair, _ = _pairs(words, lang, lang_hash)
            cell = (pair >> shift).astype(np.int64)
            new = words.new
            new[1:] |= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
            heads = np.flatnonzero(new)
            ends = np.repeat(np.append(heads[1:], size), np.diff(np.append(heads, size)))
            most = np.minimum(LONGEST, ends - np.arange(size))
            code = np.zeros((LONGEST, size), np.int32)
            code[0] = words.codes + 1
            for k in range(1, min(LONGEST, size)):
                code[k, : size - k] = np.where(most[: size - k] > k, code[0, k:], 0)
            of = lang[words.row]
            base = np.int64(len(words.names) + 1)
            high, low = (of * base + code[0]) * base + code[1], code[2] * base + code[3]
            order = np.lexsort((low, high))
            same = (np.diff(high[order]) == 0) & (np.diff(low[order]) == 0)
            firsts = np.flatnonzero(np.append(True, ~same))
            n, at = np.diff(np.append(firsts, size)), order[firsts]
            rows = np.concatenate([of[at][None, :], code[:, at], n[None, :]])
            two = np.append(pair, np.uint64(0))[at]
            h = np.append(np.uint64(0), words.hashes)
            route = np.where(rows[2] > 0, two, _mixed(h[rows[1]] ^ lang_hash[rows[0]]))
            is_hot = (rows[2] > 0) & np.isin((two >> shift).astype(np.int64), hot)
            route = np.where(is_hot, _mixed(route + h[rows[3]] * M1 + h[rows[4]] * M2), route)
            bucket = 2 * (route % np.uint64(buckets)).astype(np.int64) + is_hot
            order = np.argsort(bucket, kind="stable")
            borders = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order))
            made = [(int(bucket[order[x]]), *_packed(words.names, rows[:, order[x:y]])) for x, y in zip(borders[:-1], borders[1:])]
            columns = list(zip(*made))
            yield pa.RecordBatch.from_arrays([
                pa.array([k // 2 for k in columns[0]], pa.int64()), pa.array([k % 2 == 1 for k in columns[0]], pa.bool_()), pa.array([lang_names] * len(made), pa.list_(pa.string())),
                *[pa.array(c, pa.int32()) for c in columns[1:4]], pa.array(columns[4], pa.binary()),
            ], names=["bucket", "hot", "langs", "words", "rows", "size", "packed"])

    return docs.mapInArrow(work, EDGES)


def _flows(edges: DataFrame, rules: Phrases) -> DataFrame:
    """``lang``, ``phrase``, ``size``, ``top``, ``n``: what the edges and nodes of each bucket sum to.

    A row stands for its first ``top`` to ``size`` words, which all have ``n`` occurrences: a path without branches.
    Below ``least`` only single words and the partial sums of hot pairs are handed on.
    """
    spread = edges.repartition(partitions(edges.sparkSession), "bucket").sortWithinPartitions("bucket", "hot")

    def flow(hot: bool, parts: list[tuple]) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        # One numbering of words and languages for all parts.
        opened = [_unpacked(*p[1:]) for p in parts]
        names = pa.concat_arrays([w for w, _ in opened]).dictionary_encode()
        langs = pa.array([l for p in parts for l in p[0]], pa.string()).dictionary_encode()
        new, new_lang, at, at_lang, rows = names.indices.to_numpy(), langs.indices.to_numpy(), 0, 0, []
        for (words, found), part in zip(opened, parts):
            number = np.append(0, new[at : at + len(words)] + 1)
            rows.append(np.concatenate([new_lang[at_lang + found[0].astype(np.int64)][None, :], number[found[1:5]], found[5:]]).astype(np.int64))
            at, at_lang = at + len(words), at_lang + len(part[0])
        rows = np.concatenate(rows, 1)
        base = np.int64(len(names.dictionary) + 1)
        high, low = (rows[0] * base + rows[1]) * base + rows[2], rows[3] * base + rows[4]
        rows = rows[:, np.lexsort((low, high))]
        n = rows[5]
        begin = np.append(True, np.diff(rows[0]) != 0)
        starts, ends, there = {}, {}, {}
        for k in range(1, LONGEST + 1):
            begin = begin | np.append(True, np.diff(rows[k]) != 0)
            starts[k] = np.flatnonzero(begin)
            ends[k] = np.append(starts[k][1:], len(n))
            there[k] = rows[k, starts[k]] > 0
        # A node and the one edge (or longer node) that has all its rows are one path.
        top, covered = {1: np.ones(len(starts[1]), np.int64), 2: np.full(len(starts[2]), 2)}, {k: np.zeros(len(starts[k]), bool) for k in starts}
        for k in range(3, LONGEST + 1):
            up = np.searchsorted(starts[k - 1], starts[k], "right") - 1
            alone = there[k] & (starts[k - 1][up] == starts[k]) & (ends[k - 1][up] == ends[k]) & (not hot)
            top[k] = np.where(alone, top[k - 1][up], k)
            covered[k - 1][up[alone]] = True
        for k in range(1, LONGEST + 1):
            total = np.add.reduceat(n, starts[k])
            pick = there[k] & ~covered[k] & ((total >= rules.least) | (k == 1) | (hot and k < LONGEST))
            at = starts[k][pick]
            if len(at):
                phrase = names.dictionary.take(pa.array(rows[1, at] - 1))
                for j in range(2, k + 1):
                    phrase = pc.binary_join_element_wise(phrase, names.dictionary.take(pa.array(rows[j, at] - 1)), " ")
                yield from pa.table(
                    [langs.dictionary.take(pa.array(rows[0, at])), phrase, pa.array(np.full(len(at), k, np.int32)), pa.array(top[k][pick].astype(np.int32)), pa.array(total[pick])], names=["lang", "phrase", "size", "top", "n"]
                ).to_batches(max_chunksize=50_000)

    def work(batches: Iterator) -> Iterator:
        key, held = None, []
        for batch in batches:
            for bucket, hot, *part in zip(*[c.to_pylist() for c in batch.columns]):
                if key != (bucket, hot):
                    if held:
                        yield from flow(key[1], held)
                    key, held = (bucket, hot), []
                held.append(part)
        if held:
            yield from flow(key[1], held)

    return spread.mapInArrow(work, "lang string, phrase string, size int, top int, n bigint")


def _inner(phrase: str, size: str):
    """All shorter phrases of two words or more inside a phrase."""
    return F.expr(
        f"flatten(transform(sequence(2, {size} - 1), m -> transform(sequence(1, {size} - m + 1), i -> concat_ws(' ', slice(split({phrase}, ' '), i, m)))))"
    )


def phrases(docs: DataFrame, rules: Phrases = Phrases(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``rules.top`` phrases of each language whose parts belong together most.

    Texts, A-Z in lower case, are split at ``.,;:!?`` and line ends into pieces and those at blanks and tabs into
    words. A phrase is 2 to 4 words that stand together ``rules.least`` times (``a``), overlaps included. Cut in two,
    with ``l`` and ``r`` occurrences of its parts, it scores floor(2,000,000 a / (l + r)); its weakest cut counts, the
    first of several. One inside a longer phrase that has ``rules.inside`` percent of its occurrences or more goes.
    ``n`` is the language's number of words. Ranked by score, then ``a`` descending, then phrase in byte order.
    Counts are exact, products are taken in decimals.

    A null text has no words, like an empty one; a null language is ``und``. Every row counts, repeated ones too. An
    empty table, or one without phrases, gives no rows. Long texts are whole: their words are cut nowhere. Other
    columns are not read. The sketch's size changes what is shuffled, never the result.
    """
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    edges = _edges(slim, rules)
    with batches_of(docs.sparkSession, BATCH):
        flows = written(_flows(edges, rules), "flows")
    words = flows.where("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    spelled = flows.select("lang", "n", "phrase", F.explode(F.sequence("top", "size")).alias("size"))
    counts = spelled.groupBy("lang", F.expr("substring_index(phrase, ' ', size)").alias("phrase"), "size").agg(F.sum("n").alias("a"))
    counts = written(counts.where(F.col("a") >= rules.least), "phrase-counts")

    long = counts.where("size > 1")
    cuts = long.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"_left": F.expr("substring_index(phrase, ' ', k)"), "_right": F.expr("substring_index(phrase, ' ', k - size)")})
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    cuts = cuts.join(part("_left", "l"), ["lang", "_left"]).join(part("_right", "r"), ["lang", "_right"])
    score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(2_000_000), (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))

    inside = counts.where("size > 2").select("lang", F.col("a").alias("_longer"), F.explode(_inner("phrase", "size")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    alone = best.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < rules.inside * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("_cut.score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.top).join(words, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
