"""How far the sources of a language differ in their words, from Arrow counts merged in columnar shards.

Each task lower-cases, splits, dictionary-encodes and counts its texts with Arrow compute functions and hands on one
row per language, source and term. These meet by term, so a shard holds all sources of its terms. Most terms are in
few sources: a pair's sum over all terms is put together from the terms of either side against a source without
them, which needs only the numbers of terms by count, and corrections from the terms that both have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: What stands between terms: ASCII characters that are no letters.
BETWEEN = "[\x00-\x40\x5b-\x60\x7b-\x7f]+"
#: Bytes of text that are split at once; a longer single text is split by itself.
AT_ONCE = 4 << 20
#: Partial counts a task keeps before it hands them on.
KEPT = 400_000
#: Rows of a shard that are compared together, and cells of a block of sources by terms.
ROWS, CELLS = 100_000, 1 << 20
#: Parts by which sources of one language are paired.
SALT = 16


@dataclass(frozen=True)
class Audit:
    """Terms in at least ``documents`` documents of a language count; ``top`` terms of each source are reported."""

    documents: int = 3
    top: int = 200


def share(count: np.ndarray, words: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / (words + terms)), by long division so that no product passes 64 bits."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // (words + terms)
        rest = rest % (words + terms)
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _share(count: Column, words: Column, terms: Column) -> Column:
    """:func:`share` as a column; without words and terms it is never used."""
    exact = (count + 1).cast("decimal(20,0)") * F.lit(10**9)
    return F.call_function("div", exact.cast("decimal(38,0)"), F.greatest(words + terms, F.lit(1)).cast("decimal(38,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    """:func:`apart` as a column."""
    return F.call_function("div", (p - q) * (p - q), q)


def _slices(column) -> Iterator[tuple[int, int]]:
    """Runs of rows of bounded bytes."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
        yield start, stop
        start = stop


def partial_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` and ``docs`` (documents with the term), summed within parts of a task."""
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["lang", "source", "term"]

        def count(rows) -> pa.Table:
            words = pc.split_pattern_regex(pc.ascii_lower(rows.column(2)), pattern=BETWEEN)
            row, term = pc.list_parent_indices(words), pc.list_flatten(words)
            there = pc.not_equal(term, "")
            row, term = row.filter(there), term.filter(there).dictionary_encode()
            each = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
            of = [rows.column(i).take(each["row"].combine_chunks()).dictionary_encode() for i in (0, 1)]
            group = of[0].indices.to_numpy().astype(np.int64) * len(of[1].dictionary) + of[1].indices.to_numpy()
            both = pa.table({"group": group, "term": each["term"], "n": each["count_all"]}).group_by(["group", "term"], use_threads=False)
            both = both.aggregate([("n", "sum"), ([], "count_all")]).combine_chunks()
            group = both["group"].to_numpy()
            columns = [of[0].dictionary.take(pa.array(group // max(1, len(of[1].dictionary)))), of[1].dictionary.take(pa.array(group % max(1, len(of[1].dictionary)))), term.dictionary.take(both["term"].combine_chunks())]
            return pa.table([*columns, both["n_sum"], both["count_all"]], names=[*names, "n", "docs"])

        def merge(tables: list) -> pa.Table:
            whole = pa.concat_tables(tables).group_by(names, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            return whole.rename_columns([*names, "n", "docs"])

        kept, rows = [], 0
        for batch in batches:
            for start, stop in _slices(batch.column(2)):
                kept.append(count(batch.slice(start, stop - start)))
                rows += len(kept[-1])
                if rows > KEPT:
                    kept = [merge(kept)]
                    rows = len(kept[0])
                    if 2 * rows > KEPT:
                        yield from kept[0].combine_chunks().to_batches(max_chunksize=50_000)
                        kept, rows = [], 0
        if rows:
            yield from merge(kept).combine_chunks().to_batches(max_chunksize=50_000)

    return slim.mapInArrow(work, "lang string, source string, term string, n bigint, docs bigint")


def _shards(kept: DataFrame, top: int) -> DataFrame:
    """Of rows (``lang``, ``term``, ``source``, ``n``, ``total``, ``words``, ``lang_words``, ``terms``) that meet by term:
    corrections of pairs (``other``) and each group's farthest terms of the shard (``term``), with ``value``.
    """
    spread = kept.repartition(partitions(kept.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["lang", "source", "other", "term", "value"]

        def compare(rows: pa.Table) -> Iterator:
            lang, source, term = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source", "term"))
            l, s, t = (x.indices.to_numpy() for x in (lang, source, term))
            n, total, words, lang_words, terms = (rows[c].to_numpy() for c in ("n", "total", "words", "lang_words", "terms"))
            p, none = share(n, words, terms), share(np.zeros_like(n), words, terms)
            q = share(total, lang_words, terms)
            # Terms above their language's share, the farthest of each group; rows come in the order of terms.
            above = np.flatnonzero(p > q)
            value = apart(p[above], q[above])
            group = l[above].astype(np.int64) * (len(source.dictionary) + 1) + s[above]
            order = np.lexsort((above, -value, group))
            firsts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else np.empty(0, np.int64)
            place = np.arange(len(order)) - np.repeat(firsts, np.diff(np.append(firsts, len(order))))
            best = order[place < top]
            at = pa.array(above[best])
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(lang.indices.take(at)), source.dictionary.take(source.indices.take(at)), pa.nulls(len(at), pa.string()), term.dictionary.take(term.indices.take(at)), pa.array(value[best])], names=names
            )
            for code in np.unique(l):
                mine = np.flatnonzero(l == code)
                present, s_at = np.unique(s[mine], return_inverse=True)
                p_none = np.zeros(len(present), np.int64)
                p_none[s_at] = none[mine]
                sums, met = np.zeros((len(present),) * 2, np.int64), np.zeros((len(present),) * 2, bool)
                new = np.append(True, np.diff(t[mine]) != 0)
                t_at = np.cumsum(new) - 1
                step = max(1, CELLS // len(present))
                for first in range(0, int(t_at[-1]) + 1, step):
                    some = (t_at >= first) & (t_at < first + step)
                    block = np.zeros((len(present), step), np.int64)
                    block[s_at[some], t_at[some] - first] = p[mine[some]]
                    for a in range(len(present)):
                        has = np.flatnonzero(block[a])
                        if len(has):
                            mine_p, theirs = block[a, has][None, :], block[:, has]
                            both, away = theirs > 0, p_none[:, None]
                            found = np.where(both, apart(mine_p, np.maximum(theirs, 1)) - apart(mine_p, away) - apart(p_none[a], np.maximum(theirs, 1)) + apart(p_none[a], away), 0)
                            sums[a] += found.sum(1)
                            met[a] |= both.any(1)
                np.fill_diagonal(met, False)
                a, b = np.nonzero(met)
                name = source.dictionary.take(pa.array(present))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.dictionary[int(code)].as_py()] * len(a), pa.string()), name.take(pa.array(a)), name.take(pa.array(b)), pa.nulls(len(a), pa.string()), pa.array(sums[a, b])], names=names
                )

        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                rows = pa.Table.from_batches(held).combine_chunks()
                # The last term may go on in the next batch.
                new = (rows["lang"].to_numpy()[-1], rows["term"].to_numpy()[-1])
                end = len(rows)
                tail_lang, tail_term = rows["lang"].to_numpy(), rows["term"].to_numpy()
                while end and (tail_lang[end - 1], tail_term[end - 1]) == new:
                    end -= 1
                if end:
                    yield from compare(rows.slice(0, end))
                    held = rows.slice(end).to_batches()
        if held and sum(b.num_rows for b in held):
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    return spread.mapInArrow(work, "lang string, source string, other string, term string, value bigint")


def divergences(docs: DataFrame, audit: Audit = Audit(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: each source against the others of its language, and its own terms.

    Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. A language keeps the V terms that at
    least ``audit.documents`` of its rows have. A share is p = 1 + floor(10**9 (count + 1) / (N + V)), N the group's
    occurrences of kept terms; a divergence floor((p - q)**2 / q). Part ``pair``: against each other source, summed
    over all kept terms. Part ``term``: kept terms that the source uses more than its language does, the
    ``audit.top`` farthest. Ranks count from 1 by value descending, then item in byte order. All arithmetic is whole.

    Null text, language or source count as ''. Every row is a document, repeated ones too. A group without kept terms
    still has its pairs; without any kept term in the language their values are 0. A source alone in its language has
    no pairs. An empty table gives no rows. Long texts are split by themselves, whole. Other columns are not read.
    The pairs of a language are as many as its sources squared, because that is the report.
    """
    merged = partial_counts(docs, text, lang, source).repartition(partitions(docs.sparkSession), "lang", "term")
    merged = merged.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    kept = merged.withColumns({
        "_docs": F.sum("docs").over(by_term), "total": F.sum("n").over(by_term), "_first": F.min("source").over(by_term) == F.col("source"),
    }).where(F.col("_docs") >= audit.documents)
    kept = written(kept.select("lang", "term", "source", "n", "total", "_first"), "kept-terms")

    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("has"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_words"), F.sum(F.col("_first").cast("bigint")).alias("terms"))
    zero = lambda *names: [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names]
    groups = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *zero("words", "has", "lang_words", "terms"))
    groups = written(groups, "groups")

    shards = _shards(kept.drop("_first").join(groups.drop("has"), ["lang", "source"]), audit.top)
    shards = written(shards, "divergence-shards")

    # Every two sources of a language, in parts, so that one large language is not one task.
    sides = [groups.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "words", "has")], *(["terms"] if x == "a" else [])) for x in "ab"]
    left = sides[0].withColumn("_salt", F.pmod(F.xxhash64("source_a"), F.lit(SALT)).cast("int"))
    right = sides[1].withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    pairs = left.join(right, ["lang", "_salt"]).where("source_a <> source_b").drop("_salt")
    pairs = written(pairs.withColumns({f"none_{x}": _share(F.lit(0), F.col(f"words_{x}"), F.col("terms")) for x in "ab"}), "pairs")

    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("_times"))
    exact = lambda c: c.cast("decimal(38,0)")
    keys = ["lang", "source_a", "source_b"]
    of_a = pairs.join(counts.withColumnRenamed("source", "source_a"), ["lang", "source_a"])
    of_a = of_a.select(*keys, (exact(F.col("_times")) * _apart(_share(F.col("n"), F.col("words_a"), F.col("terms")), F.col("none_b"))).alias("_value"))
    of_b = pairs.join(counts.withColumnRenamed("source", "source_b"), ["lang", "source_b"])
    of_b = of_b.select(*keys, (exact(F.col("_times")) * _apart(F.col("none_a"), _share(F.col("n"), F.col("words_b"), F.col("terms")))).alias("_value"))
    rest = pairs.select(*keys, (exact(F.col("terms") - F.col("has_a") - F.col("has_b")) * _apart(F.col("none_a"), F.col("none_b"))).alias("_value"))
    fix = shards.where("other IS NOT NULL").select("lang", F.col("source").alias("source_a"), F.col("other").alias("source_b"), exact(F.col("value")).alias("_value"))
    sums = [x.withColumn("_value", exact(F.col("_value"))) for x in (of_a, of_b, rest, fix)]
    values = sums[0].unionByName(sums[1]).unionByName(sums[2]).unionByName(sums[3]).groupBy(*keys).agg(F.sum("_value").cast("bigint").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = values.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value")
    terms = shards.where("term IS NOT NULL").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    pair = pair.withColumn("rank", F.row_number().over(order))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= audit.top)
    return pair.unionByName(terms)
