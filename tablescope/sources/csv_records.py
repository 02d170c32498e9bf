"""Whole records of CSV files whose quoted fields hold line breaks, without giving up splitting.

Nobody can tell from the middle of a file whether it is inside quotes. So every split is walked through twice at once,
as if it began outside and as if it began inside quotes; that makes it a function of one bit, and the functions of a
file's splits are composed in order by window sums. With its true beginning known, each split hands on its whole
records and, of those that cross its ends, the pieces, which are put together by file and record.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.order import written

#: Files or splits that are broadcast at most; with more of them the lines are brought together by split.
BROADCAST_SPLITS = 100_000


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that begins inside (or outside) quotes ends inside them; quotes amid an unquoted field are text."""
    at = 0
    while True:
        if inside:
            end = line.find(b'"', at)
            if end < 0:
                return True
            if line[end + 1 : end + 2] == b'"':
                at = end + 2
                continue
            inside, at = False, line.find(b",", end + 1) + 1
        elif line.startswith(b'"', at):
            inside, at = True, at + 1
            continue
        else:
            at = line.find(b",", at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path) -> DataFrame:
    """``file``, ``split`` (its first byte), ``at`` (order within the split) and ``line`` as bytes, cut at line feeds alone."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line")
    )


def _with(lines: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Lines joined with a table of files or splits, those of a split together and in order."""
    if small.count() <= BROADCAST_SPLITS:
        return lines.join(F.broadcast(small), on)
    return lines.join(small, on).repartition("file", "split").sortWithinPartitions("file", "split", "at")


def _pieces(line: bytes) -> list[tuple[bytes, bytes]]:
    """Lines and their ends; a carriage return ends a line too."""
    if b"\r" not in line:
        return [(line, b"\n")]
    parts = line.split(b"\r")
    ends = [b"\r"] * (len(parts) - 2) + ([b"\r\n"] if not parts[-1] else [b"\r", b"\n"])
    return list(zip(parts if parts[-1] else parts[:-1], ends))


def split_states(spark: SparkSession, path, files: DataFrame) -> DataFrame:
    """``file``, ``split``, ``inside`` (it begins inside quotes) and ``broken`` (the file has records of several lines), for the splits of ``files``."""

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def row(run):
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in run], names=["file", "split", "out", "in", "opens"])

        run: list | None = None
        for batch in batches:
            quoted = pc.match_substring(batch.column(2), '"').to_numpy(zero_copy_only=False)
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for at, key in enumerate(keys):
                if run is None or key != (run[0], run[1]):
                    if run:
                        yield row(run)
                    run = [*key, False, True, False]
                if quoted[at]:
                    for line, _ in _pieces(batch.column(2)[at].as_py()):
                        now = ends_inside(line, run[2])
                        run[4] |= now and not run[2]
                        run[2], run[3] = now, ends_inside(line, run[3])
        if run:
            yield row(run)

    lines = _with(_lines(spark, path), files.select("file"), ["file"]).select("file", "split", "line")
    walked = written(lines.mapInArrow(walk, "file string, split bigint, out boolean, in boolean, opens boolean"), "csv-splits")
    order = Window.partitionBy("file").orderBy("split")
    turns = F.sum((F.col("out") & ~F.col("in")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) % 2
    fixed = F.when(F.col("out") == F.col("in"), (F.col("out").cast("int") + F.col("_turns")) % 2)
    after = walked.withColumn("_turns", turns).withColumn("_fixed", fixed)
    after = after.withColumn("_after", (F.coalesce(F.last("_fixed", ignorenulls=True).over(order), F.lit(0)) + F.col("_turns")) % 2 == 1)
    return after.select(
        "file", "split", F.coalesce(F.lag("_after").over(order), F.lit(False)).alias("inside"), F.max("opens").over(Window.partitionBy("file")).alias("broken"),
    )


def whole_records(spark: SparkSession, path, states: DataFrame) -> DataFrame:
    """``file``, ``first`` (the file's first record) and ``record`` (bytes, without its line end) for the files of ``states``.

    A record of a file that ends inside quotes goes to its end. Blank lines between records are left out.
    """
    states = written(states.select("file", "split", "inside"), "csv-states")
    lines = _with(_lines(spark, path), states, ["file", "split"])

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["file", "split", "part", "first", "record"]
        key, inside, open_, part, first, rows = None, False, [], "record", False, []

        def give():
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return done

        def close():
            # What is still open at the end of a split goes on in the next one.
            if open_:
                rows.append((*key, "head" if part == "head" else "tail", first, b"".join(open_)))
                open_.clear()

        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        for batch in batches:
            for file, split, line, begins_inside in zip(*[c.to_pylist() for c in batch.columns]):
                if (file, split) != key:
                    if key:
                        close()
                    key, inside, first = (file, split), begins_inside, split == 0
                    part = "head" if inside else "record"
                for piece, end in _pieces(line):
                    inside = ends_inside(piece, inside) if inside or b'"' in piece else False
                    if inside:
                        open_ += [piece, end]
                        continue
                    if open_ or part == "head" or piece.strip():
                        rows.append((file, split, part, first, b"".join([*open_, piece])))
                        open_.clear()
                        part, first = "record", False
            if rows:
                yield give()
        if key:
            close()
        if rows:
            yield give()

    parts = lines.select("file", "split", "line", "inside").mapInArrow(cut, "file string, split bigint, part string, first boolean, record binary")
    parts = written(parts, "csv-records")
    # Of a record that crosses splits: its tail in one, then the heads of those that follow.
    crossing = parts.where("part <> 'record'").withColumn("_order", F.struct("split", F.col("part") == "tail"))
    number = F.sum((F.col("part") == "tail").cast("int")).over(Window.partitionBy("file").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0))
    crossing = crossing.withColumn("_number", number).groupBy("file", "_number").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("_order", "record"))).alias("_parts")
    )
    whole = F.aggregate("_parts", F.lit(b""), lambda s, p: F.concat(s, p["record"]))
    whole = F.rtrim(F.decode(whole, "ISO-8859-1"), F.lit("\r\n"))
    crossing = crossing.select("file", "first", F.encode(whole, "ISO-8859-1").alias("record"))
    return parts.where("part = 'record'").select("file", "first", "record").unionByName(crossing)
