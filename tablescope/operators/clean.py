"""Ordered cleaning steps with counters and a log.

Steps take effect in the given order. Steps on different columns do not touch each other, so
between two row-dropping steps they are gathered: all the figures they need come from a few shared
passes and all their changes are one projection. The number of jobs follows the number of
row-dropping steps and of dependent steps on one column, not the number of steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import (
    AnalysisException,
    ArithmeticException,
    ArrayIndexOutOfBoundsException,
    DateTimeException,
    IllegalArgumentException,
    NumberFormatException,
    ParseException,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.dates import DATE_FORMATS, parse_date, parse_shaped_date, with_shape
from ..functions.numbers import DATE_TYPES, NUMERIC_TYPES, blank_nan, quoted
from ..functions.order import written
from ..functions.quantiles import quantiles
from ..session import cut_lineage
from .evidence import value_pairs
from .stats import fences, outside

ROW_DROPPING = ("remove_duplicates", "drop_missing_rows", "remove_outliers")
# Actions whose new values depend on figures of the whole column.
NEEDS_FIGURES = ("fill_missing_median", "fill_missing_mean", "fill_missing_mode", "convert_to_datetime", "cap_outliers", "standardize_boolean")
# Actions after which a column may have another type; the next step on it must see that type.
CHANGES_TYPE = ("fill_missing_zero", "convert_to_numeric")
# Hashes of repeated rows that are broadcast at most.
REPEATED_KEYS = 1_000_000
FILL_WORDS = {"fill_missing_unknown": "Unknown", "fill_missing_notprovided": "Not_Provided"}
NUMERIC_FILLS = ("fill_missing_median", "fill_missing_mean", "fill_missing_zero")
TITLE_ACTIONS = ("standardize_case", "standardize_categories")
COLUMN_ACTIONS = (
    *NEEDS_FIGURES, *FILL_WORDS, *TITLE_ACTIONS, "fill_missing_zero", "drop_empty_column", "drop_constant_column",
    "trim_whitespace", "remove_special_chars", "convert_to_numeric", "standardize_boolean",
)


@dataclass(frozen=True)
class Step:
    at: int
    column: str
    action: str


@dataclass
class Report:
    rows_before: int = 0
    rows_after: int = 0
    duplicates_removed: int = 0
    missing_fixed: int = 0
    columns_standardized: int = 0
    outliers_handled: int = 0
    columns_dropped: int = 0
    type_conversions: int = 0
    log: list[tuple] = field(default_factory=list)

    def note(self, step: Step, detail: str, status: str = "Applied") -> None:
        self.log.append((step.at, step.column, step.action, status, detail))


COUNTERS = [
    "rows_before", "rows_after", "duplicates_removed", "missing_fixed", "columns_standardized", "outliers_handled",
    "columns_dropped", "type_conversions",
]


def apply_cleaning(df: DataFrame, steps, stored: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply ``(column, action)`` steps: cleaned frame, one-row counters, log.

    Unless the table is ``stored`` as files already, it is written once and the passes read that.
    A step that fails, names no column of the table or no known action is logged and skipped.
    """
    queue = [Step(i, column, action) for i, (column, action) in enumerate(steps, 1)]
    frame, report = blank_nan(df if stored else written(df, "cleaning")), Report()
    report.rows_before = report.rows_after = frame.count()
    block: list[Step] = []
    for step in queue:
        if step.action in ROW_DROPPING:
            frame = _apply_block(frame, block, report)
            block = []
            frame = _guarded(_drop_rows, frame, [step], report)
        else:
            block.append(step)
    frame = _apply_block(frame, block, report)
    return frame, *_report_frames(df, report)


def _report_frames(df, report):
    spark = df.sparkSession
    counters = spark.createDataFrame([tuple(getattr(report, c) for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
    log = spark.createDataFrame(sorted(report.log), "step int, column string, action string, status string, detail string")
    return counters, log


def _guarded(work, frame, steps, report):
    """Run a group of steps; if it fails, run its steps alone so that only the bad one is skipped.

    A step's own failures are those of its plan and of a cast or sum of its values. Failures of
    the job, such as a lost executor or a full disk, are not the step's: they go on to the caller.
    """
    noted, counters = len(report.log), {c: getattr(report, c) for c in COUNTERS}
    try:
        return work(frame, steps, report)
    except (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, ParseException) as error:
        del report.log[noted:]
        for name, value in counters.items():
            setattr(report, name, value)
        if len(steps) == 1:
            report.note(steps[0], str(error).splitlines()[0], "Failed")
            return frame
        for step in steps:
            frame = _guarded(work, frame, [step], report)
        return frame


def _apply_block(frame: DataFrame, block: list[Step], report: Report) -> DataFrame:
    """Column steps between two row-dropping ones, in as few rounds as their order allows."""
    rounds: list[list[Step]] = []
    round_of: dict[str, int] = {}
    for step in block:
        at = round_of.setdefault(step.column, 0)
        while len(rounds) <= at:
            rounds.append([])
        rounds[at].append(step)
        if step.action in NEEDS_FIGURES + CHANGES_TYPE:
            round_of[step.column] = at + 1
    for steps in rounds:
        frame = _guarded(_apply_round, frame, steps, report)
    return frame


def _number(frame: DataFrame, name: str, c: Column) -> Column:
    kind = frame.schema[name].dataType
    return c.cast("double") if isinstance(kind, NUMERIC_TYPES) else text.parse_number(c)


def _is(frame: DataFrame, name: str, *kinds) -> bool:
    return isinstance(frame.schema[name].dataType, kinds)


def _apply_round(frame: DataFrame, steps: list[Step], report: Report) -> DataFrame:
    current = {name: quoted(name) for name in frame.columns}
    figures: dict[str, Column] = {}  # aggregates of the shared pass
    ranks: dict[str, Column] = {}  # columns whose quartiles are needed
    modes: dict[str, Column] = {}
    dated: dict[str, Column] = {}  # columns whose date forms are counted
    finish = []  # run once the figures are known, in step order
    for step in steps:
        name, action, tag = step.column, step.action, f"s{step.at}"
        if action not in COLUMN_ACTIONS:
            finish.append(lambda row, s=step: report.note(s, "unknown action", "Skipped"))
            continue
        if name not in current:
            finish.append(lambda row, s=step: report.note(s, "no such column", "Skipped"))
            continue
        c = current[name]
        if action in ("drop_empty_column", "drop_constant_column"):
            del current[name]
            finish.append(lambda row, s=step: _dropped(report, s))
        elif action in NUMERIC_FILLS:
            x = _number(frame, name, c)
            figures[tag] = F.count_if(x.isNull())
            if action == "fill_missing_median":
                ranks[tag] = x
            elif action == "fill_missing_mean":
                figures[f"{tag}_mean"] = F.avg(x)
            else:
                current[name] = F.coalesce(x, F.lit(0.0))
            finish.append(lambda row, s=step, x=x: _filled(report, s, row, current, x, quartiles))
        elif action in FILL_WORDS:
            figures[tag] = F.count_if(c.isNull())
            current[name] = F.coalesce(c.cast("string"), F.lit(FILL_WORDS[action]))
            finish.append(lambda row, s=step: _filled_word(report, s, row))
        elif action == "fill_missing_mode":
            figures[tag] = F.count_if(c.isNull())
            modes[tag] = c
            finish.append(lambda row, s=step, c=c: _filled_mode(report, s, row, current, c, found_modes, frame))
        elif action == "trim_whitespace":
            stripped = text.strip(c) if _is(frame, name, T.StringType) else c
            figures[tag] = F.count_if(c != stripped)
            current[name] = stripped
            finish.append(lambda row, s=step: _standardised(report, s, f"Trimmed {row[f's{s.at}']} values."))
        elif action == "remove_special_chars":
            current[name] = text.drop_non_printable(c.cast("string"))
            finish.append(lambda row, s=step: _standardised(report, s, "Removed special characters."))
        elif action in TITLE_ACTIONS:
            if _is(frame, name, T.StringType):
                current[name] = text.title_case(c)
            finish.append(lambda row, s=step: _standardised(report, s, "Changed to title case."))
        elif action == "standardize_boolean":
            figures[tag] = F.count_if(c.isNotNull() & text.parse_boolean(c).isNull())
            finish.append(lambda row, s=step, c=c: _truth(report, s, row, current, c))
        elif action == "convert_to_numeric":
            if not _is(frame, name, *NUMERIC_TYPES):
                current[name] = text.parse_number(c)
            finish.append(lambda row, s=step: _converted(report, s, "Changed to numbers."))
        elif action == "convert_to_datetime":
            if not _is(frame, name, *DATE_TYPES):
                figures[tag] = F.count(c)
                dated[tag] = c
                for i, (fmt, _) in enumerate(DATE_FORMATS):
                    figures[f"{tag}_{i}"] = F.count(parse_shaped_date(quoted(f"_text_{tag}"), quoted(f"_shape_{tag}"), fmt))
            finish.append(lambda row, s=step, c=c: _dated(report, s, row, current, c, frame))
        elif action == "cap_outliers":
            ranks[tag] = _number(frame, name, c)
            finish.append(lambda row, s=step: _capped(report, s, row, current, ranks, quartiles))
    found = quantiles(frame, ranks, [0.25, 0.5, 0.75]) if ranks else {}
    quartiles = {tag: found[tag].quantiles for tag in ranks}
    for step in steps:
        if step.action == "cap_outliers" and f"s{step.at}" in ranks:
            tag = f"s{step.at}"
            bounds = fences(quartiles[tag][0.25], quartiles[tag][0.75], guard=True)
            figures[tag] = F.count_if(outside(ranks[tag], bounds))
    found_modes = _modes(frame, modes) if modes else {}
    source = frame
    for tag, c in dated.items():
        source = with_shape(source, c, f"_text_{tag}", f"_shape_{tag}")
    row = source.agg(*[c.alias(tag) for tag, c in figures.items()]).first().asDict() if figures else {}
    for act in finish:
        act(row)
    return frame.select(*[current[name].alias(name) for name in frame.columns if name in current])


def _modes(frame: DataFrame, columns: dict[str, Column]) -> dict[str, str]:
    """Most frequent value per column as text, the smallest among equals by the column's own order; one pass for all columns."""
    typed = frame.select(*[c.alias(tag) for tag, c in columns.items()])
    numeric = [f.name for f in typed.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    pairs = value_pairs(typed).where("value is not null")
    size = F.when(F.col("column").isin(numeric), F.col("value").try_cast("double"))
    exact = F.when(F.col("column").isin(numeric), F.col("value").try_cast("decimal(38,6)"))
    first = Window.partitionBy("column").orderBy(F.desc("n"), size.asc(), exact.asc(), F.asc("value"))
    best = pairs.withColumn("at", F.row_number().over(first)).where("at = 1")
    return {r["column"]: r["value"] for r in best.collect()}


def _dropped(report, step):
    report.columns_dropped += 1
    report.note(step, "Dropped the column.")


def _filled(report, step, row, current, x, quartiles):
    tag = f"s{step.at}"
    count = row[tag]
    how = step.action.removeprefix("fill_missing_")
    if how != "zero":
        value = quartiles[tag][0.5] if how == "median" else row[f"{tag}_mean"]
        current[step.column] = F.coalesce(x, F.lit(value).cast("double"))
    report.missing_fixed += count
    report.note(step, f"Filled {count} values with {'0' if how == 'zero' else 'the ' + how}.")


def _filled_word(report, step, row):
    count = row[f"s{step.at}"]
    report.missing_fixed += count
    report.note(step, f"Filled {count} values with {FILL_WORDS[step.action]}.")


def _filled_mode(report, step, row, current, c, modes, frame):
    tag = f"s{step.at}"
    if tag not in modes:
        report.note(step, "no value to fill with", "Skipped")
        return
    value = F.lit(modes[tag]).cast(frame.schema[step.column].dataType)
    current[step.column] = F.coalesce(c, value)
    report.missing_fixed += row[tag]
    report.note(step, f"Filled {row[tag]} values with {modes[tag]}.")


def _standardised(report, step, detail):
    report.columns_standardized += 1
    report.note(step, detail)


def _converted(report, step, detail):
    report.type_conversions += 1
    report.note(step, detail)


def _truth(report, step, row, current, c):
    """A boolean column if every value is a truth word; else text with the words unified and the rest kept."""
    parsed, others = text.parse_boolean(c), row[f"s{step.at}"]
    if others:
        words = F.when(parsed, "True").when(~parsed, "False")
        current[step.column] = F.coalesce(words, c.cast("string"))
        _standardised(report, step, f"Truth words became True and False; {others} other values stay.")
    else:
        current[step.column] = parsed
        _standardised(report, step, "Changed to true and false.")


def _dated(report, step, row, current, c, frame):
    if _is(frame, step.column, *DATE_TYPES):
        _converted(report, step, "Changed to dates.")
        return
    parsed = [row[f"s{step.at}_{i}"] for i in range(len(DATE_FORMATS))]
    best, present = max(parsed), row[f"s{step.at}"]
    if not best:
        report.note(step, "no value is a date", "Skipped")
        return
    current[step.column] = parse_date(c, DATE_FORMATS[parsed.index(best)][0])
    _converted(report, step, f"Changed to dates; {present - best} values became NULL." if present > best else "Changed to dates.")


def _capped(report, step, row, current, ranks, quartiles):
    tag = f"s{step.at}"
    bounds = fences(quartiles[tag][0.25], quartiles[tag][0.75], guard=True)
    if bounds is None:
        report.note(step, "the middle half of the values is equal", "Skipped")
        return
    x, (low, high) = ranks[tag], bounds
    current[step.column] = F.when(x < low, low).when(x > high, high).otherwise(x)
    report.outliers_handled += row[tag]
    report.note(step, f"Capped {row[tag]} values to {low:.2f} .. {high:.2f}.")


def without_repeats(frame: DataFrame) -> tuple[DataFrame, int]:
    """The frame with one of each group of equal rows (missing values are equal), and how many rows went.

    Rows meet as two 64-bit hashes. Only rows whose hashes occur again are compared as a whole; the others pass a
    broadcast list of those hashes. What stays is written, as the passes that follow would hash every row again. A table
    with more than ``REPEATED_KEYS`` repeated rows is shuffled and written as a whole.
    """
    parts = [x for c in frame.columns for x in (quoted(c), quoted(c).isNull())]
    marked = frame.withColumns({"_a": F.xxhash64(*parts), "_b": F.xxhash64(F.lit(1), *parts)})
    twice = written(marked.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "repeated")
    keys, copies = twice.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if not keys:
        return frame, 0
    if keys > REPEATED_KEYS:
        once = cut_lineage(frame.dropDuplicates())
        return once, frame.count() - once.count()
    known = F.broadcast(twice.select("_a", "_b"))
    once = written(marked.join(known, ["_a", "_b"], "left_semi").drop("_a", "_b").dropDuplicates(), "once")
    rest = marked.join(known, ["_a", "_b"], "left_anti").drop("_a", "_b")
    return written(rest.unionByName(once), "unrepeated"), copies - once.count()


def _drop_rows(frame: DataFrame, steps: list[Step], report: Report) -> DataFrame:
    step = steps[0]
    if step.action == "remove_duplicates":
        frame, removed = without_repeats(frame)
        report.duplicates_removed += removed
        report.note(step, f"Removed {removed} repeated rows.")
    elif step.column not in frame.columns:
        report.note(step, "no such column", "Skipped")
        return frame
    elif step.action == "drop_missing_rows":
        c = quoted(step.column)
        removed = frame.where(c.isNull()).count()
        frame = frame.where(c.isNotNull())
        report.missing_fixed += removed
        report.note(step, f"Dropped {removed} rows without a value.")
    else:
        x = _number(frame, step.column, quoted(step.column))
        found = quantiles(frame, {"x": x}, [0.25, 0.75])["x"].quantiles
        bounds = fences(found[0.25], found[0.75], guard=True)
        if bounds is None:
            report.note(step, "the middle half of the values is equal", "Skipped")
            return frame
        bad = F.coalesce(outside(x, bounds), F.lit(False))
        removed = frame.where(bad).count()
        frame = frame.where(~bad)
        report.outliers_handled += removed
        report.note(step, f"Removed {removed} rows with outliers.")
    report.rows_after -= removed
    return frame


def enabled_steps(suggestions: DataFrame) -> list[tuple[str, str]]:
    """The suggestions that are switched on, in order, as steps (a few per column)."""
    rows = suggestions.where("enabled").orderBy("step").select("column", "action").collect()
    return [(r["column"], r["action"]) for r in rows]
