import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.operators import stats
from tablescope.functions import dates, numbers, quantiles, text


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_numbers_in_text(spark):
    raw = ["100", "200", "missing", "$400", "1,200.50", "1d", "1e3", "inf", " 12 ", "", None]
    df = one_column(spark, raw)
    strict = [r[0] for r in df.select(text.parse_number(F.col("x"))).collect()]
    assert strict == [100.0, 200.0, None, None, None, None, 1000.0, None, 12.0, None, None]
    loose = [r[0] for r in df.select(text.parse_number(text.drop_symbols(F.col("x")))).collect()]
    assert loose == [100.0, 200.0, None, 400.0, 1200.5, None, 1000.0, None, 12.0, None, None]


def test_title_and_strip(spark):
    raw = ["o'neil new-york 3rd ABC", "\ta ", "  MIDDLE east", "américa é", "x　"]
    got = [r[0] for r in one_column(spark, raw).select(text.title_case(F.col("x"))).collect()]
    assert got == [v.strip().title() for v in raw]
    got = [r[0] for r in one_column(spark, raw).select(text.strip(F.col("x"))).collect()]
    assert got == [v.strip() for v in raw]


def test_human_numbers(spark):
    df = one_column(spark, [1234567.8, 1234.5, 12.0, -2500.0, None], "double")
    rows = [tuple(r) for r in df.select(text.human_number(F.col("x")), text.plain_number(F.col("x"))).collect()]
    assert rows == [("1.23M", "1,234,567.80"), ("1.2K", "1,234.50"), ("12.00", "12"), ("-2.5K", "-2,500"), (None, None)]


def test_dates(spark):
    df = one_column(spark, ["2024-01-05", "2024-1-5", "2015", "2024-02-30", None])
    got = [r[0] for r in df.select(dates.parse_date(F.col("x"), "yyyy-M-d").cast("string")).collect()]
    assert got == ["2024-01-05 00:00:00", "2024-01-05 00:00:00", None, None, None]
    df = one_column(spark, ["Jan 5, 2024", "5 Jan 2024"])
    got = [r[0] for r in df.select(dates.parse_date(F.col("x"), "MMM d, yyyy").cast("string")).collect()]
    assert got == ["2024-01-05 00:00:00", None]


def test_skew_and_correlation(spark):
    df = one_column(spark, [1.0, 2.0, 3.0, 10.0], "double")
    row = df.agg(numbers.adjusted_skew(F.col("x")), F.stddev_samp("x")).first()
    assert row[0] == pytest.approx(1.763632614803888) and row[1] == pytest.approx(4.08248290463863)
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    row = df.agg(numbers.adjusted_skew(F.col("x")), numbers.correlation(F.col("x"), F.col("y"))).first()
    assert tuple(row) == (0.0, None)
    for n in (1, 2):
        row = df.limit(n).agg(numbers.adjusted_skew(F.col("y")), F.stddev_samp("y")).first()
        assert row[0] is None and (row[1] is None) == (n == 1)


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (-0.0,), (2.0,)], "x double")
    blank = numbers.blank_nan(df)
    assert [str(r[0]) for r in blank.collect()] == ["None", "None", "0.0", "2.0"]
    assert blank.where("false").agg(numbers.total(F.col("x"))).first()[0] == 0.0


@pytest.mark.parametrize("held", [(8, 40), (100, 500), (4096, 60_000)])
@pytest.mark.parametrize("shape", ["ties", "hot", "long tail"])
def test_quantiles_are_exact(spark, monkeypatch, held, shape):
    monkeypatch.setattr(quantiles, "FIRST_HELD", held[0])
    monkeypatch.setattr(quantiles, "HELD", held[1])
    monkeypatch.setattr(quantiles, "FEW", 0 if held[0] == 8 else 8)
    rng = random.Random(7)
    draw = {
        "even": lambda: rng.random(),
        "ties": lambda: rng.randrange(7),
        "hot": lambda: 3.0 if rng.random() < 0.6 else rng.random() * 9,
        "long tail": lambda: rng.random() ** -3,
        "tiny": lambda: rng.random(),
    }[shape]
    values = [float(draw()) for _ in range(4 if shape == "tiny" else 3000)]
    rows = [(v, "a" if i % 3 else "b") for i, v in enumerate(values)] + [(None, "a"), (1.0, None)][:1]
    df = spark.createDataFrame(rows, "x double, k string").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles.quantiles(df, {"x": F.col("x")}, probs)["x"]
    assert got.count == len(values)
    assert [got.quantiles[p] for p in probs] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    grouped = {r["g"]: r for r in quantiles.grouped_quantiles(df, F.col("k"), F.col("x"), probs).collect()}
    for key, part in pd.DataFrame(rows, columns=["x", "k"]).dropna().groupby("k")["x"]:
        assert grouped[key]["count"] == len(part)
        assert [grouped[key][f"p{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(part, probs)), rel=1e-12)
    for k in (1, 3):
        assert quantiles.kth_largest(df, F.col("x"), k) == sorted(values)[-k]
    assert quantiles.kth_largest(df, F.col("x"), len(values) + 1) is None


def test_only_rows_inside_a_bracket_are_sketched_again(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD", 500)
    sketched = []
    work = quantiles._summed
    monkeypatch.setattr(quantiles, "_summed", lambda slim, sums: sketched.append(slim.count()) or work(slim, sums))
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 4).cast("double").alias("y"))
    got = quantiles.quantiles(df, {"x": F.col("x"), "y": F.col("y")}, [0.25, 0.5])
    frame = df.toPandas()
    for c in ("x", "y"):
        assert [got[c].quantiles[p] for p in (0.25, 0.5)] == pytest.approx(list(frame[c].quantile([0.25, 0.5])), rel=1e-12)
    assert sketched[0] == 20_000 and len(sketched) > 1 and max(sketched[1:]) < 6_000


def test_numbers_with_symbols(spark):
    texts = ["$1,234.50", " 12 % ", "\u00a07", "\x1c8\x1d", "1e3", "-.5", "+ 3", "EUR 5", "\u00a3\u00a59", "1\n", "\n", "", "Customer#1", "e", "\u0665", None, "1 2", "\u30004\u2028", "\u200b5"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [tuple(r) for r in df.select(text.parse_number_with_symbols(F.col("x")), text.parse_number(text.drop_symbols(F.col("x")))).collect()]
    assert [a for a, _ in got] == [b for _, b in got] and got[0][0] == 1234.5 and got[2][0] == 7.0 and got[3][0] == 8.0


def test_quantiles_of_many_columns(spark):
    """Three ranks of 300 columns; the driver gets four numbers for each, and the passes do not follow the columns."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.normal(size=(40, 300)), columns=[f"c{i}" for i in range(300)])
    df = spark.createDataFrame(frame)
    got = quantiles.quantiles(df, {c: F.col(c) for c in frame.columns}, [0.25, 0.5, 0.75])
    for c in frame.columns:
        assert [got[c].quantiles[p] for p in (0.25, 0.5, 0.75)] == pytest.approx(list(np.quantile(frame[c], [0.25, 0.5, 0.75])), rel=1e-12)


def test_correlations_of_wide_tables(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 200)) + rng.normal(size=(300, 1)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8], x[1:, 9] = 5.1, np.nan, np.nan
    frame = pd.DataFrame(x, columns=[f"c {i}" for i in range(200)])
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in stats.correlation_pairs(df).collect()}
    want = frame.corr().to_numpy()
    assert len(got) == 200 * 199 // 2
    for i in range(200):
        for j in range(i + 1, 200):
            r, w = got[(f"c {i}", f"c {j}")], want[i, j]
            assert (r is None and (np.isnan(w) or {i, j} & {7, 8, 9})) or abs(r - w) < 1e-9, (i, j, r, w)
    assert {r["r"] for r in stats.correlation_pairs(df.where("false")).collect()} == {None}
    few = [f"c {i}" for i in range(20)]
    native = {(r["col_a"], r["col_b"]): r["r"] for r in stats.correlation_pairs(df, few).collect()}
    assert all(native[k] is None and got[k] is None or abs(native[k] - got[k]) < 1e-9 for k in native)


def _outlines(*parts):
    found = [""]
    for part in parts:
        found = [o + c for o in found for c in (["1", "12"] if part == "d" else [part])]
    return found


def test_outlines_of_dates(spark):
    day, clock, slashes = ("2021", "-", "d", "-", "d"), ("d", ":", "d", ":", "d"), ("d", "/", "d", "/", "2021")
    ends = ((), (".250",), (".250001",))
    zones = [("Z",), ("+01:00",), ("-01:00",)]
    names = ["May", "June", "March", "September"]
    texts = _outlines(*day) + [o for s in (" ", "T") for e in ends for o in _outlines(*day, s, *clock, *e)] + _outlines(*day, " ", "d", ":", "d")
    texts += [o for s in (" ", "T") for e in ends for z in zones for o in _outlines(*day, s, *clock, *e, *z)]
    texts += _outlines("2021", "/", "d", "/", "d") + [o for s in "/-." for o in _outlines("d", s, "d", s, "2021")]
    texts += [o for end in ((), (" AM",)) for c in (clock, clock[:3]) for o in _outlines(*slashes, " ", *c, *end)]
    texts += ["Mar 2021", "May 2021"] + [o for m in ["Mar", *names] for o in _outlines(m + " ", "d", ", 2021") + _outlines("d", f" {m} 2021")] + _outlines("d", "-Mar-2021")
    found = one_column(spark, texts).select("x", dates.date_shape(F.col("x")).alias("s"), F.coalesce(*[dates.parse_date(F.col("x"), f) for f, _ in dates.DATE_FORMATS]).alias("d")).collect()
    assert [r["x"] for r in found if r["s"] is None or r["d"] is None] == []
    other = ["2021-01-05x", "2021-01-05 1", "2021-1-5 1:2:3.25", "13/13/2021", "0/5/2021", "Mai 5, 2021", "5 Mar 21", "20210105", "12345.67", "a\n2021-01-05"]
    df = one_column(spark, other)
    assert [r for r in df.select(F.coalesce(*[dates.parse_date(F.col("x"), f) for f, _ in dates.DATE_FORMATS])).collect() if r[0] is not None] == []
    both = one_column(spark, ["5/4/2021", "15/4/2021", "4/15/2021", "3 Mar 2021", "3 May 2021", "3 June 2021"])
    counts = both.agg(*[F.count(dates.parse_date(F.col("x"), f)) for f in ("M/d/yyyy", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy")]).first()
    assert tuple(counts) == (2, 2, 2, 2)


def test_text_dates_are_made_once(spark):
    made = spark.createDataFrame([("05/04/2021", 1), ("25/04/2021", 2), ("x", 3)], "day string, v int").withColumn("day", F.concat("day", F.lit(" ")))
    dated = dates.with_dates(made, "day").where("day IS NOT NULL")
    plan = dated._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp") == 1 and dated.columns == ["day", "v"]
    assert sorted((str(r["day"])[:10], r["v"]) for r in dated.collect()) == [("2021-04-05", 1), ("2021-04-25", 2)]
