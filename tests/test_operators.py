import datetime as dt

import pytest

from pyspark.sql import functions as F

from tablescope.functions.quantiles import quantiles
from tablescope.operators import aggs, clean, evidence, filters, issues, kpi, profile, repair, roles, stats, timeseries
from tablescope import session
from tablescope.plans import findings


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def shop(spark):
    data = [
        ("b", "x", 1.0, dt.date(2024, 1, 5)),
        ("a", "x", 1.0, dt.date(2024, 1, 9)),
        (None, "y", 5.0, dt.date(2024, 4, 2)),
        ("c", "y", None, dt.date(2024, 4, 3)),
        ("c", None, float("nan"), None),
    ]
    return spark.createDataFrame(data, "region string, product string, price double, day date")


def test_groups_skip_missing_keys_and_break_ties_by_key(shop):
    clean_shop = stats.blank_nan(shop)
    assert rows(aggs.top_groups(clean_shop, "region", "price")) == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    assert rows(aggs.top_groups(clean_shop, "region", "price", "no such aggregate", 1)) == [("a", 1.0)]
    assert rows(aggs.extreme_group(clean_shop, "region", "price")) == [("a", 1.0)]
    assert rows(aggs.value_counts(clean_shop, "region", 2)) == [("c", 2), ("a", 1)]
    assert rows(aggs.by_group(clean_shop, "region", "price", "mean"), "key")[2] == ("c", None)
    with pytest.raises(ValueError, match="no such column: 'nope'"):
        aggs.by_group(shop, "nope", "price")
    wide = aggs.heatmap(clean_shop, "region", "product", "price", 2, 2).orderBy("outer")
    assert wide.columns == ["outer", "x"] and rows(wide) == [("a", 1.0), ("b", 1.0)]


def test_months_are_filled_and_undefined_growth_is_missing(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5), 1.0), (dt.date(2024, 4, 2), 2.0), (None, 9.0)], "d date, v double")
    series = timeseries.trend(df, "d", "v")
    got = [(r["month"].month, r["revenue"], r["mom_growth"]) for r in series.orderBy("month").collect()]
    assert got == [(1, 1.0, None), (2, 0.0, -100.0), (3, 0.0, None), (4, 2.0, None)]
    assert rows(timeseries.peak_and_trough(timeseries.monthly(df, "d", "v")), "kind") == [
        ("peak", dt.date(2024, 4, 30), 2.0), ("trough", dt.date(2024, 2, 29), 0.0),
    ]
    one = timeseries.monthly(df.limit(1), "d", "v")
    assert timeseries.forecast(one).count() == 0


def test_halves_need_both_sides(spark):
    data = [("a", 1, 5.0), ("a", 4, 2.0), ("b", 1, 9.0), ("c", 4, 1.0)]
    df = spark.createDataFrame([(k, dt.datetime(2024, m, 1), v) for k, m, v in data], "k string, d timestamp_ntz, v double")
    assert rows(timeseries.half_changes(df, "k", "d", "v")) == [("a", 5.0, 2.0, -3.0)]
    assert rows(timeseries.declining_group(df, "k", "v", None)) == [("c", 1.0)]


def test_outliers_with_zero_spread(spark):
    df = spark.createDataFrame([(5.0,)] * 4 + [(100.0,)], "x double")
    assert rows(stats.outlier_counts(df)) == [("x", 0)]
    assert stats.numeric_insight(df).first()["outliers"] == 1
    cleaned, counters, log = clean.apply_cleaning(df, [("x", "cap_outliers"), ("x", "remove_outliers")])
    assert cleaned.count() == 5 and counters.first()["outliers_handled"] == 0
    assert [r["status"] for r in log.collect()] == ["Skipped", "Skipped"]


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, 7), (1.0, 2.0, 8), (1.0, 3.0, 9)], "x double, y double, z int")
    cells = {(r["col_a"], r["col_b"]): r["r"] for r in stats.correlation_matrix(df).collect()}
    assert cells[("x", "y")] is None and cells[("x", "x")] is None and cells[("y", "z")] == 1.0 and len(cells) == 9
    insight = {r["column"]: r for r in stats.numeric_insight(df.limit(2)).collect()}
    assert insight["y"]["skew"] is None and insight["y"]["skew_label"] is None and insight["x"]["cv"] == 0.0
    assert stats.distribution_metrics(df.limit(1)).first()["std"] is None


def test_histogram_keeps_every_row_and_empty_bins(spark):
    df = spark.createDataFrame([(float(v), "a" if v < 3 else "b") for v in [0, 0, 1, 2, 10]], "x double, k string")
    assert [r["n"] for r in stats.histogram(df, "x", 5).orderBy("bin").collect()] == [3, 1, 0, 0, 1]
    split = stats.histogram_by_category(df, "x", 5)
    assert split.count() == 10 and split.agg({"n": "sum"}).first()[0] == 5
    same = stats.histogram(df.where("x = 0"), "x", 4)
    assert [r["n"] for r in same.orderBy("bin").collect()] == [2, 0, 0, 0]
    many = spark.range(1500).selectExpr("cast(id % 500 as string) k", "cast(id as double) x")
    boxes = {r["category"]: r for r in stats.box_stats(many, "x", "k").collect()}
    assert len(boxes) == 500 and (boxes["7"]["q1"], boxes["7"]["median"], boxes["7"]["q3"], boxes["7"]["n"]) == (257.0, 507.0, 757.0, 3)
    assert len(stats.box_stats(df, "x", "k").collect()) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "region string, price double, day date")
    found = roles.Roles(sales="price", region="region", date="day")
    assert profile.quality_score(df).first()[0] == 0
    assert [r["inferred_type"] for r in profile.profile_columns(df).orderBy("position").collect()] == ["string", "string", "string"]
    assert kpi.kpis(df, found).first()["total_revenue"] == 0.0
    assert timeseries.monthly(df, "day", "price").count() == 0
    assert stats.histogram(df, "price", 3).count() == 0 and stats.box_stats(df, "price").count() == 0
    assert clean.apply_cleaning(df, [("price", "fill_missing_median"), ("region", "fill_missing_mode")])[0].count() == 0


def test_types_from_text(spark):
    data = [
        ("1", "2024-01-05", "Yes", "10", "1.5", "05/04/2024", "a", "2015"),
        ("2", "2024-01-06", "no", "11", "x", "06/04/2024", "A", "2016"),
        ("3", "soon", "Y", "12", "2.5", "25/04/2024", "b", "2017"),
        ("4", "2024-01-08", None, "13", "3", "07/04/2024", "b", "2018"),
        ("5", "2024-01-09", "0", "14", "4", "08/04/2024", "b", "2019"),
    ]
    df = spark.createDataFrame(data, "i string, d string, b string, n string, f string, e string, c string, y string")
    found = {r["column"]: r for r in evidence.infer_types(df).collect()}
    kinds = {c: found[c]["inferred_type"] for c in found}
    assert kinds == {
        "i": "integer", "d": "datetime", "b": "boolean", "n": "integer", "f": "float", "e": "datetime", "c": "categorical", "y": "integer",
    }
    assert found["e"]["date_format"] == "d/M/yyyy" and found["d"]["date_count"] == 4
    repaired = repair.numeric_repair(df, exclude=("y",))
    assert dict(repaired.dtypes)["f"] == "double" and dict(repaired.dtypes)["y"] == "string"


def test_cleaning_follows_the_given_order(spark):
    data = [("  a ", "1", "yes"), ("B", None, "no"), ("B", None, "no"), (None, "9", None), ("é", "x", "maybe")]
    df = spark.createDataFrame(data, "name string, amount string, flag string")
    steps = [
        ("(dataset)", "remove_duplicates"), ("name", "fill_missing_unknown"), ("name", "trim_whitespace"), ("name", "standardize_case"),
        ("name", "remove_special_chars"), ("amount", "fill_missing_median"), ("amount", "convert_to_numeric"), ("flag", "fill_missing_mode"),
        ("flag", "standardize_boolean"), ("nope", "trim_whitespace"), ("flag", "bogus"),
    ]
    cleaned, counters, log = clean.apply_cleaning(df, steps)
    assert rows(cleaned, "name", "amount") == [("", 5.0, "maybe"), ("A", 1.0, "True"), ("B", 5.0, "False"), ("Unknown", 9.0, "maybe")]
    assert counters.first().asDict() == {
        "rows_before": 5, "rows_after": 4, "duplicates_removed": 1, "missing_fixed": 4, "columns_standardized": 4,
        "outliers_handled": 0, "columns_dropped": 0, "type_conversions": 1,
    }
    assert [r["status"] for r in log.orderBy("step").collect()] == ["Applied"] * 9 + ["Skipped"] * 2
    again = clean.apply_cleaning(cleaned, steps[:5])[0]
    assert rows(again, "name", "amount") == rows(cleaned, "name", "amount")
    # The other order of the two steps leaves other gaps.
    swapped = clean.apply_cleaning(df, [("amount", "drop_missing_rows"), ("amount", "fill_missing_zero")])
    assert rows(swapped[0].select("amount"), "amount") == [(0.0,), (1.0,), (9.0,)] and swapped[1].first()["missing_fixed"] == 3
    ties = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "k string")
    assert rows(clean.apply_cleaning(ties, [("k", "fill_missing_mode")])[0].groupBy("k").count(), "k") == [("a", 3), ("b", 2)]


def test_a_failing_step_is_logged_and_skipped(spark, monkeypatch):
    df = spark.createDataFrame([(" a",), (None,)], "k string")
    monkeypatch.setattr(clean.text, "title_case", lambda c: F.col("not there"))
    cleaned, _, log = clean.apply_cleaning(df, [("k", "trim_whitespace"), ("k", "standardize_case"), ("k", "fill_missing_unknown")])
    assert [r["status"] for r in log.orderBy("step").collect()] == ["Applied", "Failed", "Applied"]
    assert rows(cleaned, "k") == [("Unknown",), ("a",)]


def test_failures_of_the_job_are_not_hidden(spark):
    @F.udf("string")
    def dies(value):
        raise OSError("disk full")

    df = spark.createDataFrame([("1",), ("2",)], "k string").withColumn("k", dies("k"))
    with pytest.raises(Exception, match="disk full"):
        clean.apply_cleaning(df, [("k", "fill_missing_mode")])[0].count()


def test_numeric_ties_words_and_dates_that_do_not_fit(spark):
    df = spark.createDataFrame([(9.0, "yes", "soon"), (10.0, "maybe", "later"), (9.0, "NO", None), (10.0, None, "x"), (None, "y", "z")], "x double, f string, d string")
    cleaned, _, log = clean.apply_cleaning(df, [("x", "fill_missing_mode"), ("f", "standardize_boolean"), ("d", "convert_to_datetime")])
    assert sorted(r["x"] for r in cleaned.collect()) == [9.0, 9.0, 9.0, 10.0, 10.0]
    assert sorted(str(r["f"]) for r in cleaned.collect()) == ["False", "None", "True", "True", "maybe"]
    assert sorted(str(r["d"]) for r in cleaned.collect()) == ["None", "later", "soon", "x", "z"]
    assert [r["status"] for r in log.orderBy("step").collect()] == ["Applied", "Applied", "Skipped"]


def test_many_columns_and_probabilities(spark):
    df = spark.range(101).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(300)])
    found = quantiles(df, {c: F.col(c) for c in df.columns}, [0.25, 0.5, 0.75])
    assert [found[f"c{i}"].quantiles[0.5] for i in (0, 1, 299)] == [50.0, 100.0, 15000.0] and found["c3"].quantiles[0.25] == 100.0


def test_issues_disappear_after_their_action(spark):
    data = [(" a", "1", i) for i in range(30)] + [("A", "2", None), ("b", "x", 1000)]
    df = spark.createDataFrame(data, "k string, n string, x int")
    found = {(r["column"], r["issue_type"]) for r in issues.detect_issues(df).collect()}
    assert {("k", "Leading/Trailing Whitespace"), ("k", "Category Inconsistency"), ("n", "Numeric Stored as String"),
            ("x", "Missing Values"), ("x", "Outliers Detected (IQR)")} <= found
    columns = profile.profile_columns(df)
    steps = clean.enabled_steps(issues.suggest(columns, issues.detect_issues(df, columns)))
    after = {(r["column"], r["issue_type"]) for r in issues.detect_issues(clean.apply_cleaning(df, steps)[0]).collect()}
    assert not after & (found - {("n", "Missing Values")})


def test_roles_report_ambiguity_and_fall_back(spark):
    df = spark.createDataFrame([(1, 2.0, "x", "y", "2024-01-05")], "id int, score double, city string, state string, paid_date string")
    found = {r["role"]: r for r in roles.column_roles(df).where("rank = 1").collect()}
    assert (found["sales"]["column"], found["sales"]["fallback"]) == ("id", True)
    assert found["region"]["column"] == "city" and found["region"]["candidates"] == ["city", "state"] and found["region"]["ambiguous"]
    assert found["customer"]["column"] is None and found["date"]["column"] == "paid_date"
    named = spark.createDataFrame([("a", "b")], "total_region string, region_x string")
    assert roles.resolve_roles(named).region == "total_region" and roles.resolve_roles(named, "prefix").region == "region_x"
    assert roles.resolve_roles(named, product="region_x").product == "region_x"


def test_filters(shop):
    places = {"region": "region", "product": "product", "day": "day", "amount": "price"}
    nothing = filters.retention(shop, filters.Filter(), **places).first()
    assert tuple(nothing) == (5, 5, 100.0)
    wanted = filters.Filter(regions=("a", "b"), dates=(dt.date(2024, 1, 5), dt.date(2024, 1, 5)), amounts=(0.0, 1.0))
    assert rows(filters.apply_filter(shop, wanted, **places).select("region")) == [("b",)]
    sample = filters.hash_sample(shop.select("region"), 2, "region")
    assert rows(sample) == rows(filters.hash_sample(shop.select("region").repartition(3), 2, "region"))


def test_findings_fall_back_to_none(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, x double")
    assert rows(findings.findings_anomalies(df)) == [("none", None, None)]
    flat = spark.createDataFrame([("a", -1.0)] * 24 + [("b", -1.0)], "k string, unit_price double")
    kinds = {r["finding"] for r in findings.findings_anomalies(flat).collect()}
    assert kinds == {"no variance", "negative price", "almost one value"}


def test_profile_jobs_do_not_grow_with_columns(spark):
    def jobs(width):
        df = spark.range(50).selectExpr(*[f"cast(id + {i} as string) c{i}" for i in range(width)])
        spark.sparkContext.setJobGroup(f"width {width}", "")
        profile.profile_columns(df).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"width {width}"))

    assert jobs(12) <= jobs(3) + 1


def test_repeated_rows_go_without_a_shuffle_of_rows(spark, tmp_path):
    data = [(i, f"name {i % 900}", float(i) if i % 7 else None) for i in range(2000)]
    data += data[:50] + [(None, None, None)] * 3 + data[:10]
    spark.createDataFrame(data, "id int, name string, x double").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    once, gone = clean.without_repeats(table)
    assert gone == 62 and sorted(rows(once), key=str) == sorted(set(data), key=str)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SinglePartition" not in plan
    same, none = clean.without_repeats(once)
    assert none == 0 and same is once


def test_smallest_values_and_summary(spark):
    data = [(i % 5, f"v{i % 300:03d}", None) for i in range(1000)]
    df = spark.createDataFrame(data, "a int, b string, c string").repartition(4)
    assert {r["column"]: r["values"] for r in profile.smallest_values(df).collect()} == {"a": ["0", "1", "2"], "b": ["v000", "v001", "v002"]}
    got = {r["column"]: (r["missing_count"], r["unique_count"], r["sample_values"]) for r in profile.column_summary(df).collect()}
    assert got == {"a": (0, 5, "0, 1, 2"), "b": (0, 300, "v000, v001, v002"), "c": (1000, 0, "")}
    assert profile.column_summary(df.where("false")).collect() == []


def test_long_rankings_are_ranked_by_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i:03d}", float(i // 3)) for i in range(200)], "k string, v double").repartition(5)
    short = rows(aggs.ranked_groups(df, "k", "v", 150), "rank")
    monkeypatch.setattr(aggs, "MOST_LISTED", 10)
    assert rows(aggs.ranked_groups(df, "k", "v", 150), "rank") == short and len(short) == 150
    assert rows(aggs.ranked_groups(df, "k", "v", 20, descending=False), "rank")[0] == (1, "k000", 0.0)


def test_patterns_of_typed_columns(spark):
    df = spark.createDataFrame([(0, True, 1.0, dt.date(2024, 1, 1), "1"), (1, None, None, None, "x"), (None, False, 0.0, None, None)], "i int, b boolean, d double, t date, s string")
    got = {r["column"]: (r["rows"], r["missing_count"], r["boolean_words"], r["inferred_type"], r["unique_count"]) for r in evidence.column_evidence(df).collect()}
    assert got == {
        "i": (3, 1, True, "boolean", 2), "b": (3, 1, True, "boolean", 2), "d": (3, 1, False, "float", 2), "t": (3, 2, False, "datetime", 1), "s": (3, 1, False, "categorical", 2),
    }


def test_few_values_are_counted_before_they_are_looked_at(spark, monkeypatch):
    data = [(f"{i % 7}", f" v{i}é" if i % 5 else None, f"2024-01-{i % 40 + 1:02d}", None, "Yes" if i % 2 else "no", f"{i}.5") for i in range(400)]
    df = spark.createDataFrame(data, "a string, b string, c string, d string, e string, f string")
    looked = []
    work = evidence._text_patterns
    monkeypatch.setattr(evidence, "_text_patterns", lambda cells: looked.append(cells.count()) or work(cells))
    each = rows(evidence.column_evidence(df), "position")
    assert looked == [2400]
    monkeypatch.setattr(evidence, "COUNTED_VALUES", 50)
    assert rows(evidence.column_evidence(df, stored=True), "position") == each
    assert looked == [2400, 800, 7 + 40 + 1 + 2]


def test_only_texts_named_like_dates_are_parsed_for_roles(spark, monkeypatch):
    df = spark.createDataFrame([("2024-01-05", "2024-01-05", 1.0)], "ship_Day string, note string, price double")
    read = []
    work = roles.column_patterns
    monkeypatch.setattr(roles, "column_patterns", lambda part: read.append(part.columns) or work(part))
    assert roles.resolve_roles(df).date == "ship_Day" and roles.resolve_roles(df.drop("ship_Day")).date is None
    assert read == [["ship_Day"]]


def test_intermediate_data_go_away(spark):
    def files():
        path = spark._jvm.org.apache.hadoop.fs.Path(session.checkpoint_folder(spark))
        return sorted(f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))

    df = spark.createDataFrame([(i, f"v{i % 9}", float(i % 50)) for i in range(300)], "a int, b string, c double")
    before = files()
    columns = profile.profile_columns(df)
    found = issues.detect_issues(df)
    assert files() == before and columns.count() == 3 and found.count() >= 0
    with session.intermediate(spark):
        known = issues.examine(df)
        tidy = clean.apply_cleaning(known.table, clean.enabled_steps(known.steps()), stored=True)[0].collect()
        assert files() != before
    assert files() == before and len(tidy) == 300


def test_distinct_values_in_tasks_of_bounded_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 700).cast("decimal(38,0)").alias("x"))
    few, many = aggs.distinct_values(df, "x"), aggs.distinct_values(df, "x", at_once=50)
    assert few.count() == many.count() == len({i % 700 for i in range(1000) if i % 10})
    assert many.rdd.getNumPartitions() == 20 > few.rdd.getNumPartitions()
