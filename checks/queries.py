"""Every registered query: ``name -> f(spark, folder) -> DataFrame``, over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import session
from tablescope.functions import numbers, text
from tablescope.functions.order import written
from tablescope.operators import aggs, clean, evidence, filters, issues, kpi, profile, repair, roles, stats, timeseries
from tablescope.plans import answers, charts, findings, report, tagging, views
from tablescope.sources import csv_files, names, workbooks

from .workbook_maker import pack

ROLES = roles.Roles(
    sales="price", quantity="quantity", customer="customer", product="product", order="order_id", region="city", date="order_date"
)
MEASURES = ["quantity", "price", "discount"]
QUERIES = {}


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Round double columns, so that the order of addition cannot show."""
    return df.select(
        *[F.round(f.name, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields]
    )


def key_totals(table: DataFrame, groups: list[str], *more) -> DataFrame:
    """Rows and the exact sum of the keys per group: the sum is BIGINT, or DECIMAL(38,0) where some group's exceeds it."""
    found = table.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), numbers.whole_total(F.col("rid")).alias("rid_sum"), *more)
    return numbers.narrowed(written(found, "key-totals"), "rid_sum")


def on_sales(name, places=None):
    def register(work):
        def run(spark, folder):
            out = work(views.sales(spark, folder))
            return out if places is None else rounded(out, places)

        QUERIES[name] = run
        return work

    return register


def on_dirty(name, places=None):
    def register(work):
        def run(spark, folder):
            out = work(views.dirty(spark, folder))
            return out if places is None else rounded(out, places)

        QUERIES[name] = run
        return work

    return register


# ---- sources -------------------------------------------------------------------------------


@on_sales("csv_roundtrip", 2)
def _(df):
    path = session.scratch_path(df.sparkSession, "sales-csv")
    csv_files.write_csv(df, path)
    back = csv_files.read_csv(df.sparkSession, path)
    return back.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), aggs.total(F.col("price").cast("decimal(18,2)")).alias("price"),
        aggs.total(F.col("quantity")).alias("quantity"), F.min("order_date").cast("date").alias("first_day"),
    )


@on_dirty("csv_encoding_mix")
def _(df):
    spark, path = df.sparkSession, session.scratch_path(df.sparkSession, "mixed-csv")
    slim = df.select("rid", "region_txt", "amount_txt")
    csv_files.write_csv(slim.where("rid % 2 = 0"), f"{path}/utf8")
    csv_files.write_csv(slim.where("rid % 2 <> 0"), f"{path}/latin1", "ISO-8859-1")
    back = csv_files.read_csv(spark, f"{path}/*")
    return key_totals(back, ["region_txt"])


@on_dirty("csv_header_orders")
def _(df):
    spark, path = df.sparkSession, session.scratch_path(df.sparkSession, "headers-csv")
    csv_files.write_csv(df.where("rid % 2 = 0").select("rid", "region_txt", "qty"), f"{path}/a b")
    csv_files.write_csv(df.where("rid % 2 <> 0").select("qty", "note_txt", "rid", "region_txt"), f"{path}/c", "ISO-8859-1")
    back = csv_files.read_csv(spark, f"{path}/*")
    return key_totals(back, ["region_txt", "note_txt"], F.sum("qty").alias("qty_sum"))


@on_dirty("csv_quoted_breaks")
def _(df):
    """Notes with line breaks, commas and quotes, written in several files and read back in splits of any size."""
    spark, path = df.sparkSession, session.scratch_path(df.sparkSession, "quoted-csv")
    kind = F.pmod("rid", F.lit(5))
    note = F.when(kind == 0, F.concat_ws("\n", "region_txt", "customer")).when(kind == 1, F.concat(F.lit('"'), "customer", F.lit('",\n\n"x"'))).when(kind == 2, F.concat("region_txt", F.lit(", plain"))).when(
        kind == 3, F.concat(F.lit("a\r\nb "), "flag_txt")
    )
    csv_files.write_csv(df.select("rid", note.alias("note"), "qty"), path)
    back = csv_files.read_csv(spark, path)
    return key_totals(back, ["note"], F.sum("qty").alias("qty_sum"))


@on_sales("csv_wide_ids")
def _(df):
    path = session.scratch_path(df.sparkSession, "wide-csv")
    wide = F.lit(9123456789012345678 - 10**15) + F.col("rid")
    csv_files.write_csv(df.select(wide.alias("id"), F.concat(wide.cast("string"), F.lit("00")).alias("wider")), path)
    back = written(csv_files.read_csv(df.sparkSession, path), "wide-ids")
    ids, wider = (aggs.distinct_values(back, c).count() for c in ("id", "wider"))
    return back.agg(F.lit(ids).cast("bigint").alias("ids"), F.max("id").alias("last"), F.lit(wider).cast("bigint").alias("wider_ids"), F.max("wider").cast("string").alias("widest"))


def _workbooks(spark, table):
    """``table`` as a folder of workbooks and back; the text writer passes bytes through, one file a record."""
    path = session.scratch_path(spark, "workbooks")
    files = table.mapInPandas(pack, "path string, content binary")
    files.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    return workbooks.read_workbooks(spark, path, "part-*")


def _xlsx(spark, folder):
    return _workbooks(spark, spark.read.parquet(f"{folder}/customer.parquet"))


def _xlsx_dates(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_totalprice")
    return timeseries.monthly(_workbooks(spark, orders), "o_orderdate", "o_totalprice")


QUERIES["xlsx_dates"] = lambda spark, folder: rounded(_xlsx_dates(spark, folder), 2)
QUERIES["xlsx_folder"] = _xlsx


def _clean_names(spark, folder):
    raw = spark.read.parquet(f"{folder}/customer.parquet")
    return names.clean_names(raw.withColumnsRenamed({"c_custkey": "Unnamed: 0", "c_name": "  c_name ", "c_acctbal": "c_acctbal "}))


QUERIES["clean_names"] = _clean_names

# ---- typing ----------------------------------------------------------------------------------


@on_dirty("numeric_repair")
def _(df):
    return repair.numeric_repair(df).select("rid", "amount_txt", "region_txt", "order_date_txt")


@on_dirty("infer_types")
def _(df):
    return evidence.infer_types(df).drop("date_format")


@on_dirty("column_roles")
def _(df):
    found = roles.column_roles(repair.numeric_repair(df))
    return found.withColumn("candidates", F.array_join("candidates", ","))


# ---- filters ---------------------------------------------------------------------------------

WANTED = filters.Filter(
    regions=("NATION_1", "NATION_2", "NATION_3"), products=("Brand#1", "Brand#12", "Brand#19"),
    dates=(date(1996, 1, 1), date(1999, 12, 31)), amounts=(10000.0, 90000.0),
)
PLACES = {"region": "city", "product": "product", "day": "order_date", "amount": "price"}


def _sums(df):
    return df.groupBy("region").agg(F.count(F.lit(1)).alias("n"), aggs.total(F.col("price")).alias("price"))


@on_sales("filter_region")
def _(df):
    return _sums(filters.apply_filter(df, filters.Filter(regions=WANTED.regions), **PLACES))


@on_sales("filter_product")
def _(df):
    return _sums(filters.apply_filter(df, filters.Filter(products=WANTED.products), **PLACES))


@on_sales("filter_dates")
def _(df):
    return _sums(filters.apply_filter(df, filters.Filter(dates=WANTED.dates), **PLACES))


@on_sales("filter_amount")
def _(df):
    return _sums(filters.apply_filter(df, filters.Filter(amounts=WANTED.amounts), **PLACES))


@on_sales("filter_retention")
def _(df):
    return filters.retention(df, WANTED, **PLACES)


@on_sales("filter_options")
def _(df):
    def listed(kind, column):
        return filters.distinct_options(df, column).select(F.lit(kind).alias("kind"), "value")

    edges = filters.range_options(df, "order_date", "price").select(
        *[F.col(c).cast("string").alias(c) for c in ("first_day", "last_day")],
        *[F.col(c).cast("decimal(18,2)").cast("string").alias(c) for c in ("low", "high")],
    ).unpivot([], ["first_day", "last_day", "low", "high"], "kind", "value")
    return listed("region", "city").unionByName(listed("product", "product")).unionByName(edges)


@on_sales("preview_rows")
def _(df):
    columns = ["rid", "customer", "product", "city", "quantity"]
    return filters.preview(df.select(*columns), 100, *columns)


@on_sales("hash_sample")
def _(df):
    return filters.hash_sample(df.select("rid", "product", "quantity"), 1000, "rid")


@on_sales("numeric_projection", 4)
def _(df):
    numeric = filters.numeric_only(df)
    texts = filters.text_only(df)
    means = numeric.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numeric.columns if c != "rid"])
    counts = texts.agg(*[F.count_distinct(c).alias(c) for c in texts.columns])
    left = means.unpivot([], means.columns, "column", "figure")
    right = counts.select(*[F.col(c).cast("double").alias(c) for c in counts.columns])
    return left.unionByName(right.unpivot([], right.columns, "column", "figure"))


# ---- cleaning --------------------------------------------------------------------------------


def on_clean(name, columns, steps, places=None):
    @on_dirty(name, places)
    def _(df):
        return clean.apply_cleaning(df, steps)[0].select(*columns)


on_clean("clean_dedup", ["rid", "customer", "amount_txt", "order_date_txt", "region_txt", "flag_txt", "note_txt", "qty"], [("(dataset)", "remove_duplicates")])
on_clean("clean_fill_median", ["rid", "qty", "amount_txt"], [("qty", "fill_missing_median"), ("amount_txt", "fill_missing_median")], 4)
on_clean("clean_fill_mean", ["rid", "qty", "amount_txt"], [("qty", "fill_missing_mean"), ("amount_txt", "fill_missing_mean")], 2)


@on_dirty("clean_mean_values")
def _(df):
    """What the gaps of two columns were filled with."""
    tidy, _, _ = clean.apply_cleaning(df.select("rid", "qty", "amount_txt"), [("qty", "fill_missing_mean"), ("amount_txt", "fill_missing_mean")])
    return tidy.agg(
        F.max(F.when(F.expr("rid % 43 = 0 AND rid % 997 <> 0"), F.round("qty", 2))).alias("qty"), F.max(F.when(F.expr("rid % 50 = 0"), F.round("amount_txt", 2))).alias("amount_txt")
    )


on_clean("clean_fill_zero", ["rid", "qty", "amount_txt"], [("qty", "fill_missing_zero"), ("amount_txt", "fill_missing_zero")])
on_clean("clean_fill_unknown", ["rid", "note_txt"], [("note_txt", "fill_missing_unknown")])
on_clean("clean_fill_notprovided", ["rid", "note_txt"], [("note_txt", "fill_missing_notprovided")])
on_clean("clean_fill_mode", ["rid", "flag_txt", "qty"], [("flag_txt", "fill_missing_mode"), ("qty", "fill_missing_mode")])
on_clean("clean_drop_missing", ["rid", "order_date_txt"], [("order_date_txt", "drop_missing_rows")])
on_clean("clean_trim", ["rid", "region_txt"], [("region_txt", "trim_whitespace")])
on_clean("clean_special", ["rid", "region_txt"], [("region_txt", "remove_special_chars")])
on_clean("clean_case", ["rid", "region_txt"], [("region_txt", "standardize_case")])
on_clean("clean_categories", ["rid", "region_txt"], [("region_txt", "standardize_categories")])
on_clean("clean_to_numeric", ["rid", "amount_txt"], [("amount_txt", "convert_to_numeric")])
on_clean("clean_boolean", ["rid", "flag_txt"], [("flag_txt", "standardize_boolean")])
on_clean("clean_cap", ["rid", "qty"], [("qty", "cap_outliers")])
on_clean("clean_remove_outliers", ["rid", "qty"], [("qty", "remove_outliers")])


@on_dirty("clean_mode_tie")
def _(df):
    # Every row comes as 9, as 10 and as missing, so two numbers tie whose texts sort the other way round.
    tied = df.select("rid", F.explode(F.array(F.lit(9.0), F.lit(10.0), F.lit(None))).alias("x"))
    return clean.apply_cleaning(tied, [("x", "fill_missing_mode")])[0].groupBy("x").agg(F.count(F.lit(1)).alias("n"))


@on_dirty("clean_unmapped_words")
def _(df):
    mixed = df.select("rid", F.when(F.col("rid") % 5 == 0, "maybe").otherwise(F.col("flag_txt")).alias("flag_txt"))
    return clean.apply_cleaning(mixed, [("flag_txt", "standardize_boolean")])[0]


@on_dirty("clean_no_dates")
def _(df):
    cleaned, counters, log = clean.apply_cleaning(df.select("rid", "note_txt"), [("note_txt", "convert_to_datetime")])
    status = log.select(F.col("status").alias("s")).scalar()
    return cleaned.groupBy("note_txt").agg(F.count(F.lit(1)).alias("n")).withColumn("status", status)


@on_dirty("clean_to_datetime")
def _(df):
    cleaned = clean.apply_cleaning(df, [("order_date_txt", "convert_to_datetime")])[0]
    return cleaned.select("rid", F.col("order_date_txt").cast("date").alias("order_date_txt"))


@on_dirty("clean_drop_cols")
def _(df):
    cleaned = clean.apply_cleaning(df, [("empty_col", "drop_empty_column"), ("currency", "drop_constant_column")])[0]
    counts = cleaned.agg(*[F.count(c).alias(c) for c in cleaned.columns])
    return counts.unpivot([], cleaned.columns, "column", "present")


def _suggested(df):
    """A stored copy of the table and the steps that its issues call for."""
    known = issues.examine(df)
    return known.table, clean.enabled_steps(known.steps())


@on_dirty("clean_full", 4)
def _(df):
    table, steps = _suggested(df)
    cleaned = clean.apply_cleaning(table, steps, stored=True)[0]
    return cleaned.withColumn("order_date_txt", F.col("order_date_txt").cast("date"))


@on_dirty("clean_report")
def _(df):
    table, steps = _suggested(df)
    return clean.apply_cleaning(table, [*steps, ("order_date_txt", "drop_missing_rows"), ("qty", "remove_outliers")], stored=True)[1]


# ---- profile and issues ------------------------------------------------------------------------


@on_dirty("profile_columns")
def _(df):
    out = profile.profile_columns(df).select(*profile.PROFILE_COLUMNS)
    # Figures of ids in the billions are compared to whole numbers.
    big = lambda c: F.when(F.abs(c) >= 1e6, F.round(c, 0)).otherwise(F.round(c, 4))
    return out.withColumns({c: big(F.col(c)) for c in ("mean", "median", "std")})


@on_dirty("profile_dataset")
def _(df):
    return profile.profile_dataset(df)


@on_dirty("column_summary")
def _(df):
    return profile.column_summary(df)


@on_dirty("duplicate_rows")
def _(df):
    return profile.duplicate_rows(df)


@on_dirty("completeness")
def _(df):
    return profile.completeness(df)


@on_dirty("issues_all")
def _(df):
    return issues.detect_issues(df).select("column", "issue_type", "severity", "description", "affected_count")


@on_dirty("issues_by_severity")
def _(df):
    return issues.issues_by_severity(issues.detect_issues(df))


@on_dirty("suggestions")
def _(df):
    return issues.examine(df).steps().drop("description")


@on_dirty("outlier_counts")
def _(df):
    return stats.outlier_counts(df)


@on_dirty("quality_score")
def _(df):
    return profile.quality_score(df)


@on_dirty("quality_score_issues")
def _(df):
    return issues.examine(df).score()


# ---- aggregation -------------------------------------------------------------------------------

for _how in ("sum", "mean", "count", "max", "min"):
    on_sales(f"group_{_how}", 4)(lambda df, how=_how: aggs.top_groups(df, "city", "price", how))


@on_sales("global_totals", 4)
def _(df):
    middle = aggs.totals(df, "price").withColumn("median", F.lit(stats.quantiles(df, {"x": F.col("price")}, [0.5])["x"].quantiles[0.5]))
    return middle


@on_sales("distinct_counts")
def _(df):
    return aggs.distinct_counts(df, ["order_id", "customer", "product", "city", "order_date"])


@on_sales("value_counts")
def _(df):
    return aggs.value_counts(df, "customer")


@on_sales("argmax_group")
def _(df):
    return aggs.extreme_group(df, "customer", "price")


@on_sales("argmin_group")
def _(df):
    return aggs.extreme_group(df, "customer", "price", highest=False)


@on_sales("share_of_total")
def _(df):
    return aggs.with_share(aggs.by_group(df, "customer", "price"), places=4)


@on_sales("revenue_vs_quantity")
def _(df):
    return aggs.two_measures(df, "product", "price", "quantity")


@on_sales("treemap_rollup")
def _(df):
    return aggs.hierarchy(df, "city", "product", "price")


@on_sales("pivot_heatmap")
def _(df):
    return aggs.heatmap_cells(df, "city", "product", "price")


@on_sales("customer_spend_box", 2)
def _(df):
    return stats.group_total_box(df, "customer", "price").drop("category")


@on_sales("top5_customer_share", 2)
def _(df):
    return aggs.top_share(df, "customer", "price", 5)


# ---- headline figures ----------------------------------------------------------------------------


@on_sales("kpis", 4)
def _(df):
    return kpi.kpis(df, ROLES)


@on_sales("kpis_filtered", 4)
def _(df):
    return kpi.kpis_filtered(df, ROLES, filters.Filter(dates=WANTED.dates, regions=WANTED.regions))


@on_sales("insight_cards", 2)
def _(df):
    return kpi.insight_cards(df, ROLES)


# ---- time ------------------------------------------------------------------------------------------


def _monthly(df):
    return timeseries.monthly(df, "order_date", "price")


@on_sales("monthly_revenue")
def _(df):
    return _monthly(df)


@on_dirty("monthly_text_dates", 2)
def _(df):
    day_first = F.date_format(F.col("order_date_txt").try_cast("date"), "dd/MM/yyyy")
    texts = df.select(F.coalesce(day_first, F.col("order_date_txt")).alias("day"), "qty")
    return timeseries.monthly(texts, "day", "qty")


@on_sales("monthly_ma3", 2)
def _(df):
    return timeseries.moving_average(_monthly(df))


@on_sales("mom_growth", 4)
def _(df):
    return charts.growth_bars(df, ROLES)


@on_sales("latest_delta", 2)
def _(df):
    return timeseries.latest_delta(_monthly(df))


@on_sales("last6_months", 2)
def _(df):
    return timeseries.last_months(_monthly(df))


@on_sales("peak_trough", 2)
def _(df):
    return timeseries.peak_and_trough(_monthly(df))


@on_sales("declining_region", 2)
def _(df):
    return timeseries.half_changes(df, "city", "order_date", "price")


@on_sales("forecast_next_month", 2)
def _(df):
    return timeseries.forecast(_monthly(df))


# ---- statistics --------------------------------------------------------------------------------------


@on_sales("distribution_metrics")
def _(df):
    return stats.distribution_metrics(df, MEASURES)


@on_sales("sales_distribution", 4)
def _(df):
    return stats.deciles(df, "price")


@on_sales("numeric_insight")
def _(df):
    return stats.numeric_insight(df, MEASURES)


@on_sales("correlation_matrix")
def _(df):
    return stats.correlation_matrix(df, MEASURES)


@on_sales("correlation_pairs")
def _(df):
    return stats.ranked_pairs(df, 12, MEASURES)


def _with_spend(df):
    """A measure that follows two others, so that notable correlations exist."""
    return df.withColumn("spend", F.col("quantity") * 1000 + F.col("price").cast("double") / 2)


@on_sales("correlation_notable")
def _(df):
    return stats.notable_pairs(_with_spend(df), ["quantity", "price", "discount", "spend"])


@on_sales("histogram")
def _(df):
    return stats.histogram(df, "price", 30)


@on_sales("histogram_by_category")
def _(df):
    return stats.histogram_by_category(df, "price", 25)


@on_sales("box_by_category", 2)
def _(df):
    return stats.box_stats(df, "price", "region")


@on_sales("box_overall", 2)
def _(df):
    return stats.box_stats(df, "price")


@on_sales("normalised_long", 4)
def _(df):
    return stats.normalised_summary(df, MEASURES)


@on_sales("scatter_sample")
def _(df):
    return stats.scatter_points(df, "rid", "quantity", "price", "region", 10_000)


# ---- named answers -------------------------------------------------------------------------------------

for _name, _work in {
    "q_total_revenue": answers.total_revenue, "q_average_price": answers.average_price, "q_highest_city": answers.highest_city,
    "q_lowest_city": answers.lowest_city, "q_highest_product": answers.highest_product, "q_sales_by_city": answers.sales_by_city,
    "q_revenue_by_product": answers.revenue_by_product, "q_total_quantity": answers.total_quantity,
    "q_average_order_value": answers.average_order_value, "q_top_n_customers": answers.top_n_customers,
    "q_sales_trend": answers.sales_trend, "q_declining_region": answers.declining_region,
    "q_most_frequent_product": answers.most_frequent_product, "q_unique_customers": answers.unique_customers,
    "q_top_percentile": answers.top_percentile_customers, "q_revenue_share": answers.revenue_share,
    "q_sales_distribution": answers.sales_distribution, "q_top_categories": answers.top_categories,
    "q_forecast": answers.forecast_next_month,
}.items():
    on_sales(_name, 2)(lambda df, work=_work: work(df, ROLES))


@on_sales("q_correlation")
def _(df):
    return answers.correlation(df, ROLES, MEASURES)


# ---- chart data --------------------------------------------------------------------------------------------

for _name, _work in {
    "chart_trend": lambda df: charts.trend(df, ROLES),
    "chart_top_customers": lambda df: charts.top_bars(df, "customer", "price"),
    "chart_bottom_customers": lambda df: charts.top_bars(df, "customer", "price", ascending=True),
    "chart_top_products": lambda df: charts.top_bars(df, "product", "price"),
    "chart_bottom_regions": lambda df: charts.top_bars(df, "city", "price", ascending=True),
    "chart_pie_share": lambda df: charts.pie(df, "product", "price"),
    "chart_avg_bar": lambda df: charts.average_bars(df, "city", "price"),
    "chart_customer_freq": lambda df: charts.frequency_bars(df, "customer"),
    "chart_funnel": lambda df: charts.funnel(df, "city", "price"),
    "chart_region_share": lambda df: charts.region_share(df, ROLES),
    "chart_product_freq": lambda df: charts.frequency_pie(df, "product"),
}.items():
    on_sales(_name, 2)(_work)


# ---- findings ------------------------------------------------------------------------------------------------


@on_dirty("categorical_insight")
def _(df):
    return findings.categorical_insight(df)


@on_dirty("top_values")
def _(df):
    return findings.top_values(df)


@on_dirty("dataset_summary")
def _(df):
    return findings.dataset_summary(df)


@on_dirty("completeness_band")
def _(df):
    return findings.completeness_band(df)


@on_sales("findings_numeric")
def _(df):
    return findings.findings_numeric(df, MEASURES)


@on_dirty("findings_categorical")
def _(df):
    return findings.findings_categorical(df)


@on_sales("findings_correlation")
def _(df):
    return findings.findings_correlation(_with_spend(df), ["quantity", "price", "discount", "spend"])


@on_dirty("findings_anomalies")
def _(df):
    return findings.findings_anomalies(df, ["qty"])


@on_dirty("findings_recommendations", 4)
def _(df):
    return findings.findings_recommendations(df, ["qty"])


# ---- report ----------------------------------------------------------------------------------------------------

for _name, _work in {
    "report_summary": report.summary, "report_revenue": report.revenue, "report_customers": report.customers,
    "report_products": report.products, "report_regions": report.regions, "report_trends": report.trends,
    "report_recommendations": report.recommendations,
}.items():
    on_sales(_name, 2)(lambda df, work=_work: work(df, ROLES))


@on_sales("report_correlations")
def _(df):
    return report.correlations(df, MEASURES)


# ---- questions -------------------------------------------------------------------------------------------------


def on_turns(name):
    def register(work):
        def run(spark, folder):
            turns = spark.read.parquet(f"{folder}/conversations.parquet")
            return work(turns.select("conv_id", "turn", "text"), spark, folder)

        QUERIES[name] = run
        return work

    return register


@on_turns("question_normalise")
def _(turns, spark, folder):
    return turns.select("conv_id", "turn", tagging.normalise(F.col("text")).alias("q"))


@on_turns("question_intent")
def _(turns, spark, folder):
    return tagging.tag_answers(turns, "text").select("conv_id", "turn", "intent")


@on_turns("question_chart_intent")
def _(turns, spark, folder):
    return tagging.tag_charts(turns, "text").select("conv_id", "turn", "intent", "ascending")


@on_turns("question_params")
def _(turns, spark, folder):
    asked = turns.withColumn("q", tagging.normalise(F.concat(F.lit("Top "), F.col("turn"), F.lit("% of: "), F.col("text"))))
    return asked.select("conv_id", "turn", tagging.top_n(F.col("q"), 5).alias("n"), tagging.top_percent(F.col("q")).alias("pct"))


def _asked(turns):
    """Questions made of the turns: the text alone, or led by words that ask for a ranking or a share."""
    lead = F.element_at(
        F.array(*[F.lit(s) for s in ("", "Top 3 customers? ", "total revenue: ", "Top 10% elite. ", "How many units sold? ", "Lowest city! ")]),
        (F.pmod("conv_id", F.lit(6)) + 1).cast("int"),
    )
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat(lead, "text").alias("question"))


@on_turns("answer_questions")
def _(turns, spark, folder):
    return rounded(answers.answer_questions(_asked(turns), views.sales(spark, folder), ROLES, columns=MEASURES), 2)


@on_turns("chart_questions")
def _(turns, spark, folder):
    return rounded(charts.chart_questions(_asked(turns), views.sales(spark, folder).drop("rid"), ROLES), 2)


def _human(spark, folder):
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    scaled = F.col("c_acctbal") * F.pow(F.lit(10.0), F.pmod("c_custkey", F.lit(5)))
    return customers.select("c_custkey", text.human_number(scaled).alias("short"), text.plain_number(F.col("c_acctbal")).alias("plain"))


QUERIES["human_number"] = _human
