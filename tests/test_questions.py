import datetime as dt

import pytest

from tablescope.operators.roles import Roles
from tablescope.plans import answers, charts, lookup, tagging

ANSWERED = [
    ("What is the total revenue?", "total_revenue", 5), ("What is the average price?", "average_price", 5),
    ("Which city has the highest sales?", "highest_sales_city", 5), ("Show sales trend over time", "sales_trend", 5),
    ("Which product sells the most?", "highest_selling_product", 5), ("Who are the top 5 customers?", "top_n_customers", 5),
    ("Forecast next month revenue", "forecast_next_month", 5), ("", "empty", 5), ("hello", "unknown", 5),
    ("Show me the top three customers!", "top_n_customers", 3), ("top  12 customers", "top_n_customers", 12),
]
CHARTED = [
    ("Show revenue by city", "top_regions", 10, False), ("Top 10 products by sales", "top_products", 10, False),
    ("Monthly sales trend", "trend", 10, False), ("Customer purchase frequency", "histogram", 10, False),
    ("Revenue share by category", "pie", 10, False), ("Correlation heatmap", "correlation", 10, False),
    ("Distribution of amount", "histogram", 10, False), ("Top 5 customers by spend", "top_customers", 5, False),
    ("Lowest performing regions", "top_regions", 10, True), ("Average order value by product", "avg_bar", 10, False),
    ("Box plot of sales", "box", 10, False), ("Sales breakdown pie chart", "pie", 10, False), ("", "empty", 10, False),
    ("hello", "unknown", 10, False),
]
ROLES = Roles(sales="price", quantity="quantity", customer="customer", product="product", region="city", date="day")


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(f"c{i % 7}", f"p{i % 3}", f"t{i % 4}", float(i), float(i * i), dt.date(2024, 1 + i % 6, 1)) for i in range(1, 60)]
    return spark.createDataFrame(rows, "customer string, product string, city string, quantity double, price double, day date").cache()


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")


def test_answer_tags(spark):
    got = tagging.tag_answers(asked(spark, [t for t, _, _ in ANSWERED])).orderBy("question_id").collect()
    assert [(r["question"], r["intent"], r["n"]) for r in got] == ANSWERED
    loose, strict = (
        tagging.tag_answers(asked(spark, ["small talk", "sum it"]), whole_words=w).orderBy("question_id").collect() for w in (False, True)
    )
    assert [r["intent"] for r in loose] == ["total_revenue"] * 2 and [r["intent"] for r in strict] == ["unknown", "total_revenue"]


def test_chart_tags(spark):
    got = tagging.tag_charts(asked(spark, [t for t, *_ in CHARTED])).orderBy("question_id").collect()
    # "Average order value by product" names a product and no sales word of the chart list, so it is an average chart.
    assert [(r["question"], r["intent"], r["n"], r["ascending"]) for r in got] == CHARTED


def test_parameters(spark):
    got = tagging.tag_answers(asked(spark, ["Top 10% of VIPs", "elite", "top ten", "top 99999999999999999999 x"])).orderBy("question_id").collect()
    assert [(r["pct"], r["n"]) for r in got] == [(10.0, 10), (5.0, 5), (5.0, 10), (5.0, 5)]


def test_bulk_answers(spark, facts):
    texts = ["total revenue", "top 2 customers", "top 4 customers", "top 50 % vip", "hello", "  "]
    got = answers.answer_questions(asked(spark, texts), facts, ROLES).collect()
    by_id = {i: sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"] or 0) for i in range(6)}
    assert by_id[0][0]["value"] == sum(i * i for i in range(1, 60))
    spend = {}
    for i in range(1, 60):
        spend[f"c{i % 7}"] = spend.get(f"c{i % 7}", 0.0) + i * i
    best = sorted(spend.items(), key=lambda kv: (-kv[1], kv[0]))
    assert [(r["label"], r["value"]) for r in by_id[1]] == best[:2] and [(r["label"], r["value"]) for r in by_id[2]] == best[:4]
    share = by_id[3][0]
    assert share["extra"] == 3 and share["value"] == pytest.approx(sum(v for _, v in best[:3]) / sum(spend.values()) * 100)
    assert [r["status"] for r in by_id[4] + by_id[5]] == ["not understood", "no question"]
    lacking = answers.answer_questions(asked(spark, ["total revenue"]), facts, Roles()).collect()
    assert lacking[0]["status"] == "no column for: sales"


def test_equal_totals_at_the_cut(spark):
    ties = spark.createDataFrame([(f"c{i}", 10.0) for i in range(9)] + [("z", 50.0)], "customer string, price double")
    rows = answers.top_percentile_customers(ties, ROLES, 30.0).orderBy("rank").collect()
    assert rows[0]["extra"] == 3 and rows[0]["value"] == pytest.approx(70 / 140 * 100) and rows[1]["label"] == "z"


def test_bulk_charts(spark, facts):
    texts = [t for t, *_ in CHARTED]
    got = charts.chart_questions(asked(spark, texts), facts, ROLES).collect()
    per = {i: [r for r in got if r["id"] == i] for i in range(len(texts))}
    assert [len(per[i]) for i in range(14)] == [4, 3, 6, 30, 3, 4, 30, 5, 4, 4, 20, 3, 1, 1]
    assert [r["label"] for r in sorted(per[8], key=lambda r: r["rank"])][0] == "t0"
    assert sum(r["value"] for r in per[3]) == 59


def test_jobs_do_not_follow_the_parameters(spark, facts):
    def jobs(texts, name):
        spark.sparkContext.setJobGroup(name, name)
        try:
            answers.answer_questions(asked(spark, texts), facts, ROLES).collect()
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs([f"top {p}% vip" for p in range(1, 41)], "many") <= jobs(["top 5% vip"], "one") + 2


def test_shares_of_every_percentage(spark, facts):
    got = answers.answer_questions(asked(spark, [f"top {p}% vip" for p in range(0, 130, 7)]), facts, ROLES).collect()
    for i, p in enumerate(range(0, 130, 7)):
        mine = sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])
        alone = answers.top_percentile_customers(facts, ROLES, float(p)).orderBy("rank").collect()
        assert [(r["rank"], r["label"], r["value"], r["extra"]) for r in mine] == [(r["rank"], r["label"], r["value"], r["extra"]) for r in alone]
        assert mine[0]["extra"] == max(1, 7 * p // 100) and len(mine) == 1 + min(5, 7, mine[0]["extra"])


def test_large_answers_are_joined_in_salted_parts(spark, facts, monkeypatch):
    texts = ["sales by city", "top 4 customers", "hello", "total revenue"] * 30
    plain = answers.answer_questions(asked(spark, texts), facts, ROLES)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)
    # Without a broadcast of Spark's own choice.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = answers.answer_questions(asked(spark, texts), facts, ROLES)
        plan = salted._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan and "SortMergeJoin" in plan and "NestedLoop" not in plan
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keyed_answers_without_the_product(spark, facts):
    tags, made = answers.answer_tables(asked(spark, ["total revenue"] * 50 + ["top 3 customers", "top 2 customers", ""]), facts, ROLES)
    assert tags.count() == 53 and made.count() == 1 + 3
    assert {(r["intent"], r["status"], r["most"]) for r in tags.collect()} == {("total_revenue", "answered", None), ("top_n_customers", "answered", 3), ("top_n_customers", "answered", 2), ("empty", "no question", None)}


def test_scatter_without_a_key_and_box_of_many_values(spark, facts):
    got = charts.chart_questions(asked(spark, ["Scatter plot of price and quantity"]), facts, ROLES).collect()
    assert len(got) == 59 and {(r["value"], r["extra"]) for r in got} == {(float(i), float(i * i)) for i in range(1, 60)}
    many = spark.createDataFrame([(f"t{i}", float(i)) for i in range(30)], "city string, price double")
    boxes = charts.chart_questions(asked(spark, ["box plot"]), many, Roles(sales="price", region="city")).collect()
    assert len(boxes) == 5 and {r["status"] for r in boxes} == {"charted, one box for more than 20 values"}


def test_histogram_labels_are_rounded_once(spark):
    prices = spark.createDataFrame([(900.68,), (104999.91,)], "price double")
    bars = charts.chart_questions(asked(spark, ["distribution of price"]), prices, Roles(sales="price")).collect()
    assert {r["rank"]: r["label"] for r in bars}[16] == "52,950.30"
