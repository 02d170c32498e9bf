import pytest

import __spark_entry__ as entry_point
from checks import compare
from checks.oracles import ORACLES
from checks.queries import QUERIES
from tablescope.operators import filters
from tablescope.plans import views

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "kpis", "q_top_percentile", "pivot_heatmap", "declining_region", "monthly_ma3", "numeric_insight", "box_by_category",
    "issues_all", "suggestions", "clean_report", "question_intent", "csv_encoding_mix", "report_regions",
    "chart_questions", "answer_questions", "csv_quoted_breaks", "clean_mean_values", "column_summary", "infer_types", "clean_dedup", "correlation_matrix", "findings_recommendations",
]


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    frame = entry_point.queries()[name](spark, FOLDER)
    relation = con.sql(entry_point.oracle_sql()[name])
    assert compare.type_differences(frame, relation) == ""
    assert compare.differences(frame.toPandas(), relation.df()) == ""


def test_entry_and_catalogue(spark):
    assert entry_point.entry(spark).count() == 1
    assert set(QUERIES) == set(ORACLES)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    df = views.sales(spark, FOLDER)
    wanted = filters.Filter(regions=("NATION_1",), dates=(filters.date(1996, 1, 1), filters.date(1996, 12, 31)))
    plan = _plan(filters.apply_filter(df, wanted, region="city", day="order_date").select("region", "price"))
    assert "EqualTo(n_name,NATION_1)" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert "l_tax" not in plan and "c_acctbal" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
