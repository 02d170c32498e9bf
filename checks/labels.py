"""The rules by which questions are labelled, written down once more as SQL, without a look at the library's tables.

``{q}`` stands for the normalised question. A name in braces stands for one of the word lists below it.
"""

from __future__ import annotations

# Words by notion, as regular expressions.
ANSWER_NOTIONS = {
    "money": "sales|revenue|income|earning|turnover|amount|price|value",
    "high": "highest|top|most|maximum|max|best|greatest|largest|leading",
    "low": "lowest|bottom|least|minimum|min|worst|smallest|weakest|poor",
    "mean": "average|mean|avg|typical|median",
    "sum": "total|sum|overall|aggregate|combined|all|entire",
    "where": "city|region|location|area|zone|place|district|state|branch",
    "what": "product|item|goods|merchandise|sku|category|brand",
    "who": "customer|client|buyer|user|consumer|account|purchaser",
    "units": "quantity|units|count|volume|pieces|amount sold|sold",
    "course": "trend|over time|monthly|daily|weekly|growth|progress|timeline",
    "ahead": "forecast|predict|next month|projection|future|estimate|expected",
    "tie": "correlation|relationship|related|depend|link|association|between",
    "spread": "distribution|spread|range|histogram|breakdown|split",
    "many": "unique|distinct|different|how many",
    "part": "share|percentage|percent|portion|proportion|contribution|%",
    "best": "percentile|top 5%|top 10%|elite|vip|premium|top percent",
    "fall": "declining|falling|drop|decrease|worst performing|underperform|losing",
    "often": "frequent|popular|common|mostly|mainly|often|repeat",
    "deal": "order|transaction|purchase|deal|invoice",
    "order": "order",
}
CHART_NOTIONS = {
    "money": "revenue|sales|income|amount|price|earning|total|spend",
    "high": "top|best|highest|most|leading|greatest|maximum|rank",
    "low": "lowest|worst|least|bottom|minimum|declining|poor",
    "mean": "average|mean|avg|typical",
    "course": "trend|over time|monthly|time series|growth|timeline|month",
    "spread": "distribution|spread|histogram|range|frequency|how many",
    "tie": "correlation|relationship|heatmap|related|between|matrix",
    "part": "share|pie|proportion|percentage|contribution|percent|breakdown",
    "who": "customer|client|buyer|user|consumer|cust",
    "what": "product|item|goods|sku|merchandise|category|cat",
    "where": "city|region|state|location|area|zone|district|place",
    "box": "box|boxplot|quartile|outlier|iqr|median",
    "points": "scatter|compare|vs|versus|against|plot",
}
ANSWER_CASE = """CASE WHEN trim({q}) = '' THEN 'empty'
  WHEN {ahead} THEN 'forecast_next_month' WHEN {tie} THEN 'correlation' WHEN {fall} THEN 'declining_region' WHEN {best} THEN 'top_percentile_customers'
  WHEN {course} THEN 'sales_trend' WHEN {spread} THEN 'sales_distribution' WHEN {part} AND ({what} OR {where}) THEN 'revenue_share_category'
  WHEN {many} AND {who} THEN 'unique_customer_count' WHEN {deal} AND {mean} THEN 'average_order_value' WHEN {sum} AND {units} THEN 'total_quantity_sold'
  WHEN {sum} AND {money} THEN 'total_revenue' WHEN {mean} AND ({money} OR {order}) THEN 'average_price' WHEN {high} AND {where} THEN 'highest_sales_city'
  WHEN {low} AND {where} THEN 'lowest_sales_city' WHEN {high} AND {what} THEN 'highest_selling_product' WHEN {often} AND {what} THEN 'most_frequent_product'
  WHEN {money} AND {what} THEN 'revenue_by_product' WHEN {money} AND {where} THEN 'sales_by_city' WHEN {who} AND {high} THEN 'top_n_customers'
  WHEN {units} THEN 'total_quantity_sold' WHEN {who} THEN 'unique_customer_count' WHEN {what} THEN 'most_frequent_product' WHEN {where} THEN 'sales_by_city'
  WHEN {money} OR {sum} THEN 'total_revenue' WHEN {mean} THEN 'average_price' ELSE 'unknown' END"""
CHART_CASE = """CASE WHEN trim({q}) = '' THEN 'empty'
  WHEN {tie} THEN 'correlation' WHEN {course} THEN 'trend' WHEN {box} THEN 'box' WHEN {points} THEN 'scatter' WHEN {part} THEN 'pie' WHEN {spread} THEN 'histogram'
  WHEN ({high} OR {low}) AND {who} THEN 'top_customers' WHEN ({high} OR {low}) AND {what} THEN 'top_products' WHEN ({high} OR {low}) AND {where} THEN 'top_regions'
  WHEN {who} AND {money} THEN 'top_customers' WHEN {what} AND {money} THEN 'top_products' WHEN {where} AND {money} THEN 'top_regions'
  WHEN {mean} THEN 'avg_bar' WHEN {who} THEN 'customer_freq' WHEN {what} THEN 'top_products' WHEN {where} OR {money} THEN 'top_regions' ELSE 'unknown' END"""


def _filled(case: str, notions: dict, q: str) -> str:
    return case.format(q=q, **{name: f"regexp_matches({q}, '{words}')" for name, words in notions.items()})


def answer_label(q: str = "q") -> str:
    return _filled(ANSWER_CASE, ANSWER_NOTIONS, q)


def chart_label(q: str = "q") -> str:
    return _filled(CHART_CASE, CHART_NOTIONS, q)


def from_the_bottom(q: str = "q") -> str:
    return f"regexp_matches({q}, '{CHART_NOTIONS['low']}')"
