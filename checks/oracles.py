"""SQL for each registered query, over the raw tables, written independently of the library."""

from __future__ import annotations

from .labels import answer_label, chart_label, from_the_bottom

NUM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DAY = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"

SALES = """
sales AS (
  SELECT l.l_orderkey * 1000003 + l.l_partkey * 1009 + l.l_suppkey * 17 + l.l_linenumber AS rid,
         CAST(l.l_orderkey AS VARCHAR) AS order_id, o.o_orderdate AS order_date,
         c.c_name AS customer, p.p_type AS category, p.p_brand AS product,
         n.n_name AS city, r.r_name AS region,
         l.l_quantity AS quantity, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price, l.l_discount AS discount
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

DIRTY = (
    SALES
    + """, dirty0 AS (
  SELECT rid, customer,
    CASE WHEN rid % 50 = 0 THEN NULL WHEN rid % 31 = 0 THEN 'missing'
         WHEN rid % 7 = 0 THEN concat('$', CAST(price AS VARCHAR)) ELSE CAST(price AS VARCHAR) END AS amount_txt,
    CASE WHEN rid % 40 = 0 THEN NULL WHEN rid % 29 = 0 THEN 'not a date'
         ELSE CAST(CAST(order_date AS DATE) AS VARCHAR) END AS order_date_txt,
    CASE WHEN rid % 37 = 0 THEN NULL WHEN rid % 11 = 0 THEN concat('  ', lower(region))
         WHEN rid % 13 = 0 THEN concat(region, ' ') WHEN rid % 17 = 0 THEN concat(region, 'é')
         ELSE region END AS region_txt,
    CASE rid % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE'
                 WHEN 3 THEN 'false' WHEN 4 THEN 'Y' ELSE NULL END AS flag_txt,
    CASE WHEN rid % 3 <> 0 THEN NULL WHEN rid % 2 = 0 THEN 'ok' ELSE 'late' END AS note_txt,
    'USD' AS currency, CAST(NULL AS VARCHAR) AS empty_col,
    CASE WHEN rid % 997 = 0 THEN quantity * 1000 WHEN rid % 43 = 0 THEN NULL ELSE quantity END AS qty
  FROM sales
), dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE rid % 101 = 0)"""
)

COLUMNS = ["rid", "customer", "amount_txt", "order_date_txt", "region_txt", "flag_txt", "note_txt", "currency", "empty_col", "qty"]
RAW_TYPES = {"rid": ("bigint", "integer"), "qty": ("double", "float")}
WORDS = "('yes','no','true','false','1','0','y','n')"


def sales(body: str) -> str:
    return f"WITH {SALES}\n{body}"


def dirty(body: str) -> str:
    return f"WITH {DIRTY}\n{body}"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def money(x: str = "price") -> str:
    return f"coalesce(CAST(sum({x}) AS DOUBLE), 0)"


def mean(x: str = "price") -> str:
    return f"CAST(sum({x}) AS DOUBLE) / count({x})"


# ---- per-column evidence -------------------------------------------------------------------

_branches = []
for _at, _c in enumerate(COLUMNS):
    _raw, _label = RAW_TYPES.get(_c, ("string", "string"))
    _branches.append(
        f"SELECT {_at} AS position, '{_c}' AS col, '{_raw}' AS raw_type, '{_label}' AS label, CAST({_c} AS VARCHAR) AS v FROM dirty"
    )
VALS = "vals AS (" + " UNION ALL ".join(_branches) + ")"
NUMV = f"CASE WHEN label = 'string' AND regexp_matches(trim(v), '{NUM}') THEN TRY_CAST(trim(v) AS DOUBLE) END"
EVIDENCE = (
    DIRTY
    + f""", {VALS}, seen AS (
  SELECT position, col, raw_type, label, count(*) AS total, count(*) - count(v) AS missing, count(DISTINCT v) AS uniq,
         coalesce(bool_and(lower(trim(v)) IN {WORDS}), false) AS bools,
         count({NUMV}) AS numbers, coalesce(bool_and({NUMV} = floor({NUMV})), false) AS whole,
         count(CASE WHEN label = 'string' AND regexp_matches(trim(v), '{DAY}') THEN TRY_CAST(v AS DATE) END) AS dates,
         count(CASE WHEN label = 'string' AND v <> trim(v) THEN 1 END) AS padded,
         count(CASE WHEN label = 'string' AND regexp_matches(v, '[^\\x20-\\x7E]') THEN 1 END) AS special,
         count(DISTINCT CASE WHEN label = 'string' THEN trim(v) END) AS plain,
         count(DISTINCT CASE WHEN label = 'string' THEN lower(trim(v)) END) AS folded
  FROM vals GROUP BY ALL
), typed AS (
  SELECT *, CASE WHEN total = missing THEN 'string' WHEN bools THEN 'boolean'
                 WHEN label IN ('integer','float') THEN label
                 WHEN dates / (total - missing) >= 0.7 THEN 'datetime'
                 WHEN numbers / (total - missing) >= 0.8 AND whole THEN 'integer'
                 WHEN numbers / (total - missing) >= 0.8 THEN 'float'
                 WHEN uniq / (total - missing) < 0.2 OR uniq <= 20 THEN 'categorical' ELSE 'string' END AS kind,
         round(missing / total * 100, 1) AS mp, (total = missing) AS is_empty,
         (uniq + CASE WHEN missing > 0 THEN 1 ELSE 0 END) <= 1 AS is_constant
  FROM seen
), nums AS (
  SELECT col, CASE WHEN label = 'string' THEN {NUMV} ELSE CAST(v AS DOUBLE) END AS x FROM vals JOIN typed USING (col, label)
  WHERE kind IN ('integer','float')
), quarts AS (
  SELECT col, count(x) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, min(x) AS lo, max(x) AS hi,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM nums GROUP BY col
), outs AS (
  SELECT col, CASE WHEN max(n) < 4 OR max(q1) = max(q3) THEN 0
         ELSE count(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 END) END AS outliers
  FROM nums JOIN quarts USING (col) GROUP BY col
), prof AS (SELECT * FROM typed LEFT JOIN quarts USING (col) LEFT JOIN outs USING (col)
), dups AS (
  SELECT (SELECT count(*) FROM dirty) AS total, (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS dup
), cells AS (SELECT sum(missing) AS missing FROM seen
)"""
)

_RULES = [
    ("is_empty", "'Empty Column'", "'High'", "'No values.'", "total", 1),
    ("NOT is_empty AND is_constant", "'Constant Column'", "'Medium'", "'One value only.'", "total", 2),
    ("NOT is_empty AND missing > 0", "'Missing Values'", "CASE WHEN mp > 30 THEN 'High' WHEN mp > 5 THEN 'Medium' ELSE 'Low' END", "concat(missing, ' values missing.')", "missing", 3),
    ("NOT is_empty AND kind IN ('string','categorical') AND padded > 0", "'Leading/Trailing Whitespace'", "'Low'", "concat(padded, ' values padded with white space.')", "padded", 4),
    ("NOT is_empty AND label = 'string' AND kind IN ('integer','float')", "'Numeric Stored as String'", "'High'", "'Numbers held as text.'", "greatest(missing, 1)", 5),
    ("NOT is_empty AND label = 'string' AND kind = 'datetime'", "'Date Stored as Text'", "'Medium'", "'Dates held as text.'", "total - missing", 6),
    ("NOT is_empty AND kind = 'boolean' AND folded > 2", "'Boolean Inconsistency'", "'Medium'", "concat(folded, ' spellings of two truth values.')", "total - missing", 7),
    ("NOT is_empty AND kind = 'categorical' AND plain > folded", "'Category Inconsistency'", "'Medium'", "concat(plain - folded, ' labels differ by case only.')", "plain - folded", 8),
    ("NOT is_empty AND kind = 'categorical' AND uniq > 50", "'High Cardinality Categorical'", "'Low'", "concat(uniq, ' different labels.')", "uniq", 9),
    ("NOT is_empty AND kind IN ('integer','float') AND outliers > 0", "'Outliers Detected (IQR)'", "'Medium'", "concat(outliers, ' values outside the quartile fences.')", "outliers", 10),
    ("NOT is_empty AND kind IN ('string','categorical') AND special > 0", "'Special/Invisible Characters'", "'Low'", "concat(special, ' values with non-printable or accented characters.')", "special", 11),
    ("NOT is_empty AND label = 'string' AND kind = 'datetime' AND total - missing > dates", "'Invalid Date Format'", "'Medium'", "concat(total - missing - dates, ' values are no dates.')", "total - missing - dates", 12),
]
ISSUES = (
    EVIDENCE
    + """, issues AS (
  SELECT '(dataset)' AS col, -1 AS position, 0 AS pos, 'Duplicate Rows' AS issue_type, CASE WHEN dup > 10 THEN 'High' ELSE 'Medium' END AS severity,
         concat(dup, ' rows repeat an earlier row.') AS description, CAST(dup AS BIGINT) AS affected FROM dups WHERE dup > 0 """
    + " ".join(
        f"UNION ALL SELECT col, position, {pos}, {kind}, {sev}, {desc}, CAST({n} AS BIGINT) FROM prof WHERE {cond}"
        for cond, kind, sev, desc, n, pos in _RULES
    )
    + ")"
)

ORACLES: dict[str, str] = {}

# ---- sources ---------------------------------------------------------------------------------

ORACLES["csv_roundtrip"] = sales(
    f"SELECT region, count(*) AS n, round({money()}, 2) AS price, round({money('quantity')}, 2) AS quantity, min(CAST(order_date AS DATE)) AS first_day FROM sales GROUP BY region"
)
ORACLES["csv_encoding_mix"] = dirty(
    "SELECT region_txt, count(*) AS n, CAST(sum(rid) AS BIGINT) AS rid_sum FROM dirty GROUP BY region_txt"
)
ORACLES["csv_header_orders"] = dirty(
    "SELECT region_txt, CASE WHEN rid % 2 <> 0 THEN note_txt END AS note_txt, count(*) AS n, CAST(sum(rid) AS BIGINT) AS rid_sum, sum(qty) AS qty_sum FROM dirty GROUP BY 1, 2"
)
ORACLES["csv_quoted_breaks"] = dirty(
    "SELECT CASE rid % 5 WHEN 0 THEN concat_ws(chr(10), region_txt, customer) WHEN 1 THEN concat('\"', customer, '\",', chr(10), chr(10), '\"x\"') "
    "WHEN 2 THEN region_txt || ', plain' WHEN 3 THEN 'a' || chr(13) || chr(10) || 'b ' || flag_txt END AS note, "
    "count(*) AS n, CAST(sum(rid) AS BIGINT) AS rid_sum, sum(qty) AS qty_sum FROM dirty GROUP BY 1"
)
ORACLES["csv_wide_ids"] = sales(
    "SELECT count(DISTINCT rid) AS ids, max(rid) + 9122456789012345678 AS \"last\", count(DISTINCT rid) AS wider_ids, "
    "concat(CAST(max(rid) + 9122456789012345678 AS VARCHAR), '00') AS widest FROM sales"
)
ORACLES["xlsx_folder"] = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLES["xlsx_dates"] = (
    "WITH m AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, sum(o_totalprice) AS made FROM orders GROUP BY 1), "
    "s AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)), INTERVAL 1 MONTH)) AS DATE)) AS month FROM m) "
    "SELECT month, round(coalesce(made, 0), 2) AS revenue FROM s LEFT JOIN m USING (month)"
)
ORACLES["clean_names"] = "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"

# ---- typing ------------------------------------------------------------------------------------

_STRIPPED = r"regexp_replace(amount_txt, '[$,€£¥%\s]', '', 'g')"
ORACLES["numeric_repair"] = dirty(
    f"SELECT rid, CASE WHEN regexp_matches({_STRIPPED}, '{NUM}') THEN CAST({_STRIPPED} AS DOUBLE) END AS amount_txt, region_txt, order_date_txt FROM dirty"
)
ORACLES["infer_types"] = (
    f"WITH {EVIDENCE} SELECT col AS \"column\", raw_type, label, kind AS inferred_type, total AS rows, missing AS missing_count, "
    "uniq AS unique_count, bools AS boolean_words, numbers AS number_count, dates AS date_count FROM typed"
)
ORACLES["column_roles"] = (
    f"WITH {DIRTY}, parse AS (SELECT count(CASE WHEN regexp_matches(order_date_txt, '{DAY}') THEN TRY_CAST(order_date_txt AS DATE) END) / count(order_date_txt) >= 0.7 AS dated, "
    f"count(CASE WHEN regexp_matches({_STRIPPED}, '{NUM}') THEN 1 END) / count(amount_txt) >= 0.7 AS numeric FROM dirty) "
    "SELECT role, CASE WHEN ok THEN col END AS \"column\", 1 AS rank, CASE WHEN ok AND found THEN col ELSE '' END AS candidates, false AS ambiguous, "
    "(ok AND NOT found) AS fallback FROM ("
    "SELECT 'sales' AS role, CASE WHEN numeric THEN 'amount_txt' ELSE 'rid' END AS col, true AS ok, numeric AS found FROM parse "
    "UNION ALL SELECT 'quantity', 'qty', true, true FROM parse UNION ALL SELECT 'customer', 'customer', true, true FROM parse "
    "UNION ALL SELECT 'product', '', false, false FROM parse UNION ALL SELECT 'order', 'order_date_txt', true, true FROM parse "
    "UNION ALL SELECT 'region', 'region_txt', true, true FROM parse UNION ALL SELECT 'date', 'order_date_txt', dated, true FROM parse)"
)

# ---- filters -----------------------------------------------------------------------------------

_REGION = "city IN ('NATION_1','NATION_2','NATION_3')"
_PRODUCT = "product IN ('Brand#1','Brand#12','Brand#19')"
_DATES = "CAST(order_date AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"
_AMOUNT = "price BETWEEN 10000 AND 90000"
for _key, _where in {"filter_region": _REGION, "filter_product": _PRODUCT, "filter_dates": _DATES, "filter_amount": _AMOUNT}.items():
    ORACLES[_key] = sales(f"SELECT region, count(*) AS n, {money()} AS price FROM sales WHERE {_where} GROUP BY region")
ORACLES["filter_retention"] = sales(
    f"SELECT count(*) FILTER (WHERE {_REGION} AND {_PRODUCT} AND {_DATES} AND {_AMOUNT}) AS rows_kept, count(*) AS rows_total, "
    f"round(count(*) FILTER (WHERE {_REGION} AND {_PRODUCT} AND {_DATES} AND {_AMOUNT}) / count(*) * 100, 1) AS pct_kept FROM sales"
)
ORACLES["filter_options"] = sales(
    "SELECT DISTINCT 'region' AS kind, city AS value FROM sales UNION ALL SELECT DISTINCT 'product', product FROM sales "
    "UNION ALL SELECT 'first_day', CAST(min(CAST(order_date AS DATE)) AS VARCHAR) FROM sales "
    "UNION ALL SELECT 'last_day', CAST(max(CAST(order_date AS DATE)) AS VARCHAR) FROM sales "
    "UNION ALL SELECT 'low', CAST(min(price) AS VARCHAR) FROM sales UNION ALL SELECT 'high', CAST(max(price) AS VARCHAR) FROM sales"
)
ORACLES["preview_rows"] = sales(
    "SELECT rid, customer, product, city, quantity FROM sales ORDER BY rid, customer, product, city, quantity LIMIT 100"
)
ORACLES["hash_sample"] = sales(
    "SELECT rid, product, quantity FROM sales ORDER BY md5(concat(CAST(rid AS VARCHAR), '42')), rid LIMIT 1000"
)
ORACLES["numeric_projection"] = sales(
    "SELECT 'quantity' AS \"column\", round(avg(quantity), 4) AS figure FROM sales "
    f"UNION ALL SELECT 'price', round({mean()}, 4) FROM sales UNION ALL SELECT 'discount', round(avg(discount), 4) FROM sales "
    + " ".join(f"UNION ALL SELECT '{c}', CAST(count(DISTINCT {c}) AS DOUBLE) FROM sales" for c in ["order_id", "customer", "category", "product", "city", "region"])
)

# ---- cleaning ----------------------------------------------------------------------------------

_AMT = f"CASE WHEN regexp_matches(trim(amount_txt), '{NUM}') THEN CAST(trim(amount_txt) AS DOUBLE) END"
_TITLE = "array_to_string(list_transform(string_split(lower(trim(region_txt)), ' '), lambda p: concat(upper(p[1]), p[2:])), ' ')"
_SPECIAL = "trim(regexp_replace({}, '[^\\x20-\\x7E]', '', 'g'))"
_BOOL = "CASE WHEN lower(trim({0})) IN ('yes','true','1','y','t') THEN true WHEN lower(trim({0})) IN ('no','false','0','n','f') THEN false END"


def _mode(column: str, table: str) -> str:
    return f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, CAST({column} AS VARCHAR) LIMIT 1)"


ORACLES["clean_dedup"] = dirty("SELECT DISTINCT rid, customer, amount_txt, order_date_txt, region_txt, flag_txt, note_txt, qty FROM dirty")
for _how, _agg in {"median": "quantile_cont({}, 0.5)", "zero": "0.0"}.items():
    _places = {"median": 4, "zero": 9}[_how]
    # The figures of both columns are made once, as one row.
    ORACLES[f"clean_fill_{_how}"] = (
        f"WITH {DIRTY}, typed AS MATERIALIZED (SELECT rid, qty, {_AMT} AS amount FROM dirty), "
        f"figures AS MATERIALIZED (SELECT max(n) AS n, {_agg.format('qty')} AS q, {_agg.format('amount')} AS a FROM (SELECT *, 1 AS n FROM typed)) "
        f"SELECT rid, round(coalesce(qty, q), {_places}) AS qty, round(coalesce(amount, a), {_places}) AS amount_txt FROM typed, figures"
    )
# Sums of decimals over counts, with the two means as one row beside the rows.
_MEANS = f"SELECT {{}} FROM (SELECT CAST(sum(CAST(qty AS DECIMAL(18,2))) AS DOUBLE) / count(qty) AS q, CAST(sum(CAST({_AMT} AS DECIMAL(18,2))) AS DOUBLE) / count({_AMT}) AS a FROM dirty) m"
ORACLES["clean_fill_mean"] = dirty(
    _MEANS.format(f"rid, round(coalesce(qty, q), 2) AS qty, round(coalesce({_AMT}, a), 2) AS amount_txt") + " CROSS JOIN dirty"
)
ORACLES["clean_mean_values"] = dirty(_MEANS.format("round(q, 2) AS qty, round(a, 2) AS amount_txt"))
ORACLES["clean_mode_tie"] = dirty("SELECT x, count(*) AS n FROM (SELECT unnest([9.0::DOUBLE, 10.0::DOUBLE, 9.0::DOUBLE]) AS x FROM dirty) GROUP BY x")
ORACLES["clean_unmapped_words"] = dirty(
    "SELECT rid, CASE WHEN rid % 5 = 0 THEN 'maybe' WHEN flag_txt IN ('Yes', 'TRUE', 'Y') THEN 'True' WHEN flag_txt IN ('no', 'false') THEN 'False' END AS flag_txt FROM dirty"
)
ORACLES["clean_no_dates"] = dirty("SELECT note_txt, count(*) AS n, 'Skipped' AS status FROM dirty GROUP BY note_txt")
ORACLES["clean_fill_unknown"] = dirty("SELECT rid, coalesce(note_txt, 'Unknown') AS note_txt FROM dirty")
ORACLES["clean_fill_notprovided"] = dirty("SELECT rid, coalesce(note_txt, 'Not_Provided') AS note_txt FROM dirty")
ORACLES["clean_fill_mode"] = dirty(
    f"SELECT rid, coalesce(flag_txt, {_mode('flag_txt', 'dirty')}) AS flag_txt, coalesce(qty, {_mode('qty', 'dirty')}) AS qty FROM dirty"
)
ORACLES["clean_drop_missing"] = dirty("SELECT rid, order_date_txt FROM dirty WHERE order_date_txt IS NOT NULL")
ORACLES["clean_trim"] = dirty("SELECT rid, trim(region_txt) AS region_txt FROM dirty")
ORACLES["clean_special"] = dirty(f"SELECT rid, {_SPECIAL.format('region_txt')} AS region_txt FROM dirty")
ORACLES["clean_case"] = ORACLES["clean_categories"] = dirty(f"SELECT rid, {_TITLE} AS region_txt FROM dirty")
ORACLES["clean_to_numeric"] = dirty(f"SELECT rid, {_AMT} AS amount_txt FROM dirty")
ORACLES["clean_to_datetime"] = dirty("SELECT rid, TRY_CAST(order_date_txt AS DATE) AS order_date_txt FROM dirty")
ORACLES["clean_boolean"] = dirty(f"SELECT rid, {_BOOL.format('flag_txt')} AS flag_txt FROM dirty")
_FENCE = "(SELECT quantile_cont(qty, 0.25) - 1.5 * (quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25)) AS lo, quantile_cont(qty, 0.75) + 1.5 * (quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25)) AS hi FROM {})"
ORACLES["clean_cap"] = dirty(
    f"SELECT rid, CASE WHEN qty < lo THEN lo WHEN qty > hi THEN hi ELSE qty END AS qty FROM dirty, {_FENCE.format('dirty')}"
)
ORACLES["clean_remove_outliers"] = dirty(f"SELECT rid, qty FROM dirty, {_FENCE.format('dirty')} WHERE qty BETWEEN lo AND hi OR qty IS NULL")
ORACLES["clean_drop_cols"] = dirty(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS present FROM dirty" for c in COLUMNS if c not in ("currency", "empty_col"))
)
_FULL = f"""{DIRTY}, d AS (SELECT DISTINCT * FROM dirty), f AS (
  SELECT rid, customer, coalesce({_AMT}, (SELECT quantile_cont({_AMT}, 0.5) FROM d)) AS amount_txt, order_date_txt, coalesce(region_txt, 'Unknown') AS region_txt,
         coalesce(flag_txt, {_mode('flag_txt', 'd')}) AS flag_txt, coalesce(note_txt, 'Unknown') AS note_txt, currency,
         coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM d)) AS qty FROM d
)"""
ORACLES["clean_full"] = (
    f"WITH {_FULL} SELECT rid, customer, round(amount_txt, 4) AS amount_txt, TRY_CAST(order_date_txt AS DATE) AS order_date_txt, "
    f"{_SPECIAL.format(_TITLE)} AS region_txt, {_BOOL.format('flag_txt')} AS flag_txt, note_txt, currency, "
    f"round(CASE WHEN qty < lo THEN lo WHEN qty > hi THEN hi ELSE qty END, 4) AS qty FROM f, {_FENCE.format('f')}"
)
ORACLES["clean_report"] = (
    f"WITH {_FULL}, fen AS (SELECT lo, hi FROM {_FENCE.format('f')}), base AS (SELECT (SELECT count(*) FROM dirty) AS before, (SELECT count(*) FROM d) AS after, "
    f"(SELECT count(*) FROM d WHERE ({_AMT}) IS NULL) + (SELECT count(*) FROM d WHERE region_txt IS NULL) + (SELECT count(*) FROM d WHERE flag_txt IS NULL) "
    "+ (SELECT count(*) FROM d WHERE note_txt IS NULL) + (SELECT count(*) FROM d WHERE qty IS NULL) AS fixed, "
    "(SELECT count(*) FROM d WHERE TRY_CAST(order_date_txt AS DATE) IS NULL) AS undated, "
    "(SELECT count(*) FROM f, fen WHERE qty < lo OR qty > hi) AS capped) "
    # After capping no value lies outside the new fences, so the last step removes nothing.
    "SELECT before AS rows_before, after - undated AS rows_after, before - after AS duplicates_removed, fixed + undated AS missing_fixed, "
    "CAST(4 AS BIGINT) AS columns_standardized, capped AS outliers_handled, CAST(1 AS BIGINT) AS columns_dropped, CAST(2 AS BIGINT) AS type_conversions FROM base"
)

# ---- profile and issues ------------------------------------------------------------------------

_big = lambda c: f"CASE WHEN abs({c}) >= 1e6 THEN round({c}, 0) ELSE round({c}, 4) END"
ORACLES["profile_columns"] = (
    f"WITH {EVIDENCE} SELECT col AS \"column\", raw_type, kind AS inferred_type, missing AS missing_count, mp AS missing_pct, uniq AS unique_count, "
    f"round((total - missing) / total * 100, 1) AS completeness_pct, is_constant, is_empty, {_big('mean')} AS mean, {_big('median')} AS median, "
    f"{_big('std')} AS std, lo AS \"min\", hi AS \"max\" FROM prof"
)
ORACLES["profile_dataset"] = f"WITH {EVIDENCE} SELECT total AS rows, CAST(10 AS BIGINT) AS columns, dup AS duplicate_rows, CAST(missing AS BIGINT) AS total_missing FROM dups, cells"
ORACLES["duplicate_rows"] = f"WITH {EVIDENCE} SELECT total AS rows, dup AS duplicate_rows FROM dups"
ORACLES["completeness"] = (
    f"WITH {EVIDENCE} SELECT total AS rows, total * 10 AS cells, CAST(missing AS BIGINT) AS missing_cells, round((1 - missing / (total * 10)) * 100, 1) AS completeness_pct FROM dups, cells"
)
ORACLES["column_summary"] = (
    f"WITH {EVIDENCE}, ranked AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) AS pos FROM (SELECT DISTINCT col, v FROM vals WHERE v IS NOT NULL)), "
    "firsts AS (SELECT col, string_agg(v, ', ' ORDER BY pos) AS s FROM ranked WHERE pos <= 3 GROUP BY col) "
    "SELECT col AS \"column\", missing AS missing_count, mp AS missing_pct, uniq AS unique_count, round((total - missing) / total * 100, 1) AS completeness_pct, "
    "substring(coalesce(s, ''), 1, 60) AS sample_values FROM typed LEFT JOIN firsts USING (col)"
)
ORACLES["issues_all"] = f"WITH {ISSUES} SELECT col AS \"column\", issue_type, severity, description, affected AS affected_count FROM issues"
ORACLES["issues_by_severity"] = (
    f"WITH {ISSUES} SELECT s AS severity, count(issue_type) AS n FROM (VALUES ('High'), ('Medium'), ('Low')) AS t(s) LEFT JOIN issues ON severity = s GROUP BY s"
)
_SUGGEST = [
    (1, "Duplicate Rows", None, "remove_duplicates", True), (2, "Empty Column", None, "drop_empty_column", True),
    (3, "Constant Column", None, "drop_constant_column", False),
    (4, "Missing Values", "integer,float", "fill_missing_median", True), (5, "Missing Values", "integer,float", "fill_missing_mean", False),
    (6, "Missing Values", "integer,float", "fill_missing_zero", False), (7, "Missing Values", "datetime", "drop_missing_rows", False),
    (8, "Missing Values", "boolean", "fill_missing_mode", True), (9, "Missing Values", "string,categorical", "fill_missing_unknown", True),
    (10, "Missing Values", "string,categorical", "fill_missing_notprovided", False),
    (11, "Leading/Trailing Whitespace", None, "trim_whitespace", True), (12, "Numeric Stored as String", None, "convert_to_numeric", True),
    (13, "Date Stored as Text", None, "convert_to_datetime", True), (14, "Boolean Inconsistency", None, "standardize_boolean", True),
    (15, "Category Inconsistency", None, "standardize_categories", True), (16, "Special/Invisible Characters", None, "remove_special_chars", True),
    (17, "Outliers Detected (IQR)", None, "cap_outliers", True), (18, "Outliers Detected (IQR)", None, "remove_outliers", False),
]
_rules_sql = ", ".join(f"({i}, '{k}', {'NULL' if t is None else repr(t)}, '{a}', {str(e).lower()})" for i, k, t, a, e in _SUGGEST)
ORACLES["suggestions"] = (
    f"WITH {ISSUES}, hits AS (SELECT i.col, i.position, r.* FROM issues i LEFT JOIN typed t ON t.col = i.col JOIN (VALUES {_rules_sql}) AS r(rule, kind_of, kinds, action, enabled) "
    "ON r.kind_of = i.issue_type AND (r.kinds IS NULL OR list_contains(string_split(r.kinds, ','), t.kind)) "
    "UNION ALL SELECT col, position, 19, '', NULL, 'standardize_case', false FROM typed WHERE missing = 0 AND NOT is_empty AND kind IN ('string','categorical')) "
    "SELECT CAST(row_number() OVER (ORDER BY position, rule) AS INTEGER) AS step, col AS \"column\", action, enabled FROM hits"
)
ORACLES["outlier_counts"] = (
    f"WITH {EVIDENCE} SELECT col AS \"column\", CAST(outliers AS BIGINT) AS outliers FROM outs WHERE col IN ('rid','qty')"
)
_SCORED = "CAST(greatest(0, least(100, round_even({}, 0))) AS BIGINT)"
_LABEL = "CASE WHEN score >= 80 THEN 'Good' WHEN score >= 60 THEN 'Fair' WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END AS label"
_BASE = "100 - missing / (total * 10) * 40 - dup / total * 20"
ORACLES["quality_score"] = (
    f"WITH {EVIDENCE}, s AS (SELECT {_SCORED.format(_BASE + ' - (SELECT count(*) FROM seen WHERE uniq <= 1) * 5')} AS score FROM dups, cells) SELECT score, {_LABEL} FROM s"
)
_pen = " - (SELECT count(*) FROM issues WHERE severity = 'High') * 5 - (SELECT count(*) FROM issues WHERE severity = 'Medium') * 2"
ORACLES["quality_score_issues"] = f"WITH {ISSUES}, s AS (SELECT {_SCORED.format(_BASE + _pen)} AS score FROM dups, cells) SELECT score, {_LABEL} FROM s"

# ---- aggregation -------------------------------------------------------------------------------


def grouped(key: str, value: str, tail: str = "") -> str:
    return f"SELECT {key} AS key, {value} AS value FROM sales GROUP BY {key} {tail}"


def top(key: str, value: str, n: int, order: str = "DESC") -> str:
    """rank, key, value of the first n groups."""
    return (
        f"SELECT row_number() OVER (ORDER BY value {order}, key) AS rank, key, value FROM ({grouped(key, value)}) ORDER BY value {order}, key LIMIT {n}"
    )


def answer(key: str, value: str, n: int, order: str = "DESC", extra: str = "CAST(NULL AS DOUBLE)") -> str:
    return f"SELECT rank, key AS label, round(CAST(value AS DOUBLE), 2) AS value, {extra} AS extra FROM ({top(key, value, n, order)})"


_OF = {"sum": money(), "mean": f"round({mean()}, 4)", "count": "count(price)", "max": dbl("max(price)"), "min": dbl("min(price)")}
for _how, _v in _OF.items():
    ORACLES[f"group_{_how}"] = sales(grouped("city", _v, "ORDER BY value DESC, key LIMIT 15"))
ORACLES["global_totals"] = sales(
    f"SELECT {money()} AS total, round({mean()}, 4) AS mean, count(price) AS n, round(quantile_cont({dbl('price')}, 0.5), 4) AS median FROM sales"
)
ORACLES["distinct_counts"] = sales(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM sales" for c in ["order_id", "customer", "product", "city", "order_date"])
)
ORACLES["value_counts"] = sales(grouped("customer", "count(*)"))
ORACLES["argmax_group"] = sales(grouped("customer", money(), "ORDER BY value DESC, key LIMIT 1"))
ORACLES["argmin_group"] = sales(grouped("customer", money(), "ORDER BY value, key LIMIT 1"))
ORACLES["share_of_total"] = sales(
    f"SELECT customer AS key, {money()} AS value, round({money()} / (SELECT {money()} FROM sales) * 100, 4) AS share_pct FROM sales GROUP BY customer"
)
ORACLES["revenue_vs_quantity"] = sales(
    f"SELECT product AS key, {money()} AS value, {money('quantity')} AS second FROM sales GROUP BY product ORDER BY value DESC, key LIMIT 10"
)
ORACLES["treemap_rollup"] = sales(
    f"SELECT city AS \"outer\", product AS \"inner\", CAST(grouping(city, product) AS BIGINT) AS level, {money()} AS value FROM sales GROUP BY ROLLUP (city, product)"
)
ORACLES["pivot_heatmap"] = sales(
    f"SELECT r.k AS row_key, c.k AS column_key, coalesce(v, 0) AS value FROM "
    f"(SELECT city AS k FROM sales GROUP BY city ORDER BY {money()} DESC, city LIMIT 8) r CROSS JOIN "
    f"(SELECT product AS k FROM sales WHERE city IN (SELECT city FROM sales GROUP BY city ORDER BY {money()} DESC, city LIMIT 8) GROUP BY product ORDER BY {money()} DESC, product LIMIT 6) c "
    f"LEFT JOIN (SELECT city, product, {money()} AS v FROM sales GROUP BY city, product) s ON s.city = r.k AND s.product = c.k"
)


def box(source: str, by: str | None) -> str:
    """Box statistics of column x of a sub-select, optionally per column k."""
    k = "k" if by else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT category, round(max(q1), 2) AS q1, round(max(q2), 2) AS median, round(max(q3), 2) AS q3, count(*) AS n, "
        "round(min(x) FILTER (WHERE x BETWEEN lo AND hi), 2) AS whisker_low, round(max(x) FILTER (WHERE x BETWEEN lo AND hi), 2) AS whisker_high, "
        "count(*) FILTER (WHERE x < lo OR x > hi) AS outliers FROM ("
        f"SELECT s.x, q.*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM ({source}) s JOIN "
        f"(SELECT {k} AS category, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM ({source}) GROUP BY 1) q "
        f"ON {'s.k = q.category' if by else 'true'}) GROUP BY category"
    )


ORACLES["customer_spend_box"] = sales(
    f"SELECT * EXCLUDE (category) FROM ({box(f'SELECT {money()} AS x FROM sales GROUP BY customer', None)})"
)
_TOP5 = f"(SELECT sum(value) FROM (SELECT {dbl('sum(price)')} AS value FROM sales GROUP BY customer ORDER BY value DESC, customer LIMIT 5))"
ORACLES["top5_customer_share"] = sales(
    "SELECT round(CAST(sum(v) AS DOUBLE), 2) AS top_total, (SELECT round(CAST(sum(price) AS DOUBLE), 2) FROM sales) AS grand_total, "
    "round(CAST(sum(v) AS DOUBLE) / (SELECT CAST(sum(price) AS DOUBLE) FROM sales) * 100, 1) AS share_pct "
    "FROM (SELECT sum(price) AS v FROM sales GROUP BY customer ORDER BY v DESC, customer LIMIT 5)"
)

# ---- headline figures --------------------------------------------------------------------------


def kpis(where: str = "true") -> str:
    def best(key, part):
        return f"(SELECT {part} FROM (SELECT {key} AS key, {money()} AS value FROM s GROUP BY {key} ORDER BY value DESC, key LIMIT 1))"

    return (
        f"WITH {SALES}, s AS (SELECT * FROM sales WHERE {where}) SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns, 100.0::DOUBLE AS completeness_pct, "
        f"{money()} AS total_revenue, round({money()} / greatest(count(DISTINCT order_id), 1), 4) AS average_order_value, count(DISTINCT order_id) AS total_orders, "
        "count(DISTINCT customer) AS unique_customers, count(DISTINCT product) AS unique_products, count(DISTINCT city) AS unique_regions, "
        f"{best('city', 'key')} AS top_region, {best('city', 'value')} AS top_region_revenue, {best('product', 'key')} AS top_product, {best('product', 'value')} AS top_product_revenue, "
        "'price' AS sales_column, 'quantity' AS quantity_column, 'customer' AS customer_column, 'product' AS product_column, 'order_id' AS order_column, "
        "'city' AS region_column, 'order_date' AS date_column FROM s"
    )


ORACLES["kpis"] = kpis()
ORACLES["kpis_filtered"] = kpis(f"{_DATES} AND {_REGION}")

# ---- time --------------------------------------------------------------------------------------

MONTHS = (
    SALES
    + f""", made AS (SELECT last_day(CAST(order_date AS DATE)) AS month, {money()} AS revenue FROM sales WHERE order_date IS NOT NULL GROUP BY 1),
spine AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)), INTERVAL 1 MONTH)) AS DATE)) AS month FROM made),
series AS (SELECT month, coalesce(revenue, 0) AS revenue FROM spine LEFT JOIN made USING (month)),
flow AS (SELECT *, avg(revenue) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ma3, lag(revenue) OVER (ORDER BY month) AS prev,
         row_number() OVER (ORDER BY month) AS pos, row_number() OVER (ORDER BY month DESC) AS age FROM series)"""
)


def months(body: str) -> str:
    return f"WITH {MONTHS}\n{body}"


_DELTA = "coalesce(revenue - prev, 0)"
_DIRECTION = f"CASE WHEN {_DELTA} > 0 THEN 'up' ELSE 'down' END"
ORACLES["monthly_revenue"] = months("SELECT month, revenue FROM series")
ORACLES["monthly_text_dates"] = dirty(
    "SELECT m AS month, round(coalesce(made, 0), 2) AS revenue FROM (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)) AS DATE)) AS m "
    "FROM (SELECT TRY_CAST(order_date_txt AS DATE) AS d FROM dirty)) LEFT JOIN (SELECT last_day(TRY_CAST(order_date_txt AS DATE)) AS k, sum(qty) AS made FROM dirty GROUP BY 1) ON m = k"
)
ORACLES["monthly_ma3"] = ORACLES["chart_trend"] = months("SELECT month, round(revenue, 2) AS revenue, round(ma3, 2) AS ma3 FROM flow")
ORACLES["mom_growth"] = months("SELECT month, round((revenue - prev) / nullif(prev, 0) * 100, 4) AS mom_growth FROM flow WHERE prev IS NOT NULL AND prev <> 0")
ORACLES["latest_delta"] = months(f"SELECT month, round(revenue, 2) AS revenue, round({_DELTA}, 2) AS delta, {_DIRECTION} AS direction FROM flow WHERE age = 1")
ORACLES["last6_months"] = months("SELECT month, round(revenue, 2) AS revenue, strftime(month, '%b %Y') AS label FROM flow WHERE age <= 6")
ORACLES["peak_trough"] = months(
    "(SELECT 'peak' AS kind, month, round(revenue, 2) AS revenue FROM series ORDER BY series.revenue DESC, month LIMIT 1) "
    "UNION ALL (SELECT 'trough', month, round(revenue, 2) FROM series ORDER BY series.revenue, month LIMIT 1)"
)
_HALVES = (
    "SELECT city AS key, coalesce(CAST(sum(price) FILTER (WHERE early) AS DOUBLE), 0) AS first_half, coalesce(CAST(sum(price) FILTER (WHERE NOT early) AS DOUBLE), 0) AS second_half "
    "FROM (SELECT *, epoch_us(order_date) <= (SELECT quantile_cont(CAST(epoch_us(order_date) AS DOUBLE), 0.5) FROM sales) AS early FROM sales) "
    "GROUP BY city HAVING count(*) FILTER (WHERE early) > 0 AND count(*) FILTER (WHERE NOT early) > 0"
)
ORACLES["declining_region"] = sales(
    f"SELECT key, round(first_half, 2) AS first_half, round(second_half, 2) AS second_half, round(second_half - first_half, 2) AS value FROM ({_HALVES})"
)
_RECENT = "(SELECT avg(revenue) FROM flow WHERE age <= 3)"
_CHANGE = "(SELECT revenue - prev FROM flow WHERE age = 1)"
ORACLES["forecast_next_month"] = months(
    f"SELECT round({_RECENT}, 2) AS recent_mean, round({_CHANGE}, 2) AS change, round({_RECENT} + {_CHANGE} * 0.5, 2) AS forecast WHERE (SELECT count(*) FROM flow) >= 2"
)
ORACLES["insight_cards"] = months(
    f"SELECT 'total_revenue' AS card, CAST(NULL AS VARCHAR) AS label, {money()} AS value, CAST(count(*) AS DOUBLE) AS extra FROM sales "
    f"UNION ALL SELECT 'top_region', key, value, round(value / (SELECT {money()} FROM sales) * 100, 0) FROM ({top('city', money(), 1)}) "
    f"UNION ALL SELECT 'lowest_region', key, value, NULL FROM ({top('city', money(), 1, 'ASC')}) "
    f"UNION ALL SELECT 'best_product', key, value, NULL FROM ({top('product', money(), 1)}) "
    f"UNION ALL SELECT 'top_customer', key, value, NULL FROM ({top('customer', money(), 1)}) "
    f"UNION ALL SELECT 'total_units', NULL, {money('quantity')}, NULL FROM sales "
    f"UNION ALL SELECT 'latest_trend', {_DIRECTION}, round({_DELTA}, 2), NULL FROM flow WHERE age = 1"
)

# ---- statistics --------------------------------------------------------------------------------

MEASURES = ["quantity", "price", "discount"]
LONG = SALES + ", long AS (" + " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM sales" for i, c in enumerate(MEASURES)) + """), base AS (
  SELECT col, count(x) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, min(x) AS lo, max(x) AS hi,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, CASE WHEN stddev_samp(x) = 0 THEN 0 ELSE skewness(x) END AS skew FROM long GROUP BY col
), summ AS (
  SELECT base.*, (SELECT count(*) FROM long WHERE long.col = base.col AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS out FROM base
)"""
_R4 = ", ".join(f"round({e}, 4) AS \"{n}\"" for e, n in [("mean", "mean"), ("median", "median"), ("std", "std"), ("lo", "min"), ("hi", "max"), ("q1", "q1"), ("q3", "q3"), ("skew", "skew")])
_SKEW5 = (
    "CASE WHEN abs(skew) < 0.5 THEN 'approximately symmetric' WHEN skew > 1 THEN 'heavily right-skewed' WHEN skew > 0.5 THEN 'slightly right-skewed' "
    "WHEN skew < -1 THEN 'heavily left-skewed' ELSE 'slightly left-skewed' END"
)
ORACLES["distribution_metrics"] = f"WITH {LONG} SELECT col AS \"column\", n AS count, {_R4}, CASE WHEN q1 = q3 THEN 0 ELSE out END AS outliers FROM summ"
ORACLES["numeric_insight"] = (
    f"WITH {LONG} SELECT col AS \"column\", n AS count, {_R4}, round(q3 - q1, 4) AS iqr, {_SKEW5} AS skew_label, out AS outliers, round(std / nullif(mean, 0) * 100, 2) AS cv FROM summ"
)
_DEC = (
    "SELECT quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, "
    "quantile_cont(x, 0.9) AS p90, skewness(x) AS skew FROM (SELECT CAST(price AS DOUBLE) AS x FROM sales)"
)
_SKEW3 = "CASE WHEN skew > 0.5 THEN 'right-skewed' WHEN skew < -0.5 THEN 'left-skewed' ELSE 'approximately symmetric' END"
ORACLES["sales_distribution"] = sales(
    "SELECT " + ", ".join(f"round({c}, 4) AS {c}" for c in ["p10", "p25", "median", "p75", "p90", "skew"]) + f", {_SKEW3} AS skew_label FROM ({_DEC})"
)


def pairs(columns: list[str], spend: bool = False) -> str:
    source = "(SELECT *, quantity * 1000 + CAST(price AS DOUBLE) / 2 AS spend FROM sales)" if spend else "sales"
    out = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            out.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {source}")
    return " UNION ALL ".join(out)


_STRENGTH = "CASE WHEN abs(r) > 0.8 THEN 'very strong' WHEN abs(r) > 0.6 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END"
_SIGN = "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END"
_BAND = _STRENGTH.replace(" > ", " >= ")
_PAIRS3 = f"SELECT col_a, col_b, round(r, 3) AS r FROM ({pairs(MEASURES)})"
ORACLES["correlation_matrix"] = sales(
    f"WITH p AS ({_PAIRS3}) SELECT * FROM p UNION ALL SELECT col_b, col_a, r FROM p "
    + " ".join(f"UNION ALL SELECT '{c}', '{c}', 1.0::DOUBLE" for c in MEASURES)
).replace("\nWITH p AS", ", p AS", 1)
ORACLES["correlation_pairs"] = ORACLES["report_correlations"] = sales(f"SELECT *, {_STRENGTH} AS strength, {_SIGN} AS direction FROM ({_PAIRS3})")
_FOUR = ["quantity", "price", "discount", "spend"]
ORACLES["findings_correlation"] = sales(
    f"SELECT col_a, col_b, round(t.r, 2) AS r, {_BAND.replace('abs(r)', 'abs(t.r)')} AS strength, {_SIGN.replace('r >', 't.r >')} AS direction, abs(t.r) >= 0.6 AS redundant "
    f"FROM ({pairs(_FOUR, True)}) AS t WHERE abs(t.r) >= 0.2"
)
ORACLES["correlation_notable"] = sales(
    f"SELECT col_a, col_b, round(t.r, 2) AS r, {_BAND.replace('abs(r)', 'abs(t.r)')} AS strength, {_SIGN.replace('r >', 't.r >')} AS direction "
    f"FROM ({pairs(_FOUR, True)}) AS t WHERE abs(t.r) >= 0.2"
)


def hist(bins: int, by: str | None) -> str:
    key = f"{by} AS category, " if by else ""
    slots = f"(SELECT DISTINCT {by} AS category FROM sales) CROSS JOIN " if by else ""
    join = "USING (category, bin)" if by else "USING (bin)"
    out = "category, " if by else ""
    return (
        f"WITH {SALES}, e AS (SELECT min({dbl('price')}) AS lo, max({dbl('price')}) AS hi FROM sales), "
        f"b AS (SELECT {key}CAST(least(floor((CAST(price AS DOUBLE) - lo) * {bins} / (hi - lo)), {bins - 1}) AS BIGINT) AS bin, count(*) AS n FROM sales, e GROUP BY ALL) "
        f"SELECT {out}bin, round(lo + (hi - lo) / {bins} * bin, 4) AS low, round(lo + (hi - lo) / {bins} * (bin + 1), 4) AS high, coalesce(n, 0) AS n "
        f"FROM {slots}(SELECT unnest(range({bins})) AS bin) LEFT JOIN b {join}, e"
    )


ORACLES["histogram"] = hist(30, None)
ORACLES["histogram_by_category"] = hist(25, "category")
ORACLES["box_by_category"] = sales(box("SELECT region AS k, CAST(price AS DOUBLE) AS x FROM sales", "region"))
ORACLES["box_overall"] = sales(box("SELECT CAST(price AS DOUBLE) AS x FROM sales", None))
ORACLES["normalised_long"] = (
    f"WITH {LONG} SELECT col AS \"column\", n, " + ", ".join(f"round(({c} - lo) / (hi - lo + 1e-9), 4) AS {c}" for c in ["q1", "median", "q3", "mean"]) + " FROM summ"
)
ORACLES["scatter_sample"] = sales(
    "SELECT rid, quantity, price, region FROM sales ORDER BY md5(concat(CAST(rid AS VARCHAR), '42')), rid LIMIT 10000"
)

# ---- named answers -----------------------------------------------------------------------------

NULLD = "CAST(NULL AS DOUBLE)"


def single(label: str, value: str, extra: str = NULLD) -> str:
    return f"SELECT CAST(1 AS BIGINT) AS rank, '{label}' AS label, round(CAST({value} AS DOUBLE), 2) AS value, {extra} AS extra FROM sales"


_SHARE5 = f"round(value / (SELECT {money()} FROM sales) * 100, 1)"
_PCTL = (
    f"SELECT customer, {money()} AS value, row_number() OVER (ORDER BY {money()} DESC, customer) AS pos FROM sales GROUP BY customer"
)


def percentile(pct: float) -> str:
    n = f"greatest(1, CAST(floor((SELECT count(DISTINCT customer) FROM sales) * {pct} / 100) AS BIGINT))"
    return (
        f"SELECT CAST(0 AS BIGINT) AS rank, 'share' AS label, round(sum(value) FILTER (WHERE pos <= {n}) / sum(value) * 100, 2) AS value, CAST({n} AS DOUBLE) AS extra FROM ({_PCTL}) "
        f"UNION ALL SELECT pos, customer, round(value, 2), {NULLD} FROM ({_PCTL}) WHERE pos <= least({n}, 5)"
    )


_MONTH6 = (
    "SELECT 7 - age AS rank, strftime(month, '%b %Y') AS label, round(revenue, 2) AS value, CAST(NULL AS DOUBLE) AS extra FROM flow WHERE age <= 6 "
    f"UNION ALL SELECT 7, {_DIRECTION}, round({_DELTA}, 2), NULL FROM flow WHERE age = 1"
)
_DIST = (
    f"SELECT CAST(rank AS BIGINT) AS rank, label, round(value, 2) AS value, {NULLD} AS extra FROM (WITH d AS ({_DEC}) "
    + " UNION ALL ".join(f"SELECT {i} AS rank, '{c}' AS label, {c} AS value FROM d" for i, c in enumerate(["p10", "p25", "median", "p75", "p90"], 1))
    + f" UNION ALL SELECT 6, {_SKEW3}, skew FROM d)"
)
_CORR5 = (
    f"SELECT row_number() OVER (ORDER BY abs(r) DESC, col_a, col_b) AS rank, concat(col_a, ' ~ ', col_b, ' ', {_STRENGTH}, ' ', {_SIGN}) AS label, r AS value, {NULLD} AS extra FROM ({_PAIRS3})"
)
_FORECAST = (
    f"SELECT CAST(1 AS BIGINT) AS rank, 'recent_mean' AS label, round({_RECENT}, 2) AS value, {NULLD} AS extra UNION ALL SELECT 2, 'change', round({_CHANGE}, 2), NULL "
    f"UNION ALL SELECT 3, 'forecast', round({_RECENT} + {_CHANGE} * 0.5, 2), NULL"
)
# Tables per intent; %N% stands for the number of places asked for.
ANSWERS = {
    "total_revenue": single("total", "sum(price)"),
    "average_price": single("mean", mean()),
    "highest_sales_city": answer("city", money(), 1),
    "lowest_sales_city": answer("city", money(), 1, "ASC"),
    "highest_selling_product": answer("product", money(), 1),
    "sales_by_city": f"SELECT CAST(NULL AS BIGINT) AS rank, key AS label, value, {NULLD} AS extra FROM ({grouped('city', money())})",
    "revenue_by_product": answer("product", money(), 5),
    "total_quantity_sold": single("total", "sum(quantity)"),
    "average_order_value": single("mean", mean()),
    "top_n_customers": answer("customer", money(), 5),
    "correlation": _CORR5,
    "sales_trend": _MONTH6,
    "declining_region": f"SELECT CAST(1 AS BIGINT) AS rank, key AS label, round(second_half - first_half, 2) AS value, {NULLD} AS extra FROM ({_HALVES}) ORDER BY second_half - first_half, key LIMIT 1",
    "most_frequent_product": answer("product", "count(*)", 5),
    "unique_customer_count": single("distinct", "count(DISTINCT customer)", "CAST(count(*) AS DOUBLE)"),
    "top_percentile_customers": percentile(5),
    "revenue_share_category": answer("product", money(), 5, extra=_SHARE5),
    "sales_distribution": _DIST,
    "top_categories": answer("product", money(), 5),
    "forecast_next_month": _FORECAST,
}
_KEYS = {
    "total_revenue": "q_total_revenue", "average_price": "q_average_price", "highest_sales_city": "q_highest_city", "lowest_sales_city": "q_lowest_city",
    "highest_selling_product": "q_highest_product", "sales_by_city": "q_sales_by_city", "revenue_by_product": "q_revenue_by_product",
    "total_quantity_sold": "q_total_quantity", "average_order_value": "q_average_order_value", "top_n_customers": "q_top_n_customers",
    "correlation": "q_correlation", "sales_trend": "q_sales_trend", "declining_region": "q_declining_region", "most_frequent_product": "q_most_frequent_product",
    "unique_customer_count": "q_unique_customers", "top_percentile_customers": "q_top_percentile", "revenue_share_category": "q_revenue_share",
    "sales_distribution": "q_sales_distribution", "top_categories": "q_top_categories", "forecast_next_month": "q_forecast",
}
for _intent, _key in _KEYS.items():
    ORACLES[_key] = months(ANSWERS[_intent])

# ---- chart data --------------------------------------------------------------------------------

ORACLES["chart_top_customers"] = sales(top("customer", money(), 10))
ORACLES["chart_bottom_customers"] = sales(top("customer", money(), 10, "ASC"))
ORACLES["chart_top_products"] = sales(top("product", money(), 10))
ORACLES["chart_bottom_regions"] = sales(top("city", money(), 10, "ASC"))
ORACLES["chart_pie_share"] = sales(f"SELECT *, round(value / sum(value) OVER () * 100, 1) AS share_pct FROM ({top('product', money(), 8)})")
ORACLES["chart_avg_bar"] = sales(f"SELECT rank, key, round(value, 2) AS value FROM ({top('city', mean(), 15)})")
ORACLES["chart_customer_freq"] = sales(top("customer", "count(*)", 15))
ORACLES["chart_funnel"] = sales(f"SELECT *, round(value / max(value) OVER () * 100, 1) AS pct_of_first FROM ({top('city', money(), 8)})")
ORACLES["chart_region_share"] = sales(f"SELECT *, round(value / sum(value) OVER () * 100, 1) AS share_pct FROM ({grouped('city', money())})")
ORACLES["chart_product_freq"] = sales(f"SELECT *, round(value / sum(value) OVER () * 100, 1) AS share_pct FROM ({top('product', 'count(*)', 10)})")

# ---- findings ----------------------------------------------------------------------------------

_TEXT = [c for c in COLUMNS if c not in RAW_TYPES]
CATS = (
    DIRTY + ", labels AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, trim({c}) AS v FROM dirty WHERE {c} IS NOT NULL" for c in _TEXT)
    + """), cnt AS (SELECT col, v, count(*) AS n, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, v) AS pos FROM labels GROUP BY col, v),
cats AS (SELECT col, count(*) AS uniq, CAST(sum(n) AS BIGINT) AS total, max(v) FILTER (WHERE pos = 1) AS top_value, round(max(n) / sum(n) * 100, 1) AS top_pct,
         string_agg(concat(v, '=', n), '; ' ORDER BY pos) FILTER (WHERE pos <= 10) AS top_10 FROM cnt GROUP BY col),
comp AS (SELECT count(*) AS total, round((1 - ("""
    + " + ".join(f"(count(*) - count({c}))" for c in COLUMNS)
    + ") / (count(*) * 10)) * 100, 1) AS pct FROM dirty)"
)
_CONC = (
    "CASE WHEN uniq / total > 0.9 THEN 'highly unique' WHEN top_pct > 60 THEN 'dominated by one category' "
    "WHEN top_pct > 30 THEN 'moderately concentrated' ELSE 'well distributed' END"
)
QTY = ", qs AS (SELECT count(qty) AS n, avg(qty) AS mean, stddev_samp(qty) AS std, min(qty) AS lo, skewness(qty) AS skew FROM dirty), qo AS (SELECT count(*) AS out FROM dirty, " + _FENCE.format("dirty") + " WHERE qty < lo OR qty > hi)"
ORACLES["categorical_insight"] = f"WITH {CATS} SELECT col AS \"column\", uniq AS unique_count, total, top_value, top_pct, top_10, {_CONC} AS concentration FROM cats"
ORACLES["top_values"] = f"WITH {CATS} SELECT col AS \"column\", pos AS rank, v AS value, n FROM cnt WHERE pos <= 5"
ORACLES["dataset_summary"] = f"WITH {CATS} SELECT total AS rows, CAST(10 AS BIGINT) AS cols, CAST(2 AS BIGINT) AS numeric_count, CAST(8 AS BIGINT) AS categorical_count, pct AS completeness_pct FROM comp"
ORACLES["completeness_band"] = f"WITH {CATS} SELECT pct AS completeness_pct, CASE WHEN pct >= 98 THEN 'excellent' WHEN pct >= 90 THEN 'good' WHEN pct >= 75 THEN 'moderate' ELSE 'low' END AS band FROM comp"
ORACLES["findings_numeric"] = (
    f"WITH {LONG} SELECT col AS \"column\", round(lo, 4) AS \"min\", round(hi, 4) AS \"max\", round(mean, 4) AS mean, round(median, 4) AS median, {_SKEW5} AS skew_label, out AS outliers, "
    "round(std / nullif(mean, 0) * 100, 2) AS cv, out > 0 AS has_outliers, round(std / mean * 100, 2) > 100 AS high_variability, round(std / mean * 100, 2) < 15 AS low_variability, "
    "abs(mean - median) / greatest(abs(median), 1) > 0.2 AS mean_median_apart FROM summ"
)
ORACLES["findings_categorical"] = (
    f"WITH {CATS} SELECT col AS \"column\", uniq AS unique_count, {_CONC} AS concentration, top_value, top_pct, top_pct > 80 AS imbalance, (NOT top_pct > 80 AND uniq > 50) AS high_cardinality FROM cats"
)
_FOUND = (
    "SELECT 'many outliers' AS finding, 'qty' AS subject, round(out / n * 100, 1) AS value FROM qs, qo WHERE round(out / n * 100, 1) > 10 "
    "UNION ALL SELECT 'no variance', 'qty', std FROM qs WHERE std = 0 "
    "UNION ALL SELECT 'almost one value', col, top_pct FROM cats WHERE top_pct > 95 AND uniq > 1 "
    "UNION ALL SELECT 'low completeness', '(dataset)', pct FROM comp WHERE pct < 80"
)
ORACLES["findings_anomalies"] = (
    f"WITH {CATS}{QTY}, found AS ({_FOUND}) SELECT * FROM found UNION ALL SELECT 'none', NULL, NULL WHERE (SELECT count(*) FROM found) = 0"
)
ORACLES["findings_recommendations"] = (
    f"WITH {CATS}{QTY} SELECT 'investigate outliers' AS finding, 'qty' AS subject, CAST(out AS DOUBLE) AS value FROM qo WHERE out > 0 "
    "UNION ALL SELECT 'transform skewed column', 'qty', round(skew, 4) FROM qs WHERE abs(skew) > 1 "
    "UNION ALL SELECT 'group many categories', col, CAST(uniq AS DOUBLE) FROM cats WHERE uniq > 50 "
    "UNION ALL SELECT 'review missing values', '(dataset)', pct FROM comp WHERE pct < 95"
)

# ---- report ------------------------------------------------------------------------------------

ORACLES["report_summary"] = sales(
    "SELECT 'total_rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM sales UNION ALL SELECT 'total_columns', 11.0 UNION ALL SELECT 'completeness_pct', 100.0 "
    f"UNION ALL SELECT 'total_revenue', {money()} FROM sales UNION ALL SELECT 'total_orders', CAST(count(DISTINCT order_id) AS DOUBLE) FROM sales "
    f"UNION ALL SELECT 'average_order_value', round({money()} / count(DISTINCT order_id), 2) FROM sales "
    "UNION ALL SELECT 'unique_customers', CAST(count(DISTINCT customer) AS DOUBLE) FROM sales UNION ALL SELECT 'unique_products', CAST(count(DISTINCT product) AS DOUBLE) FROM sales "
    "UNION ALL SELECT 'unique_regions', CAST(count(DISTINCT city) AS DOUBLE) FROM sales"
)


def part(name: str, body: str) -> str:
    return f"SELECT '{name}' AS part, rank, label, CAST(value AS DOUBLE) AS value, CAST(extra AS DOUBLE) AS extra FROM ({body})"


def figure(label: str, value: str) -> str:
    return part("figures", f"SELECT CAST(NULL AS BIGINT) AS rank, '{label}' AS label, round(CAST({value} AS DOUBLE), 2) AS value, {NULLD} AS extra FROM sales")


ORACLES["report_revenue"] = sales(
    " UNION ALL ".join(
        [
            figure("total", "sum(price)"), figure("mean", mean()), figure("median", f"quantile_cont({dbl('price')}, 0.5)"),
            part("top region", answer("city", money(), 1, extra=_SHARE5)), part("regions", answer("city", money(), 5)), part("products", answer("product", money(), 5)),
        ]
    )
)
ORACLES["report_customers"] = sales(
    " UNION ALL ".join(
        [
            figure("unique customers", "count(DISTINCT customer)"),
            part("figures", f"SELECT CAST(NULL AS BIGINT) AS rank, 'top 5 share' AS label, round({_TOP5} / {money()} * 100, 1) AS value, {NULLD} AS extra FROM sales"),
            part("customers", answer("customer", money(), 5)),
        ]
    )
)
ORACLES["report_products"] = sales(
    " UNION ALL ".join([figure("unique products", "count(DISTINCT product)"), part("most frequent", answer("product", "count(*)", 1)), part("units", answer("product", money("quantity"), 5))])
)
ORACLES["report_regions"] = sales(
    " UNION ALL ".join(
        [part("top", answer("city", money(), 3, extra=_SHARE5.replace("100, 1", "100, 0"))), part("lowest", answer("city", money(), 1, "ASC")), part("regions", answer("city", money(), 15, extra=_SHARE5))]
    )
)
_EDGE = "(SELECT '{0}' AS part, CAST(NULL AS BIGINT) AS rank, strftime(month, '%B %Y') AS label, round(revenue, 2) AS value, CAST(NULL AS DOUBLE) AS extra FROM series ORDER BY revenue {1}, month LIMIT 1)"
ORACLES["report_trends"] = months(
    f"{_EDGE.format('peak', 'DESC')} UNION ALL {_EDGE.format('trough', 'ASC')} "
    f"UNION ALL SELECT 'change', NULL, {_DIRECTION}, round({_DELTA}, 2), NULL FROM flow WHERE age = 1 AND pos > 1 "
    "UNION ALL SELECT 'months', pos, strftime(month, '%b %Y'), round(revenue, 2), NULL FROM flow WHERE pos <= 14"
)
ORACLES["report_recommendations"] = sales(
    f"SELECT 'prioritise region' AS advice, key AS subject, round(value / (SELECT {money()} FROM sales) * 100, 0) AS value FROM ({top('city', money(), 1)}) "
    f"UNION ALL SELECT 'investigate region', key, value FROM ({top('city', money(), 1, 'ASC')}) "
    f"UNION ALL SELECT 'protect supply', key, value FROM ({top('product', money(), 1)}) "
    f"UNION ALL SELECT 'retain top customers', 'top 5', s FROM (SELECT round({_TOP5} / {money()} * 100, 1) AS s FROM sales) WHERE s > 20"
)

# ---- questions ---------------------------------------------------------------------------------


def norm(x: str) -> str:
    stripped = f"regexp_replace(lower({x}), '^\\s+|\\s+$', '', 'g')"
    return f"regexp_replace(regexp_replace({stripped}, '[^\\p{{L}}\\p{{N}}_\\s%]', ' ', 'g'), '\\s+', ' ', 'g')"


NUMBER_WORDS = "one two three four five six seven eight nine ten".split()


def top_number(default: int) -> str:
    by_word = " ".join(f"WHEN contains(q, 'top {w}') THEN {i}" for i, w in enumerate(NUMBER_WORDS, 1))
    return f"coalesce(TRY_CAST(regexp_extract(q, 'top\\s+([0-9]+)', 1) AS BIGINT), CASE {by_word} END, {default})"


TOP_PCT = "coalesce(TRY_CAST(nullif(regexp_extract(q, 'top\\s+([0-9]+)\\s*%', 1), '') AS DOUBLE), 5.0::DOUBLE)"
_LEAD = "CASE conv_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Top 3 customers? ' WHEN 2 THEN 'total revenue: ' WHEN 3 THEN 'Top 10% elite. ' WHEN 4 THEN 'How many units sold? ' ELSE 'Lowest city! ' END"
ORACLES["question_normalise"] = f"SELECT conv_id, turn, {norm('text')} AS q FROM conversations"
ORACLES["question_intent"] = f"SELECT conv_id, turn, {answer_label()} AS intent FROM (SELECT *, {norm('text')} AS q FROM conversations)"
ORACLES["question_chart_intent"] = (
    f"SELECT conv_id, turn, {chart_label()} AS intent, {from_the_bottom()} AS ascending FROM (SELECT *, {norm('text')} AS q FROM conversations)"
)
_TOPQ = norm("concat('Top ', turn, '% of: ', text)")
ORACLES["question_params"] = f"SELECT conv_id, turn, {top_number(5)} AS n, {TOP_PCT} AS pct FROM (SELECT *, {_TOPQ} AS q FROM conversations)"

_TAGGED = (
    f"asked AS (SELECT conv_id * 1000 + turn AS id, {norm(f'concat({_LEAD}, text)')} AS q FROM conversations), "
    f"tags AS (SELECT id, {answer_label()} AS intent, {top_number(5)} AS n, {TOP_PCT} AS pct FROM asked)"
)
_parts = []
for _intent, _sql in ANSWERS.items():
    if _intent in ("top_n_customers", "top_percentile_customers", "top_categories"):
        continue
    _parts.append(f"SELECT '{_intent}' AS intent, rank, label, value, extra FROM ({_sql})")
_CUST_ALL = f"SELECT row_number() OVER (ORDER BY value DESC, key) AS rank, key AS label, round(value, 2) AS value FROM ({grouped('customer', money())})"
ORACLES["answer_questions"] = months(
    f"SELECT t.id, t.intent, 'answered' AS status, a.rank, a.label, a.value, a.extra FROM tags t JOIN answers a USING (intent) "
    f"UNION ALL SELECT t.id, t.intent, 'answered', a.rank, a.label, a.value, {NULLD} FROM tags t JOIN customers a ON t.intent = 'top_n_customers' AND a.rank <= t.n "
    "UNION ALL SELECT t.id, t.intent, 'answered', 0, 'share', s.share, CAST(s.n AS DOUBLE) FROM tags t JOIN shares s ON t.intent = 'top_percentile_customers' AND s.pct = t.pct "
    f"UNION ALL SELECT t.id, t.intent, 'answered', a.rank, a.label, a.value, {NULLD} FROM tags t JOIN shares s ON t.intent = 'top_percentile_customers' AND s.pct = t.pct JOIN customers a ON a.rank <= least(s.n, 5) "
    "UNION ALL SELECT id, intent, CASE intent WHEN 'empty' THEN 'no question' ELSE 'not understood' END, NULL, NULL, NULL, NULL FROM tags WHERE intent IN ('empty', 'unknown')"
).replace(
    "\nSELECT t.id",
    f", {_TAGGED}, answers AS ({' UNION ALL '.join(_parts)}), customers AS ({_CUST_ALL}), spend AS ({_PCTL}), "
    "sizes AS (SELECT pct, greatest(1, CAST(floor((SELECT count(*) FROM spend) * pct / 100) AS BIGINT)) AS n FROM (SELECT DISTINCT pct FROM tags)), "
    "shares AS (SELECT pct, n, round((SELECT sum(value) FROM spend WHERE pos <= n) / (SELECT sum(value) FROM spend) * 100, 2) AS share FROM sizes)\nSELECT t.id",
    1,
)



def _every(key: str, value: str, order: str) -> str:
    """All groups with their rank, as label and value."""
    return f"SELECT row_number() OVER (ORDER BY value {order}, key) AS rank, key AS label, round(CAST(value AS DOUBLE), 2) AS value FROM ({grouped(key, value)})"


def _chart(intent: str, body: str, param: int = -1) -> str:
    return f"SELECT '{intent}' AS intent, {param} AS param, CAST(rank AS BIGINT) AS rank, label, CAST(value AS DOUBLE) AS value, CAST(extra AS DOUBLE) AS extra FROM ({body})"


_EDGES = f"SELECT min({dbl('price')}) AS lo, max({dbl('price')}) AS hi FROM sales"
_CHARTS = [
    _chart("trend", "SELECT pos AS rank, CAST(month AS VARCHAR) AS label, round(revenue, 2) AS value, round(ma3, 2) AS extra FROM flow"),
    _chart("pie", f"SELECT rank, key AS label, round(value, 2) AS value, round(value / sum(value) OVER () * 100, 1) AS extra FROM ({top('product', money(), 8)})"),
    _chart(
        "histogram",
        f"SELECT bin + 1 AS rank, format('{{:,.2f}}', lo + (hi - lo) / 30 * bin) AS label, coalesce(n, 0) AS value, round(lo + (hi - lo) / 30 * (bin + 1), 2) AS extra "
        f"FROM (SELECT unnest(range(30)) AS bin) CROSS JOIN ({_EDGES}) LEFT JOIN (SELECT CAST(least(floor((CAST(price AS DOUBLE) - lo) * 30 / (hi - lo)), 29) AS BIGINT) AS bin, count(*) AS n FROM sales CROSS JOIN ({_EDGES}) GROUP BY 1) USING (bin)",
    ),
    _chart("correlation", f"SELECT NULL AS rank, concat(col_a, ' ~ ', col_b) AS label, round(r, 2) AS value, NULL AS extra FROM (SELECT * FROM ({_PAIRS3}) UNION ALL SELECT col_b, col_a, r FROM ({_PAIRS3}) " + " ".join(f"UNION ALL SELECT '{c}', '{c}', 1.0" for c in MEASURES) + ")"),
    _chart("avg_bar", f"SELECT rank, key AS label, round(value, 2) AS value, NULL AS extra FROM ({top('city', mean(), 15)})"),
    _chart("customer_freq", f"SELECT rank, key AS label, value, NULL AS extra FROM ({top('customer', 'count(*)', 15)})"),
]
_SPENDS = f"SELECT CAST(price AS DOUBLE) AS x FROM sales"
_CHARTS += [
    _chart("box", f"SELECT {i} AS rank, CAST(NULL AS VARCHAR) AS label, {name} AS value, outliers AS extra FROM ({box(_SPENDS, None)})")
    for i, name in enumerate(["whisker_low", "q1", "median", "q3", "whisker_high"], 1)
]
for _intent, _key in {"top_customers": "customer", "top_products": "product", "top_regions": "city"}.items():
    for _param, _order in enumerate(["DESC", "ASC"]):
        _CHARTS.append(_chart(_intent, f"SELECT rank, label, value, NULL AS extra FROM ({_every(_key, money(), _order)})", _param))
# Questions for scatter charts do not occur in the conversations; the unit tests have them.
ORACLES["chart_questions"] = months(
    "SELECT t.id, t.intent, CASE t.intent WHEN 'empty' THEN 'no question' WHEN 'unknown' THEN 'not understood' WHEN 'box' THEN "
    "CASE WHEN (SELECT count(DISTINCT city) FROM sales) > 20 THEN 'charted, one box for more than 20 values' ELSE 'charted' END ELSE 'charted' END AS status, "
    "c.rank, c.label, c.value, c.extra FROM chart_tags t LEFT JOIN chart_rows c ON t.intent = c.intent AND t.param = c.param AND (NOT starts_with(t.intent, 'top_') OR c.rank <= t.n)"
).replace(
    "\nSELECT t.id",
    f", asked AS (SELECT conv_id * 1000 + turn AS id, {norm(f'concat({_LEAD}, text)')} AS q FROM conversations), "
    f"labels AS (SELECT id, {chart_label()} AS intent, {from_the_bottom()} AS low, {top_number(10)} AS n FROM asked), "
    f"chart_tags AS (SELECT id, intent, n, CASE WHEN NOT starts_with(intent, 'top_') THEN -1 WHEN low THEN 1 ELSE 0 END AS param FROM labels), "
    f"chart_rows AS ({' UNION ALL '.join(_CHARTS)})\nSELECT t.id",
    1,
)

_SCALED = "c_acctbal * pow(10.0, c_custkey % 5)"
ORACLES["human_number"] = (
    f"SELECT c_custkey, CASE WHEN abs(x) >= 1000000 THEN concat(CAST(CAST(round(x / 1000000, 2) AS DECIMAL(30,2)) AS VARCHAR), 'M') "
    "WHEN abs(x) >= 1000 THEN concat(CAST(CAST(round(x / 1000, 1) AS DECIMAL(30,1)) AS VARCHAR), 'K') ELSE format('{:,.2f}', round(x, 2)) END AS short, "
    "CASE WHEN c_acctbal = floor(c_acctbal) AND abs(c_acctbal) < 1e12 THEN format('{:,.0f}', c_acctbal) ELSE format('{:,.2f}', round(c_acctbal, 2)) END AS plain "
    f"FROM (SELECT *, {_SCALED} AS x FROM customer)"
)
