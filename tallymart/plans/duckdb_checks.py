"""The same results in SQL for DuckDB, as a check of the plans.

The rule patterns, labels and category texts are imported from the code, so a wrong value there is wrong
in both; ``tests/test_categorize.py`` holds the rules against written-out labels.

Amounts are added as decimals, so a sum does not depend on the order of addition, and become doubles by
their decimal text, which rounds correctly.
"""

from __future__ import annotations

from tallymart.operators.categorize import LIQUOR_RULES, UNCATEGORIZED
from tallymart.operators.features import FEATURE_LABELS, FEATURES
from tallymart.sources.star import CATEGORY_OF_BRAND


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _exact(amount: str) -> str:
    return f"CAST({amount} AS DECIMAL(28,7))"


def _double(amount: str) -> str:
    return f"CAST(CAST({amount} AS VARCHAR) AS DOUBLE)"


def _sum(amount: str) -> str:
    return _double(f"sum({_exact(amount)})")


def _cents(expression: str) -> str:
    return f"CAST(round({expression}, 2) AS DOUBLE)"


def _case(column: str, values: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in values.items())
    return f"CASE {column} {whens} ELSE {otherwise} END"


_CATEGORY_NAME = _case("p_brand", CATEGORY_OF_BRAND, "NULL")

_MAJOR_CATEGORY = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches(category_name, '(?i){rule.words}') THEN {_quoted(rule.label)}"
        for rule in LIQUOR_RULES
    )
    + f" ELSE {_quoted(UNCATEGORIZED)} END"
)


def _sales_cte(store: str = "supplier") -> str:
    if store == "supplier":
        store_join = "LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey"
        name, number, nation = "s_name", "s_suppkey", "s_nationkey"
    else:
        store_join = "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
        name, number, nation = "c_name", "c_custkey", "c_nationkey"
    return f"""sales AS (
  SELECT l_orderkey || '-' || l_linenumber AS invoice_item,
         CAST(o_orderdate AS DATE) AS sale_date,
         strftime(o_orderdate, '%m/%d/%Y') AS date_text,
         CAST({number} AS VARCHAR) AS store_number,
         {name} AS store_name, n_name AS city,
         CAST(50000 + {nation} AS VARCHAR) AS zip_code,
         nullif(l_returnflag, 'R') AS store_location,
         CAST(r_regionkey AS VARCHAR) AS county_number, r_name AS county,
         substr(p_brand, 7) AS category,
         {_CATEGORY_NAME} AS category_name,
         p_type AS vendor_name, p_name AS item_description,
         CAST(l_quantity AS SMALLINT) AS bottles_sold,
         l_extendedprice AS sale_dollars,
         l_quantity * p_size / 10 AS volume_liters,
         l_quantity * p_size / 10 * CAST('0.264172' AS DOUBLE) AS volume_gallons,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
         CAST(isodow(o_orderdate) AS INTEGER) AS weekday,
         isodow(o_orderdate) >= 5 AS is_weekend
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  {store_join}
  LEFT JOIN region ON n_regionkey = r_regionkey)"""


_PANEL = f"""panel AS MATERIALIZED (
  SELECT store_name, city, county, year, month,
         {_sum('sale_dollars')} AS monthly_revenue,
         {_sum('sale_dollars')} / count(sale_dollars) AS avg_transaction_value,
         CAST(count(DISTINCT invoice_item) AS BIGINT) AS num_transactions,
         CAST(count(DISTINCT item_description) AS BIGINT) AS unique_skus,
         CAST(sum(bottles_sold) AS BIGINT) AS total_bottles,
         {_sum('volume_liters')} AS total_liters
  FROM sales GROUP BY store_name, city, county, year, month)"""

_FEATURES = f"""lagged AS (
  SELECT *, row_number() OVER w AS rn,
         lag(monthly_revenue, 1) OVER w AS revenue_lag1,
         lag(monthly_revenue, 2) OVER w AS revenue_lag2,
         lag(monthly_revenue, 3) OVER w AS revenue_lag3,
         sum({_exact('monthly_revenue')}) OVER w - {_exact('monthly_revenue')} AS revenue_before,
         lag(num_transactions, 1) OVER w AS txn_lag1,
         lag(unique_skus, 1) OVER w AS skus_lag1,
         month AS month_of_year
  FROM panel
  WINDOW w AS (PARTITION BY store_name ORDER BY year, month, city, county)),
features AS MATERIALIZED (
  SELECT store_name, city, county, year, month, monthly_revenue, avg_transaction_value,
         num_transactions, unique_skus, total_bottles, total_liters,
         revenue_lag1, revenue_lag2, revenue_lag3,
         {_double(' + '.join(_exact(f'revenue_lag{n}') for n in (1, 2, 3)))} / 3 AS revenue_rolling3,
         (revenue_lag1 - revenue_lag2) / nullif(revenue_lag2 + 1e-9, 0) AS mom_growth_rate,
         {_double('revenue_before')} / (rn - 1) AS store_avg_revenue,
         txn_lag1, skus_lag1, month_of_year
  FROM lagged
  WHERE revenue_lag1 IS NOT NULL AND revenue_lag2 IS NOT NULL AND revenue_lag3 IS NOT NULL)"""

_CALENDAR_FEATURES = f"""numbered AS (
  SELECT *, year * 12 + month AS month_number FROM panel),
per_month AS (
  SELECT store_name, month_number, sum({_exact('monthly_revenue')}) AS revenue,
         CAST(sum(num_transactions) AS BIGINT) AS transactions, CAST(sum(unique_skus) AS BIGINT) AS skus
  FROM numbered GROUP BY store_name, month_number),
features AS (
  SELECT p.* EXCLUDE (month_number), {_double('a.revenue')} AS revenue_lag1, {_double('b.revenue')} AS revenue_lag2,
         {_double('c.revenue')} AS revenue_lag3,
         {_double('a.revenue + b.revenue + c.revenue')} / 3 AS revenue_rolling3,
         ({_double('a.revenue')} - {_double('b.revenue')}) / nullif({_double('b.revenue')} + 1e-9, 0) AS mom_growth_rate,
         (SELECT {_sum('e.monthly_revenue')} / count(*) FROM numbered e
          WHERE e.store_name = p.store_name AND e.month_number < p.month_number) AS store_avg_revenue,
         a.transactions AS txn_lag1, a.skus AS skus_lag1, p.month AS month_of_year
  FROM numbered p
  JOIN per_month a ON a.store_name = p.store_name AND a.month_number = p.month_number - 1
  JOIN per_month b ON b.store_name = p.store_name AND b.month_number = p.month_number - 2
  JOIN per_month c ON c.store_name = p.store_name AND c.month_number = p.month_number - 3)"""

_COHORT = """thresholds AS (
  SELECT year, month, quantile_disc(monthly_revenue, 0.75) AS q75 FROM features GROUP BY year, month),
labelled AS MATERIALIZED (
  SELECT f.*, q75, CAST(monthly_revenue >= q75 AS INTEGER) AS is_top_quartile
  FROM features f JOIN thresholds t ON f.year = t.year AND f.month = t.month),
cohort AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, lag(is_top_quartile) OVER (
             PARTITION BY store_name ORDER BY year, month, city, county) AS was_top_quartile_last_month
    FROM labelled)
  WHERE was_top_quartile_last_month = 0)"""

_SPLIT = """periods AS (
  SELECT DISTINCT year, month FROM cohort ORDER BY year DESC, month DESC LIMIT 3),
cutoff AS (SELECT min(year * 12 + month) AS first_index FROM periods),
split_rows AS MATERIALIZED (
  SELECT cohort.*,
         CASE WHEN year * 12 + month < (SELECT first_index FROM cutoff) THEN 'train' ELSE 'test' END
           AS split
  FROM cohort)"""

_RULE = """rolling AS (
  SELECT year, month, quantile_disc(revenue_rolling3, 0.75) AS rolling_q75
  FROM cohort GROUP BY year, month),
scored AS MATERIALIZED (
  SELECT c.*, CAST(revenue_rolling3 >= rolling_q75 AS INTEGER) AS prediction
  FROM cohort c JOIN rolling r ON c.year = r.year AND c.month = r.month),
cells AS (
  SELECT CAST(count(*) FILTER (is_top_quartile = 0 AND prediction = 0) AS DOUBLE) AS tn,
         CAST(count(*) FILTER (is_top_quartile = 0 AND prediction = 1) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (is_top_quartile = 1 AND prediction = 0) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (is_top_quartile = 1 AND prediction = 1) AS DOUBLE) AS tp
  FROM scored)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_ON_SALES = _with(_sales_cte())
_ON_PANEL = _with(_sales_cte(), _PANEL)
_ON_FEATURES = _with(_sales_cte(), _PANEL, _FEATURES)
_ON_COHORT = _with(_sales_cte(), _PANEL, _FEATURES, _COHORT)
_ON_SPLIT = _with(_sales_cte(), _PANEL, _FEATURES, _COHORT, _SPLIT)
_ON_RULE = _with(_sales_cte(), _PANEL, _FEATURES, _COHORT, _RULE)

_PANEL_COLUMNS = f"""store_name, city, county, year, month,
  {_cents('monthly_revenue')} AS monthly_revenue,
  avg_transaction_value, num_transactions, unique_skus, total_bottles, {_cents('total_liters')} AS total_liters"""

_FEATURE_COLUMNS = f"""{_PANEL_COLUMNS},
  {_cents('revenue_lag1')} AS revenue_lag1, {_cents('revenue_lag2')} AS revenue_lag2,
  {_cents('revenue_lag3')} AS revenue_lag3,
  revenue_rolling3, mom_growth_rate, store_avg_revenue, txn_lag1, skus_lag1, month_of_year"""

# Profiled columns in order: name, Spark type name, bytes per row in SQL.
_PROFILED = (
    ("invoice_item", "string", "strlen(invoice_item)"),
    ("sale_date", "date", "4"),
    ("store_name", "string", "strlen(store_name)"),
    ("city", "string", "strlen(city)"),
    ("county", "string", "strlen(county)"),
    ("store_location", "string", "coalesce(strlen(store_location), 0)"),
    ("category_name", "string", "coalesce(strlen(category_name), 0)"),
    ("item_description", "string", "strlen(item_description)"),
    ("bottles_sold", "smallint", "2"),
    ("sale_dollars", "double", "8"),
    ("volume_liters", "double", "8"),
)

_NULLS = "null_report AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS data_type, "
    f"count(*) AS n_rows, count(*) - count({name}) AS n_nulls, "
    f"count(DISTINCT {name}) + max(CAST({name} IS NULL AS INTEGER)) AS n_distinct FROM sales"
    for i, (name, kind, _) in enumerate(_PROFILED, 1)
) + ")"
_ON_NULLS = _with(_sales_cte(), _NULLS)


def _top(key: str, measure: str, out: str, k: int) -> str:
    return (
        f"{_ON_SALES} SELECT {key}, {_cents(_sum(measure))} AS {out} FROM sales "
        f"GROUP BY {key} ORDER BY {_sum(measure)} DESC, {key} NULLS FIRST LIMIT {k}"
    )


def _top_categories(amount: str) -> str:
    return (
        f"{_ON_SALES} SELECT {_MAJOR_CATEGORY} AS major_category, {amount} AS total_revenue "
        f"FROM sales GROUP BY 1 ORDER BY {_sum('sale_dollars')} DESC, 1 LIMIT 10"
    )


def _report() -> str:
    def f1(hit: str, wrong: str, missed: str) -> str:
        return f"coalesce(2 * {hit} / nullif(2 * {hit} + {wrong} + {missed}, 0), 0)"

    def rate(hit: str, other: str) -> str:
        return f"coalesce({hit} / nullif({hit} + {other}, 0), 0)"

    return f"""{_ON_RULE}, measures AS (
  SELECT {rate('tn', 'fn')} AS p0, {rate('tn', 'fp')} AS r0, {f1('tn', 'fn', 'fp')} AS f0, tn + fp AS s0,
         {rate('tp', 'fp')} AS p1, {rate('tp', 'fn')} AS r1, {f1('tp', 'fp', 'fn')} AS f1, tp + fn AS s1,
         tn + fp + fn + tp AS n, (tn + tp) / (tn + fp + fn + tp) AS accuracy
  FROM cells),
report AS (
  SELECT 1 AS position, 'Bottom 75%' AS row_name, p0 AS "precision", r0 AS recall, f0 AS f1_score, s0 AS support
  FROM measures
  UNION ALL SELECT 2, 'Top Quartile', p1, r1, f1, s1 FROM measures
  UNION ALL SELECT 3, 'accuracy', NULL, NULL, accuracy, n FROM measures
  UNION ALL SELECT 4, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM measures
  UNION ALL SELECT 5, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,
                   (f0 * s0 + f1 * s1) / n, n FROM measures)
SELECT CAST(position AS INTEGER) AS position, row_name, "precision" AS "precision",
       recall AS recall, f1_score AS f1_score,
       CAST(support AS BIGINT) AS support
FROM report ORDER BY position"""


def _relabel() -> str:
    names = ("monthly_revenue", "total_bottles", *FEATURES)
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, avg({name}) AS mean_value FROM features" for name in names
    )
    return (
        f"{_ON_FEATURES}, means AS ({rows}) SELECT feature, round(mean_value, 6) AS mean_value, "
        f"{_case('feature', FEATURE_LABELS, 'feature')} AS feature_label FROM means"
    )


def _standardized() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)
    scaled = ", ".join(f"round(({c} - m_{c}) / s_{c}, 9) AS {c}" for c in FEATURES)
    return (
        f"{_ON_SPLIT}, stats AS (SELECT {stats} FROM split_rows WHERE split = 'train') "
        f"SELECT store_name, city, county, year, month, {scaled} "
        "FROM split_rows, stats WHERE split = 'test'"
    )


def checks() -> dict[str, str]:
    """Query name -> DuckDB SQL over views named as the test tables."""
    categorized = (
        f"{_ON_SALES} SELECT invoice_item, category_name, sale_dollars, "
        f"{_MAJOR_CATEGORY} AS major_category FROM sales"
    )
    features = f"SELECT {_FEATURE_COLUMNS} FROM features"
    return {
        "csv_roundtrip_scan": f"""{_ON_SALES} SELECT invoice_item, sale_date, store_name, city, county,
            category_name, item_description, bottles_sold, sale_dollars,
            {_cents('volume_liters')} AS volume_liters, {_cents('volume_gallons')} AS volume_gallons
            FROM sales""",
        "column_profile": f"""{_ON_NULLS} SELECT CAST(position AS INTEGER) AS position, column_name,
            data_type, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_nulls AS BIGINT) AS n_nulls,
            CAST(n_distinct AS BIGINT) AS n_distinct FROM null_report""",
        "footer_profile": f"""{_ON_NULLS} SELECT CAST(position AS INTEGER) AS position, column_name,
            data_type, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_nulls AS BIGINT) AS n_nulls
            FROM null_report""",
        "footer_null_proportions": f"""{_ON_NULLS} SELECT column_name,
            n_nulls / n_rows AS missing_proportion FROM null_report""",
        "stored_size": "SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS has_bytes FROM lineitem",
        "distinct_counts": f"{_ON_SALES} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) AS BIGINT)"
            f" AS n_distinct FROM sales"
            for c in ("store_name", "city", "county", "store_location", "category_name", "item_description")
        ),
        "preview_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25",
        "table_dimensions": f"""{_ON_SALES} SELECT CAST(count(*) AS BIGINT) AS n_rows,
            CAST({len(_PROFILED)} AS INTEGER) AS n_columns FROM sales""",
        "size_estimate": f"""{_ON_SALES}, measured AS (
            SELECT count(*) AS n, CAST(sum({' + '.join(width for _, _, width in _PROFILED)}) AS DOUBLE)
              AS bytes FROM sales)
            SELECT CAST(n AS BIGINT) AS n_rows, bytes / n AS avg_row_bytes,
            bytes AS total_bytes, bytes / 1048576 AS total_mib FROM measured""",
        "null_proportions": f"""{_ON_NULLS} SELECT column_name,
            n_nulls / n_rows AS missing_proportion FROM null_report""",
        "columns_over_null_threshold": f"""{_ON_NULLS} SELECT column_name,
            n_nulls / n_rows AS missing_proportion FROM null_report
            WHERE n_nulls / n_rows >= 0.10""",
        "clean_sales": f"""{_ON_SALES} SELECT invoice_item, sale_date, store_number, store_name, city,
            zip_code, county_number, county, category, category_name, vendor_name, item_description,
            bottles_sold, sale_dollars, {_cents('volume_liters')} AS volume_liters,
            {_cents('volume_gallons')} AS volume_gallons, year, month, quarter, weekday, is_weekend
            FROM sales""",
        "parse_dates": f"""{_ON_SALES} SELECT invoice_item, date_text,
            CAST(strptime(date_text, '%m/%d/%Y') AS DATE) AS sale_date FROM sales""",
        "calendar_features": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS sale_date,
            CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
            CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
            CAST(isodow(o_orderdate) AS INTEGER) AS weekday, isodow(o_orderdate) >= 5 AS is_weekend
            FROM orders""",
        "categorize": categorized,
        "categorize_by_lookup": categorized,
        "distinct_categories": f"{_ON_SALES} SELECT DISTINCT category FROM sales ORDER BY category",
        "category_distribution": f"""{_ON_SALES} SELECT {_MAJOR_CATEGORY} AS major_category,
            CAST(count(*) AS BIGINT) AS n_sales FROM sales GROUP BY 1 ORDER BY n_sales DESC, 1""",
        "uncategorized_audit": f"""{_ON_SALES} SELECT category_name, CAST(count(*) AS BIGINT) AS n_sales
            FROM sales WHERE {_MAJOR_CATEGORY} = '{UNCATEGORIZED}' GROUP BY category_name
            ORDER BY n_sales DESC, category_name NULLS FIRST""",
        "category_mapping_pairs": f"""{_ON_SALES} SELECT DISTINCT category_name,
            {_MAJOR_CATEGORY} AS major_category FROM sales""",
        "sales_summary": f"""{_ON_SALES} SELECT {_cents(_sum('sale_dollars'))} AS total_revenue,
            {_cents(_sum('volume_gallons'))} AS total_volume_gallons,
            CAST(sum(bottles_sold) AS BIGINT) AS total_bottles,
            CAST(count(*) AS BIGINT) AS total_transactions FROM sales""",
        "yearly_summary": f"""{_ON_SALES}, yearly AS (
            SELECT year, {_sum('sale_dollars')} AS revenue, {_sum('volume_gallons')} AS gallons,
              sum(bottles_sold) AS bottles, count(*) AS transactions FROM sales GROUP BY year),
            previous AS (SELECT *, lag(revenue) OVER (ORDER BY year) AS before FROM yearly)
            SELECT year, {_cents('revenue')} AS revenue, {_cents('gallons')} AS volume_gallons,
            CAST(bottles AS BIGINT) AS bottles, CAST(transactions AS BIGINT) AS transactions,
            (revenue - before) / nullif(before, 0) * 100 AS revenue_growth_pct,
            revenue / transactions AS avg_transaction_value FROM previous ORDER BY year""",
        "quarterly_sales": f"""{_ON_SALES} SELECT year, quarter,
            {_cents(_sum('sale_dollars'))} AS total_revenue, year || ' Q' || quarter AS period
            FROM sales GROUP BY year, quarter ORDER BY year, quarter""",
        "top_categories": _top_categories(_cents(_sum("sale_dollars"))),
        "top_categories_display": _top_categories(f"format('${{:,.2f}}', {_sum('sale_dollars')})"),
        "top_products_revenue": _top("item_description", "sale_dollars", "total_revenue", 20),
        "top_products_volume": _top("item_description", "volume_liters", "total_volume", 20),
        "top_counties": _top("county", "sale_dollars", "total_revenue", 3),
        "top_cities": _top("city", "sale_dollars", "total_sales", 20),
        "weekday_weekend": f"""{_ON_SALES} SELECT is_weekend, {_cents(_sum('sale_dollars'))} AS total_sales,
            CAST(count(DISTINCT sale_date) AS BIGINT) AS n_days,
            {_sum('sale_dollars')} / count(DISTINCT sale_date) AS avg_daily_sales,
            CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type
            FROM sales GROUP BY is_weekend""",
        "city_efficiency": f"""{_ON_SALES}, cities AS (
            SELECT city, {_sum('sale_dollars')} AS total, count(DISTINCT invoice_item) AS n
            FROM sales GROUP BY city)
            SELECT city, {_cents('total')} AS total_sales, CAST(n AS BIGINT) AS n_transactions,
            total / n AS avg_sale_per_txn
            FROM cities ORDER BY total / n DESC, city LIMIT 20""",
        "store_month_panel": f"{_ON_PANEL} SELECT {_PANEL_COLUMNS} FROM panel",
        "distinct_rollups": f"""{_ON_SALES} SELECT city, year, quarter,
            CAST(count(DISTINCT invoice_item) AS BIGINT) AS num_transactions,
            CAST(count(DISTINCT item_description) AS BIGINT) AS unique_skus
            FROM sales GROUP BY city, year, quarter""",
        "panel_stats": f"""{_ON_PANEL} SELECT CAST(count(*) AS BIGINT) AS n_rows,
            CAST(count(DISTINCT store_name) AS BIGINT) AS n_stores,
            CAST((min(year * 12 + month - 1) // 12) AS INTEGER) AS first_year,
            CAST(min(year * 12 + month - 1) % 12 + 1 AS INTEGER) AS first_month,
            CAST((max(year * 12 + month - 1) // 12) AS INTEGER) AS last_year,
            CAST(max(year * 12 + month - 1) % 12 + 1 AS INTEGER) AS last_month FROM panel""",
        "store_features": f"{_ON_FEATURES} {features}",
        "refreshed_panel": f"{_ON_FEATURES} {features}",
        "store_features_sparse": f"{_with(_sales_cte('customer'), _PANEL, _FEATURES)} {features}",
        "store_features_calendar": f"{_with(_sales_cte('customer'), _PANEL, _CALENDAR_FEATURES)} {features}",
        "value_relabel": _relabel(),
        "monthly_thresholds": f"""{_ON_COHORT} SELECT year, month, {_cents('q75')} AS q75
            FROM thresholds""",
        "group_quantile_nearest": f"""{_ON_SALES}, ranked AS (
            SELECT county, sale_dollars,
              row_number() OVER (PARTITION BY county ORDER BY sale_dollars) AS rn,
              count(*) OVER (PARTITION BY county) AS n FROM sales)
            SELECT county, sale_dollars AS median_sale FROM ranked
            WHERE rn = 1 + floor((n - 1) * 0.5 + 0.5)""",
        "group_quantile_linear": f"""{_ON_SALES}, ranked AS (
            SELECT county, sale_dollars, row_number() OVER (PARTITION BY county ORDER BY sale_dollars) AS rn,
              (count(*) OVER (PARTITION BY county) - 1) * CAST(0.9 AS DOUBLE) AS place FROM sales),
            around AS (SELECT county, max(place) AS place,
              max(sale_dollars) FILTER (rn = floor(place) + 1) AS low, max(sale_dollars) FILTER (rn = ceil(place) + 1) AS high
              FROM ranked GROUP BY county)
            SELECT county, low + (high - low) * (place - floor(place)) AS quantile FROM around""",
        "group_quantile_disc": f"""{_ON_SALES} SELECT county, quantile_disc(sale_dollars, 0.5) AS quantile
            FROM sales GROUP BY county""",
        "quartile_labels": f"""{_ON_COHORT} SELECT store_name, city, county, year, month,
            {_cents('monthly_revenue')} AS monthly_revenue, {_cents('q75')} AS q75, is_top_quartile
            FROM labelled""",
        "breakout_labels": f"""{_ON_COHORT} SELECT {_FEATURE_COLUMNS}, {_cents('q75')} AS q75,
            is_top_quartile, was_top_quartile_last_month FROM cohort""",
        "temporal_cutoff": f"""{_ON_SPLIT} SELECT
            CAST((min(year * 12 + month - 1) // 12) AS INTEGER) AS cutoff_year,
            CAST(min(year * 12 + month - 1) % 12 + 1 AS INTEGER) AS cutoff_month,
            CAST(count(*) AS BIGINT) AS n_periods FROM periods""",
        "train_test_split": f"""{_ON_SPLIT} SELECT split, store_name, city, county, year, month,
            {_cents('monthly_revenue')} AS monthly_revenue, is_top_quartile FROM split_rows""",
        "split_summary": f"""{_ON_SPLIT} SELECT split, CAST(count(*) AS BIGINT) AS n_rows,
            avg(is_top_quartile) AS positive_rate FROM split_rows GROUP BY split""",
        "class_weights": f"""{_ON_SPLIT}, classes AS (
            SELECT is_top_quartile, count(*) AS n FROM split_rows WHERE split = 'train'
            GROUP BY is_top_quartile)
            SELECT is_top_quartile, CAST(n AS BIGINT) AS n_rows,
            (SELECT sum(n) FROM classes) / ((SELECT count(*) FROM classes) * n)
              AS class_weight FROM classes""",
        "standardized_features": _standardized(),
        "classification_report": _report(),
        "breakout_lift": f"""{_ON_RULE} SELECT CAST(tp + fp AS BIGINT) AS n_flagged,
            CAST(tp + fn AS BIGINT) AS n_positive, CAST(tp AS BIGINT) AS n_hits,
            (tp + fn) / (tn + fp + fn + tp) AS base_rate,
            tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall,
            2 * tp / (2 * tp + fp + fn) AS f1_score,
            tp / (tp + fp) / ((tp + fn) / (tn + fp + fn + tp)) AS lift FROM cells""",
        "confusion_matrix": f"""{_ON_RULE} SELECT is_top_quartile AS actual,
            CAST(count(*) FILTER (prediction = 0) AS BIGINT) AS predicted_0,
            CAST(count(*) FILTER (prediction = 1) AS BIGINT) AS predicted_1
            FROM scored GROUP BY is_top_quartile ORDER BY actual""",
        "auc_roc": f"""{_ON_COHORT}, ranked AS (
            SELECT is_top_quartile,
              rank() OVER (ORDER BY revenue_rolling3)
              + (count(*) OVER (PARTITION BY revenue_rolling3) - 1) / 2.0 AS mid_rank FROM cohort),
            sizes AS (
            SELECT count(*) FILTER (is_top_quartile = 1) AS p, count(*) FILTER (is_top_quartile = 0) AS n,
              CAST(sum(mid_rank) FILTER (is_top_quartile = 1) AS DOUBLE) AS rank_sum FROM ranked)
            SELECT CAST(p AS BIGINT) AS n_positive, CAST(n AS BIGINT) AS n_negative,
            (rank_sum - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n) AS auc FROM sizes""",
    }
