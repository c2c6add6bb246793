"""DuckDB SQL oracles, one per query of :mod:`pricelab.plans.queries`.

Written independently of the DataFrame code, against the same parquet tables
(views ``lineitem orders part customer``).  Notes on engine differences:
DuckDB ``CAST(double AS INT)`` rounds (so ``trunc`` first), ``round_even`` is
Spark's ``bround``, and decimal literals are cast to DOUBLE explicitly.
"""

from __future__ import annotations

import math

# Fixed values of the analysis, written out: this module takes nothing from the code it checks.
_STATUSES = "'shipped', 'shipped - delivered to buyer'"
ELASTICITY_LABELS = ("Elastic", "Inelastic", "Positive Elasticity")
PRICE_GRID = (0.9, 0.9500000000000001, 1.0, 1.05, 1.1)  # steps of (1.10 - 0.90) / 4 in double precision
PRICE_STEPS = {"pct_m10": -10, "pct_m5": -5, "pct_0": 0, "pct_p5": 5, "pct_p10": 10}
DISCOUNTS = (0.90, 0.80)
DEMAND_UPLIFTS = (1.10, 1.20)
SCENARIOS = ("-19% discount", "-9% discount", "10% demand uplift", "19% demand uplift")
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _d(x: float) -> str:
    """An exact DOUBLE literal (shortest round-trip text of the Python float)."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _list(values) -> str:
    return "[" + ", ".join(_d(float(v)) for v in values) + "]"


def _exact_sum(expr: str) -> str:
    """Σ of values rounded to nine decimals, added exactly."""
    return f"CAST(SUM(CAST({expr} AS DECIMAL(38,9))) AS DOUBLE)"


_WS = "'" + WHITE_SPACE + "'"

BASE = f"""
WITH raw AS (
  SELECT
    l.l_orderkey AS order_id,
    l.l_linenumber AS line_no,
    CASE WHEN l.l_orderkey % 97 <> 13 THEN o.o_orderdate END AS date,
    CASE WHEN l.l_returnflag = 'R' THEN 'Cancelled'
         WHEN l.l_linestatus = 'F' THEN 'Shipped - Delivered to Buyer'
         ELSE 'Shipped' END AS status,
    CASE WHEN c.c_custkey % 2 = 0 THEN ' ' || c.c_mktsegment || '  '
         ELSE lower(c.c_mktsegment) || chr(9) END AS sales_channel,
    CASE WHEN l.l_orderkey % 97 <> 17 THEN p.p_brand || '/' || substr(o.o_orderpriority, 1, 1) END AS style,
    'P' || CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey % 10 AS VARCHAR) AS sku,
    p.p_type AS category,
    CASE WHEN l.l_orderkey % 97 = 11 THEN CAST(0 AS DOUBLE)
         ELSE l.l_quantity END AS qty,
    CASE WHEN l.l_orderkey % 97 <> 7 THEN l.l_extendedprice END AS amount,
    (c.c_nationkey % 5 = 0) AS b2b,
    CASE WHEN o.o_orderpriority <> '5-LOW' THEN o.o_orderpriority END AS fulfilled_by
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
),
completed AS (
  SELECT * FROM raw WHERE lower(status) IN ({_STATUSES})
),
fact AS (
  SELECT order_id, line_no, date, status,
         lower(trim(sales_channel, {_WS})) AS sales_channel,
         style, sku, category, qty, amount, b2b,
         lower(trim(fulfilled_by, {_WS})) AS fulfilled_by,
         amount / qty AS unit_price,
         amount AS revenue,
         CAST(year(date) AS INTEGER) AS year,
         CAST(month(date) AS INTEGER) AS month,
         CAST(day(date) AS INTEGER) AS day,
         dayname(date) AS weekday,
         CAST(weekofyear(date) AS INTEGER) AS weekofyear
  FROM completed
  WHERE amount IS NOT NULL AND qty IS NOT NULL AND sku IS NOT NULL
    AND amount > 0 AND qty > 0 AND date IS NOT NULL
),
spd AS (
  SELECT sku, unit_price, SUM(qty) AS qty FROM fact GROUP BY sku, unit_price
),
cpd AS (
  SELECT * FROM (
    SELECT category, unit_price, SUM(qty) AS qty FROM fact
    WHERE category IS NOT NULL GROUP BY category, unit_price)
  WHERE unit_price > 0 AND qty > 0
),
sku_fit AS (
  SELECT sku, regr_slope(ln(qty), ln(unit_price)) AS e, regr_r2(ln(qty), ln(unit_price)) AS r2
  FROM spd GROUP BY sku HAVING count(*) >= 3
),
sku_el AS (
  SELECT sku, elasticity, r2,
         CASE WHEN elasticity IS NULL OR isnan(elasticity) THEN NULL
              WHEN elasticity <= -1 THEN '{ELASTICITY_LABELS[0]}'
              WHEN elasticity <= 0 THEN '{ELASTICITY_LABELS[1]}'
              ELSE '{ELASTICITY_LABELS[2]}' END AS elasticity_range
  FROM (SELECT sku, CASE WHEN abs(e) < 1e-12 THEN CAST(0 AS DOUBLE) ELSE e END AS elasticity, r2 FROM sku_fit)
),
cat_fit AS (
  SELECT category, regr_slope(ln(qty), ln(unit_price)) AS e, regr_r2(ln(qty), ln(unit_price)) AS r_squared,
         count(*) AS n_price_points
  FROM cpd GROUP BY category HAVING count(*) >= 3
),
cat_el AS (
  SELECT category, elasticity, r_squared, n_price_points,
         CASE WHEN elasticity IS NULL OR isnan(elasticity) THEN NULL
              WHEN elasticity <= -1 THEN '{ELASTICITY_LABELS[0]}'
              WHEN elasticity <= 0 THEN '{ELASTICITY_LABELS[1]}'
              ELSE '{ELASTICITY_LABELS[2]}' END AS elasticity_range
  FROM (SELECT category, CASE WHEN abs(e) < 1e-12 THEN CAST(0 AS DOUBLE) ELSE e END AS elasticity,
               r_squared, n_price_points FROM cat_fit)
),
labels AS (
  SELECT * FROM (VALUES ('{ELASTICITY_LABELS[0]}'), ('{ELASTICITY_LABELS[1]}'), ('{ELASTICITY_LABELS[2]}'))
    t(elasticity_range)
),
base AS (
  SELECT category, SUM(qty) AS baseline_qty, {_exact_sum('unit_price * qty')} AS baseline_rev
  FROM fact WHERE category IS NOT NULL GROUP BY category
),
be AS (
  SELECT b.category, b.baseline_qty, b.baseline_rev, c.elasticity
  FROM base b JOIN cat_el c ON b.category = c.category
),
price_scen AS (
  SELECT category,
         (m - CAST(1 AS DOUBLE)) * CAST(100 AS DOUBLE) AS price_change_pct,
         baseline_rev AS baseline_revenue,
         baseline_rev * m * pow(m, elasticity) AS simulated_revenue,
         (baseline_rev * m * pow(m, elasticity) - baseline_rev) / baseline_rev * 100 AS rev_delta_pct,
         m AS multiplier
  FROM be, (SELECT unnest({_list(PRICE_GRID)}) AS m)
),
promo AS (
  SELECT category,
         CAST(CAST(trunc((m - CAST(1 AS DOUBLE)) * CAST(100 AS DOUBLE)) AS INTEGER) AS VARCHAR) || '% discount'
           AS scenario,
         baseline_rev,
         (baseline_rev / baseline_qty) * m * (baseline_qty * pow(m, elasticity)) AS sim_rev,
         ((baseline_rev / baseline_qty) * m * (baseline_qty * pow(m, elasticity)) - baseline_rev)
           / baseline_rev * 100 AS rev_change_pct,
         m AS multiplier
  FROM be, (SELECT unnest({_list(DISCOUNTS)}) AS m)
),
peak AS (
  SELECT category,
         CAST(CAST(trunc((u - CAST(1 AS DOUBLE)) * CAST(100 AS DOUBLE)) AS INTEGER) AS VARCHAR) || '% demand uplift'
           AS scenario,
         baseline_rev,
         baseline_rev * u AS sim_rev,
         (baseline_rev * u - baseline_rev) / baseline_rev * 100 AS rev_change_pct,
         u AS multiplier
  FROM be, (SELECT unnest({_list(DEMAND_UPLIFTS)}) AS u)
),
ev AS (
  SELECT * FROM promo UNION ALL SELECT * FROM peak
),
meta_channel AS (
  SELECT sku, v FROM (
    SELECT sku, v, row_number() OVER (PARTITION BY sku ORDER BY c DESC, v ASC) AS rn FROM (
      SELECT sku, sales_channel AS v, count(*) AS c FROM fact WHERE sales_channel IS NOT NULL GROUP BY 1, 2))
  WHERE rn = 1
),
meta_fulfil AS (
  SELECT sku, v FROM (
    SELECT sku, v, row_number() OVER (PARTITION BY sku ORDER BY c DESC, v ASC) AS rn FROM (
      SELECT sku, fulfilled_by AS v, count(*) AS c FROM fact WHERE fulfilled_by IS NOT NULL GROUP BY 1, 2))
  WHERE rn = 1
),
meta_b2b AS (
  SELECT sku, v FROM (
    SELECT sku, v, row_number() OVER (PARTITION BY sku ORDER BY c DESC, v ASC) AS rn FROM (
      SELECT sku, b2b AS v, count(*) AS c FROM fact WHERE b2b IS NOT NULL GROUP BY 1, 2))
  WHERE rn = 1
),
sku_meta AS (
  SELECT s.sku, mc.v AS sales_channel, mf.v AS fulfilled_by, mb.v AS b2b_flag
  FROM (SELECT DISTINCT sku FROM fact) s
  LEFT JOIN meta_channel mc ON s.sku = mc.sku
  LEFT JOIN meta_fulfil mf ON s.sku = mf.sku
  LEFT JOIN meta_b2b mb ON s.sku = mb.sku
),
seg AS (
  SELECT e.sku, e.elasticity, e.r2, e.elasticity_range, m.sales_channel, m.fulfilled_by, m.b2b_flag
  FROM sku_el e LEFT JOIN sku_meta m ON e.sku = m.sku
  WHERE m.sales_channel IS NOT NULL AND m.fulfilled_by IS NOT NULL AND m.b2b_flag IS NOT NULL
),
vals AS (
  SELECT unit_price AS x, qty FROM fact WHERE unit_price IS NOT NULL AND NOT isnan(unit_price)
),
hstat AS (
  SELECT CASE WHEN min(x) = max(x) THEN min(x) - CAST(0.5 AS DOUBLE) ELSE min(x) END AS lo,
         CASE WHEN min(x) = max(x) THEN max(x) + CAST(0.5 AS DOUBLE) ELSE max(x) END AS hi
  FROM vals
),
hstep AS (
  SELECT lo, hi, (hi - lo) / CAST(50 AS DOUBLE) AS step FROM hstat
),
hk0 AS (
  SELECT v.x, v.qty, s.lo, s.hi, s.step,
         LEAST(GREATEST(CAST(floor((v.x - s.lo) / s.step) AS INTEGER), 0), 49) AS k0
  FROM vals v, hstep s
),
hk AS (
  SELECT x, qty,
         CASE WHEN x < (CASE WHEN k0 >= 50 THEN hi ELSE CAST(k0 AS DOUBLE) * step + lo END) THEN k0 - 1
              WHEN k0 < 49 AND x >= (CASE WHEN k0 + 1 >= 50 THEN hi ELSE CAST(k0 + 1 AS DOUBLE) * step + lo END)
                THEN k0 + 1
              ELSE k0 END AS k
  FROM hk0
),
hcounts AS (
  SELECT k + 1 AS bin, count(*) AS n, SUM(qty) AS q FROM hk GROUP BY 1
),
hist AS (
  SELECT CAST(b.i AS INTEGER) AS bin,
         CAST(b.i - 1 AS DOUBLE) * s.step + s.lo AS bin_lo,
         CASE WHEN b.i >= 50 THEN s.hi ELSE CAST(b.i AS DOUBLE) * s.step + s.lo END AS bin_hi,
         CAST(coalesce(c.n, 0) AS BIGINT) AS count,
         coalesce(c.q, CAST(0 AS DOUBLE)) AS total_qty
  FROM range(1, 51) b(i) CROSS JOIN hstep s LEFT JOIN hcounts c ON c.bin = b.i
),
kstat AS (
  SELECT min(x) AS lo, max(x) AS hi, count(x) AS n,
         stddev_samp(x) * pow(CAST(count(x) AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS h
  FROM vals
),
kgrid AS (
  SELECT CAST(g.j AS INTEGER) AS grid_index,
         CASE WHEN g.j = 199 THEN s.hi ELSE CAST(g.j AS DOUBLE) * ((s.hi - s.lo) / CAST(199 AS DOUBLE)) + s.lo END AS gx,
         s.h, s.n
  FROM range(0, 200) g(j) CROSS JOIN kstat s
),
kweights AS (
  SELECT x, count(*) AS w FROM vals GROUP BY x
),
kdens AS (
  SELECT g.grid_index, g.gx, g.h, g.n,
         SUM(CAST(w.w AS DOUBLE) * exp(CAST(-0.5 AS DOUBLE) * ((g.gx - w.x) / g.h) * ((g.gx - w.x) / g.h))) AS ks
  FROM kgrid g CROSS JOIN kweights w
  GROUP BY g.grid_index, g.gx, g.h, g.n
)
"""


def _r(expr: str, n: int, alias: str) -> str:
    return f"round({expr}, {n}) AS {alias}"


def _pivot_cell(cond: str, value: str, alias: str) -> str:
    return f'round_even(avg(CASE WHEN {cond} THEN {value} END), 1) + CAST(0 AS DOUBLE) AS "{alias}"'


def _segment_sql(dim: str) -> str:
    return (f"SELECT {dim}, count(elasticity) AS n_skus, {_r('avg(elasticity)', 6, 'avg_elasticity')}, "
            f"{_r('median(elasticity)', 6, 'med_elasticity')} FROM seg GROUP BY {dim}")


def _segment_long_sql(places: int = 6) -> str:
    parts = [f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(elasticity) AS n_skus, "
             f"{_r('avg(elasticity)', places, 'avg_elasticity')}, {_r('median(elasticity)', places, 'med_elasticity')} "
             f"FROM seg GROUP BY {d}" for d in ("sales_channel", "fulfilled_by", "b2b_flag")]
    return " UNION ALL ".join(parts)


_PRICE_PIVOT = ", ".join(
    _pivot_cell(f"CAST(round(price_change_pct) AS INTEGER) = {step}", "rev_delta_pct", name) for name, step in PRICE_STEPS.items())
_EVAL_PIVOT = ", ".join(_pivot_cell(f"scenario = '{lab}'", "rev_change_pct", lab) for lab in SCENARIOS)
_SQRT_2PI = _d(math.sqrt(2 * math.pi))
_SCEN_COLS = (f"category, scenario, {_r('baseline_rev', 2, 'baseline_rev')}, {_r('sim_rev', 2, 'sim_rev')}, "
              f"{_r('rev_change_pct', 6, 'rev_change_pct')}, multiplier")

BODIES = {
    "clean_sales": "SELECT order_id, line_no, date, status, sales_channel, style, sku, category, qty, amount, "
                   "b2b, fulfilled_by, unit_price, revenue, year, month, day, weekday, weekofyear FROM fact",
    "csv_clean_sales": "SELECT order_id, line_no, date, status, sales_channel, style, sku, category, qty, amount, "
                       "b2b, fulfilled_by, unit_price, revenue, year, month, day, weekday, weekofyear FROM fact",
    "csv_many_files": "SELECT order_id, line_no, date, status, sales_channel, style, sku, category, qty, amount, "
                      "b2b, fulfilled_by, unit_price, revenue, year, month, day, weekday, weekofyear FROM fact "
                      "WHERE order_id % 97 NOT IN (19, 23)",
    "dropped_rows": "SELECT count(*) AS completed, count(*) FILTER (WHERE amount IS NULL OR qty IS NULL OR sku IS NULL) AS missing, "
                    "count(*) FILTER (WHERE amount IS NOT NULL AND qty IS NOT NULL AND sku IS NOT NULL AND (amount <= 0 OR qty <= 0)) AS not_positive, "
                    "count(*) FILTER (WHERE amount > 0 AND qty > 0 AND sku IS NOT NULL AND date IS NULL) AS bad_date FROM completed",
    "completed_sales": "SELECT order_id, line_no, status, sku, qty, amount FROM completed",
    "distinct_skus": "SELECT DISTINCT sku FROM completed",
    "calendar_parts": "SELECT DISTINCT date, year, month, day, weekday, weekofyear FROM fact",
    "normalized_text": "SELECT sales_channel, fulfilled_by, count(*) AS count FROM fact "
                       "GROUP BY sales_channel, fulfilled_by",
    "sku_rollup": "SELECT sku, " + _exact_sum("unit_price") + " / count(unit_price) AS avg_price, "
                  "SUM(qty) AS total_qty, round(" + _exact_sum('revenue') + ", 2) AS total_revenue, "
                  "arg_min(style, order_id * 1000 + line_no) FILTER (WHERE style IS NOT NULL) AS style, "
                  "arg_min(category, order_id * 1000 + line_no) FILTER (WHERE category IS NOT NULL) AS category "
                  "FROM fact GROUP BY sku",
    "sku_counts": "SELECT sku, count(*) AS count FROM fact WHERE sku IS NOT NULL GROUP BY sku",
    "category_counts": "SELECT category, count(*) AS count FROM fact WHERE category IS NOT NULL GROUP BY category",
    "sku_demand_curve": "SELECT unit_price, SUM(qty) AS qty FROM fact WHERE sku = ("
                        "SELECT sku FROM fact GROUP BY sku ORDER BY count(*) DESC, sku LIMIT 1) "
                        "GROUP BY unit_price",
    "sku_demand_curve_for": "SELECT unit_price, SUM(qty) AS qty FROM fact WHERE sku = ("
                            "SELECT sku FROM fact GROUP BY sku ORDER BY count(*) DESC, sku DESC LIMIT 1) "
                            "GROUP BY unit_price",
    "sku_price_demand": f"SELECT sku, unit_price, qty, {_r('ln(unit_price)', 9, 'log_price')}, "
                        f"{_r('ln(qty)', 9, 'log_qty')} FROM spd",
    "category_price_demand": f"SELECT category, unit_price, qty, {_r('ln(unit_price)', 9, 'log_price')}, "
                             f"{_r('ln(qty)', 9, 'log_qty')} FROM cpd",
    "sku_elasticity": f"SELECT sku, {_r('elasticity', 6, 'elasticity')}, {_r('r2', 6, 'r2')}, elasticity_range "
                      f"FROM sku_el",
    "category_elasticity": f"SELECT category, {_r('elasticity', 6, 'elasticity')}, "
                           f"{_r('r_squared', 6, 'r_squared')}, n_price_points, elasticity_range FROM cat_el",
    "sku_range_counts": "SELECT l.elasticity_range, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM labels l "
                        "LEFT JOIN (SELECT elasticity_range, count(*) AS n FROM sku_el GROUP BY 1) c "
                        "ON l.elasticity_range = c.elasticity_range",
    "category_range_counts": "SELECT l.elasticity_range, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM labels l "
                             "LEFT JOIN (SELECT elasticity_range, count(*) AS n FROM cat_el GROUP BY 1) c "
                             "ON l.elasticity_range = c.elasticity_range",
    "sku_range_share": "SELECT elasticity_range, count, round(CAST(count AS DOUBLE) / CAST(SUM(count) OVER () "
                       "AS DOUBLE), 9) AS share FROM (SELECT l.elasticity_range, CAST(coalesce(c.n, 0) AS BIGINT) "
                       "AS count FROM labels l LEFT JOIN (SELECT elasticity_range, count(*) AS n FROM sku_el "
                       "GROUP BY 1) c ON l.elasticity_range = c.elasticity_range)",
    "stream_sku_price_demand": "SELECT sku, unit_price, qty FROM spd",
    "sku_peak_price": "SELECT sku, unit_price AS peak_price, qty AS peak_qty FROM (SELECT sku, unit_price, qty, "
                      "row_number() OVER (PARTITION BY sku ORDER BY qty DESC, unit_price ASC) AS rn FROM spd) "
                      "WHERE rn = 1",
    "baseline": f"SELECT category, baseline_qty, {_r('baseline_rev', 2, 'baseline_rev')} FROM base",
    "baseline_elasticity": f"SELECT category, baseline_qty, {_r('baseline_rev', 2, 'baseline_rev')}, "
                           f"{_r('elasticity', 6, 'elasticity')} FROM be",
    "price_scenarios": f"SELECT category, {_r('price_change_pct', 6, 'price_change_pct')}, "
                       f"{_r('baseline_revenue', 2, 'baseline_revenue')}, "
                       f"{_r('simulated_revenue', 2, 'simulated_revenue')}, "
                       f"{_r('rev_delta_pct', 6, 'rev_delta_pct')}, multiplier FROM price_scen",
    "price_pivot": f"SELECT category, {_PRICE_PIVOT} FROM price_scen GROUP BY category",
    "promo_scenarios": f"SELECT {_SCEN_COLS} FROM promo",
    "peak_scenarios": f"SELECT {_SCEN_COLS} FROM peak",
    "evaluation": f"SELECT {_SCEN_COLS} FROM ev",
    "evaluation_pivot": f"SELECT category, {_EVAL_PIVOT} FROM ev GROUP BY category",
    "sku_meta": "SELECT sku, sales_channel, fulfilled_by, b2b_flag FROM sku_meta",
    "sku_segments": f"SELECT sku, {_r('elasticity', 6, 'elasticity')}, {_r('r2', 6, 'r2')}, elasticity_range, "
                    f"sales_channel, fulfilled_by, b2b_flag FROM seg",
    "segment_stats_channel": _segment_sql("sales_channel"),
    "segment_stats_fulfilment": _segment_sql("fulfilled_by"),
    "segment_stats_b2b": _segment_sql("b2b_flag"),
    "segment_stats": _segment_long_sql(),
    "segment_tables": f"SELECT dimension, value, n_skus, round_even(round(avg_elasticity, 9), 2) AS avg_elasticity, "
                      f"round_even(round(med_elasticity, 9), 2) AS med_elasticity FROM ({_segment_long_sql(9)})",
    "price_histogram": "SELECT bin, bin_lo, bin_hi, count FROM hist",
    "demand_by_price_bin": "SELECT bin, bin_lo, bin_hi, count, total_qty FROM hist",
    "modal_price_bin": "SELECT bin, bin_lo, bin_hi, count FROM hist ORDER BY count DESC, bin LIMIT 1",
    "price_density": f"SELECT grid_index, {_r('gx', 6, 'unit_price')}, "
                     f"{_r(f'ks / (CAST(n AS DOUBLE) * h * {_SQRT_2PI})', 12, 'density')}, "
                     f"{_r(f'ks / (CAST(n AS DOUBLE) * h * {_SQRT_2PI}) * (SELECT SUM(CAST(count AS DOUBLE) * (bin_hi - bin_lo)) FROM hist)', 6, 'count_density')} "
                     f"FROM kdens",
    "top_skus_by_revenue": "SELECT sku, round(rev, 2) AS total_revenue, total_qty FROM (SELECT sku, "
                           + _exact_sum("revenue") + " AS rev, SUM(qty) AS total_qty FROM fact GROUP BY sku) "
                           "ORDER BY rev DESC, sku LIMIT 10",
    "top_categories_by_revenue": "SELECT category, round(rev, 2) AS total_revenue, total_qty FROM (SELECT category, "
                                 + _exact_sum("revenue") + " AS rev, SUM(qty) AS total_qty FROM fact "
                                 "WHERE category IS NOT NULL GROUP BY category) ORDER BY rev DESC, category LIMIT 10",
    "revenue_by_month": "SELECT year, month, round(" + _exact_sum("revenue") + ", 2) AS total_revenue, SUM(qty) AS total_qty, "
                        "count(*) AS n_lines FROM fact GROUP BY year, month",
    "revenue_by_weekday": "SELECT weekday, round(" + _exact_sum("revenue") + ", 2) AS total_revenue, SUM(qty) AS total_qty, "
                          "count(*) AS n_lines FROM fact GROUP BY weekday",
}


def oracle_sql() -> dict[str, str]:
    return {name: BASE + body for name, body in BODIES.items()}
