"""The registered queries as plain SQL over the given tables.

Written independently of the Spark plans: ranks are ranks, extremes are joined
one-row tables, and so on.  ``half_up`` rounds on the decimal text of a double,
which is what Spark's ``round`` does; the SQL engine's own ``round`` works on the
binary value and differs on exact halves.
"""

from __future__ import annotations

from fieldmart.catalogue.queries import LOAD_TIME
from fieldmart.catalogue.views import DEMAND_DAY, KPI_DAY


def half_up(value: str, digits: int) -> str:
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,22)), {digits}) AS DOUBLE)"


def _weighted(terms: list[tuple[str, str]]) -> str:
    return " + ".join(f"{weight}e0 * {term}" for weight, term in terms)


def _unit(column: str) -> str:
    return f"((CAST({column} AS DOUBLE) - lo_{column}) / span_{column})"


_NORMALISED = ("avg_weekly_revenue", "days_since_last_visit", "stockout_events", "avg_depletion_rate")


def _bounds() -> str:
    parts = []
    for c in _NORMALISED:
        low = f"coalesce(CAST(min({c}) AS DOUBLE), 0e0)"
        high = f"coalesce(nullif(CAST(max({c}) AS DOUBLE), 0e0), 1e0)"
        parts.append(f"{low} AS lo_{c}, coalesce(nullif({high} - {low}, 0e0), 1e0) AS span_{c}")
    return ", ".join(parts)


_RPS = _weighted(
    [
        ("0.30", _unit("avg_weekly_revenue")),
        ("0.25", _unit("days_since_last_visit")),
        ("0.20", _unit("stockout_events")),
        ("0.15", "CAST(stockout_risk_flag AS DOUBLE)"),
        ("0.10", _unit("avg_depletion_rate")),
    ]
)
_DRS = _weighted(
    [
        ("0.35", "(total_pest_alerts / most_pest)"),
        ("0.30", "CAST(fungicide_risk_flag AS DOUBLE)"),
        ("0.20", "CAST(high_humidity_flag AS DOUBLE)"),
        ("0.15", "CAST(drought_stress_flag AS DOUBLE)"),
    ]
)
_FORECAST = ", ".join(
    f"greatest(0e0, least(ma_4w * 1.5e0, {half_up(f'ma_4w + {n} * trend_slope', 0)})) AS forecasted_qty_w{n}"
    for n in range(1, 5)
)
_FRAME = "OVER (PARTITION BY district ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
_DAY_FRAME = (
    "OVER (PARTITION BY district ORDER BY CAST(date AS DATE) "
    "RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"
)


def _mean_in_order(frame: str) -> str:
    return f"list_reduce(list(drs_score) {frame}, lambda a, b: a + b) / count(drs_score) {frame}"


# Named sub-queries, each using those before it.
_VIEWS: dict[str, str] = {
    "dist": """
        SELECT n_nationkey, n_name AS district, r_name AS state
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "order_lines": """
        SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, min(l_quantity) AS least
        FROM lineitem GROUP BY l_orderkey""",
    "retailer_raw": """
        SELECT 'R' || o_custkey AS retailer_id, any_value(c_name) AS retailer_name, any_value(state) AS state,
               any_value(district) AS district, any_value(c_mktsegment) AS tehsil,
               isoyear(o_orderdate) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS week,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1000 AS avg_weekly_revenue,
               CAST(DATE '2001-12-31' - CAST(max(o_orderdate) AS DATE) AS INTEGER) AS days_since_last_visit,
               CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS INTEGER) AS stockout_events,
               CAST(sum(quantity) AS DOUBLE) / 7 AS avg_depletion_rate,
               min(least) / 5 AS weeks_of_stock,
               CAST(DATE '2024-01-01' + CAST(week(o_orderdate) % 30 AS INTEGER) AS DATE) AS ingestion_date
        FROM orders LEFT JOIN order_lines ON o_orderkey = l_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN dist ON c_nationkey = n_nationkey
        GROUP BY o_custkey, isoyear(o_orderdate), week(o_orderdate)""",
    "retailer": """
        SELECT *, CASE WHEN weeks_of_stock < 2 THEN 1 ELSE 0 END AS stockout_risk_flag,
               CASE WHEN avg_weekly_revenue >= 50000 THEN 'HIGH' WHEN avg_weekly_revenue >= 20000 THEN 'MID'
                    ELSE 'LOW' END AS revenue_tier
        FROM retailer_raw""",
    "dirty": """
        SELECT * REPLACE (
            CASE WHEN weeks_of_stock <> 0.2e0 THEN retailer_id END AS retailer_id,
            CASE WHEN stockout_events <= 1 THEN district END AS district,
            CASE WHEN days_since_last_visit < 100 THEN -avg_weekly_revenue
                 WHEN days_since_last_visit < 2000 THEN avg_weekly_revenue END AS avg_weekly_revenue)
        FROM retailer_raw""",
    "bounds": f"SELECT {_bounds()} FROM retailer",
    "rps": f"SELECT *, {half_up(_RPS, 4)} AS rps_score FROM retailer, bounds",
    "kpi_base": f"""
        SELECT *, {half_up('(avg_weekly_revenue - base) / base * 100', 2)} AS revenue_wow_pct,
               CASE WHEN stockout_risk_flag = 1 OR rps_score > 0.75e0 THEN 'URGENT'
                    WHEN rps_score >= 0.5e0 THEN 'SOON' ELSE 'ROUTINE' END AS visit_urgency,
               CASE WHEN tehsil_rank <= 5 THEN 1 ELSE 0 END AS top5_in_tehsil
        FROM (SELECT *, nullif(lag(avg_weekly_revenue) OVER (PARTITION BY retailer_id ORDER BY week), 0e0) AS base,
                     rank() OVER (PARTITION BY tehsil, week ORDER BY rps_score DESC NULLS LAST) AS tehsil_rank
              FROM rps)""",
    "kpi": """
        SELECT retailer_id, retailer_name, state, district, tehsil, week, avg_weekly_revenue, revenue_tier,
               revenue_wow_pct, rps_score, stockout_risk_flag, stockout_events, weeks_of_stock, visit_urgency,
               top5_in_tehsil, ingestion_date FROM kpi_base""",
    "district_raw": """
        SELECT district, state, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, min(value) AS precip_mm_7d,
               max(value) / 2 AS avg_humidity_pct,
               CAST(count(*) FILTER (WHERE event_type = 'error') AS INTEGER) AS total_pest_alerts,
               CAST(3 * count(*) FILTER (WHERE value > 60) AS INTEGER) AS high_incidence_count,
               CASE WHEN max(value) > 200 THEN 1 ELSE 0 END AS fungicide_risk_flag,
               CAST(ts AS DATE) AS ingestion_date
        FROM events JOIN dist ON user_id % 25 = n_nationkey GROUP BY district, state, CAST(ts AS DATE)""",
    "district_silver": """
        SELECT *, CASE WHEN precip_mm_7d < 2 THEN 1 ELSE 0 END AS drought_stress_flag,
               CASE WHEN avg_humidity_pct > 80 THEN 1 ELSE 0 END AS high_humidity_flag FROM district_raw""",
    "pest": """
        SELECT coalesce(nullif(CAST(max(total_pest_alerts) AS DOUBLE), 0e0), 1e0) AS most_pest FROM district_silver""",
    "drs": f"SELECT *, {half_up(_DRS, 4)} AS drs_score FROM district_silver, pest",
    "risk": f"""
        SELECT *, CASE WHEN drs_score >= 0.65e0 THEN 'HIGH' WHEN drs_score >= 0.35e0 THEN 'MEDIUM'
                       ELSE 'LOW' END AS risk_tier,
               {half_up('seven_rows', 4)} AS drs_7d_avg,
               CASE WHEN previous IS NULL THEN 'STABLE' WHEN drs_score - previous > 0.05e0 THEN 'UP'
                    WHEN drs_score - previous < -0.05e0 THEN 'DOWN' ELSE 'STABLE' END AS drs_trend,
               CASE WHEN fungicide_risk_flag = 1 THEN 'Score 250 EC'
                    WHEN high_incidence_count > 10 THEN 'Actara 25 WG'
                    WHEN drought_stress_flag = 1 THEN 'Topik 15 WP'
                    ELSE 'Monitor Digital Demand' END AS recommended_product
        FROM (SELECT *, lag(drs_score) OVER (PARTITION BY district ORDER BY date) AS previous,
                     {_mean_in_order(_FRAME)} AS seven_rows FROM drs)""",
    "sold": """
        SELECT o_custkey, p_type, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS week,
               CAST(l_quantity AS BIGINT) AS quantity, l_linestatus, district, state
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN dist ON c_nationkey = n_nationkey""",
    "inventory": """
        SELECT 'R' || o_custkey AS retailer_id, p_type AS sku_id, 'SKU ' || p_type AS sku_name, district, state, week,
               CAST(sum(quantity) AS DOUBLE) AS sku_qty FROM sold GROUP BY o_custkey, p_type, district, state, week""",
    "series": """
        SELECT p_type AS sku_id, 'SKU ' || p_type AS sku_name, district, state, week,
               CAST(sum(quantity) AS DOUBLE) AS actual_qty,
               CAST(2 * sum(CASE WHEN l_linestatus = 'O' THEN quantity ELSE 0 END) AS DOUBLE) AS current_stock_qty
        FROM sold GROUP BY p_type, district, state, week""",
    "smoothed": f"""
        SELECT *, {half_up('average', 2)} AS ma_4w,
               CASE WHEN base IS NOT NULL AND base <> 0 THEN {half_up('(actual_qty - base) / 4', 2)}
                    ELSE 0e0 END AS trend_slope
        FROM (SELECT *, avg(actual_qty) OVER (PARTITION BY sku_id, district ORDER BY week
                                              ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS average,
                     lag(actual_qty, 4) OVER (PARTITION BY sku_id, district ORDER BY week) AS base FROM series)""",
    "forecast": f"""
        SELECT sku_id, sku_name, district, state, week, actual_qty, current_stock_qty, ma_4w, trend_slope,
               CASE WHEN trend_slope > ma_4w * 0.2e0 THEN 'SPIKE' WHEN trend_slope > 5 THEN 'GROWING'
                    WHEN trend_slope < -5 THEN 'DECLINING' ELSE 'STABLE' END AS demand_category,
               CASE WHEN forecasted_qty_w1 > current_stock_qty THEN 1 ELSE 0 END AS stockout_risk_flag,
               forecasted_qty_w1, forecasted_qty_w2, forecasted_qty_w3, forecasted_qty_w4,
               CAST(week AS DATE) AS ingestion_date
        FROM (SELECT *, {_FORECAST} FROM smoothed)""",
    "loaded": """
        SELECT retailer_id, week, avg_weekly_revenue, visit_urgency, ingestion_date FROM kpi
        WHERE ingestion_date <= DATE '2024-01-20'""",
    "staged": """
        SELECT retailer_id, week, avg_weekly_revenue + 1000 AS avg_weekly_revenue, visit_urgency, ingestion_date
        FROM kpi WHERE ingestion_date >= DATE '2024-01-15'""",
    "unmatched": """
        SELECT * FROM loaded WHERE NOT EXISTS (
            SELECT 1 FROM staged WHERE staged.retailer_id = loaded.retailer_id AND staged.week = loaded.week)""",
}


def _with(names: str, body: str) -> str:
    """``body`` preceded by the named views and all they build on."""
    wanted = names.split()
    last = max(list(_VIEWS).index(n) for n in wanted)
    parts = ", ".join(f"{n} AS ({_VIEWS[n].strip()})" for n in list(_VIEWS)[: last + 1])
    return f"WITH {parts} {body}"


_DAY = "CAST(ingestion_date AS VARCHAR) AS ingestion_date"
_STAMP = "strftime(CAST(ingestion_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ingestion_timestamp"
_GOLD_TAIL = f"* REPLACE ({_DAY}), {_STAMP}"

_RISK_COLUMNS = (
    "district, state, date, drs_score, drs_7d_avg, drs_trend, risk_tier, fungicide_risk_flag, drought_stress_flag, "
    "high_humidity_flag, total_pest_alerts, high_incidence_count, recommended_product"
)


def _exact_sum(column: str) -> str:
    # Decimals are read from and turned into text, since that rounds correctly.
    return f"CAST(CAST(sum(CAST(CAST({column} AS VARCHAR) AS DECIMAL(28,10))) AS VARCHAR) AS DOUBLE)"


def _exact_avg(column: str) -> str:
    return f"{_exact_sum(column)} / CAST(count({column}) AS DOUBLE)"


def _rule(name: str, fails: str, details: str, source: str) -> str:
    """One rule result computed over ``source``."""
    return f"""
        SELECT rule, fail_count = 0 AS passed, fail_count, total,
               CASE WHEN total > 0 THEN {half_up('fail_count / total * 100', 2)} ELSE 0e0 END AS fail_pct,
               details
        FROM (SELECT '{name}' AS rule, CAST({fails} AS BIGINT) AS fail_count, count(*) AS total,
                     {details} AS details FROM {source})"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _not_null(columns: list[str], source: str) -> str:
    test = " OR ".join(f"{c} IS NULL" for c in columns)
    details = _quoted(f"Null found in critical columns: {columns}")
    return _rule(f"NOT_NULL({', '.join(columns)})", f"count(*) FILTER (WHERE {test})", details, source)


def _non_negative(columns: list[str], present: list[str], source: str) -> str:
    test = " OR ".join(f"{c} < 0" for c in present)
    details = _quoted(f"Negative values found in: {columns}")
    return _rule(f"NON_NEGATIVE({', '.join(columns)})", f"count(*) FILTER (WHERE {test})", details, source)


def _unique(keys: list[str], source: str) -> str:
    distinct = f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {source}))"
    details = _quoted(f"Duplicate rows on key: {keys}")
    return _rule(f"UNIQUE({', '.join(keys)})", f"count(*) - {distinct}", details, source)


def _min_rows(count: int, source: str) -> str:
    return _rule(
        f"MIN_ROWS({count})",
        f"CASE WHEN count(*) >= {count} THEN 0 ELSE 1 END",
        f"'Expected >= {count} rows, got ' || count(*)",
        source,
    )


_RETAILER_SUITE = " UNION ALL ".join(
    [
        _not_null(["retailer_id", "district"], "dirty"),
        _non_negative(["avg_weekly_revenue", "stockout_events"], ["avg_weekly_revenue", "stockout_events"], "dirty"),
        _unique(["retailer_id", "week"], "dirty"),
        _min_rows(10, "dirty"),
    ]
)
_DISTRICT_SUITE = " UNION ALL ".join(
    [
        _not_null(["district", "state"], "district_silver"),
        _non_negative(
            ["total_pest_alerts", "high_incidence_count"], ["total_pest_alerts", "high_incidence_count"],
            "district_silver",
        ),
        _unique(["district", "date"], "district_silver"),
        _min_rows(5, "district_silver"),
    ]
)
_DEMAND_SUITE = " UNION ALL ".join(
    [
        _not_null(["sku_id", "district", "week"], "inventory"),
        _unique(["sku_id", "district", "retailer_id", "week"], "inventory"),
    ]
)
_RUN_TIME = LOAD_TIME.replace(" ", "T") + "Z"


def _bucketed(width: str, extra: str = "", keys: str = ", event_type") -> str:
    total = _exact_sum("value")
    return f"""
        SELECT strftime(time_bucket(INTERVAL '{width}', ts), '%Y-%m-%d %H:%M:%S') AS window_start{keys},
               count(*) AS n, {total} AS sum_value, {total} / CAST(count(value) AS DOUBLE) AS avg_value
        FROM events {extra} GROUP BY time_bucket(INTERVAL '{width}', ts){keys}"""


def _closed(width: str) -> str:
    """Only windows that end before the watermark, ten minutes behind the newest event."""
    return (
        f"WHERE time_bucket(INTERVAL '{width}', ts) + INTERVAL '{width}' "
        "<= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"
    )


def _alarm(extra: str = "") -> str:
    signal = "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"
    return f"""
        SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
               CAST(sum({signal}) AS BIGINT) AS total
        FROM events {extra} GROUP BY time_bucket(INTERVAL '5 minutes', ts) HAVING sum({signal}) >= 1"""


def _decimals(columns: dict[str, str]) -> str:
    exact = "CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,22))"
    return ", ".join(
        f"CAST(TRY_CAST({exact.format(c=c)} AS DECIMAL({p})) AS VARCHAR) AS {c}" for c, p in columns.items()
    )


def _smallints(columns: list[str]) -> str:
    return ", ".join(f"CAST(coalesce({c}, 0) AS SMALLINT) AS {c}" for c in columns)


_LOADED_AT = f"'{LOAD_TIME}' AS loaded_at"
_HOST = r"regexp_extract(url, '^https?://([^/]+)', 1)"


def oracle_sql() -> dict[str, str]:
    return {
        # Bronze and Silver
        "bronze_metadata": f"""
            SELECT o_orderkey, '{LOAD_TIME}' AS ingestion_timestamp, '{LOAD_TIME[:10]}' AS ingestion_date,
                   'orders.parquet' AS source_file FROM orders""",
        "bronze_csv_roundtrip": _with("retailer_raw", f"""
            SELECT retailer_id, retailer_name, state, district, tehsil, week, avg_weekly_revenue,
                   days_since_last_visit, stockout_events, avg_depletion_rate, weeks_of_stock,
                   '{LOAD_TIME[:10]}' AS ingestion_date, false AS corrupt FROM retailer_raw"""),
        "bronze_csv_headers": _with("retailer_raw", """
            SELECT retailer_id, CASE WHEN stockout_events = 0 THEN retailer_name END AS retailer_name, state, district, tehsil, week,
                   avg_weekly_revenue, CASE WHEN stockout_events = 0 THEN stockout_events END AS stockout_events, weeks_of_stock,
                   'n' || stockout_events AS note, CASE WHEN stockout_events = 0 THEN week END AS "Note_12" FROM retailer_raw"""),
        "bronze_incremental": _with("retailer_raw", """
            SELECT retailer_id, week, avg_weekly_revenue,
                   '2024-02-0' || (1 + (days_since_last_visit % 3 + 3) % 3) AS ingestion_date FROM retailer_raw"""),
        "schema_merge": """
            SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1999-01-01' THEN o_orderpriority END AS o_orderpriority,
                   CASE WHEN o_orderdate >= DATE '1999-01-01' THEN 2 ELSE 1 END AS age FROM orders""",
        "silver_retailer": _with("retailer", """
            SELECT retailer_id, week, avg_weekly_revenue, days_since_last_visit, stockout_events, avg_depletion_rate,
                   weeks_of_stock, stockout_risk_flag, revenue_tier FROM retailer"""),
        "silver_district": _with("district_silver", """
            SELECT district, state, date, precip_mm_7d, avg_humidity_pct, total_pest_alerts, high_incidence_count,
                   fungicide_risk_flag, drought_stress_flag, high_humidity_flag FROM district_silver"""),
        "silver_demand": _with("inventory", """
            SELECT retailer_id, sku_id, district, state, week, sku_qty AS actual_qty FROM inventory"""),
        "silver_valid_rows": _with("dirty", """
            SELECT retailer_id, retailer_name, week, avg_weekly_revenue FROM dirty
            WHERE retailer_id IS NOT NULL AND avg_weekly_revenue >= 0"""),
        "enrich_inventory": _with("inventory", """
            SELECT retailer_id, sku_id, week AS week_end_date, sku_qty, district, state FROM inventory"""),
        "dedup_latest": """
            SELECT * EXCLUDE (rn) REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate)
            FROM (SELECT *, row_number() OVER (
                      PARTITION BY l_orderkey, l_linenumber
                      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
                               l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn
                  FROM lineitem) WHERE rn = 1""",
        "silver_daily_merge": _with("retailer", """
            SELECT retailer_id, week,
                   CASE WHEN ingestion_date >= DATE '2024-01-15' THEN avg_weekly_revenue + 1000
                        ELSE avg_weekly_revenue END AS avg_weekly_revenue,
                   CASE WHEN ingestion_date >= DATE '2024-01-15' THEN '2024-02-01'
                        ELSE CAST(ingestion_date AS VARCHAR) END AS ingestion_date FROM retailer"""),
        # Scores and windows
        "min_max_norm": _with("bounds", f"""
            SELECT retailer_id, week, {_unit('avg_weekly_revenue')} AS norm_revenue,
                   {_unit('days_since_last_visit')} AS norm_days_since,
                   {_unit('stockout_events')} AS norm_stockout_events,
                   {_unit('avg_depletion_rate')} AS norm_depletion FROM retailer, bounds"""),
        "rps_score": _with("kpi", "SELECT retailer_id, week, rps_score, visit_urgency FROM kpi"),
        "drs_score": _with("risk", "SELECT district, date, drs_score, risk_tier FROM risk"),
        "wow_revenue": _with("kpi", "SELECT retailer_id, week, avg_weekly_revenue, revenue_wow_pct FROM kpi"),
        "top5_in_group": _with("kpi", "SELECT retailer_id, tehsil, week, top5_in_tehsil FROM kpi"),
        "rolling_7_rows": _with("risk", "SELECT district, date, drs_7d_avg FROM risk"),
        "rolling_7_days": _with("drs", f"""
            SELECT district, date, {half_up('seven_days', 4)} AS drs_7d_avg
            FROM (SELECT *, {_mean_in_order(_DAY_FRAME)} AS seven_days FROM drs)"""),
        "drs_trend": _with("risk", "SELECT district, date, drs_trend FROM risk"),
        "moving_avg_4w": _with("smoothed", "SELECT sku_id, district, week, actual_qty, ma_4w FROM smoothed"),
        "trend_slope": _with("smoothed", "SELECT sku_id, district, week, trend_slope FROM smoothed"),
        "demand_forecast": _with("forecast", """
            SELECT sku_id, district, week, forecasted_qty_w1, forecasted_qty_w2, forecasted_qty_w3, forecasted_qty_w4,
                   0e0 AS current_stock_qty, CASE WHEN forecasted_qty_w1 > 0 THEN 1 ELSE 0 END AS stockout_risk_flag
            FROM forecast"""),
        "recommend_product": _with("risk", "SELECT district, date, recommended_product FROM risk"),
        # Gold
        "gold_retailer_kpi": _with("kpi", f"SELECT {_GOLD_TAIL} FROM kpi"),
        "gold_district_risk": _with("risk", f"SELECT {_RISK_COLUMNS}, {_DAY}, {_STAMP} FROM risk"),
        "gold_demand_forecast": _with("forecast", f"SELECT {_GOLD_TAIL} FROM forecast"),
        "gold_retailer_partial": _with("kpi", f"SELECT {_GOLD_TAIL} FROM kpi"),
        "gold_published": _with("kpi", f"SELECT {_GOLD_TAIL} FROM kpi"),
        "gold_district_partial": _with("risk", f"SELECT {_RISK_COLUMNS}, {_DAY}, {_STAMP} FROM risk"),
        "gold_anomalies": _with("forecast", """
            SELECT 'demand_spike' AS kind, district, week, sku_id, CAST(1 AS BIGINT) AS sku_count FROM forecast
            WHERE demand_category = 'SPIKE'
            UNION ALL
            SELECT 'stockout_cluster', district, week, NULL, count(*) FROM forecast WHERE stockout_risk_flag = 1
            GROUP BY district, week HAVING count(*) >= 3"""),
        "gold_summary": _with("kpi risk forecast", """
            SELECT 'retailer_kpi' AS table_name, 'rows' AS metric, count(*) AS value FROM kpi
            UNION ALL SELECT 'retailer_kpi', 'urgent', count(*) FROM kpi WHERE visit_urgency = 'URGENT'
            UNION ALL SELECT 'district_risk', 'rows', count(*) FROM risk
            UNION ALL SELECT 'district_risk', 'high_risk', count(*) FROM risk WHERE risk_tier = 'HIGH'
            UNION ALL SELECT 'demand_forecast', 'rows', count(*) FROM forecast
            UNION ALL SELECT 'demand_forecast', 'spikes', count(*) FROM forecast WHERE demand_category = 'SPIKE'
            UNION ALL SELECT 'demand_forecast', 'stockout', count(*) FROM forecast WHERE stockout_risk_flag = 1"""),
        "gold_partition_counts": _with("kpi", f"""
            SELECT state, {_DAY}, count(*) AS rows FROM kpi GROUP BY state, kpi.ingestion_date"""),
        # Business queries
        "q1_urgent_retailers": _with("kpi", f"""
            SELECT retailer_id, retailer_name, state, district, tehsil, rps_score, visit_urgency, revenue_tier,
                   stockout_risk_flag, {half_up('avg_weekly_revenue', 0)} AS revenue_inr,
                   revenue_wow_pct AS wow_change_pct
            FROM kpi WHERE ingestion_date = DATE '{KPI_DAY}' AND visit_urgency = 'URGENT'
            ORDER BY rps_score DESC NULLS LAST, retailer_id, week LIMIT 10"""),
        "q2_district_heatmap": _with("risk", f"""
            SELECT state, district, {half_up('drs_score', 3)} AS drs_score, {half_up('drs_7d_avg', 3)} AS rolling_7d_avg,
                   drs_trend, risk_tier, total_pest_alerts, high_incidence_count, recommended_product
            FROM risk WHERE ingestion_date = DATE '{KPI_DAY}' AND risk_tier IN ('HIGH', 'MEDIUM')"""),
        "q3_revenue_trend": _with("kpi", f"""
            SELECT state, week, count(DISTINCT retailer_id) AS active_retailers,
                   {half_up(_exact_sum('avg_weekly_revenue'), 0)}
                       AS total_revenue_inr,
                   {half_up(_exact_avg('rps_score'), 3)} AS avg_rps,
                   CAST(sum(stockout_risk_flag) AS BIGINT) AS stockout_risk_count,
                   count(*) FILTER (WHERE visit_urgency = 'URGENT') AS urgent_visits
            FROM kpi WHERE ingestion_date >= DATE '{KPI_DAY}' - 30 GROUP BY state, week"""),
        "q4_growing_demand": _with("forecast", f"""
            SELECT sku_name, state, district, ma_4w AS baseline_4w_avg, trend_slope, demand_category,
                   forecasted_qty_w1, forecasted_qty_w2, forecasted_qty_w3, forecasted_qty_w4,
                   forecasted_qty_w1 + forecasted_qty_w2 + forecasted_qty_w3 + forecasted_qty_w4 AS total_4w_forecast,
                   stockout_risk_flag
            FROM forecast WHERE ingestion_date = DATE '{DEMAND_DAY}' AND demand_category IN ('GROWING', 'SPIKE')
            ORDER BY total_4w_forecast DESC, sku_id, state, district LIMIT 20"""),
        "q5_daily_health": _with("kpi", f"""
            SELECT {_DAY}, count(*) AS total_retailer_records, count(DISTINCT retailer_id) AS unique_retailers,
                   count(DISTINCT district) AS districts_covered,
                   CAST(sum(stockout_risk_flag) AS BIGINT) AS at_risk_retailers,
                   {half_up(_exact_avg('rps_score'), 4)} AS mean_rps, min(rps_score) AS min_rps,
                   max(rps_score) AS max_rps, count(*) FILTER (WHERE visit_urgency = 'URGENT') AS urgent_count,
                   count(*) FILTER (WHERE visit_urgency = 'SOON') AS soon_count,
                   count(*) FILTER (WHERE visit_urgency = 'ROUTINE') AS routine_count
            FROM kpi WHERE kpi.ingestion_date >= DATE '{KPI_DAY}' - 7 GROUP BY kpi.ingestion_date"""),
        "q6_cross_layer_priority": _with("kpi risk", f"""
            SELECT r.retailer_id, r.retailer_name, r.state, r.district, r.rps_score, r.visit_urgency, d.drs_score,
                   d.risk_tier AS district_risk_tier, d.recommended_product,
                   {half_up('r.rps_score * 0.6e0 + d.drs_score * 0.4e0', 4)} AS combined_priority_score
            FROM kpi r JOIN risk d
              ON r.district = d.district AND r.state = d.state AND r.ingestion_date = d.ingestion_date
            WHERE r.ingestion_date = DATE '{KPI_DAY}' AND d.risk_tier = 'HIGH'
            ORDER BY combined_priority_score DESC NULLS LAST, r.retailer_id, r.week LIMIT 15"""),
        "district_avg_risk": _with("risk", f"""
            SELECT district, {half_up(_exact_avg('drs_score'), 4)} AS avg_risk FROM risk
            WHERE ingestion_date = (SELECT max(ingestion_date) FROM risk) GROUP BY district"""),
        "catalog_gold_scan": _with("kpi", f"""
            SELECT state, visit_urgency, count(*) AS rows, max(rps_score) AS max_rps FROM kpi
            WHERE ingestion_date = DATE '{KPI_DAY}' GROUP BY state, visit_urgency"""),
        # Data quality
        "dq_not_null": _with("dirty", _not_null(["retailer_id", "district"], "dirty")),
        "dq_non_negative": _non_negative(
            ["c_acctbal", "c_custkey", "c_credit"], ["c_acctbal", "c_custkey"], "customer"
        ),
        "dq_unique": _unique(["l_orderkey", "l_linenumber"], "lineitem")
        + " UNION ALL "
        + _unique(["text"], "documents"),
        "dq_row_count": _min_rows(10, "orders") + " UNION ALL " + _min_rows(10**15, "orders"),
        "dq_freshness": _rule(
            "FRESHNESS(ts, 48h)",
            "count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-30 23:59:59' - INTERVAL '48 hours')",
            "'Stale data detected: ' || count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-30 23:59:59' "
            "- INTERVAL '48 hours') || ' rows ingested older than 48 hours'",
            "events",
        ),
        "dq_referential": _with("retailer", _rule(
            "REFERENTIAL(district)",
            "count(*) FILTER (WHERE district NOT IN (SELECT district FROM dist WHERE state <> 'ASIA'))",
            _quoted("Values missing in the master: ['district']"),
            "retailer",
        )),
        "dq_suite_retailer": _with("dirty", _RETAILER_SUITE),
        "dq_suite_district": _with("district_silver", _DISTRICT_SUITE),
        "dq_suite_demand": _with("inventory", _DEMAND_SUITE),
        "dq_report": _with("dirty district_silver", f"""
            SELECT 'retailer' AS "table", '{_RUN_TIME}' AS run_time, bool_and(passed) OVER () AS overall_passed, *
            FROM ({_RETAILER_SUITE})
            UNION ALL
            SELECT 'district', '{_RUN_TIME}', bool_and(passed) OVER (), * FROM ({_DISTRICT_SUITE})"""),
        "dq_alerts": _with("dirty", f"""
            SELECT 'retailer' AS table_name, '{_RUN_TIME}' AS run_time,
                   '[ALERT] DQ Failure: retailer' AS subject, CAST(count(*) AS INTEGER) AS failed_rules,
                   'N/A' AS dq_report_path, 'N/A' AS execution_id,
                   string_agg(rule || ' | fail_count=' || fail_count || ' | fail_pct=' || CAST(fail_pct AS VARCHAR)
                              || '% | ' || details, chr(10)
                              ORDER BY CASE WHEN rule LIKE 'NOT_NULL%' THEN 1 WHEN rule LIKE 'NON_NEG%' THEN 2
                                            WHEN rule LIKE 'UNIQUE%' THEN 3 ELSE 4 END) AS message
            FROM ({_RETAILER_SUITE}) WHERE NOT passed"""),
        # Mart
        "mart_load_retailer": _with("kpi", f"""
            SELECT retailer_id, retailer_name, state, district, tehsil, week, revenue_tier, visit_urgency,
                   CAST(coalesce(stockout_events, 0) AS INTEGER) AS stockout_events,
                   {_decimals({'avg_weekly_revenue': '15,2', 'revenue_wow_pct': '8,2', 'rps_score': '6,4',
                               'weeks_of_stock': '6,2'})},
                   {_smallints(['stockout_risk_flag', 'top5_in_tehsil'])}, {_DAY}, {_STAMP}, {_LOADED_AT}
            FROM kpi"""),
        "mart_load_district": _with("risk", f"""
            SELECT district, state, date, drs_trend, risk_tier, recommended_product,
                   {_decimals({'drs_score': '6,4', 'drs_7d_avg': '6,4'})},
                   {_smallints(['fungicide_risk_flag', 'drought_stress_flag', 'high_humidity_flag'])},
                   total_pest_alerts, high_incidence_count, {_DAY}, {_LOADED_AT} FROM risk"""),
        "mart_load_demand": _with("forecast", f"""
            SELECT sku_id, sku_name, district, state, week, demand_category,
                   {_decimals({'actual_qty': '12,2', 'current_stock_qty': '12,2', 'ma_4w': '12,2',
                               'trend_slope': '10,2', 'forecasted_qty_w1': '12,2', 'forecasted_qty_w2': '12,2',
                               'forecasted_qty_w3': '12,2', 'forecasted_qty_w4': '12,2'})},
                   {_smallints(['stockout_risk_flag'])}, {_DAY}, {_LOADED_AT} FROM forecast"""),
        "mart_partition_load": _with("kpi", f"""
            SELECT retailer_id, week, state, {_decimals({'rps_score': '6,4'})}, {_DAY} FROM kpi
            WHERE kpi.ingestion_date = DATE '{KPI_DAY}'"""),
        "mart_delete_matched": _with("unmatched", f"SELECT * REPLACE ({_DAY}) FROM unmatched"),
        "mart_upsert": _with("unmatched", f"""
            SELECT * REPLACE ({_DAY}) FROM unmatched UNION ALL SELECT * REPLACE ({_DAY}) FROM staged"""),
        "mart_upsert_partitions": _with("unmatched", f"""
            SELECT * REPLACE ({_DAY}) FROM unmatched UNION ALL SELECT * REPLACE ({_DAY}) FROM staged"""),
        "mart_rejects": _with("kpi", """
            SELECT retailer_id, week, state, concat_ws('; ', no_district, long_week) AS reasons
            FROM (SELECT retailer_id, state,
                         CASE WHEN revenue_tier = 'HIGH' THEN week || '-final' ELSE week END AS week,
                         CASE WHEN stockout_events > 1 THEN 'district is null' END AS no_district,
                         CASE WHEN revenue_tier = 'HIGH' THEN 'week is longer than 10' END AS long_week FROM kpi)
            WHERE no_district IS NOT NULL OR long_week IS NOT NULL"""),
        "mart_load_rejects": _with("kpi", """
            SELECT retailer_id, week, state, CASE WHEN too_many IS NULL THEN stockout_events END AS stockout_events,
                   concat_ws('; ', too_many, no_district, long_week) AS reasons, (SELECT count(*) FROM kpi) AS rows_read
            FROM (SELECT retailer_id, state, CAST(CASE WHEN visit_urgency = 'URGENT' THEN 0 ELSE stockout_events END AS INTEGER) AS stockout_events,
                         CASE WHEN revenue_tier = 'HIGH' THEN week || '-final' ELSE week END AS week,
                         CASE WHEN visit_urgency = 'URGENT' THEN 'stockout_events does not fit int: 5000000000' END AS too_many,
                         CASE WHEN stockout_events > 1 THEN 'district is null' END AS no_district,
                         CASE WHEN revenue_tier = 'HIGH' THEN 'week is longer than 10' END AS long_week FROM kpi)"""),
        "mart_upsert_new_column": _with("unmatched", """
            SELECT retailer_id, week, avg_weekly_revenue, CAST(NULL AS VARCHAR) AS channel FROM unmatched
            UNION ALL SELECT retailer_id, week, avg_weekly_revenue, 'c-' || visit_urgency FROM staged"""),
        "dim_district_two_loads": _with("dist", f"""
            SELECT CAST(row_number() OVER (ORDER BY state <= 'AMERICA', state, district) AS INTEGER) AS district_id, district, state,
                   CASE WHEN state > 'AMERICA' THEN '{LOAD_TIME}' ELSE '2024-02-01 00:00:00' END AS created_at
            FROM (SELECT DISTINCT state, district FROM dist)"""),
        "mart_layout": _with("kpi", """
            SELECT district, count(*) AS rows, CAST(sum(stockout_risk_flag) AS BIGINT) AS at_risk,
                   max(rps_score) AS max_rps FROM kpi GROUP BY district"""),
        "dim_district": _with("dist", """
            SELECT CAST(row_number() OVER (ORDER BY state, district) AS INTEGER) AS district_id, district, state,
                   CAST(NULL AS VARCHAR) AS region FROM (SELECT DISTINCT state, district FROM dist)"""),
        "run_audit": _with("retailer_raw district_raw series inventory", """
            SELECT 'SUCCESS' AS status,
                   CAST(2 * r + d + i AS BIGINT) AS rows_bronze, CAST(r + d + i AS BIGINT) AS rows_silver,
                   CAST(r + d + s AS BIGINT) AS rows_gold, 1 AS dq_failures, 'scheduled' AS triggered_by
            FROM (SELECT (SELECT count(*) FROM retailer_raw) AS r, (SELECT count(*) FROM district_raw) AS d,
                         (SELECT count(*) FROM inventory) AS i, (SELECT count(*) FROM series) AS s)"""),
        "run_alerts": """
            SELECT 'retailer' AS table_name, '[TEST] DQ Failure: retailer' AS subject, CAST(1 AS INTEGER) AS failed_rules,
                   'r1' AS execution_id, 'r1' AS run_id WHERE EXISTS (SELECT 1 FROM orders)""",
        # Metrics and events
        "metric_rollup_hourly": _bucketed("1 hour"),
        "metric_rollup_daily": _bucketed("1 day"),
        "metric_status_daily": """
            SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
                   count(*) FILTER (WHERE event_type = 'purchase') AS succeeded,
                   count(*) FILTER (WHERE event_type = 'error') AS failed
            FROM events GROUP BY time_bucket(INTERVAL '1 day', ts)""",
        "alarm_windows": _alarm(),
        "log_error_tail": """
            SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, upper(event_type) || ' ' || props AS message
            FROM events WHERE regexp_matches(upper(event_type) || ' ' || props, 'ERROR|FAILED|Exception')
            ORDER BY events.ts DESC, event_id DESC LIMIT 20""",
        "arrival_events_parse": f"""
            SELECT page_id, {_HOST} AS bucket, 'raw/pages/' || page_id || '.csv' AS key,
                   CAST(length(html) AS BIGINT) AS size FROM pages
            UNION ALL SELECT page_id, {_HOST}, 'raw/late/' || page_id || '.csv', 0 FROM pages""",
        # Streaming
        "stream_bronze": _with("retailer_raw", f"""
            SELECT retailer_id, week, avg_weekly_revenue, '{LOAD_TIME[:10]}' AS ingestion_date FROM retailer_raw"""),
        "stream_dedup": "SELECT DISTINCT event_id, user_id, event_type, value FROM events",
        "stream_late_rows": """
            WITH mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 DAY AS w FROM events WHERE event_id % 2 = 0),
            told AS (SELECT coalesce(event_id % 2 = 1 AND ts <= w, false) AS is_late FROM events, mark)
            SELECT count(*) FILTER (is_late) AS late, count(*) FILTER (NOT is_late) AS kept FROM told""",
        "stream_metric_rollup": _bucketed("1 hour", _closed("1 hour")),
        "stream_alarm": _alarm(_closed("5 minutes")),
        "stream_upsert": _with("unmatched", f"""
            SELECT * REPLACE ({_DAY}) FROM unmatched UNION ALL SELECT * REPLACE ({_DAY}) FROM staged"""),
        "stream_upsert_ordered": _with("unmatched", f"""
            SELECT * REPLACE ({_DAY}) FROM unmatched UNION ALL SELECT * REPLACE ({_DAY}) FROM staged"""),
        "stream_bronze_routed": _with("retailer_raw district_raw", """
            SELECT 'retailer' AS dataset, retailer_id AS key, week AS period, avg_weekly_revenue AS measure FROM retailer_raw
            UNION ALL SELECT 'district', district, date, precip_mm_7d FROM district_raw"""),
    }
