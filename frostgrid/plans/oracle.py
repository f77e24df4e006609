"""SQL for DuckDB that states each registered query a second time."""

HOURLY_BY_TYPE = """
hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS ts, max(value) AS max_value
  FROM events GROUP BY 1, 2),
bounds AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1),
grid AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM bounds),
filled AS (SELECT event_type, ts, max_value FROM grid LEFT JOIN hourly USING (event_type, ts))
"""

# Consecutive rows of the full grid where the condition holds share n - m.
SPELLS = """
WITH {hourly},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM filled),
held AS (
  SELECT *, n - row_number() OVER (PARTITION BY event_type ORDER BY ts) AS spell
  FROM numbered WHERE max_value >= {limit})
SELECT event_type, min(ts) AS spell_start, max(ts) AS spell_end, count(*) AS n_steps, {measures}
FROM held GROUP BY event_type, spell HAVING count(*) >= {min_len}
"""

INTERVALS = """
WITH outages AS (
  SELECT event_id, user_id, ts AS s, ts + INTERVAL 6 HOUR AS e FROM events WHERE event_type = 'error'),
crews AS (
  SELECT event_id, user_id, ts AS s, ts + INTERVAL 3 HOUR AS e FROM events WHERE event_type = 'signup')
"""

OVERLAP = """
SELECT o.event_id, o.user_id, o.s AS "start", o.e AS "end",
  c.event_id AS event_id_right, {extra} c.s AS start_right, c.e AS end_right,
  CASE WHEN c.s IS NOT NULL THEN greatest(o.s, c.s) END AS overlap_start,
  CASE WHEN c.s IS NOT NULL THEN least(o.e, c.e) END AS overlap_end
FROM outages o {join} crews c ON {key} o.s < c.e AND c.s < o.e
"""

AS_OF = """
WITH errors AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'error'),
views AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view'),
matched AS (
  SELECT e.*, v.event_id AS v_id, v.ts AS v_ts, v.value AS v_value,
    row_number() OVER (PARTITION BY e.event_id ORDER BY v.ts DESC) AS nth
  FROM errors e LEFT JOIN views v ON v.user_id = e.user_id AND v.ts <= e.ts {within})
SELECT event_id, user_id, ts, value, v_id AS event_id_right, v_ts AS ts_right, v_value AS value_right
FROM matched WHERE nth = 1
"""

ORACLE_SQL: dict[str, str] = {
    "resample_hourly": """
SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n, round(avg(value), 6) AS avg_value,
  min(value) AS min_value, max(value) AS max_value
FROM events GROUP BY 1, 2
""",
    "resample_monthly": """
SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS o_orderdate,
  count(*) AS n, round(sum(o_totalprice), 2) AS sum_price, max(o_totalprice) AS max_price
FROM orders GROUP BY 1, 2
""",
    "gap_fill_null": f"WITH {HOURLY_BY_TYPE} SELECT event_type, ts, max_value FROM filled",
    "gap_fill_last": f"""
WITH {HOURLY_BY_TYPE.replace("event_type", "user_id")}
SELECT user_id, ts, last_value(max_value IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_value
FROM filled
""",
    "threshold_spell": SPELLS.format(
        hourly=HOURLY_BY_TYPE, limit=100, min_len=1, measures="max(max_value) AS peak"
    ),
    "threshold_spell_long": SPELLS.format(
        hourly=HOURLY_BY_TYPE, limit=50, min_len=3,
        measures="min(max_value) AS lowest, round(avg(max_value), 6) AS mean_peak",
    ),
    "sessions": """
WITH marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR
    THEN 0 ELSE 1 END AS opens
  FROM events),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end,
  count(*) AS n, round(sum(value), 2) AS sum_value, max(value) AS peak
FROM numbered GROUP BY user_id, session
""",
    "as_of": AS_OF.format(within=""),
    "as_of_within": AS_OF.format(within="AND e.ts - v.ts <= INTERVAL 12 HOUR"),
    "overlap_by_user": INTERVALS + OVERLAP.format(extra="", join="JOIN", key="o.user_id = c.user_id AND"),
    "overlap_by_user_left": INTERVALS
    + OVERLAP.format(extra="", join="LEFT JOIN", key="o.user_id = c.user_id AND"),
    "overlap_any_user": INTERVALS + OVERLAP.format(extra="c.user_id AS user_id_right,", join="JOIN", key=""),
    "overlap_counts_any_user": INTERVALS + """
SELECT o.event_id, o.user_id, o.s AS "start", o.e AS "end", count(c.event_id) AS overlaps
FROM outages o LEFT JOIN crews c ON o.s < c.e AND c.s < o.e GROUP BY ALL
""",
    "rolling_zscores": """
WITH framed AS (
  SELECT event_id, user_id, ts, value,
    avg(value) OVER w AS mean, stddev_samp(value) OVER w AS deviation
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, ts, value, round((value - mean) / nullif(deviation, 0), 6) AS zscore
FROM framed
""",
    "quantiles": """
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY 1
""",
    "quantiles_approx": """
SELECT event_type, count(value) AS n, true AS p5_within, true AS p50_within, true AS p95_within
FROM events GROUP BY 1
""",
    "rollup_by_place": """
SELECT r_name, n_name, grouping_id(r_name, n_name) AS grouping_id,
  count(*) AS n_orders, round(sum(o_totalprice), 2) AS sum_price
FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)
""",
    "top_readings": """
SELECT * FROM (
  SELECT event_type, event_id, ts, value,
    row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
  FROM events)
WHERE rank <= 10
""",
    "stream_resample_daily": """
WITH days AS (
  SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, count(*) AS n,
    round(avg(value), 6) AS avg_value, max(value) AS max_value
  FROM events GROUP BY 1, 2)
SELECT *, ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed FROM days
""",
}

SMALL_LIMITS = "_small_limits"
ORACLE_SQL |= {
    name + SMALL_LIMITS: ORACLE_SQL[name]
    for name in (
        "gap_fill_last", "threshold_spell", "sessions", "as_of", "overlap_any_user", "overlap_by_user", "overlap_counts_any_user",
        "rolling_zscores", "quantiles",
    )
}
