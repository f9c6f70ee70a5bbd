"""The stand-in views and shared intermediate tables once more, as DuckDB SQL for the check queries."""

from __future__ import annotations

CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (needs, body.strip())


def with_ctes(needs: str, body: str) -> str:
    """Prefix ``body`` with the named CTEs and everything they need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0].split():
            visit(dep)
        order.append(name)

    for n in needs.split():
        visit(n)
    if not order:
        return body
    head = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


cte("ev", "", """
SELECT user_id AS user_key,
       CAST(date_diff('day', DATE '2024-01-02', CAST(ts AS DATE)) AS INTEGER) AS date,
       CAST(extract(hour FROM ts) AS INTEGER) AS hour,
       strftime(ts, '%H:%M:%S') AS hms, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events
""")
cte("raw_minutes", "ev", """
SELECT user_key, date, CASE WHEN k = 77 THEN '25:00:00' ELSE hms END AS time,
       CAST(CASE WHEN event_type = 'view' THEN 100 + k % 25 ELSE k END AS DOUBLE) AS activity_type,
       CASE WHEN event_type <> 'signup' THEN value / 2 END AS intensity,
       CAST(k - 5 AS DOUBLE) AS steps,
       CASE WHEN event_type = 'click' THEN value - 10 WHEN event_type <> 'error' THEN value END AS hr
FROM ev
""")
cte("minutes", "raw_minutes", """
SELECT user_key, date, time, activity_type, intensity, steps, hr, minutes_from_midnight,
       date * 1440 + minutes_from_midnight AS relative_minute
FROM (
  SELECT user_key, date, time, activity_type, intensity,
         CASE WHEN steps >= 0 THEN steps END AS steps, CASE WHEN hr > 0 THEN hr END AS hr,
         CAST(extract(hour FROM try_strptime(time, '%H:%M:%S')) * 60
              + extract(minute FROM try_strptime(time, '%H:%M:%S')) AS BIGINT) AS minutes_from_midnight
  FROM (SELECT DISTINCT * FROM raw_minutes) WHERE date >= 0)
WHERE minutes_from_midnight IS NOT NULL
""")
cte("minutes_a", "minutes", """
SELECT *, CAST(activity_group IN ('walk', 'running', 'activity_high') AS INTEGER) AS is_active_minute,
       CAST(minutes_from_midnight >= 360 AND minutes_from_midnight < 1320 AS INTEGER) AS is_day
FROM (
  SELECT *, CASE WHEN activity_type IN (1, 16, 33) THEN 'walk' WHEN activity_type IN (66, 82, 98) THEN 'running'
    WHEN activity_type = 17 THEN 'activity_high' WHEN activity_type IN (80, 89, 90, 91, 92, 96) THEN 'sedentary'
    WHEN activity_type IN (106, 112, 121, 122, 123) THEN 'sleep' WHEN activity_type = 3 THEN 'not_worn'
    WHEN activity_type = 6 THEN 'charging' ELSE 'unknown' END AS activity_group
  FROM minutes)
""")
cte("inhaler", "ev", """
SELECT user_key, date, CASE WHEN k = 0 THEN 24 ELSE hour END AS hour,
       CASE WHEN k % 10 <> 9 THEN 'med_' || (k % 3) END AS name
FROM ev WHERE event_type IN ('click', 'purchase')
""")
cte("peakflow", "ev", """
SELECT user_key, date, hour, CASE WHEN k % 7 = 0 THEN 0.0 ELSE value * 3 END AS pef_max,
       CASE WHEN k <> 50 THEN hour < 12 END AS morning
FROM ev WHERE event_type = 'view'
""")
cte("environment", "ev", """
SELECT user_key, date, value AS temperature, value - k / 10.0::DOUBLE AS temperature_min,
       value + k / 10.0::DOUBLE AS temperature_max, CAST(1000 + k AS DOUBLE) AS pressure, CAST(k AS DOUBLE) AS humidity,
       value / 10 AS wind_speed, CAST((k * 3) % 360 AS DOUBLE) AS wind_deg, CAST(1 + k % 5 AS DOUBLE) AS aqi,
       value * 2 AS co, value / 4 AS no, value / 5 AS no2, value / 6 AS o3, value / 7 AS so2, value / 8 AS pm2_5,
       value / 3 AS pm10, value / 9 AS nh3,
       (['low', 'Moderate', 'HIGH', 'Very High', 'none'])[k % 6 + 1] AS grass_pollen,
       (['low', 'Moderate', 'HIGH', 'Very High', 'none'])[(k // 2) % 6 + 1] AS tree_pollen,
       (['low', 'Moderate', 'HIGH', 'Very High', 'none'])[(k // 3) % 6 + 1] AS weed_pollen
FROM ev WHERE event_type = 'signup'
""")
cte("patient", "", """
SELECT c_custkey AS user_key, c_mktsegment AS sex,
       CASE WHEN c_nationkey % 5 <> 4 THEN 'r' || (c_nationkey % 5) END AS region,
       CAST(350 + c_nationkey AS DOUBLE) AS max_pef_expected,
       CAST(CASE WHEN c_custkey % 4 <> 0 THEN 300 + c_nationkey * 10 END AS DOUBLE) AS pef_best,
       CAST(c_nationkey % 3 AS DOUBLE) AS n_inhalers, c_acctbal / 100 AS pack_years
FROM customer
""")
cte("weekly", "ev", """
SELECT user_key, week_date AS date,
       CAST(least(count(*) FILTER (event_type = 'click'), 6) AS INTEGER) AS weekly_night_symp,
       CAST(least(count(*) FILTER (event_type = 'view'), 6) AS INTEGER) AS weekly_day_symp,
       CAST(least(count(*) FILTER (event_type = 'purchase'), 6) AS INTEGER) AS weekly_limit_activity,
       CAST(least(count(*) FILTER (event_type = 'signup'), 6) AS INTEGER) AS weekly_short_breath,
       CAST(least(count(*) FILTER (event_type = 'error'), 6) AS INTEGER) AS weekly_wheeze,
       CAST(least(count(*) // 3, 6) AS INTEGER) AS weekly_relief_inhaler,
       coalesce(array_to_string(list_sort(list(DISTINCT o) FILTER (event_type = 'error' AND k < 5)), ','),
                CASE count(*) % 4 WHEN 0 THEN NULL WHEN 1 THEN '-9' ELSE '0' END) AS weekly_doc,
       coalesce(array_to_string(list_sort(list(DISTINCT o) FILTER (event_type = 'error' AND k = 12)), ','), '0') AS weekly_hospital,
       array_to_string(list_sort(list(DISTINCT o) FILTER (event_type = 'error' AND k = 14)), ',') AS weekly_er,
       CAST(1 + least(count(*) FILTER (k >= 97), 2) AS INTEGER) AS weekly_oral
FROM (SELECT *, date - week_date AS o FROM
       (SELECT *, CAST((floor(date / 7.0) + 1) * 7 AS INTEGER) AS week_date FROM ev))
GROUP BY user_key, week_date
""")
cte("daily", "ev", """
SELECT user_key, date, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'True' END AS daily_night_symp,
       CASE WHEN count(*) FILTER (event_type = 'view') >= 2 THEN 'true' ELSE 'False' END AS daily_day_symp,
       max(value) > 100 AS daily_limit_activity, CAST(1 + max(k) % 5 AS INTEGER) AS daily_prev_inhaler,
       ([0, 1, 3, 5, 9, 12, 7])[CAST(sum(k) % 7 AS INTEGER) + 1] AS daily_relief_inhaler,
       array_to_string(list_sort(list(DISTINCT k % 20)), ', ') AS daily_triggers
FROM ev WHERE date >= 0 GROUP BY user_key, date
""")
cte("preds", "", """
SELECT lang AS config, source AS user_key, doc_id AS sample_id, CAST(toxic AS INTEGER) AS y_true,
       (n_chars % 1000) / 1000.0::DOUBLE AS y_prob
FROM documents JOIN labels USING (doc_id)
""")
cte("trials", "", """
SELECT p_partkey AS trial_id, lower(p_type) AS algo, p_brand AS subset, CAST(p_partkey % 5 AS INTEGER) AS seed,
       ([2, 3, 4])[p_partkey % 3 + 1] AS threshold, ([7, 14, 28])[(p_partkey // 3) % 3 + 1] AS input_length_days,
       ([0, 7, 14])[(p_partkey // 9) % 3 + 1] AS washout_days,
       (p_partkey * 37) % 100 / 100.0::DOUBLE AS train_pr_auc,
       CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 53) % 97 / 100.0::DOUBLE END AS val_pr_auc,
       (p_partkey * 29) % 89 / 100.0::DOUBLE AS val_roc_auc, (p_partkey * 31) % 83 / 100.0::DOUBLE AS val_f1,
       (p_partkey * 43) % 79 / 100.0::DOUBLE AS val_recall,
       CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 41) % 73 / 100.0::DOUBLE END AS val_recall_at_precision_floor,
       (p_partkey * 47) % 71 / 100.0::DOUBLE AS val_precision_at_recall_floor,
       (p_partkey * 59) % 67 / 100.0::DOUBLE AS val_brier,
       CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey * 61) % 91 / 100.0::DOUBLE END AS test_pr_auc,
       (p_partkey * 67) % 93 / 100.0::DOUBLE AS test_roc_auc, (p_partkey * 71) % 87 / 100.0::DOUBLE AS test_f1,
       CAST(p_size AS INTEGER) AS n_features,
       CAST(CASE WHEN p_size % 4 <> 0 THEN p_size % 4 END AS INTEGER) AS param_max_depth,
       CASE WHEN p_partkey % 2 = 0 THEN 'auto' ELSE CAST(p_partkey % 7 AS VARCHAR) END AS param_scale_pos_weight
FROM part
""")
cte("vectors", "", """
SELECT vec_id AS sample_id, CAST(vec_id % 12 AS INTEGER) AS user_key, CAST(label AS INTEGER) AS label,
       CAST(label >= 7 AS INTEGER) AS target, CAST(embedding AS DOUBLE[]) AS embedding
FROM embeddings
""")
