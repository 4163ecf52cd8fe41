from oracle.views import S

APP_FEATURES = f"""
WITH a AS (SELECT * FROM app WHERE phone_no_m IS NOT NULL)
SELECT phone_no_m, count(DISTINCT busi_name) AS busi_count,
       {S("avg(flow)", "flow_mean")}, {S("median(flow)", "flow_median")},
       {S("min(flow)", "flow_min")}, {S("max(flow)", "flow_max")},
       {S("var_samp(flow)", "flow_var")}, {S("coalesce(sum(flow), 0)", "flow_sum")},
       count(DISTINCT month_id) AS month_ids,
       {S("coalesce(sum(flow), 0) / NULLIF(count(DISTINCT month_id), 0)", "flow_month")}
FROM a GROUP BY phone_no_m
"""

APP_MONTHS = """
SELECT phone_no_m, count(DISTINCT month_id) AS app_month
FROM app WHERE phone_no_m IS NOT NULL GROUP BY phone_no_m
"""

MONTHLY_FLOW_CHANGE = f"""
WITH pm AS (
  SELECT phone_no_m, month_id, coalesce(sum(flow), 0) AS month_flow
  FROM app WHERE phone_no_m IS NOT NULL AND month_id IS NOT NULL GROUP BY phone_no_m, month_id)
SELECT phone_no_m, month_id, {S("month_flow", "month_flow")},
       {S("month_flow - lag(month_flow) OVER (PARTITION BY phone_no_m ORDER BY month_id)", "flow_change")}
FROM pm
"""

SMS_FEATURES_A = f"""
WITH base AS (
  SELECT *, CAST(hour(request_datetime) AS INTEGER) AS h, CAST(day(request_datetime) AS INTEGER) AS dd
  FROM sms WHERE phone_no_m IS NOT NULL),
m AS (
  SELECT phone_no_m, count(opposite_no_m) AS sms_count, count(DISTINCT opposite_no_m) AS sms_nunique,
         count(*) FILTER (WHERE calltype_id = 2) AS n2,
         count(DISTINCT h) AS hour_nunique, count(DISTINCT dd) AS day_nunique
  FROM base GROUP BY phone_no_m),
hc AS (
  SELECT phone_no_m, h, count(*) AS n,
         row_number() OVER (PARTITION BY phone_no_m ORDER BY count(*) DESC, h) AS rk
  FROM base WHERE h IS NOT NULL GROUP BY phone_no_m, h),
dc AS (
  SELECT phone_no_m, dd, count(*) AS n,
         row_number() OVER (PARTITION BY phone_no_m ORDER BY count(*) DESC, dd) AS rk
  FROM base WHERE dd IS NOT NULL GROUP BY phone_no_m, dd)
SELECT m.phone_no_m, sms_count, sms_nunique,
       {S("sms_count / NULLIF(sms_nunique, 0)", "sms_rate")},
       NULLIF(n2, 0) AS calltype_2,
       {S("NULLIF(n2, 0) / NULLIF(sms_count, 0)", "calltype_rate")},
       hc.h AS hour_mode, hc.n AS hour_mode_count, hour_nunique,
       dc.dd AS day_mode, dc.n AS day_mode_count, day_nunique
FROM m LEFT JOIN hc ON hc.phone_no_m = m.phone_no_m AND hc.rk = 1
       LEFT JOIN dc ON dc.phone_no_m = m.phone_no_m AND dc.rk = 1
"""

SMS_FEATURES_B = """
SELECT phone_no_m, count(DISTINCT opposite_no_m) AS opposite_no_m_nunique,
       CAST(coalesce(sum(calltype_id - 1), 0) AS BIGINT) AS calltype_id_sum,
       count(DISTINCT request_datetime) AS request_datetime_nunique
FROM sms WHERE phone_no_m IS NOT NULL GROUP BY phone_no_m
"""

USER_ARPU_MEAN = f"""
SELECT phone_no_m, city_name, county_name, label, split,
       {S("(arpu_1 + arpu_2 + arpu_3 + arpu_4 + arpu_5) / 5.0", "arpu_")}
FROM users
"""

CONTACT_PAIR_STATS = f"""
SELECT phone_no_m, opposite_no_m, count(call_dur) AS count, {S("coalesce(sum(call_dur), 0)", "sum")}
FROM voice WHERE phone_no_m IS NOT NULL AND opposite_no_m IS NOT NULL
GROUP BY phone_no_m, opposite_no_m
"""

HOUR_MODE = """
WITH hc AS (
  SELECT phone_no_m, CAST(hour(request_datetime) AS INTEGER) AS h, count(*) AS n
  FROM sms WHERE phone_no_m IS NOT NULL AND request_datetime IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY phone_no_m ORDER BY n DESC, h) AS rk,
             count(*) OVER (PARTITION BY phone_no_m) AS k FROM hc)
SELECT phone_no_m, h AS hour_mode, n AS hour_mode_count, k AS hour_nunique FROM r WHERE rk = 1
"""

DAY_MODE = """
WITH dc AS (
  SELECT phone_no_m, CAST(day(start_datetime) AS INTEGER) AS dd, count(*) AS n
  FROM voice WHERE phone_no_m IS NOT NULL AND start_datetime IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY phone_no_m ORDER BY n DESC, dd) AS rk,
             count(*) OVER (PARTITION BY phone_no_m) AS k FROM dc)
SELECT phone_no_m, dd AS voc_day_mode, n AS voc_day_mode_count, k AS voc_day_nunique FROM r WHERE rk = 1
"""

QUERIES = {
    "app_features": APP_FEATURES,
    "app_months": APP_MONTHS,
    "monthly_flow_change": MONTHLY_FLOW_CHANGE,
    "sms_features_a": SMS_FEATURES_A,
    "sms_features_b": SMS_FEATURES_B,
    "user_arpu_mean": USER_ARPU_MEAN,
    "contact_pair_stats": CONTACT_PAIR_STATS,
    "hour_mode": HOUR_MODE,
    "day_mode": DAY_MODE,
}
