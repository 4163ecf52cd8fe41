from oracle.views import S

VOICE_FEATURES_A = f"""
WITH base AS (
  SELECT *, CAST(hour(start_datetime) AS INTEGER) AS h, CAST(day(start_datetime) AS INTEGER) AS dd
  FROM voice WHERE phone_no_m IS NOT NULL),
main AS (
  SELECT phone_no_m,
         count(opposite_no_m) AS opposite_count,
         count(DISTINCT opposite_no_m) AS opposite_unique,
         count(*) FILTER (WHERE calltype_id = 1) AS n1,
         count(imei_m) FILTER (WHERE calltype_id = 1) AS n1_imei,
         count(DISTINCT imei_m) FILTER (WHERE calltype_id = 1) AS imeis1,
         count(DISTINCT city_name) FILTER (WHERE calltype_id = 1) AS city1,
         count(DISTINCT county_name) FILTER (WHERE calltype_id = 1) AS county1,
         avg(call_dur) AS dmean, median(call_dur) AS dmed, max(call_dur) AS dmax, min(call_dur) AS dmin,
         count(DISTINCT city_name) AS city_name_nunique,
         count(DISTINCT county_name) AS county_name_nunique,
         count(DISTINCT calltype_id) AS calltype_id_unique,
         count(DISTINCT h) AS voc_hour_nunique,
         count(DISTINCT dd) AS voc_day_nunique
  FROM base GROUP BY phone_no_m),
pair AS (
  SELECT phone_no_m, opposite_no_m, count(call_dur) AS c, coalesce(sum(call_dur), 0) AS s
  FROM base WHERE opposite_no_m IS NOT NULL GROUP BY phone_no_m, opposite_no_m),
pair_stats AS (
  SELECT phone_no_m, avg(c) AS c_mean, median(c) AS c_med, max(c) AS c_max,
         avg(s) AS s_mean, median(s) AS s_med, max(s) AS s_max
  FROM pair GROUP BY phone_no_m),
hc AS (
  SELECT phone_no_m, h, count(*) AS n,
         row_number() OVER (PARTITION BY phone_no_m ORDER BY count(*) DESC, h ASC) AS rk
  FROM base WHERE h IS NOT NULL GROUP BY phone_no_m, h),
dc AS (
  SELECT phone_no_m, dd, count(*) AS n,
         row_number() OVER (PARTITION BY phone_no_m ORDER BY count(*) DESC, dd ASC) AS rk
  FROM base WHERE dd IS NOT NULL GROUP BY phone_no_m, dd)
SELECT m.phone_no_m, m.opposite_count, m.opposite_unique,
       CASE WHEN m.n1 > 0 THEN m.n1_imei END AS voccalltype1,
       CASE WHEN m.n1 > 0 THEN m.imeis1 END AS imeis,
       {S("CASE WHEN m.n1 > 0 THEN m.n1_imei / NULLIF(m.opposite_count, 0) END", "voc_calltype1")},
       CASE WHEN m.n1 > 0 THEN m.city1 END AS city_name_call,
       CASE WHEN m.n1 > 0 THEN m.county1 END AS county_name_call,
       {S("p.c_mean", "phone2opposite_mean")}, {S("p.c_med", "phone2opposite_median")},
       p.c_max AS phone2opposite_max,
       {S("p.s_mean", "phone2oppo_sum_mean")}, {S("p.s_med", "phone2oppo_sum_median")},
       {S("p.s_max", "phone2oppo_sum_max")},
       {S("m.dmean", "call_dur_mean")}, {S("m.dmed", "call_dur_median")},
       {S("m.dmax", "call_dur_max")}, {S("m.dmin", "call_dur_min")},
       m.city_name_nunique, m.county_name_nunique, m.calltype_id_unique,
       hc.h AS voc_hour_mode, hc.n AS voc_hour_mode_count, m.voc_hour_nunique,
       dc.dd AS voc_day_mode, dc.n AS voc_day_mode_count, m.voc_day_nunique
FROM main m
LEFT JOIN pair_stats p ON p.phone_no_m = m.phone_no_m
LEFT JOIN hc ON hc.phone_no_m = m.phone_no_m AND hc.rk = 1
LEFT JOIN dc ON dc.phone_no_m = m.phone_no_m AND dc.rk = 1
"""

_DATED = """base AS (
  SELECT *, CAST(start_datetime AS DATE) AS d FROM voice WHERE phone_no_m IS NOT NULL)"""

def _voice_features_b(S=S):
    return f"""
WITH {_DATED},
m AS (
  SELECT phone_no_m,
         count(DISTINCT opposite_no_m) AS oppsite_no_m_voc_nunique,
         count(*) FILTER (WHERE calltype_id = 1) AS n1,
         count(*) FILTER (WHERE calltype_id = 2) AS n2,
         count(DISTINCT opposite_no_m) FILTER (WHERE calltype_id = 1) AS diff1,
         count(DISTINCT opposite_no_m) FILTER (WHERE calltype_id = 2) AS diff2,
         count(start_datetime) AS start_datetime_count,
         count(DISTINCT d) AS date_unique,
         avg(call_dur) AS call_dur_mean,
         count(DISTINCT city_name) AS city_name_nunique,
         count(DISTINCT county_name) AS county_name_nunique,
         count(DISTINCT imei_m) AS imei_m_nunique,
         count(d) FILTER (WHERE calltype_id = 1) AS n1_dated,
         count(DISTINCT d) FILTER (WHERE calltype_id = 1) AS dates1,
         count(*) FILTER (WHERE calltype_id = 1 AND call_dur < 5) AS n1_short,
         coalesce(sum(call_dur), 0) AS dure_sum
  FROM base GROUP BY phone_no_m)
SELECT phone_no_m, oppsite_no_m_voc_nunique,
       CASE WHEN n1 > 0 THEN diff1 END AS call_diff_01,
       CASE WHEN n2 > 0 THEN diff2 END AS call_diff_02,
       start_datetime_count, date_unique, {S("call_dur_mean", "call_dur_mean")},
       city_name_nunique, county_name_nunique, imei_m_nunique,
       {S("n1_dated / NULLIF(dates1, 0)", "averge_call_01")},
       {S("CASE WHEN n1_short > 0 THEN n1_short / n1 END", "ratio")},
       {S("dure_sum", "dure_sum")}
FROM m
"""


VOICE_FEATURES_B = _voice_features_b()
VOICE_FEATURES_B_RAW = _voice_features_b(lambda e, n: f"CAST(({e}) AS DOUBLE) AS {n}")

SHORT_CALL_RATIO = f"""
SELECT phone_no_m,
       CASE WHEN count(*) FILTER (WHERE call_dur < 5) > 0 THEN count(*) FILTER (WHERE call_dur < 5) END AS tmp1,
       count(calltype_id) AS tmp2,
       {S("CASE WHEN count(*) FILTER (WHERE call_dur < 5) > 0 THEN count(*) FILTER (WHERE call_dur < 5) / count(calltype_id) END", "ratio")}
FROM voice WHERE phone_no_m IS NOT NULL AND calltype_id = 1
GROUP BY phone_no_m
"""

VOICE_DIRECTION_COUNTS = f"""
WITH {_DATED}
SELECT phone_no_m, count(opposite_no_m) AS call_sum,
       CASE WHEN count(*) FILTER (WHERE calltype_id = 1) > 0
            THEN count(opposite_no_m) FILTER (WHERE calltype_id = 1) END AS call_sum_01,
       CASE WHEN count(*) FILTER (WHERE calltype_id = 2) > 0
            THEN count(opposite_no_m) FILTER (WHERE calltype_id = 2) END AS call_sum_02,
       CASE WHEN count(*) FILTER (WHERE calltype_id = 1) > 0
            THEN count(DISTINCT d) FILTER (WHERE calltype_id = 1) END AS date_unique_01,
       CASE WHEN count(*) FILTER (WHERE calltype_id = 2) > 0
            THEN count(DISTINCT d) FILTER (WHERE calltype_id = 2) END AS date_unique_02
FROM base GROUP BY phone_no_m
"""

VOICE_BUSIEST_DAY = f"""
WITH {_DATED},
per_day AS (
  SELECT phone_no_m, d, count(*) AS n,
         count(*) FILTER (WHERE calltype_id = 1) AS n1,
         count(*) FILTER (WHERE calltype_id = 2) AS n2
  FROM base WHERE d IS NOT NULL GROUP BY phone_no_m, d),
phones AS (SELECT DISTINCT phone_no_m FROM base)
SELECT p.phone_no_m, max(n) AS call_day_max,
       max(n1) FILTER (WHERE n1 > 0) AS call_day_01_max,
       max(n2) FILTER (WHERE n2 > 0) AS call_day_02_max
FROM phones p LEFT JOIN per_day USING (phone_no_m)
GROUP BY p.phone_no_m
"""

VOICE_DURATION_SPREAD = f"""
SELECT phone_no_m, {S("stddev_samp(call_dur)", "dure_std")}, {S("avg(call_dur)", "dure_mean")}
FROM voice WHERE phone_no_m IS NOT NULL GROUP BY phone_no_m
"""

CALLS_PER_ACTIVE_DAY = f"""
WITH {_DATED}
SELECT phone_no_m,
       {S("count(d) / NULLIF(count(DISTINCT d), 0)", "averge_call")},
       {S("count(d) FILTER (WHERE calltype_id = 1) / NULLIF(count(DISTINCT d) FILTER (WHERE calltype_id = 1), 0)", "averge_call_01")},
       {S("count(d) FILTER (WHERE calltype_id = 2) / NULLIF(count(DISTINCT d) FILTER (WHERE calltype_id = 2), 0)", "averge_call_02")}
FROM base GROUP BY phone_no_m
"""

DAILY_MEAN_DURATION = f"""
WITH {_DATED}
SELECT phone_no_m, d AS date, {S("avg(call_dur)", "dur_mean")},
       {S("avg(call_dur) FILTER (WHERE calltype_id = 1)", "dur_mean_out")},
       {S("avg(call_dur) FILTER (WHERE calltype_id = 2)", "dur_mean_in")}
FROM base WHERE d IS NOT NULL GROUP BY phone_no_m, d
"""

DAILY_IN_OUT_RATIO = f"""
WITH {_DATED},
per_day AS (
  SELECT phone_no_m, d,
         CAST(count(*) FILTER (WHERE calltype_id = 2) AS DOUBLE)
           / NULLIF(count(*) FILTER (WHERE calltype_id = 1), 0) AS r
  FROM base WHERE d IS NOT NULL GROUP BY phone_no_m, d)
SELECT phone_no_m, {S("avg(r)", "in_out_ratio_mean")}, count(d) AS active_days
FROM per_day GROUP BY phone_no_m
"""

_DIRECTIONS = {"": "true", "_out": "calltype_id = 1", "_in": "calltype_id = 2"}


def _class_measures(cell) -> str:
    """C10's per-phone measures; ``cell(expr, name)`` writes a double."""
    some = lambda when, e: f"CASE WHEN count(*) FILTER (WHERE {when}) > 0 THEN {e} END"
    cols, per_day, day_cols = [], [], []
    for end, when in _DIRECTIONS.items():
        cols += [f"{some(when, f'count(opposite_no_m) FILTER (WHERE {when})')} AS calls{end}",
                 f"{some(when, f'count(DISTINCT opposite_no_m) FILTER (WHERE {when})')} AS contacts{end}",
                 f"{some(when, f'count(DISTINCT d) FILTER (WHERE {when})')} AS days{end}"]
        per_day.append(f"nullif(count(*) FILTER (WHERE {when}), 0) AS n{end}")
        day_cols += [f"max(n{end}) AS day_max{end}", f"CAST(sum(n{end}) AS DOUBLE) / count(n{end}) AS mean{end}"]
    short = some("calltype_id = 1", "CAST(count(*) FILTER (WHERE calltype_id = 1 AND call_dur < 5) AS DOUBLE) "
                                    "/ count(*) FILTER (WHERE calltype_id = 1)")
    return f"""
WITH {_DATED},
main AS (SELECT phone_no_m, {", ".join(cols)}, coalesce(sum(call_dur), 0) AS seconds_, {short} AS short_
         FROM base GROUP BY phone_no_m),
pd AS (SELECT phone_no_m, d, {", ".join(per_day)} FROM base WHERE d IS NOT NULL GROUP BY phone_no_m, d),
days AS (SELECT phone_no_m, {", ".join(day_cols)} FROM pd GROUP BY phone_no_m)
SELECT main.phone_no_m, {", ".join(f"main.{c}{e}" for e in _DIRECTIONS for c in ("calls", "contacts", "days"))},
       {", ".join(f"days.day_max{e}" for e in _DIRECTIONS)},
       {", ".join(cell(f"days.mean{e}", f"day_mean{e}") for e in _DIRECTIONS)},
       {cell("main.seconds_", "seconds")}, {cell("main.short_", "short_share")}
FROM main LEFT JOIN days ON days.phone_no_m = main.phone_no_m
"""


VOICE_CLASS_MEASURES = _class_measures(S)
VOICE_CLASS_MEASURES_RAW = _class_measures(lambda e, n: f"CAST(({e}) AS DOUBLE) AS {n}")

QUERIES = {
    "voice_class_measures": VOICE_CLASS_MEASURES,
    "voice_features_a": VOICE_FEATURES_A,
    "voice_features_b": VOICE_FEATURES_B,
    "short_call_ratio": SHORT_CALL_RATIO,
    "voice_direction_counts": VOICE_DIRECTION_COUNTS,
    "voice_busiest_day": VOICE_BUSIEST_DAY,
    "voice_duration_spread": VOICE_DURATION_SPREAD,
    "calls_per_active_day": CALLS_PER_ACTIVE_DAY,
    "daily_mean_duration": DAILY_MEAN_DURATION,
    "daily_in_out_ratio": DAILY_IN_OUT_RATIO,
}
