from oracle import blocks_sql, voice_sql
from oracle.views import S

_USERS_SPLIT = """us AS (
  SELECT phone_no_m, city_name, county_name, arpu_1, arpu_2, arpu_3, arpu_4, arpu_5,
         CASE WHEN split = 'train' THEN label END AS label, split FROM users)"""

_CODES = """cc AS (
  SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT coalesce(city_name, 'nan') AS v FROM users)),
kc AS (
  SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT coalesce(county_name, 'nan') AS v FROM users))"""

DATASET_LEFT = f"""
WITH {_USERS_SPLIT}, {_CODES},
af AS ({blocks_sql.APP_FEATURES}),
vf AS ({voice_sql.VOICE_FEATURES_A}),
sf AS ({blocks_sql.SMS_FEATURES_A})
SELECT us.phone_no_m, cc.code AS city_name, kc.code AS county_name, {S("us.arpu_5", "arpu_last")},
       us.label, us.split,
       af.* EXCLUDE (phone_no_m), vf.* EXCLUDE (phone_no_m), sf.* EXCLUDE (phone_no_m)
FROM us
JOIN cc ON cc.v = coalesce(us.city_name, 'nan')
JOIN kc ON kc.v = coalesce(us.county_name, 'nan')
LEFT JOIN af ON af.phone_no_m = us.phone_no_m
LEFT JOIN vf ON vf.phone_no_m = us.phone_no_m
LEFT JOIN sf ON sf.phone_no_m = us.phone_no_m
"""

_OUTER = f"""{_USERS_SPLIT},
u4 AS (SELECT phone_no_m, city_name, county_name, label, split,
              {S("(arpu_1 + arpu_2 + arpu_3 + arpu_4 + arpu_5) / 5.0", "arpu_")} FROM us),
vb AS ({voice_sql.VOICE_FEATURES_B}),
sb AS ({blocks_sql.SMS_FEATURES_B}),
am AS ({blocks_sql.APP_MONTHS}),
ds AS (
  SELECT coalesce(u4.phone_no_m, vb.phone_no_m, sb.phone_no_m, am.phone_no_m) AS phone_no_m,
         u4.* EXCLUDE (phone_no_m), vb.* EXCLUDE (phone_no_m), sb.* EXCLUDE (phone_no_m),
         am.* EXCLUDE (phone_no_m)
  FROM u4 FULL JOIN vb ON vb.phone_no_m = u4.phone_no_m
  FULL JOIN sb ON sb.phone_no_m = coalesce(u4.phone_no_m, vb.phone_no_m)
  FULL JOIN am ON am.phone_no_m = coalesce(u4.phone_no_m, vb.phone_no_m, sb.phone_no_m))"""

DATASET_OUTER = f"WITH {_OUTER} SELECT * FROM ds"

ALIGN_COLUMNS = f"WITH {_OUTER} SELECT * EXCLUDE (phone_no_m, label) FROM ds WHERE split = 'test'"

_FILL = ["arpu_", "oppsite_no_m_voc_nunique", "call_diff_01", "call_diff_02", "start_datetime_count",
         "date_unique", "call_dur_mean", "city_name_nunique", "county_name_nunique", "imei_m_nunique",
         "averge_call_01", "ratio", "dure_sum", "opposite_no_m_nunique", "calltype_id_sum",
         "request_datetime_nunique", "app_month"]
FILL_MISSING = (f"WITH {_OUTER} SELECT phone_no_m, city_name, county_name, label, split, "
                + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _FILL) + " FROM ds")

_LABELLED = "tu AS (SELECT phone_no_m, label FROM users WHERE split = 'train')"

CATEGORY_CODES = f"""
WITH {_CODES}
SELECT u.phone_no_m, cc.code AS city_name, kc.code AS county_name
FROM users u JOIN cc ON cc.v = coalesce(u.city_name, 'nan') JOIN kc ON kc.v = coalesce(u.county_name, 'nan')
"""

_FOLDS = f"""{_LABELLED},
folds AS (
  SELECT phone_no_m, label,
         CAST((row_number() OVER (PARTITION BY label ORDER BY md5('1024:' || CAST(phone_no_m AS VARCHAR)),
                                  phone_no_m) - 1) % 5 AS INTEGER) AS fold
  FROM tu)"""

STRATIFIED_FOLDS = f"WITH {_FOLDS} SELECT phone_no_m, label, fold FROM folds"

HOLDOUT_SPLIT = f"""
WITH {_LABELLED},
r AS (SELECT phone_no_m, label,
             row_number() OVER (ORDER BY md5('2020:' || CAST(phone_no_m AS VARCHAR)), phone_no_m) - 1 AS rk,
             count(*) OVER () AS n
      FROM tu)
SELECT phone_no_m, label, rk < ceil(n * 0.3) AS holdout FROM r
"""

_DUR = """dm AS (SELECT phone_no_m, avg(call_dur) AS call_dur_mean FROM voice
              WHERE phone_no_m IS NOT NULL GROUP BY 1)"""

MINMAX_SCALE = f"""
WITH {_FOLDS}, {_DUR},
j AS (SELECT f.phone_no_m, f.label, f.fold, dm.call_dur_mean FROM folds f LEFT JOIN dm USING (phone_no_m)),
e AS (SELECT fold, min(call_dur_mean) AS lo, max(call_dur_mean) AS hi FROM j GROUP BY fold)
SELECT j.phone_no_m, j.label, j.fold, {S("j.call_dur_mean", "call_dur_mean")},
       {S("CASE WHEN e.hi - e.lo = 0 THEN 0.0 ELSE (j.call_dur_mean - e.lo) / (e.hi - e.lo) END", "score")}
FROM j JOIN e USING (fold)
"""

FOLD_MEAN_BODY = f"""{_FOLDS}, {_DUR},
tr AS (SELECT f.fold, dm.call_dur_mean FROM folds f JOIN dm USING (phone_no_m)),
e AS (SELECT k.fold, min(tr.call_dur_mean) AS lo, max(tr.call_dur_mean) AS hi
      FROM (SELECT unnest(range(5)) AS fold) k JOIN tr ON tr.fold <> k.fold GROUP BY k.fold),
te AS (SELECT u.phone_no_m, dm.call_dur_mean FROM users u JOIN dm USING (phone_no_m) WHERE u.split = 'test'),
fm AS (SELECT te.phone_no_m,
              avg(CASE WHEN e.hi - e.lo = 0 THEN 0.0 ELSE (te.call_dur_mean - e.lo) / (e.hi - e.lo) END) AS prob
       FROM te, e GROUP BY te.phone_no_m)"""

FOLD_MEAN = f"WITH {FOLD_MEAN_BODY} SELECT phone_no_m, {S('prob', 'prob')} FROM fm"

_SCORES = f"""{_LABELLED}, {_DUR},
j AS (SELECT tu.phone_no_m, tu.label, dm.call_dur_mean AS x FROM tu LEFT JOIN dm USING (phone_no_m)),
s AS (SELECT phone_no_m, label,
             CASE WHEN max(x) OVER () - min(x) OVER () = 0 THEN 0.0
                  ELSE (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) END AS prob
      FROM j)"""

_CUT89 = """cut AS (SELECT round_even(quantile_cont(prob, 0.89) * 10000, 0) / 10000 AS c
               FROM s WHERE prob IS NOT NULL)"""

PERCENTILE_CUT = f"""
WITH {_SCORES}, {_CUT89}
SELECT s.phone_no_m, {S("s.prob", "prob")}, coalesce(s.prob > cut.c, false) AS label FROM s, cut
"""

FIXED_OFFSET = f"""
WITH {_SCORES} SELECT phone_no_m, {S("prob - 0.3", "label")} FROM s
"""

ENSEMBLE_CUT = f"""
WITH {FOLD_MEAN_BODY},
cut AS (SELECT round_even(quantile_cont(prob, 0.89) * 10000, 0) / 10000 AS c FROM fm)
SELECT fm.phone_no_m, {S("fm.prob", "prob")}, coalesce(fm.prob > cut.c, false) AS label FROM fm, cut
"""

F1_SCORE = f"""
WITH {_SCORES}, {_CUT89},
d AS (SELECT s.label, coalesce(s.prob > cut.c, false) AS pred FROM s, cut),
c AS (SELECT count(*) FILTER (WHERE pred AND label = 1) AS tp,
             count(*) FILTER (WHERE pred AND label <> 1) AS fp,
             count(*) FILTER (WHERE NOT pred AND label = 1) AS fn FROM d)
SELECT tp, fp, fn, {S("CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END", "f1")} FROM c
"""

_POINTS = [32.0 + i * 0.08 for i in range(600)]
_GRID = ", ".join(f"({i}, {repr(p)})" for i, p in enumerate(_POINTS))
_PROBS = "[" + ", ".join(repr(p / 100.0) for p in _POINTS) + "]"

F1_SEARCH = f"""
WITH {_SCORES},
sc AS (SELECT label, prob FROM s WHERE prob IS NOT NULL),
grid AS (SELECT * FROM (VALUES {_GRID}) g(i, p)),
qs AS (SELECT quantile_cont(prob, {_PROBS}) AS qq FROM sc),
cuts AS (SELECT g.i, g.p, round_even(qs.qq[g.i + 1] * 10000, 0) / 10000 AS cut FROM grid g, qs),
ev AS (SELECT c.i, c.p,
              count(*) FILTER (WHERE sc.prob > c.cut AND sc.label = 1) AS tp,
              count(*) FILTER (WHERE sc.prob > c.cut AND sc.label <> 1) AS fp,
              count(*) FILTER (WHERE NOT (sc.prob > c.cut) AND sc.label = 1) AS fn
       FROM cuts c, sc GROUP BY c.i, c.p),
f AS (SELECT i, p, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM ev)
SELECT {S("p", "best_percentile")}, {S("f1", "best_f1")} FROM f ORDER BY f1 DESC, i DESC LIMIT 1
"""

AUC_RANK = f"""
WITH {_SCORES},
r AS (SELECT label, rank() OVER (ORDER BY prob) AS rk, count(*) OVER (PARTITION BY prob) AS c
      FROM s WHERE prob IS NOT NULL),
t AS (SELECT sum(CASE WHEN label = 1 THEN rk + (c - 1) / 2.0 ELSE 0 END) AS R,
             count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label <> 1) AS N FROM r)
SELECT {S("(R - P * (P + 1) / 2.0) / NULLIF(P * N, 0)", "auc")} FROM t
"""

USERS_VOICE_FEATURES_B = f"""
WITH vb AS ({voice_sql.VOICE_FEATURES_B})
SELECT u.phone_no_m, u.label, u.split, vb.* EXCLUDE (phone_no_m)
FROM users u LEFT JOIN vb ON vb.phone_no_m = u.phone_no_m
"""

QUERIES = {
    "fixed_offset": FIXED_OFFSET,
    "ensemble_cut": ENSEMBLE_CUT,
    "users_voice_features_b": USERS_VOICE_FEATURES_B,
    "dataset_left": DATASET_LEFT,
    "dataset_outer": DATASET_OUTER,
    "dataset_outer_stored": DATASET_OUTER,
    "align_columns": ALIGN_COLUMNS,
    "fill_missing": FILL_MISSING,
    "category_codes": CATEGORY_CODES,
    "stratified_folds": STRATIFIED_FOLDS,
    "holdout_split": HOLDOUT_SPLIT,
    "minmax_scale": MINMAX_SCALE,
    "fold_mean": FOLD_MEAN,
    "percentile_cut": PERCENTILE_CUT,
    "f1_score": F1_SCORE,
    "f1_search": F1_SEARCH,
    "auc_rank": AUC_RANK,
}
