from oracle.views import S, sig
from oracle.voice_sql import VOICE_CLASS_MEASURES_RAW, VOICE_FEATURES_B_RAW

F7_NUMERIC = ["oppsite_no_m_voc_nunique", "call_diff_01", "call_diff_02", "start_datetime_count",
              "date_unique", "call_dur_mean", "city_name_nunique", "county_name_nunique", "imei_m_nunique",
              "averge_call_01", "ratio", "dure_sum"]
C10 = ["oppsite_no_m_voc_nunique", "call_diff_01", "call_diff_02", "start_datetime_count",
       "date_unique", "call_dur_mean", "imei_m_nunique", "averge_call_01", "ratio", "dure_sum"]


def _long(cols, with_label):
    lab = "tu.label, " if with_label else ""
    src = "vb JOIN tu ON tu.phone_no_m = vb.phone_no_m" if with_label else "vb"
    name = "measure" if with_label else "column"
    return "\nUNION ALL\n".join(
        f"SELECT {lab}'{c}' AS {name}, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols)


COLUMN_PROFILE = f"""
WITH vb AS ({VOICE_FEATURES_B_RAW}),
lg AS ({_long(F7_NUMERIC, False)}),
st AS (SELECT "column", count(*) AS rows, count(value) AS count, count(*) FILTER (WHERE value IS NULL) AS nulls,
              count(DISTINCT value) AS distinct_, avg(value) AS mean, stddev_samp(value) AS std,
              min(value) AS mn, max(value) AS mx,
              quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
              quantile_cont(value, 0.75) AS q75
       FROM lg GROUP BY 1),
vc AS (SELECT "column", value, count(*) AS n,
              row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rk
       FROM lg WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT st."column" AS "column", rows, count, nulls, distinct_ AS "distinct", {S("mean", "mean")}, {S("std", "std")},
       {S("mn", "min")}, {S("mx", "max")}, {S("q25", "q25")}, {S("q50", "q50")}, {S("q75", "q75")},
       {S("vc.value", "top")}, vc.n AS top_count
FROM st LEFT JOIN vc ON vc."column" = st."column" AND vc.rk = 1
"""

_TU = "tu AS (SELECT phone_no_m, label FROM users WHERE split = 'train')"

CLASS_QUANTILES = f"""
WITH vb AS ({VOICE_FEATURES_B_RAW}), {_TU},
lg AS ({_long(C10, True)}),
q AS (SELECT label, measure, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS qs
      FROM lg WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT label, measure, {S("[0.1, 0.25, 0.5, 0.75, 0.9][i]", "prob")}, {S("qs[i]", "q")}
FROM q, (SELECT unnest(range(1, 6)) AS i) g
"""

CLASS_HISTOGRAM = f"""
WITH vb AS ({VOICE_FEATURES_B_RAW}), {_TU},
lg AS (SELECT * FROM ({_long(C10, True)}) WHERE value IS NOT NULL),
rg AS (SELECT measure, min(value) AS lo, max(value) AS hi FROM lg GROUP BY 1),
b AS (SELECT lg.label, lg.measure, rg.lo, rg.hi,
             CAST(CASE WHEN rg.hi = rg.lo THEN 0
                       ELSE least(floor((lg.value - rg.lo) / ((rg.hi - rg.lo) / 20.0)), 19) END AS INTEGER) AS bin
      FROM lg JOIN rg ON rg.measure = lg.measure)
SELECT label, measure, bin, {S("lo + bin * ((hi - lo) / 20.0)", "lo")}, {S("lo + (bin + 1) * ((hi - lo) / 20.0)", "hi")},
       count(*) AS n
FROM b GROUP BY label, measure, bin, lo, hi
"""

CLASS_DAILY_QUANTILES = f"""
WITH {_TU},
dm AS (SELECT phone_no_m, CAST(start_datetime AS DATE) AS d, avg(call_dur) AS dur_mean,
              avg(call_dur) FILTER (WHERE calltype_id = 1) AS dur_mean_out,
              avg(call_dur) FILTER (WHERE calltype_id = 2) AS dur_mean_in
       FROM voice WHERE phone_no_m IS NOT NULL AND start_datetime IS NOT NULL GROUP BY 1, 2),
lg AS (
  SELECT tu.label, 'dur_mean' AS measure, dur_mean AS value FROM dm JOIN tu ON tu.phone_no_m = dm.phone_no_m
  UNION ALL
  SELECT tu.label, 'dur_mean_out', dur_mean_out FROM dm JOIN tu ON tu.phone_no_m = dm.phone_no_m
  UNION ALL
  SELECT tu.label, 'dur_mean_in', dur_mean_in FROM dm JOIN tu ON tu.phone_no_m = dm.phone_no_m),
q AS (SELECT label, measure, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS qs
      FROM lg WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT label, measure, {S("[0.1, 0.25, 0.5, 0.75, 0.9][i]", "prob")}, {S("qs[i]", "q")}
FROM q, (SELECT unnest(range(1, 6)) AS i) g
"""

MEASURES = [*[f"{m}{end}" for m in ("calls", "contacts", "days", "day_max", "day_mean") for end in ("", "_out", "_in")],
            "seconds", "short_share"]
DAILY = {"dur_mean": "true", "dur_mean_out": "calltype_id = 1", "dur_mean_in": "calltype_id = 2"}

_CLASS_VALUES = "\nUNION ALL\n".join(
    [f"SELECT label, '{c}' AS measure, CAST({c} AS DOUBLE) AS value FROM vm JOIN tu ON tu.phone_no_m = vm.phone_no_m"
     for c in MEASURES] + [f"SELECT label, '{c}', {c} FROM dm JOIN tu ON tu.phone_no_m = dm.phone_no_m" for c in DAILY])

# Every value meets every point of its measure through its bin; no reach is cut.
CLASS_DENSITY = f"""
WITH vm AS ({VOICE_CLASS_MEASURES_RAW}), {_TU},
dm AS (SELECT phone_no_m, {", ".join(f"avg(call_dur) FILTER (WHERE {w}) AS {c}" for c, w in DAILY.items())}
       FROM voice WHERE phone_no_m IS NOT NULL AND start_datetime IS NOT NULL
       GROUP BY phone_no_m, CAST(start_datetime AS DATE)),
lg AS (SELECT * FROM ({_CLASS_VALUES}) WHERE value IS NOT NULL),
raw AS (SELECT label, measure, count(*) AS n, min(value) AS lo, max(value) AS hi,
               stddev_samp(value) * pow(count(*), -0.2) AS h0 FROM lg GROUP BY 1, 2 HAVING min(value) < max(value)),
st AS (SELECT label, measure, n, lo, hi, {sig("h0", 6)} AS h FROM raw),
span AS (SELECT measure, min(lo - h * 3.0::DOUBLE) AS a, max(hi + h * 3.0::DOUBLE) AS b FROM st GROUP BY 1),
g AS (SELECT st.*, a, (b - a) / 99.0::DOUBLE AS step FROM st JOIN span ON span.measure = st.measure),
t AS (SELECT g.label, g.measure, (value - lo) / (h / 8.0::DOUBLE) AS place
      FROM lg JOIN g ON g.label = lg.label AND g.measure = lg.measure),
bins AS (SELECT label, measure, floor(place) AS bin, count(*) AS m, sum(place - floor(place)) AS r FROM t GROUP BY 1, 2, 3),
pts AS (SELECT g.*, CAST(point AS INTEGER) AS point, a + point * step AS x FROM g, range(0, 100) p(point)),
s AS (SELECT p.label, p.measure, p.point,
             sum((m - r) * exp(-0.5 * pow((x - (lo + bin * (h / 8.0::DOUBLE))) / h, 2))
                 + r * exp(-0.5 * pow((x - (lo + (bin + 1) * (h / 8.0::DOUBLE))) / h, 2))) AS mass
      FROM pts p JOIN bins ON bins.label = p.label AND bins.measure = p.measure GROUP BY 1, 2, 3)
SELECT p.label, p.measure, p.point, {S("p.x", "x")}, p.n, {S("p.h", "bandwidth")},
       {S("round_even(s.mass / (p.n * p.h * sqrt(2 * pi())) * p.h * 1e6, 0) / 1e6", "density_per_bandwidth")}
FROM pts p JOIN s ON s.label = p.label AND s.measure = p.measure AND s.point = p.point
"""

VOICE_TEXT = {"phone_no_m": "phone_no_m", "opposite_no_m": "opposite_no_m", "calltype_id": "calltype_id",
              "start_datetime": "strftime(start_datetime, '%Y-%m-%d %H:%M:%S')", "call_dur": "CAST(call_dur AS BIGINT)",
              "city_name": "city_name", "county_name": "county_name", "imei_m": "imei_m"}
_TEXTS = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST({e} AS VARCHAR) AS value FROM voice" for c, e in VOICE_TEXT.items())

VALUE_PROFILE = f"""
WITH lg AS ({_TEXTS}),
st AS (SELECT "column", count(*) AS rows, count(value) AS count, count(*) FILTER (WHERE value IS NULL) AS nulls,
              count(*) FILTER (WHERE trim(value) = '') AS blank, count(DISTINCT value) AS distinct_,
              min(value) AS mn, max(value) AS mx, min(length(value)) AS mnl, max(length(value)) AS mxl,
              avg(length(value)) AS ml, entropy(value) AS e FROM lg GROUP BY 1),
vc AS (SELECT "column", value, count(*) AS n FROM lg WHERE value IS NOT NULL GROUP BY 1, 2),
tp AS (SELECT "column", value, n, count(*) FILTER (WHERE n = 1) OVER (PARTITION BY "column") AS once,
              row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk FROM vc)
SELECT st."column" AS "column", rows, count, nulls, blank, distinct_ AS "distinct", coalesce(once, 0) AS once,
       mn AS "min", mx AS "max", CAST(mnl AS INTEGER) AS min_length, CAST(mxl AS INTEGER) AS max_length,
       {S("ml", "mean_length")}, {S("e", "entropy")}, tp.value AS top, tp.n AS top_count
FROM st LEFT JOIN tp ON tp."column" = st."column" AND tp.rk = 1
"""

_AMOUNTS = ["city_name", "county_name", *[f"arpu_{i}" for i in range(1, 6)]]
_SPARK_ORDER = [*_AMOUNTS, *[f"{m}{e}" for m in ("calls", "contacts", "days", "day_max", "day_mean")
                             for e in ("", "_out", "_in")], "seconds", "short_share"]


def _pairs(columns, one):
    return "\nUNION ALL\n".join(one(a, b) for i, a in enumerate(columns) for b in columns[i + 1:])


_CORR = ("round_even(CASE WHEN {a} * (n - {a}) * {b} * (n - {b}) > 0 THEN (n * {ab} - {a} * {b}) "
         "/ (sqrt({a} * (n - {a})) * sqrt({b} * (n - {b}))) END * 1e8, 0) / 1e8").format(
    a="CAST(nulls_a AS DOUBLE)", b="CAST(nulls_b AS DOUBLE)", ab="CAST(both_ AS DOUBLE)")

NULL_PAIRS = f"""
WITH vm AS ({VOICE_CLASS_MEASURES_RAW}),
u AS (SELECT users.*, vm.* EXCLUDE (phone_no_m) FROM users LEFT JOIN vm ON vm.phone_no_m = users.phone_no_m),
p AS ({_pairs(_SPARK_ORDER, lambda a, b: f"""SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS n,
      count(*) - count({a}) AS nulls_a, count(*) - count({b}) AS nulls_b,
      count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS both_ FROM u""")})
SELECT column_a, column_b, n AS rows, nulls_a, nulls_b, both_ AS "both", {S(_CORR, "correlation")} FROM p
"""

_AVERAGE_RANK = ("rank() OVER (PARTITION BY column_a, column_b ORDER BY {c}) "
                 "+ (count(*) OVER (PARTITION BY column_a, column_b, {c}) - 1) / 2.0::DOUBLE")

COLUMN_CORRELATIONS = f"""
WITH vb AS ({VOICE_FEATURES_B_RAW}),
lg AS ({_pairs(F7_NUMERIC, lambda a, b: f"""SELECT '{a}' AS column_a, '{b}' AS column_b, CAST({a} AS DOUBLE) AS x,
      CAST({b} AS DOUBLE) AS y FROM vb WHERE {a} IS NOT NULL AND {b} IS NOT NULL""")}),
rk AS (SELECT *, {_AVERAGE_RANK.format(c="x")} AS rx, {_AVERAGE_RANK.format(c="y")} AS ry FROM lg),
c AS (SELECT column_a, column_b, count(*) AS n, min(x) < max(x) AND min(y) < max(y) AS varies,
             covar_pop(x, y) / nullif(sqrt(var_pop(x)) * sqrt(var_pop(y)), 0) AS p,
             covar_pop(rx, ry) / nullif(sqrt(var_pop(rx)) * sqrt(var_pop(ry)), 0) AS s FROM rk GROUP BY 1, 2)
SELECT column_a, column_b, n, {S("round_even(CASE WHEN varies THEN p END * 1e8, 0) / 1e8", "pearson")},
       {S("round_even(CASE WHEN varies THEN s END * 1e8, 0) / 1e8", "spearman")}
FROM c
"""

QUERIES = {
    "class_density": CLASS_DENSITY,
    "value_profile": VALUE_PROFILE,
    "null_pairs": NULL_PAIRS,
    "column_correlations": COLUMN_CORRELATIONS,
    "class_daily_quantiles": CLASS_DAILY_QUANTILES,
    "column_profile": COLUMN_PROFILE,
    "class_quantiles": CLASS_QUANTILES,
    "class_histogram": CLASS_HISTOGRAM,
}
