from oracle.views import S

HANDSET_DAY_MAX = """
WITH p AS (
  SELECT phone_no_m, CAST(start_datetime AS DATE) AS d, imei_m, count(*) AS n FROM voice
  WHERE phone_no_m IS NOT NULL AND imei_m IS NOT NULL AND start_datetime IS NOT NULL GROUP BY 1, 2, 3)
SELECT phone_no_m, max(n) AS phone_count_max FROM p GROUP BY 1
"""

HANDSET_COUNTY_MAX = """
WITH p AS (
  SELECT phone_no_m, imei_m, county_name, count(*) AS n FROM voice
  WHERE phone_no_m IS NOT NULL AND imei_m IS NOT NULL AND county_name IS NOT NULL GROUP BY 1, 2, 3)
SELECT phone_no_m, max(n) AS imei_county_mean FROM p GROUP BY 1
"""

SHARED_HANDSET_SCORE = f"""
WITH pr AS (SELECT phone_no_m, imei_m, count(*) AS r FROM voice WHERE phone_no_m IS NOT NULL GROUP BY 1, 2),
h AS (SELECT imei_m, count(DISTINCT phone_no_m) AS ph FROM voice
      WHERE imei_m IS NOT NULL AND phone_no_m IS NOT NULL GROUP BY 1)
SELECT pr.phone_no_m,
       {S("sum(CASE WHEN h.ph > 1 THEN pr.r * h.ph ELSE 0 END) / sum(pr.r)", "imei_phone")}
FROM pr LEFT JOIN h ON pr.imei_m = h.imei_m GROUP BY 1
"""

PHONES_PER_HANDSET = """
SELECT imei_m, count(DISTINCT phone_no_m) AS phones FROM voice
WHERE phone_no_m IS NOT NULL AND imei_m IS NOT NULL GROUP BY 1 HAVING count(DISTINCT phone_no_m) > 1
"""

HANDSETS_PER_PHONE_BY_CLASS = """
WITH pp AS (SELECT phone_no_m, count(DISTINCT imei_m) AS h FROM voice WHERE phone_no_m IS NOT NULL GROUP BY 1)
SELECT u.label, count(*) FILTER (WHERE pp.h > 40) AS phones_over, count(*) AS phones
FROM pp JOIN users u ON u.phone_no_m = pp.phone_no_m WHERE u.split = 'train' GROUP BY 1
"""

CONTACT_EDGES = """
SELECT phone_no_m, opposite_no_m AS contact, CASE calltype_id WHEN 1 THEN 'out' ELSE 'in' END AS direction,
       count(*) AS n, 'call' AS channel
FROM voice WHERE phone_no_m IS NOT NULL AND opposite_no_m IS NOT NULL AND calltype_id IN (1, 2) GROUP BY 1, 2, 3
UNION ALL
SELECT phone_no_m, opposite_no_m AS contact, CASE calltype_id WHEN 1 THEN 'out' ELSE 'in' END AS direction,
       count(*) AS n, 'sms' AS channel
FROM sms WHERE phone_no_m IS NOT NULL AND opposite_no_m IS NOT NULL AND calltype_id IN (1, 2) GROUP BY 1, 2, 3
"""

NO_OUTGOING = """
SELECT DISTINCT phone_no_m FROM voice v
WHERE phone_no_m IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM voice w WHERE w.phone_no_m = v.phone_no_m AND w.calltype_id = 1 AND w.opposite_no_m IS NOT NULL)
"""

def _cc(log: str = "voice") -> str:
    return f"""cc AS (
  WITH o AS (SELECT DISTINCT phone_no_m, opposite_no_m FROM {log}
             WHERE calltype_id = 1 AND opposite_no_m IS NOT NULL AND phone_no_m IS NOT NULL),
       i AS (SELECT DISTINCT phone_no_m, opposite_no_m FROM {log}
             WHERE calltype_id = 2 AND opposite_no_m IS NOT NULL AND phone_no_m IS NOT NULL),
       ph AS (SELECT DISTINCT phone_no_m FROM {log} WHERE phone_no_m IS NOT NULL)
  SELECT ph.phone_no_m, count(i.opposite_no_m) AS recall, count(o.opposite_no_m) AS call
  FROM ph LEFT JOIN o ON o.phone_no_m = ph.phone_no_m
          LEFT JOIN i ON i.phone_no_m = o.phone_no_m AND i.opposite_no_m = o.opposite_no_m
  GROUP BY 1)"""


def _rr(log: str = "voice") -> str:
    return f"""rr AS (
  WITH pc AS (SELECT phone_no_m, opposite_no_m, count(*) AS n FROM {log}
              WHERE phone_no_m IS NOT NULL AND opposite_no_m IS NOT NULL GROUP BY 1, 2)
  SELECT a.phone_no_m, CAST(sum(b.n) AS BIGINT) AS recall
  FROM pc a JOIN pc b ON b.phone_no_m = a.opposite_no_m AND b.opposite_no_m = a.phone_no_m GROUP BY 1)"""


_CC = _cc()
_RR = _rr()

CALLBACK_COUNT = f"WITH {_CC} SELECT phone_no_m, recall, call FROM cc"

RECIPROCATED_ROWS = f"WITH {_RR} SELECT phone_no_m, recall FROM rr"

REPEAT_RATIO = f"""
SELECT phone_no_m, {S("count(DISTINCT opposite_no_m) / count(*)", "repeat_ratio")}
FROM voice WHERE phone_no_m IS NOT NULL GROUP BY 1
"""

def _callback_with_fallback(log: str) -> str:
    return f"""
WITH {_cc(log)}, {_rr(log)},
rows_ AS (SELECT phone_no_m, count(*) AS c FROM {log} WHERE phone_no_m IS NOT NULL GROUP BY 1)
SELECT phone_no_m, recall, call, {S("recall / NULLIF(call, 0)", "re_ratio")}, 'distinct_contacts' AS measure
FROM cc WHERE call > 0
UNION ALL
SELECT cc.phone_no_m, coalesce(rr.recall, 0) AS recall, rows_.c AS call,
       {S("coalesce(rr.recall, 0) / NULLIF(rows_.c, 0)", "re_ratio")}, 'rows' AS measure
FROM cc JOIN rows_ ON rows_.phone_no_m = cc.phone_no_m LEFT JOIN rr ON rr.phone_no_m = cc.phone_no_m
WHERE cc.call = 0
"""


CALLBACK_WITH_FALLBACK = _callback_with_fallback("voice")
SMS_CALLBACK_WITH_FALLBACK = _callback_with_fallback("sms")

CALLBACK_SHARE = f"""
WITH {_CC}
SELECT u.label, count(*) FILTER (WHERE call <> 0) AS with_out,
       count(*) FILTER (WHERE call <> 0 AND recall <> 0) AS nonzero
FROM cc JOIN users u ON u.phone_no_m = cc.phone_no_m WHERE u.split = 'train' GROUP BY 1
"""

_SEG = """tu AS (SELECT phone_no_m, label FROM users WHERE split = 'train'),
m AS (SELECT phone_no_m, count(DISTINCT month_id) AS months FROM app WHERE phone_no_m IS NOT NULL GROUP BY 1),
seg AS (SELECT tu.phone_no_m, tu.label FROM tu LEFT JOIN m ON m.phone_no_m = tu.phone_no_m
        WHERE coalesce(m.months, 0) < 8)"""

LOG_COVERAGE = """
WITH tu AS (SELECT * FROM users WHERE split = 'train')
SELECT 'voice' AS log, count(*) AS missing, CAST(coalesce(sum(label), 0) AS BIGINT) AS missing_scam FROM tu
WHERE phone_no_m NOT IN (SELECT phone_no_m FROM voice WHERE phone_no_m IS NOT NULL)
UNION ALL
SELECT 'sms', count(*), CAST(coalesce(sum(label), 0) AS BIGINT) FROM tu
WHERE phone_no_m NOT IN (SELECT phone_no_m FROM sms WHERE phone_no_m IS NOT NULL)
UNION ALL
SELECT 'app', count(*), CAST(coalesce(sum(label), 0) AS BIGINT) FROM tu
WHERE phone_no_m NOT IN (SELECT phone_no_m FROM app WHERE phone_no_m IS NOT NULL)
"""

TEST_COVERAGE = """
SELECT count(*) AS missing FROM users WHERE split = 'test'
AND phone_no_m NOT IN (SELECT phone_no_m FROM voice WHERE phone_no_m IS NOT NULL)
"""

LOW_USAGE_SEGMENT = f"""
WITH {_SEG}
SELECT tu.label, count(*) AS users, count(m.phone_no_m) AS app_phones,
       count(*) FILTER (WHERE coalesce(m.months, 0) < 8) AS low_usage
FROM tu LEFT JOIN m ON m.phone_no_m = tu.phone_no_m GROUP BY 1
"""


def _segment_contacts(log: str) -> str:
    return f"""
WITH {_SEG},
c AS (SELECT phone_no_m, count(DISTINCT opposite_no_m) AS k FROM {log} WHERE phone_no_m IS NOT NULL GROUP BY 1),
s AS (SELECT seg.label, count(*) AS segment_phones,
             count(*) FILTER (WHERE coalesce(c.k, 0) > 40) AS over_bound,
             count(*) FILTER (WHERE coalesce(c.k, 0) = 0) AS no_contact
      FROM seg LEFT JOIN c ON c.phone_no_m = seg.phone_no_m GROUP BY 1),
l AS (SELECT tu.label, count(*) AS log_phones
      FROM (SELECT DISTINCT phone_no_m FROM {log} WHERE phone_no_m IS NOT NULL) v
      JOIN tu ON tu.phone_no_m = v.phone_no_m GROUP BY 1)
SELECT coalesce(s.label, l.label) AS label, segment_phones, over_bound, no_contact, log_phones
FROM s FULL JOIN l ON s.label = l.label
"""


SEGMENT_CALLBACK = f"""
WITH {_SEG}, {_CC}
SELECT seg.label, count(*) FILTER (WHERE coalesce(cc.call, 0) <> 0) AS with_out,
       count(*) FILTER (WHERE coalesce(cc.call, 0) <> 0 AND coalesce(cc.recall, 0) <> 0) AS nonzero
FROM seg LEFT JOIN cc ON cc.phone_no_m = seg.phone_no_m GROUP BY 1
"""

CALLBACK_TIMES_RATIO = f"""
WITH {_CC}, {_RR},
rows_ AS (SELECT phone_no_m, count(*) AS c FROM voice WHERE phone_no_m IS NOT NULL GROUP BY 1),
t AS (
  SELECT phone_no_m, recall, call FROM cc WHERE call > 0
  UNION ALL
  SELECT cc.phone_no_m, coalesce(rr.recall, 0), rows_.c
  FROM cc JOIN rows_ ON rows_.phone_no_m = cc.phone_no_m LEFT JOIN rr ON rr.phone_no_m = cc.phone_no_m
  WHERE cc.call = 0)
SELECT phone_no_m, {S("call * (CAST(recall AS DOUBLE) / NULLIF(call, 0))", "kkk")} FROM t
"""

RECALL_TRAIN = f"""
WITH tv AS (SELECT * FROM voice WHERE phone_no_m IN (SELECT phone_no_m FROM users WHERE split = 'train')),
{_cc("tv")}, {_rr("voice")},
rows_ AS (SELECT phone_no_m, count(*) AS c FROM voice WHERE phone_no_m IS NOT NULL GROUP BY 1)
SELECT phone_no_m, recall, call, {S("recall / NULLIF(call, 0)", "re_ratio")}, 'distinct_contacts' AS measure
FROM cc WHERE call > 0
UNION ALL
SELECT cc.phone_no_m, coalesce(rr.recall, 0) AS recall, rows_.c AS call,
       {S("coalesce(rr.recall, 0) / NULLIF(rows_.c, 0)", "re_ratio")}, 'rows' AS measure
FROM cc JOIN rows_ ON rows_.phone_no_m = cc.phone_no_m LEFT JOIN rr ON rr.phone_no_m = cc.phone_no_m
WHERE cc.call = 0
"""

CONTACT_EDGES_REVERSED = """
SELECT phone_no_m, contact, direction, count(*) AS n, 'call' AS channel FROM (
  SELECT phone_no_m, opposite_no_m AS contact, CASE calltype_id WHEN 1 THEN 'out' ELSE 'in' END AS direction
  FROM voice WHERE calltype_id IN (1, 2)
  UNION ALL
  SELECT opposite_no_m, phone_no_m, 'in' FROM voice WHERE calltype_id = 1)
WHERE phone_no_m IS NOT NULL AND contact IS NOT NULL GROUP BY 1, 2, 3
"""

CLASS_SPLIT_CALLS = f"""
SELECT u.label, count(*) AS rows, count(DISTINCT v.phone_no_m) AS phones, {S("coalesce(sum(v.call_dur), 0)", "seconds")}
FROM voice v JOIN users u ON u.phone_no_m = v.phone_no_m WHERE u.split = 'train' GROUP BY 1
"""

BOTH_SPLITS = """
SELECT v.phone_no_m, count(*) AS rows FROM voice v JOIN users u ON u.phone_no_m = v.phone_no_m GROUP BY 1
"""

TEXT_TIME_PARTS = """
SELECT CAST(month(request_datetime) AS INTEGER) AS month, strftime(request_datetime, '%H:%M:%S') AS time, count(*) AS rows
FROM sms GROUP BY 1, 2
"""


def _unpivot(sql: str, part: str, metrics: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{part}' AS part, label, '{m}' AS metric, CAST({m} AS BIGINT) AS value FROM ({sql}) x"
        for m in metrics)


SEGMENT_REPORT = "\nUNION ALL\n".join([
    _unpivot(LOW_USAGE_SEGMENT.replace(f"WITH {_SEG}", f"WITH {_SEG}", 1), "app_months",
             ["users", "app_phones", "low_usage"]),
    _unpivot(_segment_contacts("voice"), "voice_contacts",
             ["segment_phones", "over_bound", "no_contact", "log_phones"]),
    _unpivot(_segment_contacts("sms"), "sms_contacts",
             ["segment_phones", "over_bound", "no_contact", "log_phones"]),
    _unpivot(SEGMENT_CALLBACK, "callback", ["with_out", "nonzero"]),
    _unpivot(HANDSETS_PER_PHONE_BY_CLASS, "handsets", ["phones_over", "phones"]),
])

QUERIES = {
    "recall_train": RECALL_TRAIN,
    "contact_edges_reversed": CONTACT_EDGES_REVERSED,
    "class_split_calls": CLASS_SPLIT_CALLS,
    "both_splits": BOTH_SPLITS,
    "text_time_parts": TEXT_TIME_PARTS,
    "segment_report": SEGMENT_REPORT,
    "callback_times_ratio": CALLBACK_TIMES_RATIO,
    "handset_day_max": HANDSET_DAY_MAX,
    "handset_county_max": HANDSET_COUNTY_MAX,
    "shared_handset_score": SHARED_HANDSET_SCORE,
    "phones_per_handset": PHONES_PER_HANDSET,
    "handsets_per_phone_by_class": HANDSETS_PER_PHONE_BY_CLASS,
    "contact_edges": CONTACT_EDGES,
    "no_outgoing": NO_OUTGOING,
    "callback_count": CALLBACK_COUNT,
    "reciprocated_rows": RECIPROCATED_ROWS,
    "repeat_ratio": REPEAT_RATIO,
    "callback_with_fallback": CALLBACK_WITH_FALLBACK,
    "stored_graph_callbacks": CALLBACK_WITH_FALLBACK,
    "sms_callback_with_fallback": SMS_CALLBACK_WITH_FALLBACK,
    "callback_share": CALLBACK_SHARE,
    "log_coverage": LOG_COVERAGE,
    "test_coverage": TEST_COVERAGE,
    "low_usage_segment": LOW_USAGE_SEGMENT,
    "segment_voice_contacts": _segment_contacts("voice"),
    "segment_sms_contacts": _segment_contacts("sms"),
    "segment_callback": SEGMENT_CALLBACK,
}
