"""Voice-log feature blocks (F2, F7 and its dead/commented measures).

Input: a voice log with ``phone_no_m, opposite_no_m, calltype_id
(1 = caller, 2 = called), start_datetime, call_dur, city_name, county_name,
imei_m``.  Output: one row per non-NULL phone.

Conditional distinct counts ("distinct contacts as caller") need no grain
of their own: the (phone, contact) group counts its caller rows, and a
contact was called when that count is positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens import constants as K
from phonelens.functions.expr import date_of, day_of, hour_of, safe_ratio, zero_sum
from phonelens.functions.grain import fan_out_aggregate, is_grain
from phonelens.functions.ranking import exact_quantiles
from phonelens.operators._common import (
    CONTACT, KEY, grain_median, grain_mode_packed, n_values, n_values_if, over_grain, packed_mode_count,
    packed_mode_value, row_val, when_any)


def _t1():
    return F.col("calltype_id") == K.CALLER


def _t2():
    return F.col("calltype_id") == K.CALLED


def _voice(log: DataFrame) -> DataFrame:
    return log.select(
        KEY, CONTACT, "calltype_id", "start_datetime", "call_dur", "city_name", "county_name", "imei_m",
        date_of("start_datetime").alias("_date"), hour_of("start_datetime").alias("_hour"),
        day_of("start_datetime").alias("_day"))


def _direction_counts():
    """Level-1 counts shared by every grain: rows as caller / called."""
    return [F.count_if(_t1()).alias("n1"), F.count_if(_t2()).alias("n2")]


def voice_features_a(log: DataFrame) -> DataFrame:
    """volumes, caller share, places, calls and seconds per contact,
    duration statistics, favourite hour and day of month.

    Medians are exact.  Those of durations and of seconds per contact are
    ``percentile`` buffers for phones that one task may hold; of hotter
    phones they go through one distributed rank path (range sort by phone,
    measure and value), so a phone with a third of all rows, or with
    millions of contacts, is split over many tasks.  The median of calls per
    contact uses ``percentile`` always: its buffer holds one entry per distinct
    call count of the phone, a small set."""
    v = _voice(log)
    grains = {
        "contact": F.col(CONTACT), "hour": F.col("_hour"), "day": F.col("_day"),
        "city": F.col("city_name"), "county": F.col("county_name"), "calltype": F.col("calltype_id"),
        "imei": F.col("imei_m"),
    }
    level1 = [
        *_direction_counts(),
        F.count("call_dur").alias("n_dur"), zero_sum("call_dur").alias("sum_dur"),
        F.count(CONTACT).alias("n_contact"), F.count(F.when(_t1(), F.col("imei_m"))).alias("n1_imei"),
        F.avg("call_dur").alias("dur_mean"), F.max("call_dur").alias("dur_max"), F.min("call_dur").alias("dur_min"),
    ]
    caller = F.col("n1") > 0
    level2 = [
        row_val("n_contact").alias("opposite_count"), n_values("contact").alias("opposite_unique"),
        row_val("n1").alias("_n1"), row_val("n1_imei").alias("_n1_imei"),
        n_values_if("imei", caller).alias("_imeis"), n_values_if("city", caller).alias("_city1"),
        n_values_if("county", caller).alias("_county1"),
        over_grain(F.avg, "contact", "n_dur").alias("phone2opposite_mean"),
        over_grain(F.median, "contact", "n_dur").alias("phone2opposite_median"),
        over_grain(F.max, "contact", "n_dur").alias("phone2opposite_max"),
        over_grain(F.avg, "contact", "sum_dur").alias("phone2oppo_sum_mean"),
        over_grain(F.max, "contact", "sum_dur").alias("phone2oppo_sum_max"),
        row_val("dur_mean").alias("call_dur_mean"),
        row_val("dur_max").alias("call_dur_max"), row_val("dur_min").alias("call_dur_min"),
        n_values("city").alias("city_name_nunique"), n_values("county").alias("county_name_nunique"),
        n_values("calltype").alias("calltype_id_unique"),
        grain_mode_packed("hour").alias("_hour_mode"), n_values("hour").alias("voc_hour_nunique"),
        grain_mode_packed("day").alias("_day_mode"), n_values("day").alias("voc_day_nunique"),
    ]
    inside = ({"dur": F.col("call_dur").cast("double")}, [
        grain_median("dur").alias("call_dur_median"),
        over_grain(F.median, "contact", "sum_dur").alias("phone2oppo_sum_median")])

    def medians(rows: DataFrame) -> DataFrame:
        durations = rows.select(KEY, F.lit("dur").alias("_m"), F.col("call_dur").alias("_x"))
        per_contact = (rows.filter(F.col(CONTACT).isNotNull()).groupBy(KEY, CONTACT)
                       .agg(zero_sum("call_dur").alias("_x")).select(KEY, F.lit("contact_sum").alias("_m"), "_x"))
        q = exact_quantiles(durations.unionByName(per_contact), "_x", [0.5], by=[KEY, "_m"])
        return q.groupBy(KEY).agg(F.max(F.when(F.col("_m") == "dur", F.col("q"))).alias("call_dur_median"),
                                  F.max(F.when(F.col("_m") == "contact_sum", F.col("q"))).alias("phone2oppo_sum_median"))

    agg = fan_out_aggregate(v, KEY, grains, level1, level2, inside, medians)
    return agg.select(
        KEY, "opposite_count", "opposite_unique",
        when_any("_n1", F.col("_n1_imei")).alias("voccalltype1"),
        when_any("_n1", F.col("_imeis")).alias("imeis"),
        safe_ratio(when_any("_n1", F.col("_n1_imei")), "opposite_count").alias("voc_calltype1"),
        when_any("_n1", F.col("_city1")).alias("city_name_call"),
        when_any("_n1", F.col("_county1")).alias("county_name_call"),
        "phone2opposite_mean", "phone2opposite_median", "phone2opposite_max",
        "phone2oppo_sum_mean", "phone2oppo_sum_median", "phone2oppo_sum_max",
        "call_dur_mean", "call_dur_median", "call_dur_max", "call_dur_min",
        "city_name_nunique", "county_name_nunique", "calltype_id_unique",
        packed_mode_value("_hour_mode").alias("voc_hour_mode"),
        packed_mode_count("_hour_mode").alias("voc_hour_mode_count"), "voc_hour_nunique",
        packed_mode_value("_day_mode").alias("voc_day_mode"),
        packed_mode_count("_day_mode").alias("voc_day_mode_count"), "voc_day_nunique",
    )


def _f7_level1():
    return [
        *_direction_counts(),
        F.count("start_datetime").alias("n_ts"), F.avg("call_dur").alias("dur_mean"),
        zero_sum("call_dur").alias("dur_sum"),
        F.count(CONTACT).alias("n_contact"),
        F.count(F.when(_t1(), F.col(CONTACT))).alias("n1_contact"),
        F.count(F.when(_t2(), F.col(CONTACT))).alias("n2_contact"),
        F.count_if(_t1() & (F.col("call_dur") < K.SHORT_CALL_SECONDS)).alias("n1_short"),
        F.count("_date").alias("n_dated"),
        F.count(F.when(_t1(), F.col("_date"))).alias("n1_dated"),
        F.count(F.when(_t2(), F.col("_date"))).alias("n2_dated"),
    ]


def voice_features_b(log: DataFrame) -> DataFrame:
    """contacts (all / as caller / as called), dated rows, active dates,
    mean duration, places, handsets, caller rows per active caller day,
    share of short caller calls, total seconds."""
    v = _voice(log)
    grains = {"contact": F.col(CONTACT), "date": F.col("_date"), "city": F.col("city_name"),
              "county": F.col("county_name"), "imei": F.col("imei_m")}
    level2 = [
        n_values("contact").alias("oppsite_no_m_voc_nunique"),
        row_val("n1").alias("_n1"), row_val("n2").alias("_n2"),
        n_values_if("contact", F.col("n1") > 0).alias("_diff1"),
        n_values_if("contact", F.col("n2") > 0).alias("_diff2"),
        row_val("n_ts").alias("start_datetime_count"), n_values("date").alias("date_unique"),
        row_val("dur_mean").alias("call_dur_mean"),
        n_values("city").alias("city_name_nunique"), n_values("county").alias("county_name_nunique"),
        n_values("imei").alias("imei_m_nunique"),
        row_val("n1_dated").alias("_n1_dated"), n_values_if("date", F.col("n1") > 0).alias("_dates1"),
        row_val("n1_short").alias("_n1_short"), row_val("dur_sum").alias("dure_sum"),
    ]
    agg = fan_out_aggregate(v, KEY, grains, _f7_level1(), level2)
    return agg.select(
        KEY, "oppsite_no_m_voc_nunique",
        when_any("_n1", F.col("_diff1")).alias("call_diff_01"),
        when_any("_n2", F.col("_diff2")).alias("call_diff_02"),
        "start_datetime_count", "date_unique", "call_dur_mean",
        "city_name_nunique", "county_name_nunique", "imei_m_nunique",
        safe_ratio("_n1_dated", F.nullif(F.col("_dates1"), F.lit(0))).alias("averge_call_01"),
        F.when(F.col("_n1_short") > 0, safe_ratio("_n1_short", "_n1")).alias("ratio"),
        "dure_sum",
    )


def short_call_ratio(log: DataFrame, max_seconds: float = K.SHORT_CALL_SECONDS) -> DataFrame:
    """F7 ``ratio`` with its parts: caller rows under ``max_seconds``
    (``tmp1``, NULL if none), caller rows (``tmp2``), and their ratio.
    Phones with no caller row are absent, as in the source."""
    v = log.filter(F.col(KEY).isNotNull() & _t1())
    g = v.groupBy(KEY).agg(F.count_if(F.col("call_dur") < max_seconds).alias("_short"),
                           F.count("calltype_id").alias("tmp2"))
    tmp1 = F.nullif(F.col("_short"), F.lit(0))
    return g.select(KEY, tmp1.alias("tmp1"), "tmp2", safe_ratio(tmp1, "tmp2").alias("ratio"))


def voice_direction_counts(log: DataFrame) -> DataFrame:
    """Dead F7 measures: rows in all / as caller / as called (counted over
    contacts) and active dates as caller / as called."""
    v = _voice(log)
    level2 = [row_val("n_contact").alias("call_sum"), row_val("n1").alias("_n1"), row_val("n2").alias("_n2"),
              row_val("n1_contact").alias("_s1"), row_val("n2_contact").alias("_s2"),
              n_values_if("date", F.col("n1") > 0).alias("_d1"), n_values_if("date", F.col("n2") > 0).alias("_d2")]
    agg = fan_out_aggregate(v, KEY, {"date": F.col("_date")}, _f7_level1(), level2)
    return agg.select(
        KEY, "call_sum",
        when_any("_n1", F.col("_s1")).alias("call_sum_01"), when_any("_n2", F.col("_s2")).alias("call_sum_02"),
        when_any("_n1", F.col("_d1")).alias("date_unique_01"), when_any("_n2", F.col("_d2")).alias("date_unique_02"),
    )


def voice_busiest_day(log: DataFrame) -> DataFrame:
    """Dead F7 measures: most rows on one date, all / as caller / as called
    (NULL when the phone has no dated row of that kind)."""
    v = _voice(log)
    d = is_grain("date")
    level2 = [over_grain(F.max, "date", "_n").alias("call_day_max"),
              F.max(F.when(d & (F.col("n1") > 0), F.col("n1"))).alias("call_day_01_max"),
              F.max(F.when(d & (F.col("n2") > 0), F.col("n2"))).alias("call_day_02_max")]
    return fan_out_aggregate(v, KEY, {"date": F.col("_date")}, _direction_counts(), level2)


def voice_duration_spread(log: DataFrame) -> DataFrame:
    """Dead F7 measures: sample standard deviation and mean of durations."""
    v = log.filter(F.col(KEY).isNotNull())
    return v.groupBy(KEY).agg(F.stddev_samp("call_dur").alias("dure_std"), F.avg("call_dur").alias("dure_mean"))


def calls_per_active_day(log: DataFrame) -> DataFrame:
    """Commented F7 measures: rows per active date, all / as caller / as
    called (``averge_call``, ``averge_call_01``, ``averge_call_02``)."""
    v = _voice(log)
    level2 = [row_val("n_dated").alias("_a"), row_val("n1_dated").alias("_b"), row_val("n2_dated").alias("_c"),
              n_values("date").alias("_da"), n_values_if("date", F.col("n1") > 0).alias("_db"),
              n_values_if("date", F.col("n2") > 0).alias("_dc")]
    agg = fan_out_aggregate(v, KEY, {"date": F.col("_date")}, _f7_level1(), level2)
    return agg.select(
        KEY,
        safe_ratio("_a", F.nullif(F.col("_da"), F.lit(0))).alias("averge_call"),
        safe_ratio("_b", F.nullif(F.col("_db"), F.lit(0))).alias("averge_call_01"),
        safe_ratio("_c", F.nullif(F.col("_dc"), F.lit(0))).alias("averge_call_02"),
    )


def daily_mean_duration(log: DataFrame) -> DataFrame:
    """Commented analysis: mean duration per (phone, date), all calls, as
    caller and as called (NULL where the phone has no such call that day)."""
    v = _voice(log).filter(F.col("_date").isNotNull())
    return v.groupBy(KEY, F.col("_date").alias("date")).agg(
        F.avg("call_dur").alias("dur_mean"),
        F.avg(F.when(_t1(), F.col("call_dur"))).alias("dur_mean_out"),
        F.avg(F.when(_t2(), F.col("call_dur"))).alias("dur_mean_in"))


def daily_in_out_ratio(log: DataFrame) -> DataFrame:
    """Commented idea: per phone, called rows / caller rows on each active
    date, averaged over the phone's active dates (dates with no caller row
    give NULL and leave the mean)."""
    v = _voice(log).filter(F.col("_date").isNotNull())
    per_day = v.groupBy(KEY, "_date").agg(
        safe_ratio(F.count_if(_t2()), F.count_if(_t1())).alias("r"))
    return per_day.groupBy(KEY).agg(F.avg("r").alias("in_out_ratio_mean"),
                                    F.count("_date").alias("active_days"))


def voice_class_measures(log: DataFrame) -> DataFrame:
    """The per-phone measures whose class densities the source drew, in
    one pass: calls (rows with a contact), contacts, active dates, most and
    mean rows on a date, each over all rows / as caller (``_out``) / as
    called (``_in``); total seconds; share of short caller calls.  A
    direction the phone never had is NULL, as is a day measure without a
    dated row of that kind."""
    v = _voice(log)
    d = is_grain("date")
    busiest = lambda n: F.max(F.when(d & (F.col(n) > 0), F.col(n)))
    level2 = [
        row_val("n1").alias("_n1"), row_val("n2").alias("_n2"),
        row_val("n_contact").alias("calls"), row_val("n1_contact").alias("_c1"), row_val("n2_contact").alias("_c2"),
        n_values("contact").alias("contacts"),
        n_values_if("contact", F.col("n1") > 0).alias("_k1"), n_values_if("contact", F.col("n2") > 0).alias("_k2"),
        n_values("date").alias("days"),
        n_values_if("date", F.col("n1") > 0).alias("_d1"), n_values_if("date", F.col("n2") > 0).alias("_d2"),
        busiest("_n").alias("day_max"), busiest("n1").alias("day_max_out"), busiest("n2").alias("day_max_in"),
        row_val("n_dated").alias("_t"), row_val("n1_dated").alias("_t1"), row_val("n2_dated").alias("_t2"),
        row_val("dur_sum").alias("seconds"), row_val("n1_short").alias("_short"),
    ]
    agg = fan_out_aggregate(v, KEY, {"contact": F.col(CONTACT), "date": F.col("_date")}, _f7_level1(), level2)
    per_day = lambda rows, days: safe_ratio(rows, F.nullif(F.col(days), F.lit(0)))
    return agg.select(
        KEY, "calls", when_any("_n1", F.col("_c1")).alias("calls_out"), when_any("_n2", F.col("_c2")).alias("calls_in"),
        "contacts", when_any("_n1", F.col("_k1")).alias("contacts_out"), when_any("_n2", F.col("_k2")).alias("contacts_in"),
        "days", when_any("_n1", F.col("_d1")).alias("days_out"), when_any("_n2", F.col("_d2")).alias("days_in"),
        "day_max", "day_max_out", "day_max_in",
        per_day("_t", "days").alias("day_mean"), per_day("_t1", "_d1").alias("day_mean_out"),
        per_day("_t2", "_d2").alias("day_mean_in"),
        "seconds", when_any("_n1", safe_ratio("_short", "_n1")).alias("short_share"))
