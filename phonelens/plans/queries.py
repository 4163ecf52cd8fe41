"""Query registry: name -> (spark, sf_dir) -> DataFrame.

Every query reads the shared tables through ``phonelens.sources.views``
and runs one library operator over the whole of them.  Double columns are
rounded (snap to 14 significant digits, then 10) so that the DuckDB twin
(``oracle/``) can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonelens import constants as K
from phonelens.functions.expr import month_of, np_round, parse_datetime, stable, time_of, zero_sum
from phonelens.operators import app as A
from phonelens.operators import coverage as C
from phonelens.operators import device as D
from phonelens.operators import graph as G
from phonelens.operators import learn as L
from phonelens.operators import profile as P
from phonelens.operators import sms as SM
from phonelens.operators import stats as ST
from phonelens.operators import user as U
from phonelens.operators import voice as V
from phonelens.plans.dataset import (
    align_columns, baseline_dataset, fill_missing, join_stored_blocks, outer_blocks, outer_dataset, store_blocks,
    with_test_unlabelled)
from phonelens.plans.model import (
    SECOND_FLOW, FlowResult, TreeParams, category_sizes, kfold_mean_offset, kfold_train_score, split_train_test)
from phonelens.plans.report import segment_report
from phonelens.session import ensure_checkpoint_dir, materialize
from phonelens.sources import views
from phonelens.sources.graph_store import load_pairs, merge_log

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return stable(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def np_rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Correlations to 8 decimals: a near-zero one has few certain digits."""
    return df.withColumns({c: np_round(c, 8) for c in cols})


def _voice(spark, d):
    return views.voice(spark, d)


# ---- step 1: voice feature block B and its dead measures ------------------
@register("voice_features_b")
def _q_vfb(spark, d):
    """F7 over the whole voice log."""
    return V.voice_features_b(_voice(spark, d))


@register("voice_busiest_day")
def _q_vbd(spark, d):
    return V.voice_busiest_day(_voice(spark, d))


@register("voice_direction_counts")
def _q_vdc(spark, d):
    return V.voice_direction_counts(_voice(spark, d))


@register("voice_duration_spread")
def _q_vds(spark, d):
    return V.voice_duration_spread(_voice(spark, d))


@register("short_call_ratio")
def _q_scr(spark, d):
    return V.short_call_ratio(_voice(spark, d))


# ---- step 3: voice feature block A ----------------------------------------
@register("voice_features_a")
def _q_vfa(spark, d):
    """F2 over the whole voice log."""
    return V.voice_features_a(_voice(spark, d))


# ---- step 11: commented analyses -------------------------------------------
@register("calls_per_active_day")
def _q_cpad(spark, d):
    return V.calls_per_active_day(_voice(spark, d))


@register("daily_mean_duration")
def _q_dmd(spark, d):
    return V.daily_mean_duration(_voice(spark, d))


@register("daily_in_out_ratio")
def _q_dior(spark, d):
    return V.daily_in_out_ratio(_voice(spark, d))


# ---- step 2: app, sms and user blocks ---------------------------------------
@register("app_features")
def _q_af(spark, d):
    """F1 over the whole app log."""
    return A.app_features(views.app(spark, d))


@register("app_months")
def _q_am(spark, d):
    return A.app_months(views.app(spark, d))


@register("monthly_flow_change")
def _q_mfc(spark, d):
    return A.monthly_flow_change(views.app(spark, d))


@register("sms_features_a")
def _q_sfa(spark, d):
    return SM.sms_features_a(views.sms(spark, d))


@register("sms_features_b")
def _q_sfb(spark, d):
    return SM.sms_features_b(views.sms(spark, d))


@register("user_arpu_mean")
def _q_uam(spark, d):
    return U.user_arpu_mean(views.users(spark, d), views.ARPU_COLS)


# ---- step 3: generic two-level aggregates and modes -------------------------
@register("contact_pair_stats")
def _q_cps(spark, d):
    return ST.value_counts(_voice(spark, d), ["phone_no_m", "opposite_no_m"], "call_dur")


@register("hour_mode")
def _q_hm(spark, d):
    """Favourite SMS hour per phone."""
    return ST.value_mode(views.sms(spark, d), "phone_no_m", F.hour("request_datetime"), "hour", small_int_bits=6)


@register("day_mode")
def _q_dm(spark, d):
    """Favourite day of month of voice calls per phone."""
    return ST.value_mode(_voice(spark, d), "phone_no_m", F.dayofmonth("start_datetime"), "voc_day",
                         small_int_bits=6)


def _labels(spark, d):
    """Labelled (training) users: the class split of the source's logs."""
    return views.train_users(spark, d)


# ---- step 4: handsets ------------------------------------------------------
@register("handset_day_max")
def _q_hdm(spark, d):
    return D.handset_day_max(_voice(spark, d))


@register("handset_county_max")
def _q_hcm(spark, d):
    return D.handset_county_max(_voice(spark, d))


@register("shared_handset_score")
def _q_shs(spark, d):
    return D.shared_handset_score(_voice(spark, d))


@register("phones_per_handset")
def _q_pph(spark, d):
    return D.phones_per_handset(_voice(spark, d), more_than=K.SHARED_HANDSET_PHONES_OVER)


@register("handsets_per_phone_by_class")
def _q_hppc(spark, d):
    return D.handsets_per_phone_by_class(_voice(spark, d), _labels(spark, d), more_than=K.FIXTURE_HANDSETS_OVER)


# ---- step 5: contact graph -------------------------------------------------
@register("contact_edges")
def _q_ce(spark, d):
    """G1 for both channels."""
    return G.contact_edges(_voice(spark, d), "call").unionByName(G.contact_edges(views.sms(spark, d), "sms"))


@register("no_outgoing")
def _q_no(spark, d):
    return G.no_outgoing(_voice(spark, d))


@register("callback_count")
def _q_cc(spark, d):
    return G.callback_count(_voice(spark, d))


@register("reciprocated_rows")
def _q_rr(spark, d):
    return G.reciprocated_rows(_voice(spark, d))


@register("repeat_ratio")
def _q_rep(spark, d):
    return G.repeat_ratio(_voice(spark, d))


@register("callback_with_fallback")
def _q_cwf(spark, d):
    return G.callback_with_fallback(_voice(spark, d))


@register("sms_callback_with_fallback")
def _q_scwf(spark, d):
    """G3 on the SMS channel: graph and fallback both from the SMS log."""
    return G.callback_with_fallback(views.sms(spark, d))


@register("callback_share")
def _q_cs(spark, d):
    return G.callback_share(G.callback_count(_voice(spark, d)), _labels(spark, d))


def _scratch(spark, name: str) -> str:
    """A fresh folder in the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


@register("stored_graph_callbacks")
def _q_sgc(spark, d):
    """The whole voice log merged into a stored graph as two batches
    (before and from a date), then G3 read from the stored pairs."""
    v, path = _voice(spark, d), _scratch(spark, "contact-graph")
    first = F.coalesce(F.col("start_datetime") < F.lit("1995-06-17").cast("timestamp_ntz"), F.lit(False))
    merge_log(spark, path, v.filter(first), "before", buckets=16)
    merge_log(spark, path, v.filter(~first), "after", buckets=16)
    return G.callback_with_fallback(load_pairs(spark, path))


# ---- step 6: coverage and segments -----------------------------------------
@register("log_coverage")
def _q_lc(spark, d):
    logs = {"voice": _voice(spark, d), "sms": views.sms(spark, d), "app": views.app(spark, d)}
    return C.log_coverage(_labels(spark, d), logs)


@register("test_coverage")
def _q_tc(spark, d):
    return C.test_coverage(views.test_users(spark, d), _voice(spark, d))


@register("low_usage_segment")
def _q_lus(spark, d):
    return C.low_usage_segment(_labels(spark, d), views.app(spark, d), max_months=K.FIXTURE_LOW_MONTHS)


def _segment(spark, d):
    return C.low_usage_phones(_labels(spark, d), views.app(spark, d), max_months=K.FIXTURE_LOW_MONTHS)


@register("segment_voice_contacts")
def _q_svc(spark, d):
    return C.segment_contacts(_segment(spark, d), _voice(spark, d), _labels(spark, d), more_than=K.FIXTURE_CONTACTS_OVER)


@register("segment_sms_contacts")
def _q_ssc(spark, d):
    return C.segment_contacts(_segment(spark, d), views.sms(spark, d), _labels(spark, d), more_than=K.FIXTURE_CONTACTS_OVER)


@register("segment_callback")
def _q_scb(spark, d):
    return C.segment_callback(_segment(spark, d), _voice(spark, d))


# ---- step 7: data sets ---------------------------------------------------------
def _users_split(spark, d):
    return with_test_unlabelled(views.users(spark, d))


@register("dataset_left")
def _q_dl(spark, d):
    """F9 + baseline assembly over all users of both splits."""
    return baseline_dataset(_users_split(spark, d), _voice(spark, d), views.sms(spark, d),
                            views.app(spark, d), views.ARPU_COLS)


def _outer(spark, d):
    return outer_dataset(_users_split(spark, d), _voice(spark, d), views.sms(spark, d),
                         views.app(spark, d), views.ARPU_COLS)


@register("dataset_outer")
def _q_do(spark, d):
    return _outer(spark, d)


@register("dataset_outer_stored")
def _q_dos(spark, d):
    """The outer data set from blocks stored in buckets by phone: all joins
    without a shuffle."""
    name = f"blocks_{uuid4().hex}"
    blocks = outer_blocks(_users_split(spark, d), _voice(spark, d), views.sms(spark, d), views.app(spark, d), views.ARPU_COLS)
    return join_stored_blocks(store_blocks(blocks, _scratch(spark, "blocks"), name, buckets=8))


@register("align_columns")
def _q_ac(spark, d):
    """Test rows of the outer data set in the training rows' columns."""
    ds = _outer(spark, d)
    train = ds.filter(F.col("split") == "train")
    test = ds.filter(F.col("split") == "test").drop("label")
    return align_columns(train, test)


@register("fill_missing")
def _q_fm(spark, d):
    return fill_missing(_outer(spark, d))


# ---- step 9: learning operators on plain columns ---------------------------------
def _plain_scores(spark, d):
    """Labelled users with a plain score: their mean call duration (F7),
    min-max scaled over all of them (M7).  Stands in for model output."""
    f = V.voice_features_b(_voice(spark, d)).select("phone_no_m", F.col("call_dur_mean").alias("prob"))
    j = _labels(spark, d).select("phone_no_m", "label").join(f, "phone_no_m", "left")
    return L.minmax_scale(j, "prob")


@register("category_codes")
def _q_ccodes(spark, d):
    u = views.users(spark, d).select("phone_no_m", "city_name", "county_name")
    return L.category_codes(u, ["city_name", "county_name"])


@register("stratified_folds")
def _q_sf(spark, d):
    return L.stratified_folds(_labels(spark, d).select("phone_no_m", "label"), k=5, seed=1024)


@register("holdout_split")
def _q_hs(spark, d):
    return L.holdout_split(_labels(spark, d).select("phone_no_m", "label"), 0.3, seed=2020)


@register("minmax_scale")
def _q_mms(spark, d):
    """Mean call duration scaled within each of 5 stratified folds."""
    f = V.voice_features_b(_voice(spark, d)).select("phone_no_m", "call_dur_mean")
    folds = L.stratified_folds(_labels(spark, d).select("phone_no_m", "label"), k=5, seed=1024)
    return L.minmax_scale(folds.join(f, "phone_no_m", "left"), "call_dur_mean", by=["fold"], out="score")


@register("fold_mean")
def _q_fmean(spark, d):
    """Per test phone, the mean over 5 folds of its mean call duration
    scaled with each fold's training extremes (rows outside that fold)."""
    f = materialize(V.voice_features_b(_voice(spark, d)).select("phone_no_m", "call_dur_mean"))
    folds = L.stratified_folds(_labels(spark, d).select("phone_no_m", "label"), k=5, seed=1024)
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k != F.col("fold")))
    ends = folds.join(f, "phone_no_m").select(other.alias("fold"), "call_dur_mean").groupBy("fold").agg(
        F.min("call_dur_mean").alias("lo"), F.max("call_dur_mean").alias("hi"))
    test = views.test_users(spark, d).select("phone_no_m").join(f, "phone_no_m")
    spread = F.col("hi") - F.col("lo")
    allf = (test.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
            .join(F.broadcast(ends), "fold")       # five rows
            .select("phone_no_m", "fold", F.when(spread == 0, F.lit(0.0)).otherwise(
                (F.col("call_dur_mean") - F.col("lo")) / spread).alias("prob")))
    return L.fold_mean(allf, "prob")


@register("percentile_cut")
def _q_pc(spark, d):
    return L.percentile_cut(_plain_scores(spark, d), 89.0, "prob")


@register("f1_search")
def _q_f1s(spark, d):
    return L.f1_search(_plain_scores(spark, d), "prob", "label")


@register("f1_score")
def _q_f1(spark, d):
    s = _plain_scores(spark, d)
    dec = L.percentile_cut(s, 89.0, "prob").select("phone_no_m", F.col("label").alias("pred"))
    return L.f1_score(dec.join(s.select("phone_no_m", "label"), "phone_no_m"), "pred", "label")


@register("auc_rank")
def _q_auc(spark, d):
    return L.auc_rank(_plain_scores(spark, d), "prob", "label")


# ---- step 8: profile and class distributions ---------------------------------
C10_MEASURES = ["oppsite_no_m_voc_nunique", "call_diff_01", "call_diff_02", "start_datetime_count",
                "date_unique", "call_dur_mean", "imei_m_nunique", "averge_call_01", "ratio", "dure_sum"]


@register("column_profile")
def _q_cp(spark, d):
    """C9 over the F7 feature table."""
    f = V.voice_features_b(_voice(spark, d))
    return P.column_profile(f, P.numeric_columns(f, exclude=["phone_no_m"]))


@register("class_quantiles")
def _q_cq(spark, d):
    return P.class_quantiles(V.voice_features_b(_voice(spark, d)), _labels(spark, d), C10_MEASURES)


@register("class_histogram")
def _q_ch(spark, d):
    return P.class_histogram(V.voice_features_b(_voice(spark, d)), _labels(spark, d), C10_MEASURES, bins=20)


@register("voice_class_measures")
def _q_vcm(spark, d):
    """C10's per-phone measures over the whole voice log."""
    return V.voice_class_measures(_voice(spark, d))


@register("class_density")
def _q_cd(spark, d):
    """Densities per class of all twenty measures; the density is given
    per bandwidth, so that all measures compare on one scale."""
    labels = _labels(spark, d)
    per_phone = V.voice_class_measures(_voice(spark, d))
    per_day = V.daily_mean_duration(_voice(spark, d))
    values = P.class_values(per_phone, labels, [c for c in per_phone.columns if c != "phone_no_m"]).unionByName(
        P.class_values(per_day, labels, ["dur_mean", "dur_mean_out", "dur_mean_in"]))
    dens = P.class_density(values)
    return dens.select("label", "measure", "point", "x", "n", "bandwidth",
                       np_round(F.col("density") * F.col("bandwidth"), 6).alias("density_per_bandwidth"))


@register("value_profile")
def _q_vp(spark, d):
    """C9 over the text, code and time columns of the voice log."""
    return P.value_profile(_voice(spark, d).withColumn(
        "start_datetime", F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "call_dur", F.col("call_dur").cast("long")))


@register("null_pairs")
def _q_np(spark, d):
    """Which C10 measures and monthly amounts are missing together."""
    u = views.users(spark, d).join(V.voice_class_measures(_voice(spark, d)), "phone_no_m", "left")
    return np_rounded(P.null_pairs(u.drop("phone_no_m", "label", "split")), "correlation")


@register("column_correlations")
def _q_cc9(spark, d):
    """Correlations of the F7 features."""
    f = V.voice_features_b(_voice(spark, d))
    c = P.column_correlations(f, P.numeric_columns(f, exclude=["phone_no_m"]))
    return np_rounded(c, "pearson", "spearman")


# ---- step 10: training and scoring (rows-only checks) ---------------------------
def _flow_inputs(spark, d, outer: bool):
    ds = _outer(spark, d) if outer else _q_dl(spark, d)
    return split_train_test(ds)


@register("train_score_gbt")
def _q_tsg(spark, d):
    """First flow: 5 folds, boosted trees, F1 cut-off search, fold-mean
    scaled scores, decision per test phone."""
    train, test, feats = _flow_inputs(spark, d, outer=False)
    cats = category_sizes(train, test, ["city_name", "county_name"])
    res = kfold_train_score(train, test, feats, k=K.FIRST_FOLDS, seed=K.FIRST_SEED,
                            params=TreeParams(), categorical=cats)
    return res.submission


_SECOND: dict[tuple[str, str], FlowResult] = {}


def _second(spark, d) -> FlowResult:
    """The second flow, fitted once per session and data set: its two queries
    read the same fold models."""
    name = (spark.sparkContext.applicationId, d)
    if name not in _SECOND:
        train, test, feats = _flow_inputs(spark, d, outer=True)
        _SECOND[name] = kfold_mean_offset(train, test, feats, k=K.SECOND_FOLDS, seed=K.SECOND_SEED, params=SECOND_FLOW)
    return _SECOND[name]


@register("submission")
def _q_sub(spark, d):
    """Second flow: 3 folds on the outer data set, mean score minus 0.3."""
    return _second(spark, d).submission


@register("feature_importance")
def _q_fi(spark, d):
    """Mean importance per feature over the second flow's fold models."""
    return _second(spark, d).importances


# ---- splits, edges and time parts -------------------------------------------------
@register("recall_train")
def _q_rt(spark, d):
    """G3 of the training users' own voice rows, falling back to all rows."""
    v = _voice(spark, d)
    return G.callback_with_fallback(v.join(_labels(spark, d).select("phone_no_m"), "phone_no_m", "left_semi"), v)


@register("contact_edges_reversed")
def _q_cer(spark, d):
    """G1 with other phones' caller rows as incoming edges."""
    return G.contact_edges(_voice(spark, d), "call", reverse=True)


@register("class_split_calls")
def _q_csc(spark, d):
    """The voice rows of each class, counted and summed."""
    return C.class_split(_voice(spark, d), _labels(spark, d)).groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("phone_no_m").alias("phones"), zero_sum("call_dur").alias("seconds"))


@register("both_splits")
def _q_bs(spark, d):
    """The voice rows of both splits as one log, counted per phone."""
    v = _voice(spark, d)
    of = lambda users: v.join(users.select("phone_no_m"), "phone_no_m", "left_semi")
    both = of(views.train_users(spark, d)).unionByName(of(views.test_users(spark, d)))
    return both.groupBy("phone_no_m").agg(F.count(F.lit(1)).alias("rows"))


@register("text_time_parts")
def _q_ttp(spark, d):
    """SMS times written as text, parsed, by month and time."""
    text = F.date_format("request_datetime", "yyyy-MM-dd HH:mm:ss")
    t = views.sms(spark, d).select(parse_datetime(text).alias("t"))
    return t.groupBy(month_of("t").alias("month"), time_of("t").alias("time")).agg(F.count(F.lit(1)).alias("rows"))


@register("fixed_offset")
def _q_fo(spark, d):
    """M14 / P11 over the plain scores."""
    return L.fixed_offset(_plain_scores(spark, d))


@register("ensemble_cut")
def _q_ec(spark, d):
    """M10 over fold means (M8): decisions above the rounded percentile."""
    return L.percentile_cut(_q_fmean(spark, d), 89.0, "prob")


# ---- flagship and remaining small operators --------------------------------------
@register("users_voice_features_b")
def _q_flag(spark, d):
    """Flagship: every user left-joined to the F7 voice features."""
    u = views.users(spark, d).select("phone_no_m", "label", "split")
    return u.join(V.voice_features_b(_voice(spark, d)), "phone_no_m", "left")


@register("callback_times_ratio")
def _q_ctr(spark, d):
    """Call x re_ratio over the call-back table with fallback."""
    return G.callback_times_ratio(G.callback_with_fallback(_voice(spark, d)))


@register("segment_report")
def _q_sr(spark, d):
    """The segment report (C4-C8) of the labelled users as one table."""
    return segment_report(_labels(spark, d), views.app(spark, d), _voice(spark, d), views.sms(spark, d),
                          max_months=K.FIXTURE_LOW_MONTHS, contacts_over=K.FIXTURE_CONTACTS_OVER,
                          handsets_over=K.FIXTURE_HANDSETS_OVER)


@register("class_daily_quantiles")
def _q_cdq(spark, d):
    """C10, daily measures: quantiles per class of each phone-day's mean
    duration, all calls / as caller / as called."""
    daily = V.daily_mean_duration(_voice(spark, d))
    return P.class_quantiles(daily, _labels(spark, d), ["dur_mean", "dur_mean_out", "dur_mean_in"])


# the training queries take minutes each: keep them behind the others
for _name in ("train_score_gbt", "submission", "feature_importance"):
    REGISTRY[_name] = REGISTRY.pop(_name)
