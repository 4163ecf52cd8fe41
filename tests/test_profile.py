"""Whole profile (C9) and class densities (C10) against numpy and pandas."""

import math

import numpy as np
import pandas as pd
import pytest

from phonelens.functions import ranking
from phonelens.operators import profile as P
from phonelens.operators import voice as V

MISSING = float("nan")


def _values(spark, groups):
    rows = [(label, m, float(v)) for (label, m), vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "label int, measure string, value double")


def _exact_density(xs, at):
    h = np.std(xs, ddof=1) * len(xs) ** -0.2
    return np.exp(-0.5 * ((at[:, None] - xs[None]) / h) ** 2).sum(1) / (len(xs) * h * math.sqrt(2 * math.pi)), h


def test_density_equals_the_written_out_sum(spark):
    rng = np.random.default_rng(7)
    groups = {(0, "a"): rng.normal(5, 2, 400), (1, "a"): rng.exponential(3, 250),
              (0, "b"): np.r_[np.zeros(300), rng.lognormal(2, 1.5, 200)], (1, "b"): [1.0, 2.0]}
    got = P.class_density(_values(spark, groups), points=60).toPandas()
    assert len(got) == 4 * 60
    for (label, m), xs in groups.items():
        xs = np.asarray(xs, float)
        g = got[(got.label == label) & (got.measure == m)].sort_values("point")
        exact, h = _exact_density(xs, g.x.to_numpy())
        assert g.bandwidth.iloc[0] == pytest.approx(h, rel=1e-5) and (g.n == len(xs)).all()
        # linear dealing to bins of h / 8 moves the density by at most 0.3 % of its greatest value
        assert np.abs(g.density.to_numpy() - exact).max() < 3e-3 * (0.4 / h)
    a = got[got.measure == "a"]
    assert a[a.label == 0].x.sort_values().tolist() == a[a.label == 1].x.sort_values().tolist()


def test_density_has_unit_mass_and_a_shared_grid(spark):
    rng = np.random.default_rng(3)
    got = P.class_density(_values(spark, {(0, "a"): rng.normal(0, 1, 500)}), points=200).toPandas().sort_values("point")
    assert np.trapezoid(got.density, got.x) == pytest.approx(1.0, abs=3e-3)
    assert got.point.tolist() == list(range(200))


def test_density_without_spread_nulls_and_no_rows(spark):
    rows = [(0, "a", 1.0), (0, "a", 1.0), (1, "a", 4.0), (None, "a", 2.0), (0, None, 2.0),
            (0, "b", None), (0, "b", MISSING), (0, "b", float("inf")), (0, "b", 1.0), (0, "b", 2.0)]
    df = spark.createDataFrame(rows, "label int, measure string, value double")
    got = P.class_density(df, points=10).toPandas()
    assert set(zip(got.label, got.measure)) == {(0, "b")} and (got.n == 2).all()
    assert P.class_density(df.limit(0)).count() == 0


def test_class_values_keeps_labelled_phones_only(spark):
    f = spark.createDataFrame([("p", 1.0, None), ("q", 2.0, 3.0), ("z", 9.0, 9.0)], "phone_no_m string, a double, b double")
    lab = spark.createDataFrame([("p", 0), ("q", 1)], "phone_no_m string, label int")
    got = {tuple(r) for r in P.class_values(f, lab, ["a", "b"]).collect()}
    assert got == {(0, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0)}


def test_class_measures_against_pandas(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        phone = "hot" if i % 3 == 0 else f"p{rng.integers(6)}"
        contact = None if rng.random() < 0.1 else f"c{rng.integers(9)}"
        when = None if rng.random() < 0.1 else pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(rng.integers(5)))
        rows.append((phone, contact, int(rng.integers(1, 4)), when, float(rng.integers(0, 12)), "x", "y", "h"))
    rows.append(("lone", "c1", 3, None, None, None, None, None))
    rows.append((None, "c1", 1, None, 3.0, None, None, None))
    names = ["phone_no_m", "opposite_no_m", "calltype_id", "start_datetime", "call_dur", "city_name", "county_name", "imei_m"]
    log = spark.createDataFrame([(*r[:3], r[3].to_pydatetime() if r[3] is not None else None, *r[4:]) for r in rows],
                                "phone_no_m string, opposite_no_m string, calltype_id int, start_datetime timestamp_ntz, "
                                "call_dur double, city_name string, county_name string, imei_m string")
    got = V.voice_class_measures(log).toPandas().set_index("phone_no_m").astype(float)
    pdf = pd.DataFrame(rows, columns=names)
    pdf = pdf[pdf.phone_no_m.notna()]
    want = pd.DataFrame(index=pdf.phone_no_m.unique())
    for end, part in (("", pdf), ("_out", pdf[pdf.calltype_id == 1]), ("_in", pdf[pdf.calltype_id == 2])):
        by = part.groupby("phone_no_m")
        per_day = part.dropna(subset=["start_datetime"]).groupby(["phone_no_m", "start_datetime"]).size().groupby("phone_no_m")
        want[f"calls{end}"], want[f"contacts{end}"] = by.opposite_no_m.count(), by.opposite_no_m.nunique()
        want[f"days{end}"] = by.start_datetime.nunique()
        want[f"day_max{end}"], want[f"day_mean{end}"] = per_day.max(), per_day.mean()
    want["seconds"] = pdf.groupby("phone_no_m").call_dur.sum()
    out = pdf[pdf.calltype_id == 1]
    want["short_share"] = (out.call_dur < 5).groupby(out.phone_no_m).mean()
    assert len(got) == len(want) and set(got.columns) == set(want.columns)
    pd.testing.assert_frame_equal(got.sort_index()[sorted(want.columns)], want.sort_index()[sorted(want.columns)].astype(float),
                                  check_names=False)


def test_value_profile_of_texts_and_times(spark):
    rows = [("a", 1, None), ("a", 2, None), ("bb", 2, None), ("", None, None), (None, 3, None), (" ", 2, None)]
    df = spark.createDataFrame(rows, "t string, i int, nothing timestamp_ntz")
    got = {r["column"]: r.asDict() for r in P.value_profile(df).collect()}
    t = got["t"]
    assert (t["rows"], t["count"], t["nulls"], t["blank"], t["distinct"], t["once"]) == (6, 5, 1, 2, 4, 3)
    assert (t["top"], t["top_count"], t["min"], t["max"]) == ("a", 2, "", "bb")
    assert (t["min_length"], t["max_length"]) == (0, 2) and t["mean_length"] == pytest.approx(1.0)
    p = np.array([2, 1, 1, 1]) / 5
    assert t["entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert got["i"]["top"] == "2" and got["i"]["top_count"] == 3
    n = got["nothing"]
    assert (n["rows"], n["count"], n["nulls"], n["distinct"], n["once"], n["top"], n["top_count"]) == (6, 0, 6, 0, 0, None, None)
    assert P.value_profile(df.limit(0)).count() == 0


def test_null_pairs_against_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({c: np.where(rng.random(300) < p, np.nan, 1.0) for c, p in
                        (("a", 0.3), ("b", 0.6), ("full", -1.0), ("none", 2.0))})
    pdf["like_a"] = pdf.a
    df = spark.createDataFrame([tuple(None if math.isnan(x) else x for x in r) for r in pdf.itertuples(index=False)],
                               "a double, b double, full double, none double, like_a double")
    got = {(r.column_a, r.column_b): r for r in P.null_pairs(df).collect()}
    flags = pdf.isna()
    assert len(got) == 10
    for (a, b), r in got.items():
        assert (r.rows, r.nulls_a, r.nulls_b) == (300, flags[a].sum(), flags[b].sum())
        assert r.both == (flags[a] & flags[b]).sum()
        if flags[a].nunique() < 2 or flags[b].nunique() < 2:
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(np.corrcoef(flags[a], flags[b])[0, 1], abs=1e-12)
    with pytest.raises(ValueError):
        P.null_pairs(df.select("a"))


@pytest.mark.parametrize("small", [None, 0])
def test_correlations_against_pandas(spark, monkeypatch, small):
    """``small`` 0 sends the ranks through the split running sums."""
    if small is not None:
        monkeypatch.setattr(ranking, "SMALL_TABLE", small)
    rng = np.random.default_rng(2)
    n = 500
    a = np.where(rng.random(n) < 0.4, 0.0, rng.integers(0, 50, n)).astype(float)   # two rows of five share a value
    pdf = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(0, 9, n), "c": rng.normal(1e6, 1, n), "flat": np.ones(n),
                        "holes": np.where(rng.random(n) < 0.5, np.nan, -a + rng.integers(0, 5, n))})
    rows = [tuple(r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, holes double")
    got = {(r.column_a, r.column_b): r for r in P.column_correlations(df).collect()}
    pearson, spearman = pdf.corr(), pdf.corr(method="spearman")
    assert len(got) == 10
    for (x, y), r in got.items():
        assert r.n == pdf[[x, y]].dropna().shape[0]
        if "flat" in (x, y):
            assert r.pearson is None and r.spearman is None
        else:
            assert r.pearson == pytest.approx(pearson.loc[x, y], abs=1e-9)
            assert r.spearman == pytest.approx(spearman.loc[x, y], abs=1e-9)


def test_correlations_of_empty_and_one_row_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0, None)], "a double, b double, c double")
    got = [tuple(r) for r in P.column_correlations(df).collect()]
    assert got == [("a", "b", 1, None, None)]
    assert P.column_correlations(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [None, 0])
def test_column_profile_against_pandas(spark, monkeypatch, small):
    """``small`` 0 sends the quantiles through the split running sums."""
    if small is not None:
        monkeypatch.setattr(ranking, "SMALL_GROUP", small)
        monkeypatch.setattr(ranking, "SMALL_TABLE", small)
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": np.where(rng.random(300) < 0.4, 0.0, rng.normal(1e6, 3, 300)),
                        "b": np.where(rng.random(300) < 0.3, np.nan, rng.integers(0, 9, 300).astype(float)),
                        "one": np.r_[5.0, np.full(299, np.nan)], "none": np.full(300, np.nan)})
    rows = [tuple(None if math.isnan(x) else x for x in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, one double, none double")
    got = {r["column"]: r.asDict() for r in P.column_profile(df).collect()}
    assert set(got) == set(pdf.columns)
    for c, r in got.items():
        xs = pdf[c].dropna()
        assert (r["rows"], r["count"], r["nulls"], r["distinct"]) == (300, len(xs), 300 - len(xs), xs.nunique())
        if len(xs) == 0:
            assert all(r[k] is None for k in ("mean", "std", "min", "max", "q25", "q50", "q75", "top", "top_count"))
            continue
        assert r["mean"] == pytest.approx(xs.mean(), rel=1e-12) and (r["min"], r["max"]) == (xs.min(), xs.max())
        assert r["std"] is None if len(xs) == 1 else r["std"] == pytest.approx(xs.std(), rel=1e-12)
        assert [r["q25"], r["q50"], r["q75"]] == pytest.approx(xs.quantile([0.25, 0.5, 0.75]).tolist(), rel=1e-12)
        counted = xs.value_counts()
        assert r["top"] == min(counted[counted == counted.max()].index) and r["top_count"] == counted.max()
