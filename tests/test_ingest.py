"""Broken CSV rows: kept apart, counted, and never read as NULLs."""

import os
import tempfile

import pytest

from phonelens.sources import ingest as I
from phonelens.sources import load

HEAD = "phone_no_m,opposite_no_m,calltype_id,start_datetime,call_dur,city_name,county_name,imei_m\n"
SOUND = ["p1,p2,1,2020-01-02 03:04:05,12,c,k,h", "p1,,2,,,,,", 'p2,"a,b",1,2020-01-02 03:04:05,1.5,c,k,h']
BROKEN = ["p3,p2,1,2020-13-45 03:04:05,12,c,k,h",        # no such date
          "p3,p2,one,2020-01-02 03:04:05,12,c,k,h",      # no number
          "p3,p2,1",                                     # columns missing
          "p3,p2,1,2020-01-02 03:04:05,12,c,k,h,more",   # one too many
          'p3,"p2,1,2020-01-02 03:04:05,12,c,k,h']       # a stray quote swallows the rest


def _table(lines, head=HEAD, name="train_voc"):
    d = tempfile.mkdtemp(prefix="phonelens-ingest-", dir="/tmp")
    with open(os.path.join(d, f"{name}.csv"), "w") as f:
        f.write(head + "".join(x + "\n" for x in lines))
    return d


def test_broken_rows_go_to_quarantine(spark):
    d = _table([SOUND[0], *BROKEN, *SOUND[1:], ""])
    out = os.path.join(d, "out")
    got = I.ingest(spark, d, "train_voc", out)
    assert (got.rows, got.kept, got.broken) == (8, 3, 5)
    kept = load(spark, out, "train_voc", fmt="parquet")
    assert {(r.phone_no_m, r.opposite_no_m, r.call_dur) for r in kept.collect()} == {
        ("p1", "p2", 12.0), ("p1", None, None), ("p2", "a,b", 1.5)}
    assert dict(kept.dtypes) == dict(load(spark, d, "train_voc").dtypes)
    aside = spark.read.parquet(I.quarantine_path(out, "train_voc")).collect()
    assert sorted(r.line for r in aside) == sorted(BROKEN)
    why = {r.line: r.columns for r in aside}
    assert [why[x] for x in BROKEN] == [["start_datetime"], ["calltype_id"], *[[I.FIELDS]] * 3]
    assert all(r.file.endswith("train_voc.csv") for r in aside)


def test_rows_are_broken_whatever_is_selected(spark):
    d = _table([*SOUND, *BROKEN])
    rows = I.load_checked(spark, d, "train_voc")
    assert rows.filter(rows[I.BROKEN].isNotNull()).count() == 5
    assert len(rows.filter(rows[I.BROKEN].isNull()).select("call_dur").collect()) == 3
    assert len(rows.select("phone_no_m").collect()) == 8
    two = _table(["p1,x,one,2020-1-2,12,c,k,h"])
    assert I.load_checked(spark, two, "train_voc").first()[I.BROKEN] == ["calltype_id", "start_datetime"]


def test_a_second_run_leaves_no_old_lines(spark):
    d = _table([*SOUND, *BROKEN])
    out = os.path.join(d, "out")
    I.ingest(spark, d, "train_voc", out)
    with open(os.path.join(d, "train_voc.csv"), "w") as f:
        f.write(HEAD + SOUND[0] + "\n")
    got = I.ingest(spark, d, "train_voc", out)
    assert (got.rows, got.broken) == (1, 0)
    assert spark.read.parquet(I.quarantine_path(out, "train_voc")).count() == 0
    assert load(spark, out, "train_voc", fmt="parquet").count() == 1


def test_header_in_another_order_and_unknown_names_raise(spark):
    d = _table([SOUND[0]], head=HEAD.replace("phone_no_m,opposite_no_m", "opposite_no_m,phone_no_m"))
    with pytest.raises(Exception, match="(?i)header"):
        I.load_checked(spark, d, "train_voc").count()
    with pytest.raises(ValueError):
        I.load_checked(spark, d, "train_foo")


def test_all_tables_counts_and_limit(spark):
    d = _table([*SOUND, *BROKEN])
    with open(os.path.join(d, "train_app.csv"), "w") as f:
        f.write("phone_no_m,busi_name,flow,month_id\np1,w,1.5,2020-01\n")
    with open(os.path.join(d, "test_app.csv"), "w") as f:
        f.write("phone_no_m,busi_name,flow,month_id\n")
    names = ["test_app", "train_app", "train_voc"]
    got = {tuple(r) for r in I.ingest_all(spark, d, os.path.join(d, "out"), names).collect()}
    assert got == {("test_app", 0, 0, 0), ("train_app", 1, 1, 0), ("train_voc", 8, 3, 5)}
    with pytest.raises(ValueError, match="train_voc"):
        I.ingest_all(spark, d, os.path.join(d, "out2"), names, max_broken_share=0.1)
