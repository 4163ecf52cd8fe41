"""End-to-end runs over the eight source tables (CSV or Parquet).

``first_flow`` is what the source's main script did: feature tables for
train and test, the user tables joined to them, k-fold boosted trees with
the F1 cut-off search, and the two submission files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonelens import constants as K
from phonelens.plans.dataset import (
    align_columns, baseline_dataset, join_stored_blocks, outer_blocks, outer_dataset, store_blocks)
from phonelens.plans.model import (
    SECOND_FLOW, FlowResult, TreeParams, category_sizes, kfold_mean_offset, kfold_train_score, split_train_test,
    write_submissions)
from phonelens.sources.sinks import write_named, write_submission
from phonelens.sources.loader import load, load_log_pair
from phonelens.sources.schemas import ARPU_MONTHS, TEST_ARPU
from phonelens.operators import graph
from phonelens.operators.app import app_features
from phonelens.operators.sms import sms_features_a
from phonelens.operators.user import keep_last_month
from phonelens.operators.voice import voice_features_a


def stack_users(train_user: DataFrame, test_user: DataFrame) -> DataFrame:
    """Train and test users in one table with a ``split`` column: training
    rows keep only their last ARPU month, under the test table's name;
    test rows have no label."""
    tr = keep_last_month(train_user, ARPU_MONTHS, TEST_ARPU).withColumn("split", F.lit("train"))
    te = test_user.withColumn("label", F.lit(None).cast("int")).withColumn("split", F.lit("test"))
    return tr.unionByName(te)


def first_flow(spark: SparkSession, base: str, out: str | None = None, fmt: str = "csv",
               params: TreeParams | None = None) -> FlowResult:
    """Load the eight tables under ``base``, build the data set, train and
    score; write ``prob_submission`` and ``submission`` under ``out``."""
    users = stack_users(load(spark, base, "train_user", fmt), load(spark, base, "test_user", fmt))
    ds = baseline_dataset(users, load_log_pair(spark, base, "voc", fmt), load_log_pair(spark, base, "sms", fmt),
                          load_log_pair(spark, base, "app", fmt), [TEST_ARPU], keep_as=TEST_ARPU)
    train, test, feats = split_train_test(ds)
    cats = category_sizes(train, test, ["city_name", "county_name"])
    res = kfold_train_score(train, test, feats, k=K.FIRST_FOLDS, seed=K.FIRST_SEED,
                            params=params or TreeParams(), categorical=cats)
    if out is not None:
        write_submissions(res.submission, out)
    return res


def feature_tables(spark: SparkSession, base: str, out: str, fmt: str = "csv") -> None:
    """The source's feature run: app, voice and SMS blocks of each split's
    own logs, written as the six tables that ``load`` finds by name."""
    for split in ("train", "test"):
        for name, log, block in (("app", "app", app_features), ("voice", "voc", voice_features_a),
                                 ("sms", "sms", sms_features_a)):
            write_named(block(load(spark, base, f"{split}_{log}", fmt)), out, f"{split}_{name}_features")


def recall_flow(spark: SparkSession, base: str, out: str, fmt: str = "csv") -> None:
    """The source's call-back run: per split and channel the table of the
    split's own log, written as ``{split}_recall_{channel}``; phones without
    an outgoing edge fall back to the voice rows of both splits."""
    pool = load_log_pair(spark, base, "voc", fmt)
    for split in ("train", "test"):
        for channel, log in (("call", "voc"), ("sms", "sms")):
            table = graph.callback_with_fallback(load(spark, base, f"{split}_{log}", fmt), pool)
            write_named(table, out, f"{split}_recall_{channel}")


def second_flow(spark: SparkSession, base: str, out: str | None = None, fmt: str = "csv",
                params: TreeParams | None = None, recall: str | None = None, buckets: int | None = None) -> FlowResult:
    """The source's second (switched-off) run: per split, users (training
    users with the ARPU mean) full-outer-joined to the voice, SMS and app
    blocks; features filled with 0; test columns aligned to training ones
    (its month renamed ``arpu_``); 3 folds; mean score minus 0.3, written
    as ``(phone_no_m, label)`` under ``out``.  The merged data sets are
    written there too and read back.  ``recall``: the folder of a
    ``recall_flow``, whose call tables then join the data sets.  ``buckets``
    (with ``out``) stores each split's blocks bucketed by phone, to be joined
    without a shuffle and read by later runs (``dataset.open_blocks``)."""
    def logs(split):
        return [load(spark, base, f"{split}_{name}", fmt) for name in ("voc", "sms", "app")]

    train_u = load(spark, base, "train_user", fmt).withColumn("split", F.lit("train"))
    test_u = (load(spark, base, "test_user", fmt).withColumnRenamed(TEST_ARPU, "arpu_")
              .withColumn("label", F.lit(None).cast("int")).withColumn("split", F.lit("test")))
    def merged(split, users, months):
        calls = load(spark, recall, f"{split}_recall_call") if recall else None
        if out is not None and buckets:
            ds = join_stored_blocks(store_blocks(outer_blocks(users, *logs(split), months, calls), out, f"{split}_block", buckets))
        else:
            ds = outer_dataset(users, *logs(split), months, callbacks=calls)
        if out is None:
            return ds
        write_named(ds, out, f"{split}_dataset")
        return load(spark, out, f"{split}_dataset")

    train_ds, test_ds = merged("train", train_u, ARPU_MONTHS), merged("test", test_u, None)
    test_ds = test_ds.select("phone_no_m", *align_columns(train_ds, test_ds).columns, "label")
    train, _, feats = split_train_test(train_ds)
    _, test, _ = split_train_test(test_ds.withColumn("split", F.lit("test")))
    res = kfold_mean_offset(train, test, feats, k=K.SECOND_FOLDS, seed=K.SECOND_SEED,
                            params=params or SECOND_FLOW)
    if out is not None:
        write_submission(res.submission, f"{out.rstrip('/')}/second_submission")
    return res


def coverage_flow(spark: SparkSession, base: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """The source's coverage script: training users missing from each
    training log with the scam numbers among them (C1), and test users
    missing from the test voice log (C2)."""
    from phonelens.operators.coverage import log_coverage, test_coverage
    users = load(spark, base, "train_user", fmt)
    logs = {name: load(spark, base, f"train_{name}", fmt) for name in ("voc", "sms", "app")}
    return (log_coverage(users, logs),
            test_coverage(load(spark, base, "test_user", fmt), load(spark, base, "test_voc", fmt)))


def segment_flow(spark: SparkSession, base: str, fmt: str = "csv") -> DataFrame:
    """The source's segment report over the training tables, with the
    source's bounds (fewer than 2 app months, more than 100 contacts, more
    than 10 handsets)."""
    from phonelens.plans.report import segment_report
    labels = load(spark, base, "train_user", fmt).select("phone_no_m", "label")
    return segment_report(labels, load(spark, base, "train_app", fmt), load(spark, base, "train_voc", fmt),
                          load(spark, base, "train_sms", fmt), max_months=K.LOW_USAGE_MONTHS,
                          contacts_over=K.SOURCE_CONTACTS_OVER, handsets_over=K.SOURCE_HANDSETS_OVER)
