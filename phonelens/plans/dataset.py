"""Data-set assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonelens.operators.app import app_features, app_months
from phonelens.operators.learn import category_codes
from phonelens.operators.sms import sms_features_a, sms_features_b
from phonelens.operators.user import keep_last_month, user_arpu_mean
from phonelens.operators.voice import voice_features_a, voice_features_b
from phonelens.operators._common import KEY
from phonelens.sources.sinks import open_bucketed, write_bucketed

CATEGORIES = ["city_name", "county_name"]
NON_FEATURES = [KEY, "label", "split"]


def with_test_unlabelled(users: DataFrame) -> DataFrame:
    """Test rows carry no label (the source's test table has none)."""
    return users.withColumn("label", F.when(F.col("split") == "train", F.col("label")))


def baseline_dataset(users: DataFrame, voice: DataFrame, sms: DataFrame, app: DataFrame,
                     months: list[str], keep_as: str = "arpu_last") -> DataFrame:
    """F9 + the first flow's assembly: every user left-joined to the
    app (F1), voice (F2) and SMS (F3) blocks; only the last ARPU month is
    kept, under one name for both splits; city and county become codes
    fitted once on train ∪ test.  Each block is one row per phone and
    already hash-partitioned by phone, so the joins add no shuffle of the
    logs."""
    u = keep_last_month(users, months, keep_as)
    j = (u.join(app_features(app), KEY, "left")
         .join(voice_features_a(voice), KEY, "left")
         .join(sms_features_a(sms), KEY, "left"))
    return category_codes(j, CATEGORIES, fit_on=u)


def outer_dataset(users: DataFrame, voice: DataFrame, sms: DataFrame, app: DataFrame,
                  months: list[str] | None, callbacks: DataFrame | None = None) -> DataFrame:
    """F8: users with the ARPU mean (F4), full-outer-joined to voice (F7),
    SMS (F5) and app months (F6).  Phones absent from the user table keep
    a NULL label and split; they are not training rows.  ``callbacks``
    (G3's ``recall``, ``call``) is the optional block the source loaded and
    never merged (D8).  ``months=None`` keeps the user table as it is (the
    source's test users, which have one month only)."""
    out, *blocks = outer_blocks(users, voice, sms, app, months, callbacks).values()
    for block in blocks:
        out = out.join(block, KEY, "full")
    return out


def outer_blocks(users: DataFrame, voice: DataFrame, sms: DataFrame, app: DataFrame,
                 months: list[str] | None, callbacks: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that ``outer_dataset`` joins, users first."""
    blocks = {"users": users if months is None else user_arpu_mean(users, months),
              "voice": voice_features_b(voice), "sms": sms_features_b(sms), "app": app_months(app)}
    if callbacks is not None:
        blocks["recall"] = callbacks.select(KEY, "recall", "call")
    return blocks


def store_blocks(blocks: dict[str, DataFrame], folder: str, prefix: str, buckets: int) -> dict[str, DataFrame]:
    """The blocks of ``outer_blocks`` as tables ``{prefix}_{block}``
    bucketed by phone under ``folder``, and ``{prefix}_phones``, every phone that a
    block other than the users has.  Returns them as read back."""
    place = lambda n: f"{folder.rstrip('/')}/{prefix}_{n}"
    stored = {n: write_bucketed(b, f"{prefix}_{n}", place(n), buckets) for n, b in blocks.items()}
    # as plain files: distinct over a union of bucketed scans returns repeated
    # phones (the union claims the buckets, which its scans then do not keep)
    spark = blocks["users"].sparkSession
    of = [spark.read.parquet(place(n)).select(KEY) for n in blocks if n != "users"]
    phones = reduce(DataFrame.union, of).distinct()
    stored["phones"] = write_bucketed(phones, f"{prefix}_phones", place("phones"), buckets)
    return stored


def open_blocks(spark: SparkSession, folder: str, prefix: str, names: list[str], buckets: int) -> dict[str, DataFrame]:
    """The tables of ``store_blocks`` in a later session; ``names`` without ``phones``."""
    return {n: open_bucketed(spark, f"{prefix}_{n}", f"{folder.rstrip('/')}/{prefix}_{n}", buckets)
            for n in [*names, "phones"]}


def join_stored_blocks(stored: dict[str, DataFrame]) -> DataFrame:
    """J3 over stored blocks: the rows of ``outer_dataset``.  A full join's result
    has no partitioning that the next join could use, so the
    blocks join the stored phones from the right, and the users come
    last, in the only full join.  Bucketed by phone, no row moves.  Blocks
    hold one row per phone; user rows keep repeated and NULL phones."""
    out = stored["phones"]
    blocks = [b for n, b in stored.items() if n not in ("users", "phones")]
    for block in blocks:
        out = out.join(block, KEY, "left")
    return stored["users"].join(out, KEY, "full")


def feature_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    exclude = NON_FEATURES if exclude is None else exclude
    return [c for c in df.columns if c not in exclude]


def align_columns(train: DataFrame, test: DataFrame, rename: dict[str, str] | None = None,
                  drop: list[str] | None = None) -> DataFrame:
    """The test table in the training table's feature columns."""
    drop = [KEY, "label"] if drop is None else drop
    t = test
    for a, b in (rename or {}).items():
        t = t.withColumnRenamed(a, b)
    return t.select(*[c for c in train.columns if c not in drop])


def fill_missing(df: DataFrame, value: float = 0, exclude: list[str] | None = None) -> DataFrame:
    """NULL features become ``value``; key, label and split are left
    alone, so unlabelled rows stay unlabelled."""
    cols = [f.name for f in df.schema.fields
            if f.name not in (NON_FEATURES if exclude is None else exclude)
            and isinstance(f.dataType, T.NumericType)]
    return df.fillna(value, subset=cols)
