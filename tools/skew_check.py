"""Hot-key check from Spark's event log.

Builds a skewed voice log from the shared tables (a third of the rows
re-keyed to one phone, derived by Spark from the data), runs operators on
it with the event log written to a scratch folder, and reports for every
stage the largest share of shuffle records read by one task.  A plan that
gathers the hot phone's rows in one task shows a share of at least 1/3;
pre-aggregated plans stay near 1/partitions.

usage: python tools/skew_check.py [sf_dir]   (prints one JSON line)
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def stage_shares(event_dir: str) -> dict[int, tuple[int, float]]:
    """stage id -> (records read, largest single-task share)."""
    per: dict[int, list[int]] = {}
    for path in glob.glob(os.path.join(event_dir, "**", "events_*"), recursive=True):
        if path.endswith(".zstd"):
            import io

            import zstandard
            with open(path, "rb") as raw:
                text = zstandard.ZstdDecompressor().stream_reader(raw).read().decode()
            lines = io.StringIO(text)
        else:
            lines = open(path)
        with lines as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                n = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                per.setdefault(ev["Stage ID"], []).append(n)
    out = {}
    biggest = max((sum(xs) for xs in per.values()), default=0)
    for sid, xs in per.items():
        tot = sum(xs)
        # stages over bounded tables (rank offsets, F1 buckets) read a few
        # records in one task; only stages carrying real data are judged
        if tot > 0 and tot >= 0.02 * biggest:
            out[sid] = (tot, max(xs) / tot)
    return out


def main() -> None:
    from pyspark.sql import SparkSession, Window
    from pyspark.sql import functions as F

    from phonelens.functions.ranking import exact_quantiles
    from phonelens.operators import app as A
    from phonelens.operators import device as D
    from phonelens.operators import graph as G
    from phonelens.operators import learn as L
    from phonelens.operators import voice as V
    from phonelens.session import DEFAULT_CONF, ensure_checkpoint_dir
    from phonelens.sources import views

    # small groups and tables are one task's work on purpose: measure the way of the large ones
    from phonelens.functions import ranking
    ranking.SMALL_GROUP = ranking.SMALL_TABLE = 0

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    scratch = tempfile.mkdtemp(prefix="phonelens-skew-", dir="/tmp")
    results = {}
    # name -> (view, column made hot, operator)
    cases = {
        "voice_features_b": ("voice", "phone_no_m", V.voice_features_b),
        "voice_features_a": ("voice", "phone_no_m", V.voice_features_a),
        "callback_with_fallback": ("voice", "phone_no_m", G.callback_with_fallback),
        "shared_handset_score": ("voice", "imei_m", D.shared_handset_score),
        "app_features": ("app", "phone_no_m", A.app_features),
        "no_outgoing": ("voice", "phone_no_m", G.no_outgoing),
        "contact_edges": ("voice", "phone_no_m", G.contact_edges),
        # classes are naturally skewed (about 92% label 0): ranks per class
        "stratified_folds": ("users", None, lambda u: L.stratified_folds(u.select("phone_no_m", "label"))),
        # many distinct scores over the whole voice log; then nine rows of ten share one value
        "auc_rank": ("voice", None, lambda v: L.auc_rank(v.select(
            (F.xxhash64(*v.columns) / 1e18).alias("prob"), (F.col("calltype_id") == 1).cast("int").alias("label")))),
        "tied_quantiles": ("voice", None, lambda v: exact_quantiles(v.select(
            F.when(F.pmod(F.xxhash64(*v.columns), F.lit(10)) == 0, F.xxhash64(*v.columns) / 1e18).otherwise(1.0)
            .alias("x")), "x", [0.1, 0.5, 0.97])),
        # negative controls: every row of a phone / of a class sent to one task
        "naive_repartition_by_phone": ("voice", "phone_no_m", lambda log: log.repartition(8, "phone_no_m")
                                       .groupBy("phone_no_m").agg(F.count_distinct("opposite_no_m").alias("n"))),
        "naive_window_by_class": ("users", None, lambda u: u.withColumn(
            "r", F.row_number().over(Window.partitionBy("label").orderBy("phone_no_m")))),
    }
    for name, (view, hot_col, fn) in cases.items():
        ev = os.path.join(scratch, name)
        os.makedirs(ev)
        b = SparkSession.builder.master("local[8]").appName(f"skew-{name}")
        for k, v in DEFAULT_CONF.items():
            b = b.config(k, v)
        spark = (b.config("spark.sql.shuffle.partitions", "8").config("spark.eventLog.enabled", "true")
                 .config("spark.eventLog.dir", ev).config("spark.sql.adaptive.coalescePartitions.enabled", "false")
                 .getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
        ensure_checkpoint_dir(spark)
        log = views.VIEWS[view](spark, sf_dir)
        skewed = log
        if hot_col is not None:
            hot = F.pmod(F.xxhash64(*[c for c in log.columns if c != hot_col]), F.lit(3)) == 0
            skewed = log.withColumn(hot_col, F.when(hot, F.lit(0)).otherwise(F.col(hot_col)).cast(
                dict(log.dtypes)[hot_col]))
        fn(skewed).write.format("noop").mode("overwrite").save()
        spark.stop()
        shares = stage_shares(ev)
        results[name] = round(max(s for _, s in shares.values()), 3) if shares else 0.0
    print(json.dumps({"max_task_share": results}))


if __name__ == "__main__":
    main()
