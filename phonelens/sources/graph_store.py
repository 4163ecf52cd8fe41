"""A contact graph that is stored and grows by batches.

Stored are the pairs of ``graph.contact_pairs`` (phone, contact, rows, rows
as caller, rows as called) per channel, in folders by a hash of the phone.
All counts add up, so a new batch (a day's log) is aggregated alone and
merged into the folders of its phones; other folders are not touched.  The
graph operators read the stored pairs in place of a log.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonelens.operators._common import CONTACT, KEY
from phonelens.operators.graph import contact_pairs
from phonelens.session import materialize

BUCKET = "bucket"
LEDGER = -1          # the folder that names the merged batches
COUNTS = ["n", "n_out", "n_in"]


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None before the first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def merged_batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches in the graph (one short row each)."""
    old = _stored(spark, path)
    return [] if old is None else sorted(r.batch for r in old.filter(F.col(BUCKET) == LEDGER).select("batch").collect())


def merge_log(spark: SparkSession, path: str, log: DataFrame, batch: str, channel: str = "call",
              buckets: int = 256) -> int:
    """Add the rows of ``log`` to the graph at ``path`` under the name
    ``batch``; returns the number of folders rewritten.

    Only the folders that hold a phone of the batch are read and replaced,
    together with the list of batches, in one job; a batch that is in that
    list raises, so that a repeated run does not count twice.  One writer at a
    time; should the job's last step, which swaps folders, be cut off, build the
    graph anew.  ``buckets``
    must stay the same for a graph and raises otherwise; it bounds what the driver
    sees (the touched folder numbers).  Rows without a phone are left out, a NULL
    contact is kept (see ``contact_pairs``).  Keys are stored as text or as
    numbers, as the first batch has them."""
    old = _stored(spark, path)
    if old is not None:
        ledger = old.filter(F.col(BUCKET) == LEDGER)
        names = {r.batch: r.n for r in ledger.select("batch", "n").collect()}
        if batch in names:
            raise ValueError(f"batch {batch!r} is in the graph already")
        if set(names.values()) != {buckets}:
            raise ValueError(f"the graph has {sorted(set(names.values()))} folders, not {buckets}")
    place = F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int").alias(BUCKET)
    new = materialize(contact_pairs(log).select(KEY, CONTACT, *COUNTS, F.lit(channel).alias("channel"),
                                                F.lit(None).cast("string").alias("batch"), place))
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
    rows, listed = new, None
    if old is not None:
        if [old.schema[c].dataType for c in (KEY, CONTACT)] != [new.schema[c].dataType for c in (KEY, CONTACT)]:
            raise ValueError("phones of the batch and of the graph have different types")
        rows = new.unionByName(old.filter(F.col(BUCKET).isin(touched)))
        listed = ledger
    summed = rows.groupBy(BUCKET, KEY, CONTACT, "channel").agg(*[F.sum(c).alias(c) for c in COUNTS])
    entry = spark.createDataFrame([(batch, LEDGER, buckets)], T.StructType([
        T.StructField("batch", T.StringType()), T.StructField(BUCKET, T.IntegerType()), T.StructField("n", T.LongType())]))
    out = summed.unionByName(entry, allowMissingColumns=True)
    if listed is not None:
        out = out.unionByName(listed)
    # written out before the folders that it was read from are replaced; a
    # folder with a hot phone is split over several tasks and files
    out = materialize(out.hint("rebalance", F.col(BUCKET)))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))
    return len(touched)


def load_pairs(spark: SparkSession, path: str, channel: str = "call") -> DataFrame:
    """The stored pairs of one channel; ``graph``'s operators take them in
    place of a log.  A path without a graph raises."""
    return (spark.read.parquet(path).filter((F.col(BUCKET) != LEDGER) & (F.col("channel") == channel))
            .select(KEY, CONTACT, *COUNTS))
