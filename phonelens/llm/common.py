"""Storage and input helpers shared by the operators."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonelens.session import ensure_checkpoint_dir

# White space between words, as contracts define words: [^\x20\x09-\x0D]+
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go as soon as each has ended;
    otherwise they wait for a garbage collection of the driver, which more data
    does not bring nearer."""
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the session's checkpoint folder (shared
    on a cluster) and read it back.  Cuts lineage, so a lost executor costs a
    re-read; columns stay prunable.  The write's shuffle files go with it."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"llm-{uuid.uuid4().hex}")
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove all files of ``stored`` that ``frames`` read; other files stay.
    For tables whose successors are stored: nothing may read them again."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark)).toUri().getPath()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("llm-") and path.getParent().toUri().getPath() == top:
                path.getFileSystem(conf).delete(path, True)


def instead(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, stored; then the stored files of ``old`` go."""
    out = stored(new)
    discard(old)
    return out


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so other
    columns of the input can neither clash nor be scanned."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def conf_bytes(spark: SparkSession, key: str) -> int:
    """A size setting ("16m", "128MB", "134217728b") in bytes."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", str(spark.conf.get(key)).strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


HOT_KEYS = 1000


def join_spread(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row per key; ``weight``: how many
    of ``rows`` have it) so that no key's rows meet in one task.

    Keys that hold more than 1 / HOT_KEYS of all rows, fewer than HOT_KEYS by that, are
    broadcast; the others are joined by shuffle.  Both inputs are read twice: store them."""
    share = rows.count() // HOT_KEYS
    hot, rest = table.filter(F.col(weight) > share), table.filter(F.col(weight) <= share)
    of_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    out = others.join(rest.hint("shuffle_hash"), key, how)
    return of_hot.unionByName(out)


def rows_without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not among ``gone`` (doc_id, text_key: a
    hash of the text), which may hold NULL and repeated ids."""
    names = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    same = F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col("_gone_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id"))
    return docs.join(names, same, "left_anti")
