"""Writers for feature tables, data sets and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phonelens.sources.loader import path_of
from phonelens.sources.schemas import WRITTEN


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Feature table / merged data-set / recall table sink (Parquet)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, by: str = "phone_no_m") -> DataFrame:
    """Write ``df`` under ``path`` in ``buckets`` hash buckets of
    ``by``, sorted inside, as the catalog table ``table``, and read it back.
    Tables with the same ``by`` and ``buckets`` join and group on it without
    a shuffle.  An earlier table of that name is replaced.  One file per
    bucket: a key with a third of the rows belongs in a log, not here; feature tables
    have one row per phone."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    (df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by)
     .option("path", path).format("parquet").saveAsTable(table))
    return spark.table(table)


def open_bucketed(spark: SparkSession, table: str, path: str, buckets: int, by: str = "phone_no_m") -> DataFrame:
    """A table that ``write_bucketed`` left under ``path``, in a session
    whose catalog does not know it: its buckets are declared again."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def write_named(df: DataFrame, base: str, name: str) -> None:
    """Write one of the tables that ``loader.load`` finds by name."""
    if name not in WRITTEN:
        raise ValueError(f"unknown table {name!r}; expected one of {WRITTEN}")
    write_table(df, path_of(base, name, "parquet"))


def write_submission(df: DataFrame, path: str) -> None:
    """Submission sink: CSV with a header, as many files as partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)
