"""Logical table name -> DataFrame with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phonelens.sources.schemas import SCHEMAS, WRITTEN

FORMATS = ("csv", "parquet")


def path_of(base: str, name: str, fmt: str) -> str:
    """``base/name.csv`` or ``base/name.parquet``; any Hadoop path works
    (no local file-system probing, so this runs the same on a cluster)."""
    return f"{base.rstrip('/')}/{name}.{fmt}"


def load(spark: SparkSession, base: str, name: str, fmt: str = "csv") -> DataFrame:
    """Read one logical table (``train_voc``, ``test_user`` ...) from ``base``.

    CSV is read with the registered schema and a header (no inference);
    Parquet keeps its own schema; tables that runs write are Parquet
    whatever ``fmt`` says.  Unknown names raise instead of returning
    nothing."""
    if name in WRITTEN:
        return spark.read.parquet(path_of(base, name, "parquet"))
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name!r}; expected one of {sorted([*SCHEMAS, *WRITTEN])}")
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; expected one of {FORMATS}")
    path = path_of(base, name, fmt)
    if fmt == "parquet":
        return spark.read.parquet(path)
    return (spark.read.schema(SCHEMAS[name]).option("header", True)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
            .csv(path))


def load_log_pair(spark: SparkSession, base: str, log: str, fmt: str = "csv") -> DataFrame:
    """Train and test logs of one kind as one DataFrame."""
    return load(spark, base, f"train_{log}", fmt).unionByName(load(spark, base, f"test_{log}", fmt))
