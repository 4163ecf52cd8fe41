"""CSV tables with broken rows, checked while they become Parquet.

A row is broken if a field does not parse as its column's type (a date, a
number), or if it has too few or too many fields; a quote that was never
closed shows itself in the same way.  ``load`` reads such fields as NULL;
here the whole line is kept apart, with its file and the columns at fault,
and counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonelens.sources.loader import path_of
from phonelens.sources.schemas import SCHEMAS
from phonelens.sources.sinks import write_table

BROKEN = "_broken"       # names of the columns that do not parse, NULL for sound rows
LINE = "_line"           # the raw line of a broken row
FIELDS = "(fields)"      # stands in ``_broken`` for a wrong number of fields
TIMES = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


@dataclass
class Ingested:
    """Rows of one table: read, kept, and set aside."""
    table: str
    rows: int
    broken: int

    @property
    def kept(self) -> int:
        return self.rows - self.broken


def _typed(field: T.StructField) -> Column:
    """The text of a field as its column's type, NULL if it is none."""
    text = F.col(field.name)
    value = text.try_cast(field.dataType)
    return F.when(text.rlike(TIMES), value) if isinstance(field.dataType, T.TimestampNTZType) else value


def load_checked(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The CSV table ``name`` with its schema and two columns more:
    ``_broken``, the columns that do not parse (``(fields)``: a wrong number of
    fields), and ``_line``, the raw line; both NULL for sound rows.  A
    header that does not name the schema's columns in their order raises.
    Empty lines are no rows, empty fields are NULL.

    Fields are read as text and converted by expressions: the reader's own
    verdict on a row depends on the columns that a query selects."""
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name!r}; expected one of {sorted(SCHEMAS)}")
    fields = SCHEMAS[name].fields
    texts = T.StructType([T.StructField(f, T.StringType(), True) for f in [*(f.name for f in fields), LINE]])
    raw = (spark.read.schema(texts).option("header", True).option("enforceSchema", False).option("columnPruning", False)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE).csv(path_of(base, name, "csv")))
    unread = [F.when(F.col(f.name).isNotNull() & _typed(f).isNull(), F.lit(f.name)) for f in fields]
    broken = F.when(F.col(LINE).isNotNull(), F.array(F.lit(FIELDS))).otherwise(
        F.nullif(F.array_compact(F.array(*unread)), F.array().cast("array<string>")))
    line = F.coalesce(F.col(LINE), F.when(broken.isNotNull(), F.to_csv(F.struct(*[F.col(f.name) for f in fields]))))
    return raw.select(*[_typed(f).alias(f.name) for f in fields], broken.alias(BROKEN), line.alias(LINE))


def quarantine_path(out: str, name: str) -> str:
    return path_of(f"{out.rstrip('/')}/quarantine", name, "parquet")


def ingest(spark: SparkSession, base: str, name: str, out: str) -> Ingested:
    """Write the sound rows of CSV table ``name`` to ``out/name.parquet`` and
    the broken ones (``line``, ``file``, ``columns`` that do not parse) to ``out/quarantine/name.parquet``.

    The counts come with the first write, so a table without broken rows is
    read once; one that has some is read a second time for them.  Both
    tables are overwritten, and the second is written even when empty, so a
    repeated run leaves no lines of an earlier one."""
    rows = load_checked(spark, base, name)
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(BROKEN).alias("broken"))
    write_table(counted.filter(F.col(BROKEN).isNull()).drop(BROKEN, LINE), path_of(out, name, "parquet"))
    total, broken = seen.get["rows"], seen.get["broken"]
    aside = rows.select(F.col(LINE).alias("line"), F.input_file_name().alias("file"), F.col(BROKEN).alias("columns"))
    aside = aside.filter(F.col("columns").isNotNull()) if broken else spark.createDataFrame([], aside.schema)
    write_table(aside, quarantine_path(out, name))
    return Ingested(name, total, broken)


def ingest_all(spark: SparkSession, base: str, out: str, names: list[str] | None = None,
               max_broken_share: float | None = None) -> DataFrame:
    """``ingest`` for all source tables: ``(table, rows, kept, broken)``, one
    row per table.  The flows then run on ``out`` with ``fmt="parquet"``.
    With ``max_broken_share``, a table over it raises after all are written."""
    done = [ingest(spark, base, n, out) for n in (names or sorted(SCHEMAS))]
    over = [t.table for t in done if max_broken_share is not None and t.broken > max_broken_share * t.rows]
    if over:
        raise ValueError(f"too many broken rows in {over}; see {out.rstrip('/')}/quarantine")
    return spark.createDataFrame([(t.table, t.rows, t.kept, t.broken) for t in done],
                                 "table string, rows long, kept long, broken long")
