"""Column profile and class-conditional distributions.

The source drew an HTML profile and density plots; here the numbers behind
them are DataFrames.  Every statistic is computed per column (or per
class and measure) in long form, so the work spreads over the rows, and
quantiles use the distributed exact ranks of ``functions.ranking``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonelens.functions.expr import sig_round
from phonelens.functions.joins import join_bounded
from phonelens.functions.ranking import cumulative, exact_quantiles
from phonelens.session import materialize

PROFILE_QUANTILES = [0.25, 0.5, 0.75]
CLASS_QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]
# Density: bins per bandwidth, reach of the kernel and margin of the grid in bandwidths.
BINS_PER_BANDWIDTH = 8
KERNEL_REACH = 8
GRID_MARGIN = 3


def numeric_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def to_long(df: DataFrame, columns: list[str], ids: list[str] = (), name: str = "column") -> DataFrame:
    """Unpivot ``columns`` (as double) into ``(*ids, name, value)`` rows."""
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(ids), columns, name, "value")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: rows, non-NULL count, NULLs, distinct values,
    mean, sample std, min, quartiles, max, most frequent value (smallest on
    ties) and its count."""
    columns = columns or numeric_columns(df)
    # every statistic follows from one table of (column, value, count)
    counts = materialize(to_long(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n")))
    n, value = F.col("_n"), F.col("value")
    some = value.isNotNull()
    total = F.sum(F.when(some, n))
    stats = materialize(counts.groupBy("column").agg(
        F.sum(n).alias("rows"), F.coalesce(total, F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(~some, n)), F.lit(0)).alias("nulls"), F.count(value).alias("distinct"),
        (F.sum(n * value) / total).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.min(F.when(some, F.struct((-n).alias("neg_n"), value.alias("v")))).alias("_t")))
    off = value - F.col("mean")
    spread = join_bounded(counts.filter(some), stats.select("column", "mean"), "column").groupBy("column").agg(
        F.sqrt(F.try_divide(F.sum(n * off * off), F.sum(n) - 1)).alias("std"))
    q = exact_quantiles(counts, "value", PROFILE_QUANTILES, by=["column"], weight="_n")
    qw = q.groupBy("column").pivot("prob", PROFILE_QUANTILES).agg(F.first("q"))
    for p, name in zip(PROFILE_QUANTILES, ["q25", "q50", "q75"]):
        qw = qw.withColumnRenamed(str(p), name)
    return stats.join(spread, "column", "left").join(qw, "column", "left").select(
        "column", "rows", "count", "nulls", "distinct", "mean", "std", "min", "max", "q25", "q50", "q75",
        F.col("_t.v").alias("top"), (-F.col("_t.neg_n")).alias("top_count"))


def class_quantiles(features: DataFrame, labels: DataFrame, measures: list[str], key: str = "phone_no_m",
                    probs: list[float] = CLASS_QUANTILES) -> DataFrame:
    """Quantiles of each per-phone measure within each class:
    ``(label, measure, prob, q)``."""
    j = features.join(labels.select(key, "label"), key)
    long = materialize(to_long(j, measures, ids=["label"], name="measure"))
    return exact_quantiles(long, "value", probs, by=["label", "measure"])


def class_histogram(features: DataFrame, labels: DataFrame, measures: list[str], bins: int = 20,
                    key: str = "phone_no_m") -> DataFrame:
    """Fixed-width histogram per measure (edges from the measure's
    range over both classes), counted per class: ``(label, measure, bin,
    lo, hi, n)``.  The maximum falls in the last bin."""
    j = features.join(labels.select(key, "label"), key)
    long = materialize(to_long(j, measures, ids=["label"], name="measure").filter(F.col("value").isNotNull()))
    rng = long.groupBy("measure").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / w), F.lit(bins - 1))).cast("int")
    binned = join_bounded(long, rng, "measure").select("label", "measure", b.alias("bin"), "_lo", "_hi")
    out = binned.groupBy("label", "measure", "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return out.select("label", "measure", "bin", (F.col("_lo") + F.col("bin") * width).alias("lo"),
                      (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"), "n")


def class_values(features: DataFrame, labels: DataFrame, measures: list[str], key: str = "phone_no_m") -> DataFrame:
    """The non-NULL measures of labelled phones in long form:
    ``(label, measure, value)``."""
    j = features.join(labels.select(key, "label"), key)
    return to_long(j, measures, ids=["label"], name="measure").filter(F.col("value").isNotNull())


def class_density(values: DataFrame, points: int = 100) -> DataFrame:
    """Gaussian kernel density of ``(label, measure, value)`` rows on
    ``points`` equally spaced places per measure: ``(label, measure, point,
    x, n, bandwidth, density)``.

    The bandwidth is Scott's, ``std * n ** -0.2`` per class and measure, kept
    to six significant digits, so that it does not hang on summation order.
    The grid of a measure spans all its classes and three bandwidths more.
    Values are first dealt linearly to bins of an eighth of the bandwidth
    (their number follows from the spread, not from the rows), and each bin
    reaches the places within eight bandwidths: no step holds a class's rows.
    A class with fewer than two distinct values of a measure has no density
    and no rows.  NULL, NaN and infinite values are left out, as are rows
    without a label or measure."""
    v = materialize(values.select("label", "measure", F.col("value").cast("double").alias("value")).filter(
        F.col("label").isNotNull() & F.col("measure").isNotNull()
        & (F.abs("value") < float("inf")) & ~F.isnan("value")))
    scott = F.stddev_samp("value") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))
    stats = (v.groupBy("label", "measure")
             .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), scott.alias("_h"))
             .filter(F.col("_lo") < F.col("_hi")).withColumn("bandwidth", sig_round("_h", 6)).drop("_h"))
    margin = F.col("bandwidth") * F.lit(float(GRID_MARGIN))
    span = stats.groupBy("measure").agg(F.min(F.col("_lo") - margin).alias("_from"), F.max(F.col("_hi") + margin).alias("_to"))
    step = (F.col("_to") - F.col("_from")) / F.lit(float(points - 1))
    groups = materialize(stats.join(span, "measure").withColumn("_step", step))  # a row per class and measure

    at = (F.col("value") - F.col("_lo")) / (F.col("bandwidth") / F.lit(float(BINS_PER_BANDWIDTH)))
    placed = join_bounded(v, groups.select("label", "measure", "_lo", "bandwidth"), ["label", "measure"]).select(
        "label", "measure", F.floor(at).alias("_bin"), (at - F.floor(at)).alias("_part"))
    bins = placed.groupBy("label", "measure", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("_part").alias("_right"))

    h = F.col("bandwidth")
    width = h / F.lit(float(BINS_PER_BANDWIDTH))
    left = F.col("_lo") + F.col("_bin") * width
    reach = h * F.lit(float(KERNEL_REACH))
    first = F.greatest(F.ceil((left - reach - F.col("_from")) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((left + width + reach - F.col("_from")) / F.col("_step")), F.lit(points - 1))
    reached = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    x = F.col("_from") + F.col("point") * F.col("_step")
    bump = lambda centre: F.exp(F.lit(-0.5) * F.pow((x - centre) / h, F.lit(2.0)))
    mass = (F.col("_n") - F.col("_right")) * bump(left) + F.col("_right") * bump(left + width)
    sums = (join_bounded(bins, groups, ["label", "measure"]).withColumn("point", F.explode(reached))
            .withColumn("_mass", mass).groupBy("label", "measure", "point").agg(F.sum("_mass").alias("_mass")))
    grid = groups.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    density = F.coalesce(F.col("_mass"), F.lit(0.0)) / (F.col("n") * h * F.sqrt(F.lit(2.0) * F.pi()))
    return grid.join(sums, ["label", "measure", "point"], "left").select(
        "label", "measure", F.col("point").cast("int").alias("point"), x.alias("x"), "n", "bandwidth", density.alias("density"))


def value_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C9 for columns of any type, read as text: rows, non-NULL count, NULLs,
    blank values, distinct values, values that occur once, least and greatest
    text, shortest, longest and mean length, entropy in bits, most frequent
    value (least on ties) and its count.

    All follow from one table of (column, value, count), so a value that a
    third of all rows share is one light row.  A column of NULLs keeps its
    row.  Texts compare by code point."""
    columns = columns or df.columns
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = text.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    value, n = F.col("value"), F.col("n")
    some = value.isNotNull()
    length = F.char_length("value")
    total = F.sum(F.when(some, n))
    bits = F.log2(total.cast("double")) - F.sum(F.when(some, n * F.log2(n.cast("double")))) / total
    return counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(total, F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(~some, n)), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.trim("value") == "", n)), F.lit(0)).alias("blank"),
        F.count("value").alias("distinct"), F.count_if(some & (n == 1)).alias("once"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(length).alias("min_length"), F.max(length).alias("max_length"),
        (F.sum(n * length) / total).alias("mean_length"), bits.alias("entropy"),
        F.min(F.when(some, F.struct((-n).alias("_neg"), value.alias("_v")))).alias("_top"),
    ).select("*", F.col("_top._v").alias("top"), (-F.col("_top._neg")).alias("top_count")).drop("_top")


def _pairs(names: list[str], values: Column) -> Column:
    """Array of ``(column_a, column_b, a, b)`` for each two entries of the
    array ``values``, in the order of ``names``; as loops over positions, since
    a written-out list of pairs outgrows a generated method."""
    if len(names) < 2:
        raise ValueError("pairs need two columns")
    name, last = F.array(*[F.lit(n) for n in names]), len(names) - 1
    one = lambda i, j: F.struct(F.get(name, i).alias("column_a"), F.get(name, j).alias("column_b"),
                                F.get(values, i).alias("_a"), F.get(values, j).alias("_b"))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda i: F.transform(
        F.sequence(i + 1, F.lit(last)), lambda j: one(i, j))))


def null_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C9, missing values together: per pair of columns (in the order given)
    ``(column_a, column_b, rows, nulls_a, nulls_b, both, correlation)``, the
    last being that of the two NULL flags (NULL if a flag never changes).

    Rows are counted per pattern of NULLs first; only patterns meet the pairs."""
    columns = columns or df.columns
    flags = df.select(F.array(*[F.col(c).isNull() for c in columns]).alias("_p"))
    patterns = flags.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    n_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    g = patterns.select("_n", F.inline(_pairs(columns, F.col("_p")))).groupBy("column_a", "column_b").agg(
        F.sum("_n").alias("rows"), n_if(F.col("_a")).alias("nulls_a"), n_if(F.col("_b")).alias("nulls_b"),
        n_if(F.col("_a") & F.col("_b")).alias("both"))
    n, a, b, ab = (F.col(c).cast("double") for c in ("rows", "nulls_a", "nulls_b", "both"))
    spread = F.sqrt(a * (n - a)) * F.sqrt(b * (n - b))
    return g.withColumn("correlation", F.try_divide(n * ab - a * b, spread))


def column_correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per pair of numeric columns (in the order given) the rows that
    hold both, Pearson's and Spearman's correlation over those rows:
    ``(column_a, column_b, n, pearson, spearman)``.  NULL where a side does
    not vary; a pair that no row holds is absent.  NaN counts as missing.

    Equal value pairs are counted first.  Ranks (the mean rank on ties, taken
    among the pair's own rows) come from running sums over distinct values,
    split over tasks, and are summed with the counts: ranks are halves, so
    the sums are exact."""
    columns = columns or numeric_columns(df)
    x, y = F.col("_x"), F.col("_y")
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    of = ["column_a", "column_b"]
    row = df.select(F.array(*[number(c) for c in columns]).alias("_v"))
    pairs = row.select(F.inline(_pairs(columns, F.col("_v")))).withColumnsRenamed({"_a": "_x", "_b": "_y"})
    counted = materialize(pairs
                          .filter(x.isNotNull() & y.isNotNull()).groupBy(*of, "_x", "_y").agg(F.count(F.lit(1)).alias("_n")))

    sides = F.array(*[F.struct(F.lit(s).alias("_side"), c.alias("_value")) for s, c in (("x", x), ("y", y))])
    per_value = counted.select(*of, "_n", F.inline(sides)).groupBy(*of, "_side", "_value").agg(F.sum("_n").alias("_w"))
    placed = cumulative(per_value, [*of, "_side"], "_value", "_w")
    # distance of the value's mean rank from the middle rank, doubled to stay whole
    ranks = materialize(placed.select(*of, "_side", "_value", "_total",
                                      (2 * F.col("_start") + F.col("_w") - F.col("_total")).cast("double").alias("_r")))
    side = lambda s, value, rank: ranks.filter(F.col("_side") == s).select(
        *of, F.col("_value").alias(value), F.col("_r").alias(rank))
    both = join_bounded(join_bounded(counted, side("x", "_x", "_rx"), [*of, "_x"]), side("y", "_y", "_ry"), [*of, "_y"])

    # Pearson's moments about the means
    w = F.col("_n").cast("double")
    means = counted.groupBy(*of).agg((F.sum(w * x) / F.sum(w)).alias("_mx"), (F.sum(w * y) / F.sum(w)).alias("_my"))
    both = join_bounded(both, means, of)
    dx, dy = x - F.col("_mx"), y - F.col("_my")
    rx, ry = F.col("_rx"), F.col("_ry")
    moments = lambda p, q, name: [F.sum(w * p * q).alias(f"{name}_xy"), F.sum(w * p * p).alias(f"{name}_xx"),
                                  F.sum(w * q * q).alias(f"{name}_yy")]
    varies = [F.min(c) < F.max(c) for c in (x, y)]
    g = both.groupBy(*of).agg(F.sum("_n").alias("n"), (varies[0] & varies[1]).alias("_varies"),
                              *moments(dx, dy, "p"), *moments(rx, ry, "s"))
    r = lambda name: F.when(F.col("_varies"), F.try_divide(
        F.col(f"{name}_xy"), F.sqrt(F.col(f"{name}_xx")) * F.sqrt(F.col(f"{name}_yy"))))
    return g.select(*of, "n", r("p").alias("pearson"), r("s").alias("spearman"))
