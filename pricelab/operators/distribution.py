"""Distribution of a numeric column: equal-width histogram and Gaussian KDE curve.

Range, count and standard deviation are one partial aggregate over the rows (an uncorrelated scalar
subquery, no ``collect()``); the histogram and the curve are a second one that buckets the rows
directly, so a task ships one row per bin or grid point and the rows themselves are never shuffled by
value.  Both read the same columns of the same plan, whose exchanges are reused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _values(df: DataFrame, col: str, weight: str | None, rows: str | None) -> DataFrame:
    """The column as ``x``, its multiplicity as ``w`` and the weight as ``q``, missing values left out."""
    x = df.where(F.col(col).isNotNull() & ~F.isnan(col))
    w = F.col(rows) if rows else F.lit(1).cast("long")
    return x.select(F.col(col).alias("x"), w.alias("w"), *([F.col(weight).alias("q")] if weight else []))


def _stats(values: DataFrame, rows: str | None) -> Column:
    """Scalar struct(lo, hi, n, sd); sd is the sample deviation (NULL for a single value, as is the KDE).

    Plain rows take one pass; values with multiplicities (a small table) take the mean first.
    """
    if rows is None:
        sd = F.stddev_samp("x")
    else:
        mean = values.select(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w"))).scalar()
        dev = F.col("x") - mean
        sd = F.sqrt(F.try_divide(F.sum(F.col("w") * dev * dev), F.sum("w") - F.lit(1)))
    return values.select(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("w").alias("n"), sd.alias("sd")).alias("s")).scalar()


def _with_stats(df: DataFrame, stats: Column) -> DataFrame:
    """Attach the scalar stats struct as column ``s`` (one subquery reference per plan)."""
    return df.select("*", stats.alias("s"))


def _edge(k: Column, lo: Column, hi: Column, step: Column, bins: int) -> Column:
    # Edge k of linspace(lo, hi, bins + 1): k * step + lo, the last one exactly hi.
    return F.when(k >= F.lit(bins), hi).otherwise(k.cast("double") * step + lo)


def _range_cols(bins: int) -> list[Column]:
    # On a frame with column ``s``: a constant column gets the range [x - 0.5, x + 0.5].
    lo, hi = F.col("s.lo"), F.col("s.hi")
    same = lo == hi
    lo2 = F.when(same, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(same, hi + F.lit(0.5)).otherwise(hi)
    return [lo2.alias("lo"), hi2.alias("hi"), ((hi2 - lo2) / F.lit(float(bins))).alias("step")]


def _histogram(values: DataFrame, bins: int, weight: str | None, rows: str | None) -> DataFrame:
    stats = _stats(values, rows)
    wcols = ["q"] if weight else []
    staged = _with_stats(values, stats).select("x", "w", *wcols, *_range_cols(bins))
    x, lo, hi, step = F.col("x"), F.col("lo"), F.col("hi"), F.col("step")
    staged = staged.withColumn("k0", F.least(F.greatest(F.floor((x - lo) / step).cast("int"), F.lit(0)),
                                             F.lit(bins - 1)))
    k0 = F.col("k0")
    staged = staged.withColumns({"e0": _edge(k0, lo, hi, step, bins), "e1": _edge(k0 + 1, lo, hi, step, bins)})
    # floor() can be one bin off next to an edge: settle it against the exact edges.
    k = (F.when(x < F.col("e0"), k0 - 1)
          .when((k0 < bins - 1) & (x >= F.col("e1")), k0 + 1)
          .otherwise(k0))
    aggs = [F.sum("w").alias("count")] + ([F.sum("q").alias(f"total_{weight}")] if weight else [])
    counts = staged.groupBy((k + 1).alias("bin")).agg(*aggs)
    spark = values.sparkSession
    # every bin with its edges: a fixed list of `bins` rows
    edges = (_with_stats(spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")), stats)
                  .select("bin", *_range_cols(bins)))
    kk = F.col("bin") - 1
    edges = edges.select("bin", _edge(kk, lo, hi, step, bins).alias("bin_lo"),
                         _edge(kk + 1, lo, hi, step, bins).alias("bin_hi"))
    # at most `bins` counts: a proven bound, on the side a left join can broadcast
    return (edges.join(F.broadcast(counts), "bin", "left")
            .select("bin", "bin_lo", "bin_hi",
                    F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    *([F.coalesce(f"total_{weight}", F.lit(0.0)).alias(f"total_{weight}")] if weight else [])))


def histogram(df: DataFrame, col: str = "unit_price", bins: int = 50,
              weight: str | None = "qty", rows: str | None = None) -> DataFrame:
    """``bins`` equal-width bins over [min, max]; bins are [lo, hi), the last [lo, hi].

    Returns every bin (empty ones with count 0): ``bin`` (1-based), ``bin_lo``,
    ``bin_hi``, ``count`` and, when ``weight`` is given, ``total_<weight>``.
    ``rows`` names a column of multiplicities, for tables already reduced by value.
    """
    return _histogram(_values(df, col, weight, rows), bins, weight, rows)


def modal_bin(hist: DataFrame) -> DataFrame:
    """The most populated histogram bin (ties: the lowest bin)."""
    return hist.orderBy(F.desc("count"), "bin").limit(1)


def density(df: DataFrame, col: str = "unit_price", gridsize: int = 200, bins: int = 50, rows: str | None = None) -> DataFrame:
    """Gaussian KDE (Scott bandwidth sd·n^-1/5) on ``gridsize`` points spanning [min, max].

    ``density`` integrates to 1; ``count_density`` is scaled by Σ count·width of
    the ``bins``-bin histogram, i.e. the curve drawn over a count histogram.
    Every row adds its kernel to every grid point; the sums are combined in each task, which ships
    ``gridsize`` rows.
    """
    values = _values(df, col, None, rows)
    stats = _stats(values, rows)
    staged = _with_stats(values, stats).select(
        "x", "w", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"),
        (F.col("s.sd") * F.pow(F.col("s.n").cast("double"), F.lit(-0.2))).alias("bw"))
    points = staged.select("x", "w", "bw", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("grid_index"))
    z = F.try_divide(_grid_point(F.col("grid_index"), F.col("lo"), F.col("hi"), gridsize) - F.col("x"), F.col("bw"))  # NULL when the values are all equal
    sums = points.groupBy("grid_index").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * z * z)).alias("kernel_sum"))
    # every grid point; at most `gridsize` sums: a proven bound
    dens = _grid(values, stats, gridsize).join(F.broadcast(sums), "grid_index", "left") \
        .withColumn("kernel_sum", F.coalesce("kernel_sum", F.lit(0.0)))
    hist = _histogram(values, bins, None, rows)
    hist_norm = hist.select(F.sum(F.col("count") * (F.col("bin_hi") - F.col("bin_lo")))).scalar()
    pdf = F.try_divide(F.col("kernel_sum"), F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))
    return (dens.select("grid_index", F.col("gx").alias(col), pdf.alias("density"))
                .select("*", (F.col("density") * hist_norm).alias("count_density")))


def _grid_point(j: Column, lo: Column, hi: Column, gridsize: int) -> Column:
    return F.when(j == gridsize - 1, hi).otherwise(j.cast("double") * ((hi - lo) / F.lit(float(gridsize - 1))) + lo)


def _grid(values: DataFrame, stats: Column, gridsize: int) -> DataFrame:
    """The ``gridsize`` evaluation points linspace(min, max, gridsize), with n and bandwidth."""
    g = _with_stats(values.sparkSession.range(gridsize).select(F.col("id").cast("int").alias("grid_index")), stats)
    n = F.col("s.n").cast("double")
    return g.select("grid_index", _grid_point(F.col("grid_index"), F.col("s.lo"), F.col("s.hi"), gridsize).alias("gx"),
                    n.alias("n"), (F.col("s.sd") * F.pow(n, F.lit(-0.2))).alias("bw"))
