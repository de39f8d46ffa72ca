"""The tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import quantiles, same


def histogram(rows: DataFrame, column: str, bins: int, log: bool = False) -> DataFrame:
    """bin (from 0), low, high, n, density over equal steps from the smallest to the largest value."""
    x = rows.where(F.col(column).isNotNull()).select((F.log10(column) if log else F.col(column).cast("double")).alias("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"))
    step = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("lo"), step)), F.lit(0))).cast("int")
    counts = x.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("lo") + F.col("bin") * step).alias("low"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high"), "n", F.try_divide(F.col("n"), F.col("total") * step).alias("density"))


#: Bins that a density is computed from, for each group; their width is the error of a value's place.
DENSITY_BINS = 512


def density(rows: DataFrame, by: str, column: str, points: int = 200, log: bool = False) -> DataFrame:
    """by, point (from 0), x, density: a Gaussian kernel estimate over each group's range, null among the groups.

    Values are counted in bins, and the bins' middles, as often as they were met, are convolved with the kernel; its
    width is Scott's, the sample deviation over the fifth root of the count. Groups without two values that differ have none.
    """
    value = F.log10(column) if log else F.col(column).cast("double")
    x = rows.select(by, value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = x.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.stddev_samp("v").alias("sd")).where("lo < hi")
    step = (F.col("hi") - F.col("lo")) / DENSITY_BINS
    place = F.least(F.lit(DENSITY_BINS - 1), F.floor((F.col("v") - F.col("lo")) / step))
    cells = same(x, ends, [by]).groupBy(by, "lo", "hi", "n", "sd", place.alias("bin")).agg(F.count("*").alias("c"))  # as many rows as bins
    at = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    grid, middle = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1), F.col("lo") + (F.col("bin") + 0.5) * step
    width = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    kernel = F.col("c") * F.exp(-0.5 * F.pow((grid - middle) / width, 2)) / (F.col("n") * width * F.sqrt(2 * F.pi()))
    return at.groupBy(by, "point", grid.alias("x")).agg(F.sum(kernel).alias("density"))


def box_summary(rows: DataFrame, by: str, column: str) -> DataFrame:
    """Five numbers by group, null among them; whiskers reach the last value within 1.5 interquartile ranges."""
    q = quantiles(rows, [by], [column], [0.25, 0.5, 0.75]).select(by, "q", (1.5 * (F.col("q")[2] - F.col("q")[0])).alias("reach"))
    x = same(rows.select(by, column), q, [by])
    inside = (F.col(column) >= F.col("q")[0] - F.col("reach")) & (F.col(column) <= F.col("q")[2] + F.col("reach"))
    ends = x.where(inside).groupBy(by, "q").agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return ends.select(by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def annotated(rolling: DataFrame, marks: DataFrame, keys: list[str], value: str = "rolling", keep: list[str] | None = None) -> DataFrame:
    """The points of a curve that a small table of marks(keys..., label) names."""
    return rolling.join(F.broadcast(marks), keys).select(*(keep or []), *keys, "label", value)
