"""Ranks, running sums and exact quantiles without a whole column in one task.

Running sums: the rows are dealt to partitions by range, each partition adds up its own, and partitions pass on their
totals, which are few. Quantiles: histograms narrow the interval that holds a rank until it holds one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Bins of one pass of the narrowing histograms.
BINS = 4096


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to the columns of ``right`` beside the keys, where a null key equals a null key."""
    other = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    matched = [left[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)]
    return left.join(other, matched or F.lit(True), how).drop(*[f"_k{i}" for i in range(len(keys))])


#: Rows of a table that all tasks have; they are the most frequent ones.
MOST_SENT = 1 << 18


def least_sent(table: DataFrame, weight: str, most: int) -> tuple[int | None, bool]:
    """The least ``weight`` down to which all rows of ``table`` are at most ``most``, if any, and whether these are all its rows."""
    upto = F.sum("n").over(Window.orderBy(F.desc(weight)).rowsBetween(Window.unboundedPreceding, 0))  # over distinct weights
    least, every = table.groupBy(weight).agg(F.count("*").alias("n")).withColumn("upto", upto).agg(F.min(F.when(F.col("upto") <= most, F.col(weight))), F.max("upto")).first()
    return least, (every or 0) <= most


def met(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined to the row of ``table`` that has their keys, which are not null; ``weight`` says how many rows ask for it.

    Up to ``MOST_SENT`` rows of the table, the most asked for, go to all tasks. Only rows that ask for others, a small
    part as frequencies fall off, are shuffled, and no frequent key's rows meet in a task.
    """
    least, every = least_sent(table, weight, MOST_SENT)
    if every:
        return rows.join(F.broadcast(table), keys)
    if least is None:
        return rows.join(table, keys)
    often = table.where(F.col(weight) >= least)
    rest = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(table.where(F.col(weight) < least), keys)
    return rows.join(F.broadcast(often), keys).unionByName(rest)


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` stored in ranges of ``by`` and ``order``; _part numbers the ranges upwards. Equal rows share a range."""
    return stored(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def running(ranges: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``ranges`` with each of ``sums`` up to and with the row, in ``order`` within ``by``, and its total as all_<name>."""
    own = ranges.groupBy(*by, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])  # a row for each range and group
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(*by, "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums], *[F.sum(n).over(group).alias(f"all_{n}") for n in sums])
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = same(ranges.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}), own, [*by, "_part"])
    return x.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop(*[f"_before_{n}" for n in sums])


def least_from(ranges: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``ranges`` with the least ``value`` of the row and all after it, in ``order`` within ``by``."""
    own = ranges.groupBy(*by, "_part").agg(F.min(value).alias("_own"))
    after = Window.partitionBy(*by).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    own = own.select(*by, "_part", F.min("_own").over(after).alias("_after"))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = same(ranges.withColumn(name, F.min(value).over(within)), own, [*by, "_part"])
    return x.withColumn(name, F.least(name, "_after")).drop("_after")


def _scale(x: Column) -> Column:
    """Grows with x, as its order of magnitude does: 0, or the sign times more than 0."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))


def _bin(x: Column, lo: Column, hi: Column, log: bool) -> Column:
    """A bin that grows with x: the first for ``lo``, the last for ``hi``."""
    half = lambda c: c / 2  # noqa: E731  # so that no difference overflows
    part = F.try_divide(half(x) - half(lo), half(hi) - half(lo))
    if log:
        part = F.coalesce(F.try_divide(_scale(x) - _scale(lo), _scale(hi) - _scale(lo)), part)
    inner = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.coalesce(part, F.lit(0.5)) * BINS)))
    return F.when(x == lo, -1).when(x == hi, BINS).otherwise(inner).cast("int")


def order_statistics(values: DataFrame, by: list[str], ranks: Column) -> DataFrame:
    """by, rank, value, n: the values x at the ``ranks`` (from 0, an array over n) of each group of values(by, x, times).

    Each pass counts the values within the interval of a rank by bins of it, and the bin with the rank becomes the
    next interval, from the least to the greatest value in it. The ends have bins of their own, so that every pass
    ends or leaves less; bins of equal width and of equal ratio alternate.
    """
    values = stored(values.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("times") > 0)).select(*by, F.col("x").cast("double").alias("x"), F.col("times").cast("long").alias("times")))
    ends = values.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("times").alias("n")).where("n > 0")
    targets = stored(ends.select(*by, "lo", "hi", F.lit(0).cast("long").alias("below"), "n", F.explode(F.array_distinct(ranks)).alias("rank")))
    keys, log = [*by, "rank", "n"], False
    while not (wide := targets.where("lo < hi")).isEmpty():
        met = same(values, wide, by).where("x between lo and hi")
        cells = met.groupBy(*keys, "below", _bin(F.col("x"), F.col("lo"), F.col("hi"), log).alias("bin")).agg(F.sum("times").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # as many rows as bins
        cells = cells.withColumn("upto", F.col("below") + F.sum("c").over(upto)).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        found = cells.select(*by, "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), "n", "rank")
        targets, log = stored(targets.where("lo = hi").unionByName(found)), not log
    return targets.select(*by, "rank", F.col("lo").alias("value"), "n")


def quantiles(rows: DataFrame, by: list[str], columns: list[str], probs: list[float], times: str | None = None) -> DataFrame:
    """by, feature, q: exact quantiles of each column in each group, interpolated between neighbours.

    ``times``: a column that says how often a row counts. Nulls and NaN are no values; a group of a column without
    any gives no row. Without ``by`` all rows are one group.
    """
    n = F.lit(1) if times is None else F.col(times)
    long = rows.select(*by, n.alias("times"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])))
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    found = order_statistics(long, [*by, "feature"], F.array(*[f(h).cast("long") for h in place for f in (F.floor, F.ceil)]))
    whole = found.groupBy(*by, "feature").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two ranks for each of probs

    def between(h: Column) -> Column:
        a, b = F.col("at")[F.floor(h).cast("long")], F.col("at")[F.ceil(h).cast("long")]
        return a + (b - a) * (h - F.floor(h))

    return whole.select(*by, "feature", F.array(*[between(h) for h in place]).alias("q"))
