"""Group comparison over long tables feature, x, y (y is 0 or 1): one aggregation serves all features."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ordering import least_from, placed, quantiles, running, same


def melt(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return rows.select(F.col(label).alias("y"), F.inline(pairs)).where("x is not null and not isnan(x) and y in (0, 1)")


def moments(long: DataFrame) -> DataFrame:
    one, zero = F.when(F.col("y") == 1, F.col("x")), F.when(F.col("y") == 0, F.col("x"))
    return long.groupBy("feature").agg(F.count(one).alias("n1"), F.count(zero).alias("n0"), F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"))


def cohen_d() -> Column:
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2))
    return F.try_divide(F.col("m1") - F.col("m0"), pooled)


def welch() -> tuple[Column, Column]:
    a, b = F.try_divide("v1", "n1"), F.try_divide("v0", "n0")
    return F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b)), F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))


def rank_statistics(long: DataFrame) -> DataFrame:
    """feature, u1, auc, z: mid-ranks by distinct value, so that equal values meet before any ordering."""
    g = placed(long.groupBy("feature", "x").agg(F.count("*").alias("c"), F.sum("y").alias("p")), ["feature"], ["x"])
    g = running(g, ["feature"], ["x"], {"upto": F.col("c")}).withColumn("mid", F.col("upto") - F.col("c") + (F.col("c") + 1) / 2.0)
    s = g.groupBy("feature").agg(F.sum(F.col("p") * F.col("mid")).alias("r1"), F.sum("p").alias("n1"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    n0 = F.col("n") - F.col("n1")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    mean = F.col("n1") * n0 / 2.0
    sd = F.sqrt(F.col("n1") * n0 / 12.0 * ((F.col("n") + 1) - F.try_divide(F.col("ties"), F.col("n") * (F.col("n") - 1))))
    z = F.try_divide(F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)), sd)  # with the continuity correction
    return s.select("feature", u.alias("u1"), F.try_divide(u, F.col("n1") * n0).alias("auc"), z.alias("z"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, from its end."""
    value = 0.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1 + odd / (1 + value))
    return 1 / (1 - (a + b) * x / (a + 1) / (1 + value))


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if not math.isfinite(t) or not math.isfinite(df) or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def p_student(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else student_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    """Two-sided."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str] | None = None, name: str = "p_adjusted") -> DataFrame:
    """``rows`` with p adjusted for all tests of their group; ranks by distinct p. Without a p there is no test."""
    by, keys = by or [], [*(by or []), p]
    g = placed(rows.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(*keys).agg(F.count("*").alias("bh_c")), by, [p])
    g = running(g, by, [p], {"bh_rank": F.col("bh_c")}).withColumn("bh_scaled", F.col(p) * F.col("all_bh_rank") / F.col("bh_rank"))
    g = least_from(g, by, [p], "bh_scaled", "bh_least")
    return same(rows, g.select(*keys, F.least(F.lit(1.0), F.col("bh_least")).alias("bh_adjusted")), keys, "left").withColumn(name, F.col("bh_adjusted")).drop("bh_adjusted")


def univariate(rows: DataFrame, label: str, features: list[str], layer: str = "all") -> DataFrame:
    """The battery: means, Cohen's d, Welch's t and p, Mann-Whitney p with adjustment, AUC and its direction."""
    long = melt(rows, label, features)
    t, df = welch()
    x = moments(long).withColumns({"d": cohen_d(), "t": t, "df": df}).join(rank_statistics(long), "feature")
    x = x.withColumns({"layer": F.lit(layer), "p_welch": p_student("t", "df"), "p_mw": p_normal("z"), "auc_abs": F.greatest(F.col("auc"), 1 - F.col("auc")), "direction": F.when(F.col("d") > 0, "one").otherwise("zero")})
    return benjamini_hochberg(x, "p_mw", ["layer"], "p_bh")


def group_profile(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def confusion(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    return rows.groupBy(truth).agg(F.count_if(F.col(prediction) == 0).alias("pred_0"), F.count_if(F.col(prediction) == 1).alias("pred_1"))


def error_by_group(rows: DataFrame, by: str, truth: str, prediction: str) -> DataFrame:
    wrong = (F.col(truth) != F.col(prediction)).cast("int")
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.sum(wrong).alias("errors"), F.avg(wrong).alias("error_rate"))


def roc_points(rows: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, fpr, tpr at every distinct score."""
    g = placed(rows.groupBy(F.col(score).alias("threshold")).agg(F.sum(label).alias("p"), F.count("*").alias("c")), [], ["threshold"])
    g = running(g, [], ["threshold"], {"tp": F.col("p"), "seen": F.col("c")})
    tp, seen = (F.col(f"all_{n}") - F.col(n) + F.col(c) for n, c in (("tp", "p"), ("seen", "c")))  # at the threshold or above
    return g.select("threshold", F.try_divide(seen - tp, F.col("all_seen") - F.col("all_tp")).alias("fpr"), F.try_divide(tp, F.col("all_tp")).alias("tpr"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])))


def correlation_tests(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, n, r, t, p of each pair: Pearson's r over rows that have both values, and its two-sided p.

    Under three rows, or without variance, there is no test; values on a line have p = 0 and no finite t.
    """
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    each = rows.agg(*[x.alias(f"{name}{k}") for k, ((a, b), own) in enumerate(zip(pairs, both, strict=True)) for name, x in (("r", F.corr(a, b)), ("n", F.count_if(own)))])
    x = each.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{k}").alias("n"), F.nanvl(f"r{k}", F.lit(None)).alias("r")) for k, (a, b) in enumerate(pairs)])))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))
    t = F.when(F.col("n") > 2, r * F.sqrt(F.try_divide(F.col("n") - 2, 1 - r * r)))
    x = x.withColumn("t", t)
    return x.withColumn("p", F.when((F.col("n") > 2) & (F.abs("r") >= 1), 0.0).otherwise(p_student("t", (F.col("n") - 2).cast("double"))))


def iqr_repair(rows: DataFrame, columns: list[str], fence: float = 6.0, divisor: float = 1000.0) -> DataFrame:
    """Values beyond ``fence`` interquartile ranges of the quartiles lost a decimal point: they are divided."""
    ends = {r["feature"]: r["q"] for r in quantiles(rows, [], columns, [0.25, 0.75]).collect()}  # a row for each column

    def fixed(c: str) -> Column:
        lo, hi = ends.get(c, (None, None))
        if lo is None:
            return F.col(c)
        reach = fence * (hi - lo)
        return F.when((F.col(c) < lo - reach) | (F.col(c) > hi + reach), F.col(c) / divisor).otherwise(F.col(c))

    return rows.select(*[c for c in rows.columns if c not in columns], *[fixed(c).alias(c) for c in columns])


def two_groups(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """feature, m1, m0, d, t, auc of each feature between the two classes."""
    long = melt(rows, label, features)
    x = moments(long).select("feature", "m1", "m0", cohen_d().alias("d"), welch()[0].alias("t"))
    return x.join(rank_statistics(long).select("feature", "auc"), "feature")


def significant(tests: DataFrame, by: str, p: str, effect: str, level: float = 0.05, large: float = 0.8) -> DataFrame:
    """How many tests of each group are significant, and how many effects large."""
    return tests.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(p) < level).alias("significant"), F.count_if(F.abs(effect) > large).alias("large"))


def first_and_last(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """The first and last value of each group and the change between; groups without a value give no row."""
    at, x = F.struct(*order), rows.where(F.col(value).isNotNull())
    x = x.groupBy(by).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    return x.withColumn("change", F.col("last") - F.col("first"))
