"""Models fitted together against models fitted alone; ranks and quantiles against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemetrics.operators import fitting, models, ordering, stats
from prosemetrics.operators.fitting import Draw, Spec


def table(spark, n=300, holes=True):
    r = np.random.default_rng(8)
    data = []
    for k in range(n):
        y = None if k % 17 == 0 else int(r.uniform() < 0.4)
        x = [float(v) for v in r.normal(0, 3, 3) + [y or 0, 5, 0]]
        data.append((k, y, int(x[2] > 0) if k % 2 else None, *(None if holes and (k + c) % 11 == 0 else v for c, v in enumerate(x)), 7.0))
    return spark.createDataFrame(data, "k int, y int, z int, a double, b double, c double, same double").withColumn("b", F.when(F.col("k") % 23 == 0, float("nan")).otherwise(F.col("b"))).repartition(5)


def alone(x, y, times):
    """Scale and coefficients from rows that repeat ``times``, by Newton's method over the whole matrix."""
    x, y = np.repeat(x, times, axis=0), np.repeat(y, times)
    median = np.nan_to_num(np.nanmedian(x, axis=0))
    x = np.where(np.isnan(x), median, x)
    spread = x.std(0)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / np.where(spread > 0, spread, 1)])
    beta, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (p - y) + ridge @ beta)
    return beta


def arrays(rows):
    got = rows.orderBy("key").collect()
    f = lambda c: np.array([[np.nan if v is None else v for v in r[c]] for r in got])
    return f("x"), f("y"), np.array([r["fold"] for r in got]), np.array([r["h"] for r in got]).view(np.uint64)


def test_models_fitted_together_are_those_fitted_alone(spark):
    """Folds, resamples, both labels and blocks of features, with missing values and a constant column."""
    marked = models.folds(table(spark), "k", "y", 4)
    rows = fitting.design(marked, "k", ["y", "z"], ["a", "b", "c", "same"], "fold")
    draws = [Draw(), Draw(1), *[Draw(fold=k) for k in range(4)], *[Draw(label, round=r) for r in range(6) for label in (0, 1)]]
    specs = [Spec(f"{n}|{f}", f, d) for n, d in enumerate(draws) for f in ((0, 1, 2, 3), (1,))]
    got = fitting.fit(rows, specs)
    x, y, fold, h = arrays(rows)
    assert len(got) == len(specs)
    for s in specs:
        w = s.draw.weights(y, fold, h).astype(int)
        want = alone(x[:, list(s.features)][w > 0], y[w > 0, s.draw.label], w[w > 0])
        assert got[s.name].beta == pytest.approx(want, abs=1e-7)
    again = fitting.fit(rows, specs[-1:])[specs[-1].name]
    assert again.beta == pytest.approx(got[specs[-1].name].beta, abs=1e-9)


def test_resamples(spark):
    """Weights are Poisson of mean 1, other in each round and for each axis, and the same when asked again."""
    y, fold, h = np.zeros((20_000, 2)), np.zeros(20_000), np.arange(20_000, dtype=np.uint64) * 2_654_435_761
    w = [Draw(label, round=r).weights(y, fold, h) for r in range(3) for label in (0, 1)]
    for one in w:
        assert abs(one.mean() - 1) < 0.03 and abs(one.var() - 1) < 0.05 and abs((one == 0).mean() - np.exp(-1)) < 0.02
    assert all(abs(np.corrcoef(w[a], w[b])[0, 1]) < 0.03 for a in range(6) for b in range(a))
    assert (w[0] == Draw(0, round=0).weights(y, fold, h)).all()


def test_separable_classes_and_single_ones(spark):
    rows = fitting.design(spark.createDataFrame([(k, int(k > 9), 1, float(k)) for k in range(20)], "k int, y int, one int, a double"), "k", ["y", "one"], ["a"])
    got = fitting.fit(rows, [Spec("y", (0,)), Spec("one", (0,), Draw(1))])
    assert set(got) == {"y"} and got["y"].beta[1] > 1 and abs(got["y"].score(np.array([[9.5]]))[0]) < 1e-6
    assert fitting.fit(rows.limit(0), [Spec("y", (0,))]) == {}


def test_bootstrap_angles(spark):
    got = models.bootstrap_angles(table(spark), "k", "y", "z", ["a", "b", "c"], rounds=12).orderBy("round").collect()
    assert [r["round"] for r in got] == list(range(12)) and all(r["degrees"] == pytest.approx(np.degrees(np.arccos(r["cosine"]))) for r in got)
    rows = fitting.design(table(spark), "k", ["y", "z"], ["a", "b", "c"])
    x, y, fold, h = arrays(rows)
    one, two = ((lambda w, i: alone(x[w > 0], y[w > 0, i], w[w > 0])[1:])(Draw(i, round=7).weights(y, fold, h).astype(int), i) for i in (0, 1))
    assert got[7]["cosine"] == pytest.approx(one @ two / np.sqrt((one @ one) * (two @ two)), abs=1e-7)


def test_out_of_fold_scores(spark):
    """Each row is scored by the model that has not seen its fold; blocks together give what each gives alone."""
    rows = table(spark)
    both = models.block_scores(rows, "k", "y", {"one": ["b"], "all": ["a", "b", "c"]}, k=3).toPandas()
    one = models.out_of_fold(rows, "k", "y", ["a", "b", "c"], k=3).toPandas().set_index("k").sort_index()
    own = both[both["block"] == "all"].set_index("k").sort_index()
    assert len(own) == rows.where("y is not null").count() and np.allclose(own["score"], one["score"], atol=1e-9) and (own["fold"] == one["fold"]).all()
    marked = fitting.design(models.folds(rows.where("y is not null"), "k", "y", 3), "k", ["y"], ["a", "b", "c"], "fold")
    x, y, fold, _ = arrays(marked)
    train = fold != 1
    beta = alone(x[train], y[train, 0], np.ones(train.sum(), int))
    median = np.nanmedian(x[train], axis=0)
    filled = np.where(np.isnan(x), median, x)
    want = beta[0] + ((filled - filled[train].mean(0)) / filled[train].std(0)) @ beta[1:]
    assert np.allclose(np.sort(one[one["fold"] == 1]["score"]), np.sort(want[fold == 1]), atol=1e-7)


def test_quantiles(spark):
    r = np.random.default_rng(1)
    data = [(int(k % 3) if k % 7 else None, float(v), float(10 ** (300 * u) * (-1 if k % 2 else 1)), int(r.integers(0, 3)), None) for k, (v, u) in enumerate(zip(r.normal(size=900).round(1), r.uniform(-1, 1, 900), strict=True))]
    data += [(9, None, float("nan"), 1, None), (8, 1.5, -0.0, 1, None), (8, 2.5, 5e-324, 1, None)]
    rows, probs = spark.createDataFrame(data, "g int, a double, b double, t int, e double"), [0, 0.25, 0.5, 0.95, 1]
    got = {(x["g"], x["feature"]): x["q"] for x in ordering.quantiles(rows, ["g"], ["a", "b", "e"], probs).collect()}
    assert set(got) == {(g, f) for g in (0, 1, 2, 8, None) for f in "ab"}
    for (g, f), q in got.items():
        own = [x["ab".index(f) + 1] for x in data if x[0] == g]
        assert q == pytest.approx(np.percentile([v for v in own if v is not None], [100 * p for p in probs]), rel=1e-12)
    own = np.repeat([x[1] for x in data if x[1] is not None], [x[3] for x in data if x[1] is not None])
    assert ordering.quantiles(rows, [], ["a"], [0.5], "t").first()["q"] == [np.median(own)]
    assert ordering.quantiles(rows.limit(0), [], ["a"], [0.5]).count() == 0


def test_running_sums_over_many_ranges(spark):
    """With more ranges than the session would make: order, sums, totals and least values from a row on."""
    r = np.random.default_rng(2)
    data = [("ab"[k % 2] if k % 5 else None, int(k), float(r.integers(0, 50))) for k in r.permutation(400)]
    rows = spark.createDataFrame(data, "g string, k int, v double")
    ranges = ordering.placed(rows.repartitionByRange(9, "g", "k"), ["g"], ["k"])
    many = rows.repartitionByRange(9, "g", "k").withColumn("_part", F.spark_partition_id())
    for x in (ranges, many):
        x = ordering.stored(x)
        out = ordering.least_from(ordering.running(x, ["g"], ["k"], {"s": F.col("v"), "n": F.lit(1)}), ["g"], ["k"], "v", "least").collect()
        assert len(out) == 400
        for g in ("a", "b", None):
            own = sorted(d[1:] for d in data if d[0] == g)
            for i, x_ in enumerate(sorted((o for o in out if o["g"] == g), key=lambda o: o["k"])):
                assert (x_["s"], x_["n"], x_["all_s"], x_["least"]) == (sum(v for _, v in own[: i + 1]), i + 1, sum(v for _, v in own), min(v for _, v in own[i:]))
    assert many.select("_part").distinct().count() > 4


def test_no_window_holds_a_whole_feature(spark):
    """Windows over rows are parted by range; those over whole groups see one row for each range."""
    long = spark.range(5000).selectExpr("'f' as feature", "cast(id * 37 % 4999 as double) as x", "cast(id % 2 as int) as y")
    plan = stats.rank_statistics(long)._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window [" in line]
    assert rows and all("_part" in line for line in rows)
    assert stats.iqr_repair(spark.createDataFrame([(k, float(v)) for k, v in enumerate([1, 2, 3, 4, 5000])] + [(9, None)], "k int, v double"), ["v"]).orderBy("k").select("v").toPandas()["v"].tolist()[:5] == [1, 2, 3, 4, 5.0]
