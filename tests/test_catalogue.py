"""Every query with an oracle gives the oracle's rows; the others run."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemetrics.operators import arcs, models, stats
from prosemetrics.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def table(rows, order):
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "events", "lineitem", "orders", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    expected = con.sql(catalogue.ORACLES[name])
    columns = expected.columns
    assert sorted(columns) == sorted(df.columns)
    assert table(rows, columns) == table([dict(zip(columns, r, strict=True)) for r in expected.fetchall()], columns)


def test_bh_over_all_orders(spark, small):
    """As the SQL of bh_adjust without its filter; only distinct values of p are ordered."""
    x = spark.read.parquet(f"{small}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), ((F.col("o_orderkey") * 7919 % 1000 + 1) / 1000000.0).alias("p"))
    got = stats.benjamini_hochberg(x, "p")
    sql = catalogue.ORACLES["bh_adjust"].replace(" where o_orderkey <= 400", "")
    expected = duckdb.connect().sql(sql.replace("from orders", f"from '{small}/orders.parquet'")).fetchall()
    assert len(expected) == x.count() > 400
    assert table(got.collect(), ["k", "p", "p_adjusted"]) == table([dict(zip(("k", "p", "p_adjusted"), r, strict=True)) for r in expected], ["k", "p", "p_adjusted"])


def test_bh_without_a_p(spark):
    """Rows without a p are no tests: they move no rank and get no value."""
    x = spark.createDataFrame([(1, None, "a"), (2, 0.01, "a"), (3, 0.02, "a"), (4, 0.02, "a"), (5, float("nan"), None), (6, 0.5, None)], "k int, p double, layer string")
    got = {r["k"]: r["q"] for r in stats.benjamini_hochberg(x, "p", ["layer"], "q").collect()}
    assert got == pytest.approx({1: None, 2: 0.02, 3: 0.02, 4: 0.02, 5: None, 6: 0.5})


def test_registered_with_the_rounds_trees_and_folds_of_the_reference(spark, small, monkeypatch):
    asked = []
    for module, name in ((models, "out_of_fold"), (models, "ablation"), (models, "bootstrap_angles"), (arcs, "permutation_test")):
        monkeypatch.setattr(module, name, lambda *a, **k: asked.append(k) or spark.range(1))
    for name in ("cv_summary", "with_interval"):
        monkeypatch.setattr(models, name, lambda x: x, raising=False)
    for name in ("oof_scores", "cv_ablation", "forest_ceiling", "axis_bootstrap", "permutation_test"):
        catalogue.QUERIES[name](spark, small)
    assert asked == [{"k": 10}, {"k": 10}, {"k": 10, "forest": 500}, {"rounds": 200}, {"rounds": 1000}]


def test_percentile_interval(spark):
    cosines = np.random.default_rng(3).uniform(-1, 1, 200)
    got = models.with_interval(spark.createDataFrame([(k, float(c)) for k, c in enumerate(cosines)], "round long, cosine double")).collect()
    assert len(got) == 200
    assert all((r["low"], r["high"]) == pytest.approx(tuple(np.percentile(cosines, [2.5, 97.5]))) for r in got)
