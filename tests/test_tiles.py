"""Tiles and rounds against whole matrices."""

import numpy as np
import pytest

from prosemetrics.operators import arcs


def curves(spark, n, seed=0, points=12, copies=()):
    x = np.random.default_rng(seed).normal(size=(n, points)).cumsum(1)
    for a, b in copies:
        x[b] = x[a]
    return x, spark.createDataFrame([(k, k % 4 if k else 9, v.tolist()) for k, v in enumerate(x)], "book long, cluster int, arc array<double>").repartition(3)


def one_pair_at_a_time(x):
    """Ward's merges from the whole matrix, the nearest pair alone each time."""
    own = np.stack([np.abs(x - row).sum(1) for row in x])
    d = np.stack([np.sqrt(((own - row) ** 2).sum(1)) for row in own])
    np.fill_diagonal(d, np.inf)
    names, sizes, out = list(range(len(x))), [1] * len(x), []
    for step in range(len(x) - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        a, b, h = sizes[i], sizes[j], d[i, j]
        out.append((step, names[i], names[j], h, a + b))
        n = np.array(sizes)
        with np.errstate(invalid="ignore"):
            new = np.sqrt(np.maximum(0, ((a + n) * d[i] ** 2 + (b + n) * d[j] ** 2 - n * h * h) / (a + b + n)))
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        names[i], sizes[i] = len(x) + step, a + b
    return out


@pytest.mark.parametrize("n", [2, 3, 90])
def test_ward(spark, n):
    x, rows = curves(spark, n)
    got, want = arcs.ward_merges(rows, "book").orderBy("step").collect(), one_pair_at_a_time(x)
    assert [(r["step"], r["left"], r["right"], r["size"]) for r in got] == [(s, a, b, m) for s, a, b, _, m in want]
    assert [r["height"] for r in got] == pytest.approx([h for *_, h, _ in want], rel=1e-9)


def test_ward_of_copies_and_of_few(spark, monkeypatch):
    """Equal arcs merge at 0, whatever the order among them; one arc or none has no merge."""
    x, rows = curves(spark, 30, 1, copies=[(0, 5), (0, 9), (3, 20), (7, 8)])
    got = arcs.ward_merges(rows, "book").orderBy("step").collect()
    assert sorted(r["height"] for r in got) == pytest.approx([h for *_, h, _ in one_pair_at_a_time(x)], abs=1e-6) and got[-1]["size"] == 30
    assert all(r["left"] < 30 + r["step"] and r["right"] < 30 + r["step"] for r in got)
    assert arcs.ward_merges(rows.limit(1), "book").count() == arcs.ward_merges(rows.limit(0), "book").count() == 0
    monkeypatch.setattr(arcs, "MOST_MERGED", 29)
    with pytest.raises(ValueError, match="more than 29"):
        arcs.ward_merges(rows, "book")


@pytest.mark.parametrize("size", [512, 7])
def test_silhouette_in_tiles(spark, monkeypatch, size):
    x, rows = curves(spark, 40, 2)
    c = np.array([9, *[k % 4 for k in range(1, 40)]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    values = []
    for i in range(40):
        own = [d[i, j] for j in range(40) if j != i and c[j] == c[i]]
        other = min(np.mean(d[i, c == g]) for g in set(c) - {c[i]})
        values.append((other - np.mean(own)) / max(other, np.mean(own)) if own else 0.0)
    monkeypatch.setattr(arcs, "TILE", size)
    out = arcs.silhouette(rows, "book")
    assert out.first()[0] == pytest.approx(np.mean(values), abs=1e-9)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_product_matrices_are_added_in_stages(spark, monkeypatch):
    _, rows = curves(spark, 60, 3)
    whole = arcs.permutation_test(rows, "book", m=1, rounds=5).first()
    monkeypatch.setattr(arcs, "BLOCK", 4)
    apart = arcs.permutation_test(rows, "book", m=1, rounds=5).first()
    monkeypatch.setattr(arcs, "TOGETHER", 3)
    staged = arcs.permutation_test(rows, "book", m=1, rounds=5).first()
    assert staged["real"] == whole["real"] and staged["null_mean"] == pytest.approx(apart["null_mean"], rel=1e-12)
