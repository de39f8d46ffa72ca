"""Many logistic models over one table, fitted together: each pass over the rows is a Newton step of every model.

A model has a label, some of the features, and a draw: all rows, all but a fold, or a resample in which a hash of the row
and the round gives each row a Poisson weight. A task adds up gradients and Hessians of its rows for all models; their
sums, whose size hangs on models and features alone, reach the driver, which solves for the next step of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from ..sources.shipping import map_arrow
from .ordering import quantiles

#: Cumulative probabilities of a Poisson variable of mean 1; its largest value here has a probability of 1e-17.
POISSON = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1, dtype=float))) for k in range(18)])


@dataclass(frozen=True)
class Draw:
    """Which rows a model sees: those with its label, but ``fold``, or each as often as round ``round`` draws it."""

    label: int = 0
    fold: int | None = None
    round: int | None = None

    def weights(self, y: np.ndarray, fold: np.ndarray, key: np.ndarray) -> np.ndarray:
        own = ~np.isnan(y[:, self.label])
        if self.fold is not None:
            own = own & (fold != self.fold)
        if self.round is None:
            return own.astype(float)
        seed = _mix(np.array([self.round * 1_000_003 + self.label + 1], np.uint64))[0]
        uniform = (_mix(key.astype(np.uint64) ^ seed) >> np.uint64(11)).astype(float) / float(1 << 53)
        return own * np.searchsorted(POISSON, uniform, "right").astype(float)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Spec:
    """A model to fit: its name, its features by place, and its draw."""

    name: str
    features: tuple[int, ...]
    draw: Draw = Draw()


@dataclass
class Scale:
    """Medians that stand for missing values, means and population deviations of a draw; deviations of 0 count as 1."""

    median: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    rows: float
    ones: float


@dataclass
class Model:
    """Intercept and coefficients over standardised features."""

    spec: Spec
    scale: Scale
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def standard(self, x: np.ndarray) -> np.ndarray:
        at = list(self.spec.features)
        own = x[:, at]
        own = np.where(np.isnan(own), self.scale.median[at], own)
        return (own - self.scale.mean[at]) / self.scale.deviation[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.beta[0] + self.standard(x) @ self.beta[1:]


def design(rows: DataFrame, key: str, labels: list[str], features: list[str], fold: str | None = None) -> DataFrame:
    """key, x, y, fold, h of ``rows``, stored: features and labels as arrays, and a hash of the key.

    A feature that is null or NaN, and a label other than 0 and 1, is null there.
    """
    x = [F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features]
    y = [F.when(F.col(c).isin(0, 1), F.col(c).cast("double")) for c in labels]
    return stored(rows.select(F.col(key).alias("key"), F.array(*x).alias("x"), F.array(*y).alias("y"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"), F.xxhash64(F.col(key).cast("string")).alias("h")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y (NaN for null), fold and hash of a batch of a design."""
    return _matrix(batch.column("x")), _matrix(batch.column("y")), batch.column("fold").fill_null(-1).to_numpy(), batch.column("h").to_numpy().view(np.uint64)


def _summed(rows: DataFrame, add: Callable[[tuple, dict[int, np.ndarray]], None]) -> dict[int, np.ndarray]:
    """Arrays by number that ``add`` makes of each batch, summed over all batches of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                add(_arrays(batch), total)
        for number, values in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([values.tolist()], pa.list_(pa.float64()))], ["number", "values"])

    cells = map_arrow(rows.select("x", "y", "fold", "h"), run, "number int, values array<double>").select("number", F.posexplode("values").alias("at", "v"))
    got = cells.groupBy("number", "at").agg(F.sum("v").alias("v")).orderBy("number", "at").toArrow()  # of the size of the models
    numbers, values = got.column("number").to_numpy(), got.column("v").to_numpy()
    return {int(k): values[a:b] for k, a, b in zip(*_runs(numbers), strict=True)}


def _runs(sorted_numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    which, first = np.unique(sorted_numbers, return_index=True)
    return which, first, np.append(first[1:], len(sorted_numbers))


def scales(rows: DataFrame, draws: list[Draw]) -> dict[Draw, Scale]:
    """The scale of each draw. Medians are exact, and asked for only where values are missing; without any, 0."""
    means = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.count_if(F.col("v").isNull()).alias("holes")).orderBy("at").collect()  # a row for each feature
    if not means:
        return {}
    shift, holes = np.array([r["m"] or 0.0 for r in means]), [r["at"] for r in means if r["holes"]]
    medians = {d: np.zeros(len(shift)) for d in draws}
    if holes:

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, *rest = _arrays(batch)
                for k, d in enumerate(draws):
                    w = d.weights(*rest)
                    at = np.flatnonzero(w)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(w[at].astype(np.int64)), *[pa.array(x[at, c]) for c in holes]], ["draw", "times", *[f"x{c}" for c in holes]])

        values = map_arrow(rows.select("x", "y", "fold", "h"), drawn, "draw int, times long, " + ", ".join(f"x{c} double" for c in holes))
        for r in quantiles(values, ["draw"], [f"x{c}" for c in holes], [0.5], "times").collect():  # a row for each draw and feature
            medians[draws[r["draw"]]][int(r["feature"][1:])] = r["q"][0]

    def add(arrays: tuple, total: dict[int, np.ndarray]) -> None:
        x, *rest = arrays
        for k, d in enumerate(draws):
            w, own = d.weights(*rest), np.where(np.isnan(x), medians[d], x) - shift
            label = np.nan_to_num(rest[0][:, d.label])
            total[k] = total.get(k, 0.0) + np.concatenate([[w.sum(), w @ label], w @ own, w @ (own * own)])

    out, n = {}, len(shift)
    for k, s in _summed(rows, add).items():
        count = max(s[0], 1e-300)
        mean, square = s[2 : 2 + n] / count, s[2 + n :] / count
        variance = np.maximum(0.0, square - mean * mean)
        out[draws[k]] = Scale(medians[draws[k]], mean + shift, np.where(variance > 1e-14 * np.maximum(square, 1e-300), np.sqrt(variance), 1.0), s[0], s[1])
    return out


def fit(rows: DataFrame, specs: list[Spec], c: float = 1.0, most: int = 60) -> dict[str, Model]:
    """The models by name: ridge penalty of half the squared coefficients, the loss times ``c``, a free intercept.

    Draws of one class have no model. Every step that does not lower a model's loss is halved; a model is done when its
    step is below 1e-9. Raises RuntimeError if one is not done after ``most`` passes.
    """
    found = scales(rows, list(dict.fromkeys(s.draw for s in specs)))
    models = [Model(s, found[s.draw], np.zeros(1 + len(s.features))) for s in specs if s.draw in found and 0 < found[s.draw].ones < found[s.draw].rows]
    loss, before, step = [np.inf] * len(models), [m.beta for m in models], [np.zeros(len(m.beta)) for m in models]
    todo = list(range(len(models)))
    for _ in range(most):
        if not todo:
            break
        active = [(k, models[k]) for k in todo]

        def add(arrays: tuple, total: dict[int, np.ndarray], active: list = active) -> None:
            x, *rest = arrays
            drawn: dict[Draw, np.ndarray] = {}
            for k, m in active:
                draw = m.spec.draw
                if draw not in drawn:
                    drawn[draw] = draw.weights(*rest)
                at = np.flatnonzero(drawn[draw])
                w, y = drawn[draw][at], rest[0][at, draw.label]
                z = np.column_stack([np.ones(len(at)), m.standard(x[at])])
                score = z @ m.beta
                p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
                own = w @ (np.logaddexp(0, score) - y * score), z.T @ (w * (p - y)), (z.T * (w * p * (1 - p))) @ z
                total[k] = total.get(k, 0.0) + np.concatenate([[own[0]], own[1], own[2].reshape(-1)])

        sums, todo = _summed(rows, add), []
        for k, m in active:
            n, s = len(m.beta), c * sums[k]
            ridge = np.append(0.0, np.ones(n - 1))
            value = s[0] + 0.5 * (ridge * m.beta) @ m.beta
            if value > loss[k] + 1e-12 * abs(loss[k]):
                step[k] = step[k] / 2
            else:
                loss[k], before[k] = value, m.beta
                step[k] = -np.linalg.solve(s[1 + n :].reshape(n, n) + np.diag(ridge) + 1e-12 * np.eye(n), s[1 : 1 + n] + ridge * m.beta)
            m.beta = before[k] + step[k]
            if np.abs(step[k]).max() > 1e-9:
                todo.append(k)
    if todo:
        raise RuntimeError(f"{len(todo)} models are not done after {most} passes")
    return {m.spec.name: m for m in models}


def scored(rows: DataFrame, models: dict[str, Model], groups: list[str], pick: Callable[[str, int], str], where: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """key, y, fold, model, score, probability: for each group the row's score by the model named pick(group, fold).

    ``where`` says by labels and folds which rows are scored; y is the first label.
    """
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fold, _ = _arrays(batch)
            for group in groups:
                for k in np.unique(fold):
                    at = np.flatnonzero((fold == k) & where(y, fold))
                    name = pick(group, int(k))
                    if len(at) and name in models:
                        score = models[name].score(x[at])
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(y[at, 0], from_pandas=True), pa.array(fold[at].astype(np.int32)), pa.array([group] * len(at)), pa.array(score), pa.array(1 / (1 + np.exp(-np.clip(score, -700, 700))))], ["key", "y", "fold", "model", "score", "probability"])

    return map_arrow(rows, run, f"key {kind}, y double, fold int, model string, score double, probability double")
