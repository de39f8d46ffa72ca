"""Cross-validated linear axes over feature tables."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import fitting
from . import forest as cell_forest
from .ordering import placed, running
from .stats import melt, rank_statistics

#: Folds of a forest whose jobs run side by side.
AT_ONCE = 4


class ForestModel(RandomForestClassificationModel):
    """``trees`` as a property: as the cached one of Spark it counts as a parameter, so that each fit makes an object of every tree."""

    trees = property(RandomForestClassificationModel.trees.func)


class Forest(RandomForestClassifier):
    def _create_model(self, java_model) -> ForestModel:
        return ForestModel(java_model)


def folds(rows: DataFrame, key: str, label: str, k: int = 10, seed: int = 42) -> DataFrame:
    """fold 0 .. k-1, shares of each class alike, by a hash of the key."""
    marked = rows.withColumn("_order", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    x = running(placed(marked, [label], ["_order", key]), [label], ["_order", key], {"_place": F.lit(1)})
    return x.select(*rows.columns, ((F.col("_place") - 1) % k).cast("int").alias("fold"))


def _labelled_design(rows: DataFrame, key: str, label: str, features: list[str], k: int) -> DataFrame:
    """The design of all rows; those whose label is 0 or 1 have a fold, the others fold -1.

    The rows are stored first, as sorting them by ranges runs what makes them twice, and the others once more.
    """
    rows = stored(rows.select(key, label, *features))
    own = folds(rows.where(F.col(label).isin(0, 1)), key, label, k)
    rest = rows.where(F.col(label).isNull() | ~F.col(label).isin(0, 1)).withColumn("fold", F.lit(-1))
    return fitting.design(own.unionByName(rest), key, [label], features, "fold")


def block_scores(rows: DataFrame, key: str, label: str, blocks: dict[str, list[str]], k: int = 10) -> DataFrame:
    """key, y, fold, block, score, probability: each row scored, block by block, by a model of the other folds.

    The models of all blocks and folds are fitted together, in one pass over the rows for each step.
    """
    features = list(dict.fromkeys(f for names in blocks.values() for f in names))
    table = _labelled_design(rows.where(F.col(label).isin(0, 1)), key, label, features, k)
    specs = [fitting.Spec(f"{b}|{fold}", tuple(features.index(f) for f in names), fitting.Draw(fold=fold)) for b, names in blocks.items() for fold in range(k)]
    out = fitting.scored(table, fitting.fit(table, specs), list(blocks), lambda b, fold: f"{b}|{fold}", lambda y, fold: fold >= 0)
    return out.withColumnsRenamed({"key": key, "model": "block"})


def out_of_fold(rows: DataFrame, key: str, label: str, features: list[str], k: int = 5, forest: int = 0) -> DataFrame:
    """key, y, fold, score, probability: each row scored by a model of the other folds.

    A forest of few features is grown over cells, in work that does not grow with the rows; one of more by ``pyspark.ml``.
    """
    if not forest:
        return block_scores(rows, key, label, {"all": features}, k).drop("block")
    table = _labelled_design(rows.where(F.col(label).isin(0, 1)), key, label, features, k)
    if len(features) <= cell_forest.MOST_FEATURES:
        return cell_forest.out_of_fold(table, len(features), k, forest).withColumnRenamed("key", key)
    draws = [fitting.Draw(fold=fold) for fold in range(k)]
    scales = fitting.scales(table, draws)
    y = F.col("y")[0]

    def one(fold: int) -> DataFrame:
        scale = scales[draws[fold]]
        z = [(F.coalesce(F.col("x")[i], F.lit(float(scale.median[i]))) - float(scale.mean[i])) / float(scale.deviation[i]) for i in range(len(features))]
        x = table.select("key", y.alias("y"), "fold", array_to_vector(F.array(*z)).alias("vector"))
        model = Forest(featuresCol="vector", labelCol="y", numTrees=forest, seed=42).fit(x.where(F.col("fold") != fold))
        own = model.transform(x.where(F.col("fold") == fold))
        return stored(own.select(F.col("key").alias(key), "y", "fold", vector_to_array("rawPrediction")[1].alias("score"), vector_to_array("probability")[1].alias("probability")))

    # The jobs of several folds run side by side; each stores its scores, as every task of a union would be sent all models.
    with ThreadPoolExecutor(min(k, AT_ONCE)) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(one), range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mixed_scores(rows: DataFrame, key: str, label: str, features: list[str], k: int = 10) -> DataFrame:
    """key, score, source: out-of-fold scores where the label is 0 or 1, those of a model of all such rows elsewhere."""
    table, every = _labelled_design(rows, key, label, features, k), tuple(range(len(features)))
    specs = [fitting.Spec("full fit", every), *[fitting.Spec(f"{fold}", every, fitting.Draw(fold=fold)) for fold in range(k)]]
    out = fitting.scored(table, fitting.fit(table, specs), [""], lambda _, fold: f"{fold}" if fold >= 0 else "full fit", lambda y, fold: np.ones(len(fold), bool))
    return out.select(F.col("key").alias(key), "score", F.when(F.col("fold") >= 0, "out of fold").otherwise("full fit").alias("source"))


def loadings(rows: DataFrame, key: str, label: str, features: list[str], k: int = 5) -> DataFrame:
    """component, explained, auc, feature, loading: what each component is made of and how it parts the classes."""
    rows = stored(rows.select(key, label, *features))
    scores, explained, weights = principal(rows, key, features, k)
    names = [f"pc{i + 1}" for i in range(len(weights))]
    auc = {r["feature"]: r["auc"] for r in rank_statistics(melt(scores.join(rows.select(key, label), key), label, names)).collect()}  # a row for each component
    out = [(n, float(explained[i]), auc.get(n), f, float(w)) for i, n in enumerate(names) for f, w in zip(features, weights[i], strict=True)]
    return rows.sparkSession.createDataFrame(out, "component string, explained double, auc double, feature string, loading double")


def save(model, path: str) -> None:
    """A fitted model of ``pyspark.ml``, in place of one that is there."""
    model.write().overwrite().save(path)


def load(kind: type, path: str):
    return kind.load(path)


def cv_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mean and population deviation over folds of AUC and accuracy, for each group of ``by``."""
    by = by or []
    scored = stored(scored.select("fold", "y", "probability", F.to_json(F.struct("fold", *by)).alias("feature"), *by))
    acc = scored.groupBy("feature", *by).agg(F.avg(((F.col("probability") >= 0.5).cast("int") == F.col("y")).cast("int")).alias("acc"))
    auc = rank_statistics(scored.select("feature", F.col("probability").alias("x"), F.col("y").cast("int").alias("y")))
    return auc.join(acc, "feature").groupBy(*by).agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_sd"), F.avg("acc").alias("acc_mean"), F.stddev_pop("acc").alias("acc_sd"))


def ablation(rows: DataFrame, key: str, label: str, blocks: dict[str, list[str]], k: int = 3) -> DataFrame:
    """block, features and the summary over folds of each block of features."""
    sizes = F.create_map(*[F.lit(v) for b, names in blocks.items() for v in (b, len(names))])
    return cv_summary(block_scores(rows, key, label, blocks, k), ["block"]).withColumn("features", sizes[F.col("block")])


def axes(rows: DataFrame, key: str, labels: list[str], features: list[str]) -> list[list[float]]:
    """For each label the coefficients, over standardised features, of a model of all rows that have it."""
    table, every = fitting.design(rows, key, labels, features), tuple(range(len(features)))
    fitted = fitting.fit(table, [fitting.Spec(f"{k}", every, fitting.Draw(k)) for k in range(len(labels))])
    return [fitted[f"{k}"].beta[1:].tolist() for k in range(len(labels))]


def angle(a: list[float], b: list[float]) -> tuple[float, float]:
    """Cosine and degrees between two axes."""
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    size = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) or 1.0
    c = max(-1.0, min(1.0, dot / size))
    return c, math.degrees(math.acos(c))


def bootstrap_angles(rows: DataFrame, key: str, one: str, two: str, features: list[str], rounds: int = 20) -> DataFrame:
    """round, cosine, degrees over resamples, each axis with its own; draws of one class are passed over.

    Rows whose label is not 0 or 1 are not drawn for that axis. A resample gives each row a Poisson weight of mean 1 by
    a hash of its key, the round and the axis. All rounds are fitted together.
    """
    table, every = fitting.design(rows, key, [one, two], features), tuple(range(len(features)))
    fitted = fitting.fit(table, [fitting.Spec(f"{label}|{r}", every, fitting.Draw(label, round=r)) for r in range(rounds) for label in (0, 1)])
    got = [(r, *angle(*[fitted[f"{label}|{r}"].beta[1:].tolist() for label in (0, 1)])) for r in range(rounds) if f"0|{r}" in fitted and f"1|{r}" in fitted]
    return rows.sparkSession.createDataFrame(got, "round long, cosine double, degrees double")


def with_interval(angles: DataFrame) -> DataFrame:
    """``angles`` with low and high, the percentiles 2.5 and 97.5 of the cosine over all rounds, interpolated."""
    ends = angles.agg(F.percentile("cosine", F.array(F.lit(0.025), F.lit(0.975))).alias("ends"))
    return angles.crossJoin(F.broadcast(ends)).select(*angles.columns, F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


def principal(rows: DataFrame, key: str, features: list[str], k: int = 5) -> tuple[DataFrame, list[float], list[list[float]]]:
    """Scores key, pc1 .. pck; explained shares; loadings, each with a positive largest entry. Up to one a feature."""
    table = fitting.design(rows.withColumn("_all", F.lit(0)), key, ["_all"], features)
    scale = fitting.scales(table, [fitting.Draw()])[fitting.Draw()]
    z = [(F.coalesce(F.col("x")[i], F.lit(float(scale.median[i]))) - float(scale.mean[i])) / float(scale.deviation[i]) for i in range(len(features))]
    x = table.select("key", array_to_vector(F.array(*z)).alias("vector"))
    model = PCA(k=min(k, len(features)), inputCol="vector", outputCol="pcs").fit(x)
    loadings = model.pc.toArray().T
    signs = [1.0 if v[abs(v).argmax()] >= 0 else -1.0 for v in loadings]
    pcs = vector_to_array("pcs")
    scores = model.transform(x).select(F.col("key").alias(key), *[(pcs[i] * signs[i]).alias(f"pc{i + 1}") for i in range(len(signs))])
    return scores, list(model.explainedVariance), [list(v * s) for v, s in zip(loadings, signs, strict=True)]


__all__ = ["ablation", "angle", "axes", "block_scores", "bootstrap_angles", "cv_summary", "folds", "load", "loadings", "melt", "mixed_scores", "out_of_fold", "principal", "save", "with_interval"]
