"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit, a binary classifier weighs byte n-grams by the log odds of their
counts in the languages whose codeword has the bit set against the others. Decoding weighs each bit's logistic
loss by how far its two sides lie apart, takes the codeword of the least loss and flags close calls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast, _FOLD, map_arrow, remainder, slices, sums, table, utf8

#: Byte trigrams are hashed to so many features.
FEATURES = 1 << 15
#: Values of lang that can be learned at most.
MOST_LANGUAGES = 1_000
#: How steeply the loss falls with a bit's margin, and the lead in probability under which a call is ambiguous.
STEEPNESS, LEAD = 6.0, 0.1
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1. Up to 7 languages: the exhaustive code; beyond: random bits, the best of many draws.

    Every column has both values if n is 2 or more.
    """
    if n <= 7:
        columns = [[1] + [1 if (k >> j) & 1 else -1 for j in range(n - 1)] for k in range((1 << (n - 1)) - 1)] or [[1]]
        return np.array(columns, float).T.reshape(n, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, 8 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = code.shape[1] - np.abs(code @ code.T - 2 * code.shape[1] * np.eye(n)).max()
        if apart > far:
            best, far = code, apart
    return best


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature of the trigram at each byte, ends of texts counting as blanks, and the documents' bounds."""
    data = _FOLD[data].astype(np.uint32)
    one, two = np.full(len(data) + 2, 32, np.uint32), np.full(len(data) + 2, 32, np.uint32)
    one[: len(data)], two[: len(data)] = data, data
    inner = offsets[1:-1]  # what follows the last two bytes of a text is not the next text
    one[inner], two[inner], two[inner + 1] = 32, 32, 32
    key = data << np.uint32(16) | one[1 : len(data) + 1] << np.uint32(8) | two[2 : len(data) + 2]
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(17), offsets


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    spread: np.ndarray

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: the place of its language, the probability, and whether a second one is near."""
        key, bounds = grams(data, offsets)
        margin = sums(self.weights[key], bounds) / np.maximum(1, np.diff(bounds))[:, None] / self.spread
        share = self.spread / self.spread.sum()
        loss = (np.logaddexp(0, -STEEPNESS * margin[:, None, :] * self.code[None]) * share).sum(2)
        p = np.exp(-len(share) * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        ranked = np.sort(p, 1)
        lead = ranked[:, -1] - ranked[:, -2] if p.shape[1] > 1 else np.ones(len(p))
        return p.argmax(1), p.max(1), lead < LEAD


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for a, b in slices(offsets):
            key, bounds = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            each, at = np.unique(langs[a:b].astype(str), return_inverse=True)
            owner = np.repeat(at, np.diff(bounds))
            for k, lang in enumerate(each):
                total[lang] = total.get(lang, 0) + np.bincount(key[owner == k], minlength=FEATURES)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at], pa.int64())], ["lang", "feature", "n"])


def fit(docs: DataFrame) -> Model:
    """Learns from all rows with a text and a lang. Raises ValueError at more than MOST_LANGUAGES values of lang."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    counts = np.zeros((max(1, len(languages)), FEATURES))
    place = {x: k for k, x in enumerate(languages)}
    for r in map_arrow(rows, _count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("x")).toLocalIterator():  # at most FEATURES in a list
        x = np.array(r["x"], np.int64)
        counts[place[r["lang"]], x[:, 0]] = x[:, 1]
    code = codewords(len(counts))
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * FEATURES)  # languages count alike
    weights, spread = [], []
    for bit in code.T:
        yes = share[bit > 0].mean(0) if (bit > 0).any() else np.full(FEATURES, 1 / FEATURES)
        no = share[bit < 0].mean(0) if (bit < 0).any() else np.full(FEATURES, 1 / FEATURES)
        odds = np.log(yes / no)
        centre = ((yes + no) * odds).sum() / 2
        weights.append(odds - centre)
        spread.append(max(1e-6, ((yes - no) * odds).sum() / 2))
    return Model(languages, code, np.array(weights, np.float32).T.copy(), np.array(spread))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous.

    A null text, one without a letter, and every text if nothing was learned get ``und`` with the score 0 and are
    not ambiguous. All bytes of a text count. Repeated rows get equal results; no column but text is an input.
    """
    sent = broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            names, scores, close = [], [], []
            for a, b in slices(offsets):
                own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                letters = sums(_LETTER[own], bounds) > 0
                for k in np.flatnonzero(~letters):
                    letters[k] = any(c.isalpha() for c in own[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "ignore"))
                letters &= bool(model.languages)
                best, score, near = model.predict(own, bounds)
                names += [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                scores.append(np.where(letters, score, 0.0))
                close.append(near & letters)
            none = np.zeros(0)
            new = [pa.array(names, pa.string()), pa.array(np.concatenate([none, *scores])), pa.array(np.concatenate([none, *close]).astype(bool))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    kept = docs.drop("lang_pred", "score", "ambiguous")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return map_arrow(kept, run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


def op10_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every whole document; held-out rows teach nothing."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
