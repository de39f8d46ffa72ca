"""Toxicity by weak supervision.

Voters look for lexicon entries or patterns in a text. The lexicons differ in what they look at (whole words, or their
first letters) and in the labelled rows that they were read from. A generative label model estimates each voter's
accuracy, and the correlations between them, from how they agree over all training rows, labelled or not, starting
from their majority; no label enters it but for the share of toxic rows. A linear classifier over lexicon entries and
patterns, trained on its posteriors alone, scores every text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast, map_arrow, MARKS, mix, remainder, slices, span_hash, sums, table, utf8, words

#: Features of one family are hashed to so many places.
BITS = 20
#: Labelled rows of each class that are fitted on at most, the first by a hash of their id.
MOST_TOXIC, MOST_CLEAN = 4_000, 6_000
#: The share of toxic rows among those with a lexicon entry, at least.
PURE = 0.85
#: Families of features: whole words (0), and so many initial letters (bytes) of a word.
FAMILIES = (0, 4, 5, 6)
#: Lexicons of each family; each is read from the labelled rows but one part in so many.
PARTS = 3
LEXICONS = PARTS * len(FAMILIES)
PATTERNS = ("shouting", "exclaiming", "masking", "repeating")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature places in each document, document by document, and the documents' bounds.

    The bits above BITS are the place of the family.
    """
    folded, start, end, at = words(data, offsets, MARKS)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(at))
    both = []
    for family, n in enumerate(FAMILIES):
        long = end - start >= n
        hashes = span_hash(folded, start[long], start[long] + n if n else end[long]) >> np.uint64(64 - BITS)
        both.append(owner[long] << np.uint64(BITS + 2) | np.uint64(family << BITS) | hashes)
    both = np.sort(np.concatenate(both))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both & np.uint64((1 << BITS + 2) - 1)).astype(np.int64), np.searchsorted(both, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BITS + 2))


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A vote of each pattern voter for each document: 1 if its pattern stands out, else -1 (no vote)."""
    n = np.maximum(1, np.diff(offsets))
    upper = sums((data >= 65) & (data <= 90), offsets)
    lower = sums((data >= 97) & (data <= 122), offsets)
    shout = upper > lower
    exclaim = sums(data == 33, offsets) > 0.02 * n
    mask = sums((data == 42) | (data == 35) | (data == 36), offsets) > 0.01 * n
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    again = sums(same, offsets) > 0.01 * n
    return np.where(np.stack([shout, exclaim, mask, again], 1), 1, -1).astype(np.int8)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets):
            own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            place, at = features(own, bounds)
            found = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(place.astype(np.int32)))
            votes = patterns(own, bounds)
            votes = pa.ListArray.from_arrays(pa.array(np.arange(len(votes) + 1, dtype=np.int32) * votes.shape[1]), pa.array(votes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic")[a:b], batch.column("part")[a:b], found, votes], ["toxic", "part", "places", "votes"])


def label_model(votes: np.ndarray, anchor: np.ndarray, rounds: int = 30, rate: np.ndarray | None = None, share: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row of votes (1, 0 or -1 for none), the voters' accuracies, and correlations.

    Expectation-maximization over P(vote | label), from the anchor (guesses in [0, 1]) on. A voter's evidence is
    divided by one plus its positive correlations with others given the label, so that voters that say the same
    thing count once. A row stands for ``rate`` rows, or for itself. ``share`` of label 1, if it is known.
    """
    rate = np.ones(len(votes)) if rate is None else rate
    seen = np.stack([votes == -1, votes == 0, votes == 1], 2).astype(float)
    post = np.clip(anchor.astype(float), 0.02, 0.98)
    corr = np.eye(votes.shape[1])
    for _ in range(rounds):
        ones, zeros = rate * post, rate * (1 - post)
        prior = np.clip(ones.sum() / rate.sum() if share is None else share, 1e-3, 1 - 1e-3)
        one = (np.einsum("i,ijv->jv", ones, seen) + 0.5) / (ones.sum() + 1.5)
        zero = (np.einsum("i,ijv->jv", zeros, seen) + 0.5) / (zeros.sum() + 1.5)
        voted = seen[:, :, 2] - seen[:, :, 1]
        rest = voted - (post[:, None] * (one[:, 2] - one[:, 1]) + (1 - post[:, None]) * (zero[:, 2] - zero[:, 1]))
        mean = rate @ rest / rate.sum()
        rest = rest / np.maximum(1e-9, np.sqrt(rate @ (rest - mean) ** 2 / rate.sum()))
        corr = (rate[:, None] * rest).T @ rest / rate.sum()
        damp = 1 + np.maximum(0, corr - np.diag(np.diag(corr))).sum(1)
        odds = np.log(prior / (1 - prior)) + ((np.log(one) - np.log(zero))[None] * seen).sum(2) @ (1 / damp)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    accuracy = prior * one[:, 2] / np.maximum(1e-9, one[:, 2] + one[:, 1]) + (1 - prior) * zero[:, 1] / np.maximum(1e-9, zero[:, 2] + zero[:, 1])
    return post, accuracy, corr


@dataclass
class Lexicons:
    """Which of the lexicons has each of some places, as bits, and what the places weigh."""

    places: np.ndarray
    member: np.ndarray
    name: str = ""

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and entries that they hold."""
        if self.name not in _masks:
            _masks.clear()
            _masks[self.name] = np.zeros(1 << BITS + 2, bool)
            _masks[self.name][self.places] = True
        place, at = features(data, offsets)
        hit = np.flatnonzero(_masks[self.name][place])
        return np.searchsorted(at, hit, "right") - 1, np.searchsorted(self.places, place[hit])

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits: those of the lexicons that a document has an entry of, then those of the patterns that it shows."""
        out = np.zeros(len(offsets) - 1, np.int64)
        owner, entry = self.find(data, offsets)
        np.bitwise_or.at(out, owner, self.member[entry])
        return out | ((patterns(data, offsets) == 1) << np.arange(LEXICONS, LEXICONS + len(PATTERNS))).sum(1)


_masks: dict[str, np.ndarray] = {}


@dataclass
class Model:
    lexicons: Lexicons
    weights: np.ndarray  # of the entries, then of the patterns
    bias: float
    accuracies: np.ndarray
    correlations: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        owner, entry = self.lexicons.find(data, offsets)
        total = np.bincount(owner, self.weights[entry], len(offsets) - 1) + (patterns(data, offsets) == 1) @ self.weights[len(self.lexicons.places) :]
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Votes out of their bits: a lexicon without an entry votes 0, a pattern that does not show casts no vote."""
    on = (bits[:, None] >> np.arange(LEXICONS + len(PATTERNS))) & 1
    return np.where(on == 1, 1, np.where(np.arange(on.shape[1]) < LEXICONS, 0, -1)).astype(np.int8)


def _apart(cols: np.ndarray, bounds: np.ndarray, hashes: int = 6) -> np.ndarray:
    """A weight for each row, one over the size of its family: copies and near copies count once between them.

    A row joins the first one that shares a min-hash with it, if half of their features are the same.
    """
    n = len(bounds) - 1
    full = np.flatnonzero(np.diff(bounds))
    sets = [cols[bounds[k] : bounds[k + 1]] for k in range(n)]
    family = np.arange(n)
    for seed in range(1, hashes + 1) if len(full) else ():
        order = mix(cols.astype(np.uint64) + np.uint64(seed << BITS + 2))
        least = np.minimum.reduceat(order, bounds[:-1][full])
        first: dict[int, int] = {}
        for row, mark in zip(full.tolist(), least.tolist(), strict=True):
            other = first.setdefault(mark, row)
            if family[other] != family[row]:
                same = len(np.intersect1d(sets[row], sets[other], assume_unique=True))
                if 2 * same >= len(sets[row]) + len(sets[other]) - same:
                    family[family == family[row]] = family[other]
    return 1 / np.bincount(family, minlength=n)[family]


def _logistic(rows: np.ndarray, cols: np.ndarray, n: int, target: np.ndarray, weight: np.ndarray, width: int, rounds: int = 1500, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on binary features (row, column pairs), by Adam over all rows."""
    mean = np.average(target, weights=weight)
    w, b = np.zeros(width), float(np.log(np.clip(mean, 1e-3, 1 - 1e-3) / np.clip(1 - mean, 1e-3, 1)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], n) + b, -30, 30)))
        rest = weight * (p - target) / weight.sum()
        g = np.append(np.bincount(cols, rest[rows], width) + l2 / max(1, n) * w, rest.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = np.maximum(0, w - step[:-1]), b - step[-1]  # entries and patterns speak for a label of 1 only
    return w, b


def _strong(cols: np.ndarray, owner: np.ndarray, y: np.ndarray, apart: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Places that toxic rows have far more often than others, beyond what chance gives the best of so many."""
    each, cols = np.unique(cols, return_inverse=True)
    weight = apart * rate
    count = lambda w: np.bincount(cols, w[owner], len(each))
    yes, no = count(weight * y), count(weight * (1 - y))
    # chance is told from the sampled rows, counted as they are: a row that stands for many is one observation
    hit, miss = count(apart * y), count(apart * (1 - y))
    base, drawn = (apart * y).sum() / apart.sum(), hit + miss
    part = np.clip(hit / np.maximum(1e-9, drawn), 1e-12, 1 - 1e-12)
    evidence = 2 * (hit * np.log(part / base) + miss * np.log((1 - part) / (1 - base)))  # likelihood ratio against the base rate
    return each[(yes > PURE * (yes + no)) & (hit >= 2) & (evidence > 2 * np.log(max(2, (drawn > 1).sum())))]


def _count_votes(lexicons: Lexicons):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                each, n = np.unique(lexicons.votes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), return_counts=True)
                for k, m in zip(each.tolist(), n.tolist(), strict=True):
                    total[k] = total.get(k, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["votes", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from ``docs``: lexicons from the rows whose doc_id has a toxic label of 0 or 1, the label model from all.

    Of several labels of one id, the largest counts; of several texts, the least. Lexicons and the classifier are
    fitted on at most MOST_TOXIC and MOST_CLEAN rows, each of which counts for the labelled rows of its class that
    it stands for, so that the fit sees the classes' true shares. The label model sees the votes of every row, counted
    by pattern, of which there are at most 2^16. Without labels, or with one class only, the score is the smoothed
    share of toxic labels for every text.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two at most
    first = lambda v, n: marked.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(first(1, MOST_TOXIC).unionByName(first(0, MOST_CLEAN)))  # at most 10,000 pairs of numbers
    rows = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.select("text", "toxic", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(PARTS)).cast("int").alias("part"))
    got = map_arrow(rows, _extract, "toxic int, part int, places array<int>, votes array<int>").toArrow()
    y, part = (np.array(got.column(c).to_pylist(), float) for c in ("toxic", "part"))
    rate = np.where(y == 1, max(1, total.get(1, 0) / MOST_TOXIC), max(1, total.get(0, 0) / MOST_CLEAN))
    share = ((rate * y).sum() + 0.5) / (rate.sum() + 2)  # no labels at all: under one half
    if len(set(y)) < 2:
        nothing = Lexicons(np.zeros(0, np.int64), np.zeros(0, np.int64), uuid.uuid4().hex)
        return Model(nothing, np.zeros(len(PATTERNS)), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, 0)))
    places = got.column("places").combine_chunks()
    cols, bounds = places.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(places).to_numpy())])
    owner = np.repeat(np.arange(len(y)), np.diff(bounds))
    apart = _apart(cols, bounds)
    found: dict[int, int] = {}  # place -> lexicons that have it
    for k in range(PARTS):
        read = part != k if len(set(y[part != k])) == 2 else np.ones(len(y), bool)
        keep = read[owner]
        for place in _strong(cols[keep], owner[keep], y, apart * read, rate).tolist():
            found[place] = found.get(place, 0) | 1 << ((place >> BITS) * PARTS + k)
    used = np.array(sorted(found), np.int64)
    lexicons = Lexicons(used, np.array([found[x] for x in used.tolist()], np.int64), uuid.uuid4().hex)
    # label model over the votes of all rows
    counted = map_arrow(docs.select("text"), _count_votes(lexicons), "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).sort("votes").toArrow()
    pattern, n = counted.column("votes").to_numpy(), counted.column("n").to_numpy().astype(float)
    votes = unpacked(pattern)
    majority = (votes == 1).sum(1) / np.maximum(1, (votes >= 0).sum(1))
    post, accuracies, correlations = label_model(votes, majority, rate=n, share=share)
    # classifier on the posteriors
    shown = np.array(got.column("votes").to_pylist(), np.int64).reshape(len(y), -1) == 1
    at = np.searchsorted(used, cols)
    keep = np.append(used, -1)[at] == cols
    own = np.zeros(len(y), np.int64)
    np.bitwise_or.at(own, owner[keep], lexicons.member[at[keep]])
    own |= (shown << np.arange(LEXICONS, LEXICONS + len(PATTERNS))).sum(1)
    target = post[np.searchsorted(pattern, own)]
    who, what = np.nonzero(shown)
    w, b = _logistic(np.append(owner[keep], who), np.append(at[keep], what + len(used)), len(y), target, apart * rate, len(used) + len(PATTERNS))
    return Model(lexicons, w, b, accuracies, correlations)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity (0 to 1) of each whole text; a column of that name is replaced.

    Null and empty texts get the score of no evidence. A text of any length counts whole. Repeated rows get equal
    scores; no column but text is an input; an empty table gives no rows.
    """
    sent = broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            scores = [sent.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], [*batch.schema.names, "toxicity"])

    kept = docs.drop("toxicity")
    return map_arrow(kept, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", toxicity double")


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 5) == 0


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every text of documents; held-out rows and their labels teach nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    out = score_texts(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
