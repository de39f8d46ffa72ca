"""How filters of documents work together: what each removes in every order, and what it alone removes.

A document becomes a mask of the filters that it fails, found by scanning Arrow buffers: each byte has classes, words
are the runs between blanks, and prefix sums over the bytes give counts by document. Words are told apart by hashes
that are sorted within their document and verified by bytes. All orders of the filters are answered from counts by mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _same, distinct, map_arrow, slices, span_hash, sums, table, utf8

#: The filters by letter, in the order of their bits. E is found by joining equal texts.
FILTERS = "ABCDE"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, b"#$%&*|"
#: A document of more bytes is read a stretch at a time.
LONG = 1 << 22

BLANK, CAPITAL, SIGN, TAIL = 1, 2, 4, 8
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] |= BLANK
CLASSES[65:91] |= CAPITAL
CLASSES[list(SIGNS)] |= SIGN
CLASSES[0x80:0xC0] |= TAIL


def _words(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ink; none goes on into the next document."""
    edge = np.zeros(len(ink) + 1, bool)
    edge[offsets] = True
    start, stop = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    stop[:-1] &= ~ink[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many contents the spans at[i] to at[i + 1] of each document have."""
    owner, hashes = np.repeat(np.arange(len(at) - 1), np.diff(at)), span_hash(data, start, end)
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    if _same(data, start, end, first):
        return np.bincount(owner[order[new]], minlength=len(at) - 1)
    return np.array([len({data[x:y].tobytes() for x, y in zip(start[a:b], end[a:b], strict=True)}) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """words, distinct words, capitals, code points and signs: a column for each document."""
    classes = CLASSES[data]
    start, end = _words(classes & BLANK == 0, offsets)
    at = np.searchsorted(start, offsets)
    counts = [sums(classes & c != 0, offsets) for c in (CAPITAL, TAIL, SIGN)]
    return np.stack([np.diff(at), _distinct(data, start, end, at), counts[0], np.diff(offsets) - counts[1], counts[2]])


def measures_long(data: np.ndarray, stretch: int = LONG) -> np.ndarray:
    """``measures`` of one document, in stretches that end at blanks; the distinct words seen are kept as places."""
    total, a = np.zeros(5, np.int64), 0
    start = end = np.zeros(0, np.int64)
    while a < len(data):
        b = min(len(data), a + stretch)
        while b < len(data) and not CLASSES[data[b]] & BLANK:  # on to the next blank
            found = np.flatnonzero(CLASSES[data[b : b + 65536]] & BLANK)
            b = b + int(found[0]) if len(found) else min(len(data), b + 65536)
        own, bounds = data[a:b], np.array([0, b - a])
        total += measures(own, bounds)[:, 0]
        x, y = _words(CLASSES[own] & BLANK == 0, bounds)
        where = distinct(own, x, y)[0]
        start, end = np.concatenate([start, x[where] + a]), np.concatenate([end, y[where] + a])
        where = distinct(data, start, end)[0]
        start, end, a = start[where], end[where], b
    total[1] = len(start)
    return total[:, None]


def failed(found: np.ndarray) -> np.ndarray:
    """The filters A to D that documents of these ``measures`` fail, as bits."""
    words, kinds, capitals, points, signs = found
    return ((words < FEWEST_WORDS) + 2 * (100 * kinds < LEAST_DISTINCT * words) + 4 * (100 * capitals > MOST_CAPITALS * points) + 8 * (signs > 0)).astype(np.int32)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, digest of each row: filters A to D failed, and the SHA-256 of the text. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            masks, digests = [], []
            for a, b in slices(offsets):
                own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                masks.append(failed(measures_long(own) if b == a + 1 and len(own) > LONG else measures(own, bounds)))
                digests += [hashlib.sha256(own[x:y]).digest() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(np.concatenate(masks or [np.zeros(0, np.int32)])), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text"), run, "doc_id long, part string, mask int, digest binary")


def _matrices(n: int) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The steps of all orders of n filters, and for each step the weight of every mask in each count."""
    masks, steps, rows = np.arange(1 << n), [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    set_bits = np.array([int(m).bit_count() for m in masks])
    orders = len(list(permutations(range(n))))
    for order in permutations(range(n)):
        before = 0
        for k, f in enumerate(order):
            fails = masks >> f & 1
            steps.append(("".join(FILTERS[x] for x in order), k + 1))
            rows["removed"].append(fails * (masks & before == 0))
            rows["redundant"].append(fails * (masks & before != 0))
            rows["unique_fails"].append((masks == 1 << f).astype(np.int64))
            rows["shapley"].append(fails * orders // np.maximum(1, set_bits))  # first of its mask's filters in as many orders
            before |= 1 << f
            rows["kept"].append((masks & before == 0).astype(np.int64))
    return steps, {k: np.array(v, np.int64) for k, v in rows.items()}


def interactions(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and counts of each step of every order, from counts(part, mask, n, good, toxic).

    ``counts`` has a row for each part and mask at most; masks without a row count 0. A part without rows has none here.
    """
    slots = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # one row for each mask at most
    by_part = counts.groupBy("part").agg(slots.alias("slots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, weigh = _matrices(len(FILTERS))
        orders, numbers = zip(*steps, strict=True)
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                n, good, toxic = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for c in cells:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                lost = {"good_lost": weigh["removed"] @ good, "toxic_lost": weigh["removed"] @ toxic}
                columns = {k: w @ n for k, w in weigh.items()} | lost
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps)), pa.array(orders), pa.array(numbers, pa.int32()), *[pa.array(v) for v in columns.values()]], ["part", "filter_order", "step", *columns])

    return map_arrow(by_part, run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, shapley long, good_lost long, toxic_lost long")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows by the filters that they fail, E for a text that a smaller doc_id has as well.

    A row is good or toxic if any label of its doc_id says so. Rows without a doc_id have no label and fail E never, nor
    do they make others fail it; rows that repeat a doc_id with the same text are no copies of each other.
    """
    own = scan(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    own = own.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(4096))).otherwise(0))  # null ids would meet in one task
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    own = own.join(said.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    # copies meet in the map-side sums first: a text has few rows when its groups are brought together
    alike = own.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    alike = alike.withColumn("smallest", F.min("least").over(Window.partitionBy("digest")))
    passed = F.col("unnamed") + F.when(F.col("least") == F.col("smallest"), F.col("at_least")).otherwise(0)
    either = F.inline(F.array(F.struct(F.col("mask"), passed.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passed).alias("n"))))
    flat = alike.select("part", "good", "toxic", either).where("n > 0")
    return flat.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all documents.

    A null text is empty, a null lang the part of the empty string. Rows with a null or repeated doc_id are as in
    ``mask_counts``. A text of any length is read whole, a stretch at a time. An empty table gives no rows.
    """
    return interactions(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_BITS = " + ".join(f"{1 << k} * {x.lower()}" for k, x in enumerate(FILTERS))
ORACLE = rf"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(ws) < 100)::int as a, (100 * len(list_distinct(ws)) < 80 * len(ws))::int as b,
 (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int as c, regexp_matches(t, '[#$%&*|]')::int as d, coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)::int as e from d left join l on d.doc_id = l.doc_id),
m as (select part, {_BITS} as mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as bit),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from x a join x b on b.c <> a.c join x c on c.c not in (a.c, b.c) join x d on d.c not in (a.c, b.c, c.c) join x e on e.c not in (a.c, b.c, c.c, d.c)),
s as (select filter_order, k as step, bits[k] as bit, coalesce(list_sum(bits[1:k - 1]), 0)::int as before from o, range(1, 6) t(k)),
r as (select part, filter_order, step, bit, sum(case when mask & (before | bit) = 0 then n else 0 end) as kept, sum(case when mask & bit <> 0 and mask & before = 0 then n else 0 end) as removed,
 sum(case when mask & bit <> 0 and mask & before <> 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
 sum(case when mask & bit <> 0 and mask & before = 0 then good else 0 end) as good_lost, sum(case when mask & bit <> 0 and mask & before = 0 then toxic else 0 end) as toxic_lost from m, s group by 1, 2, 3, 4)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
 cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r
"""
