"""Language-model scores by context-tree weighting over bytes.

The running text is the lower-case words, each followed by a blank, then an end. Each byte is coded as eight binary
decisions, whose contexts are the 0 to DEPTH bytes before it, across words; before the text there are ends. Each node
has a Krichevsky-Trofimov estimate, and a node's weighted probability is half its own and half its children's product.
The trained tree is frozen and mixes the depths' predictions by the weights that training gives them along the path,
so that the probabilities of all texts sum to one.

An event is DEPTH context bytes and the byte that follows. Events are counted, which is all that the tree needs; the
tree below each context of SPLIT bytes is built by itself, many of them in a task, and the few nodes above are
aggregates of its tops, level by level, so that no task and no driver holds the tree.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Table
from .common import broadcast, forget, made, map_arrow, release, remainder, ship, slices, span_hash, sums, table, tidy, utf8, words, written

#: Bytes of context; DEPTH + 1 bytes are one event, 7 at most. Bytes of context below which trees are built apart.
DEPTH, SPLIT = 6, 3
BLANK, STOP = 0x20, 0x0A
#: Types and events whose values each worker holds (8 and 32 MB), the most frequent ones; the others are joined by a shuffle.
TYPES_HELD, EVENTS_HELD = 1 << 18, 1_000_000
#: Types, and events, that a task holds before it hands counts on.
TYPES_COUNTED, EVENTS_COUNTED = 400_000, 1_000_000
#: Events in one bucket of trees.
BUCKET = 50_000
#: Bytes of text whose words are looked at at once.
SLICE = 1 << 19


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def _count_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(np.fromiter(held, np.uint64, len(held))), pa.array(list(held.values()), pa.int64())], ["h", "n"])

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        learned = batch.column("learned").to_numpy(zero_copy_only=False).astype(bool)
        for a, b in slices(offsets, SLICE):
            own, start, end, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            each, back = np.unique(span_hash(own, start, end) >> np.uint64(1), return_inverse=True)
            n = np.bincount(back, np.repeat(learned[a:b], np.diff(at)), len(each)).astype(np.int64)
            for key, more in zip(each.tolist(), n.tolist(), strict=True):
                held[key] = held.get(key, 0) + more
            if len(held) > TYPES_COUNTED:
                yield out()
                held.clear()
    if held:
        yield out()


def count_types(docs: DataFrame) -> DataFrame:
    """h, n: every type of docs(text, learned) with its count in learned texts, 0 for those only in others."""
    return map_arrow(docs.select("text", "learned"), _count_types, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def event_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The events of each text's words (as ``words`` gives them), blanks and end, and the texts' bounds among them.

    The next byte is the lowest of an event's DEPTH + 1, the nearest context byte the highest.
    """
    size, n = end - start, len(at) - 1
    before = np.concatenate([[0], np.cumsum(size + 1)])
    length = before[at[1:]] - before[at[:-1]] + 1
    begin = np.cumsum(length + DEPTH) - length  # of each text, after DEPTH ends
    stream = np.full(int((length + DEPTH).sum()), BLANK, np.uint8)
    real = np.ones(len(stream), bool)
    pad = (begin[:, None] - 1 - np.arange(DEPTH)).ravel()
    stream[pad], real[pad], stream[begin + length - 1] = STOP, False, STOP
    place = before[:-1] + np.repeat(begin - before[at[:-1]], np.diff(at))
    inner = np.cumsum(size) - size
    byte = np.arange(int(size.sum()))
    stream[byte + np.repeat(place - inner, size)] = data[byte + np.repeat(start - inner, size)]
    wide = stream.astype(np.uint64)
    keys = wide[DEPTH:].copy()
    for j in range(1, DEPTH + 1):
        keys |= wide[DEPTH - j : len(wide) - j] << np.uint64(8 * (DEPTH + 1 - j))
    return keys[real[DEPTH:]], np.concatenate([[0], np.cumsum(length)])


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _count_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(held[0][0]), pa.array(held[0][1])], ["key", "n"])

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        learned = batch.column("learned").to_numpy(zero_copy_only=False).astype(np.uint64)
        for a, b in slices(offsets, SLICE):
            keys, bounds = event_keys(*words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            marked = np.sort(keys << np.uint64(1) | np.repeat(learned[a:b], np.diff(bounds)))  # learned or not is the last bit
            first = np.flatnonzero(np.append(True, marked[1:] != marked[:-1]))
            held.append((marked[first] >> np.uint64(1), np.diff(np.append(first, len(marked))) * (marked[first] & np.uint64(1)).astype(np.int64)))
            if sum(len(x[0]) for x in held) > 2 * EVENTS_COUNTED:
                held = [_merged(held)]
                if len(held[0][0]) > EVENTS_COUNTED:
                    yield out()
                    held = []
    if held:
        held = [_merged(held)]
        yield out()


def count_events(docs: DataFrame) -> DataFrame:
    """key, n: every event of docs(text, learned) with its count in learned texts, 0 for those only in others."""
    return map_arrow(docs.select("text", "learned"), _count_events, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


_tables = np.cumsum(np.log(np.arange(4096) + 0.5)), np.cumsum(np.log(np.arange(1, 8193)))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""

    def rising(x: np.ndarray, small: np.ndarray, shift: float) -> np.ndarray:  # log of shift (shift + 1) ... , x factors
        z = x + shift
        big = (z - 0.5) * np.log(np.maximum(z, 1)) - z + 1 / (12 * np.maximum(z, 1)) + 0.5 * np.log(2 * np.pi) - (0.5 * np.log(np.pi) if shift == 0.5 else 0)
        at = np.minimum(x, len(small)).astype(np.int64)
        return np.where(x <= 0, 0.0, np.where(x <= len(small), small[at - 1], big))

    return rising(a, _tables[0], 0.5) + rising(b, _tables[0], 0.5) - rising(a + b, _tables[1], 1.0)


def _share(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


class Tree:
    """The nodes of SPLIT to DEPTH context bytes of some events, depth by depth and bit by bit."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, n = keys, n.astype(float)
        self.nodes: dict[tuple[int, int], tuple] = {}  # first event, zeros, ones; and each event's node
        for d in range(SPLIT, DEPTH + 1):
            own = keys >> np.uint64(8 * (DEPTH + 1 - d)) << np.uint64(8) | keys & np.uint64(255)
            order = np.argsort(own, kind="stable")
            own, m = own[order], n[order]
            for j in range(8):
                path = own >> np.uint64(8 - j)
                first = np.append(True, path[1:] != path[:-1])
                at, back = np.flatnonzero(first), np.empty(len(own), np.int32)
                back[order] = np.cumsum(first) - 1
                ones = np.add.reduceat(m * (own >> np.uint64(7 - j) & np.uint64(1)), at)
                self.nodes[d, j] = order[at], np.add.reduceat(m, at) - ones, ones, back
        self.weighted: dict[tuple[int, int], np.ndarray] = {}
        self.odds: dict[tuple[int, int], np.ndarray] = {}  # of a node's own estimate against its children's
        for j in range(8):
            for d in range(DEPTH, SPLIT - 1, -1):
                _, a, b, back = self.nodes[d, j]
                own = log_kt(a, b)
                if d == DEPTH:
                    self.weighted[d, j] = own
                    continue
                kids = np.bincount(back[self.nodes[d + 1, j][0]], self.weighted[d + 1, j], len(a))
                self.odds[d, j] = own - kids
                self.weighted[d, j] = np.logaddexp(own, kids) - np.log(2)

    def _names(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Context and number (1 before the first bit, then the bits so far) of the nodes of SPLIT bytes."""
        some = self.keys[self.nodes[SPLIT, j][0]]
        return (some >> np.uint64(8 * (DEPTH + 1 - SPLIT))).astype(np.int64), ((some & np.uint64(255)) >> np.uint64(8 - j) | np.uint64(1 << j)).astype(np.int64)

    def top(self) -> pa.Table:
        parts = [(*self._names(j), *self.nodes[SPLIT, j][1:3], self.weighted[SPLIT, j]) for j in range(8)]
        return pa.table({name: pa.array(np.concatenate(x)) for name, x in zip(("ctx", "node", "a", "b", "w"), zip(*parts, strict=True), strict=True)})

    def scores(self, above: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """log10 of each event's probability.

        above: sorted ctx * 256 + node of the nodes of SPLIT bytes; mixed: for each, what the shorter contexts say
        of a zero and of a one, with their weights, and the weight that is left for it and those below. A context or
        decision that was never learned says what the one above it says.
        """
        total = np.zeros(len(self.keys))
        for j in range(8):
            one = (self.keys >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
            ctx, node = self._names(j)
            zero, ones, left = mixed[:, np.searchsorted(above, ctx << 8 | node)][:, self.nodes[SPLIT, j][3]]
            p = np.where(one, ones, zero)
            for d in range(SPLIT, DEPTH + 1):
                _, a, b, back = self.nodes[d, j]
                n = a + b
                said = np.where(one, ((b + 0.5) / (n + 1))[back], ((a + 0.5) / (n + 1))[back])
                share = np.ones(len(one))
                if d < DEPTH:
                    _, c, e, below = self.nodes[d + 1, j]
                    share = np.where((c + e)[below] > 0, _share(self.odds[d, j])[back], 1.0)
                p += left * share * said
                left = left * (1 - share)
            total += np.log10(p)
        return total


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted logarithm and the own estimate's share, of nodes with zeros, ones and their children's logarithm."""
    for batch in batches:
        own, kids = log_kt(batch.column("a").to_numpy(), batch.column("b").to_numpy()), batch.column("kids").to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.logaddexp(own, kids) - np.log(2)), pa.array(_share(own - kids))], ["ctx", "node", "a", "b", "w", "share"])


def _mixed_above(tops: DataFrame) -> DataFrame:
    """ctx, node, zero, one, left of the nodes of SPLIT bytes: the shorter contexts' part of the mixture.

    Levels are aggregated upwards and joined downwards; each has fewer nodes than the one below.
    """
    levels = [tops]
    for _ in range(SPLIT):
        up = levels[-1].groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("kids"))
        levels.append(written(map_arrow(up, _estimated, "ctx long, node long, a double, b double, w double, share double"), "tree-level"))
    above = levels[SPLIT].select("ctx", "node", "a", "b", "share", F.lit(0.0).alias("zero"), F.lit(0.0).alias("one"), F.lit(1.0).alias("left"))
    for d in range(1, SPLIT + 1):
        kid = levels[SPLIT - d].select("ctx", "node", "a", "b", F.lit(1.0).alias("share") if d == SPLIT else "share", F.shiftright("ctx", 8).alias("up"))
        more = above.select(F.col("ctx").alias("up"), "node", (F.col("a") + F.col("b")).alias("n"), F.col("a").alias("za"), F.col("b").alias("zb"), F.col("share").alias("s"), "zero", "one", "left")
        s = F.when(F.col("a") + F.col("b") > 0, F.col("s")).otherwise(1.0)
        said = lambda c, had: F.col(had) + F.col("left") * s * (F.col(c) + 0.5) / (F.col("n") + 1)
        above = kid.join(more, ["up", "node"]).select("ctx", "node", "a", "b", "share", said("za", "zero").alias("zero"), said("zb", "one").alias("one"), (F.col("left") * (1 - s)).alias("left"))
    return above.select("ctx", "node", "zero", "one", "left")


def score_events(events: DataFrame) -> DataFrame:
    """key, n, logp of the written events key, n. A task holds a bucket's trees, some BUCKET events and more."""
    buckets = max(1, -(-events.count() // BUCKET))
    in_bucket = lambda ctx: F.pmod(F.xxhash64(ctx), F.lit(buckets)).cast("int").alias("bucket")
    marked = events.select(in_bucket(F.shiftrightunsigned("key", 8 * (DEPTH + 1 - SPLIT))), "key", "n")

    def arrays(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = group.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], group.column("n").to_numpy()[order]

    def tops(group: pa.Table) -> pa.Table:
        return Tree(*arrays(group)).top()

    def scored(group: pa.Table, above: pa.Table) -> pa.Table:
        keys, n = arrays(group)
        name = above.column("ctx").to_numpy() << 8 | above.column("node").to_numpy()
        order = np.argsort(name)
        mixed = np.stack([above.column(c).to_numpy()[order] for c in ("zero", "one", "left")])
        logp = Tree(keys, n).scores(name[order], mixed) if len(keys) else np.zeros(0)
        return pa.table({"key": _signed(keys), "n": pa.array(n), "logp": pa.array(logp)})

    ship(events.sparkSession)
    above = _mixed_above(written(marked.groupBy("bucket").applyInArrow(tops, "ctx long, node long, a double, b double, w double"), "tree-tops"))
    above = above.select(in_bucket(F.col("ctx")), "*")
    return marked.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(scored, "key long, n long, logp double")


def _frequent(rows: DataFrame, most: int) -> int:
    """The least count n such that no more than ``most`` rows have it or a greater one."""
    steps = rows.groupBy(F.floor(F.log2(F.col("n") + 1) * 16).alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).sort(F.desc("step")).collect()  # at most 16 for each doubling
    total, least = 0, (1 << 62)
    for r in steps:
        total += r["rows"]
        if total > most:
            break
        least = r["n"]
    return least


def _packed(keys: np.ndarray, values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Distinct keys in order, as compressed planes of their differences' bytes, and their values."""
    order = np.argsort(keys)
    gaps = np.diff(keys[order].view(np.uint64), prepend=np.uint64(0))
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1), values[order]


_built: dict[str, tuple[Table, np.ndarray, Table]] = {}


def _unpacked(held) -> tuple[Table, np.ndarray, Table]:
    """Places of types, their counts, and the logarithms of events; made once in a worker."""
    name, *parts = held.value
    if name not in _built:
        _built.clear()
        keys = [np.cumsum(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()).view(np.int64) for x, _ in parts]
        types, events = Table(kind=np.int32, width=1), Table(kind=np.float64, width=1)
        types.add(keys[0], np.arange(len(keys[0]), dtype=np.int32)[:, None])
        events.add(keys[1], parts[1][1][:, None])
        _built[name] = types, parts[0][1].astype(np.float64), events
    return _built[name]


def score_texts(docs: DataFrame, learned: Column) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows where ``learned``. Words are runs of characters other than blank and tab to
    carriage return, A-Z in lower case; the end of a text is one more token. A null text is empty: one token. With
    no rows learned, all is unknown, and every decision has probability one half. Texts of any length are scored
    whole. Repeated rows get equal results; an empty table gives no rows. Types are told apart by 63-bit hashes of
    their bytes, events by their bytes.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(learned, F.lit(False)).alias("learned"))
    types = written(count_types(rows), "types")
    ends = rows.where("learned").count()
    totals = types.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, v = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    since = made()
    events = written(count_events(rows), "events")
    tidy(spark)
    scored = written(score_events(events), "event-scores")
    forget(since, but=1)
    tidy(spark)
    # executors keep what is broadcast in files: it goes packed, and each worker builds its tables once
    known = types.where(F.col("n") >= _frequent(types, TYPES_HELD)).toArrow()
    least = _frequent(scored, EVENTS_HELD)
    likely = scored.where(F.col("n") >= least).select("key", "logp").toArrow()
    held = broadcast(spark, (uuid.uuid4().hex, *[_packed(x.column(c).to_numpy(), x.column(v).to_numpy()) for x, c, v in ((known, "h", "n"), (likely, "key", "logp"))]))
    del known, likely
    release()
    floor = float(np.log10(n + v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, counts, events = _unpacked(held)
        base, seen = np.append(np.log10(counts + 1.0) - floor, 0.0), np.append(counts > 0, False).astype(np.int64)  # the last: not held
        uid = int.from_bytes(os.urandom(7), "little")  # rows of one attempt; only one attempt's are kept
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, SLICE):
                own, start, end, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes = span_hash(own, start, end) >> np.uint64(1)
                place = types.find(hashes.view(np.int64))
                place = np.where(place >= 0, types.values[place, 0], -1)
                keys, bounds = event_keys(own, start, end, at)
                keys = keys.view(np.int64)
                slot = events.find(keys)
                logp = np.where(slot >= 0, events.values[slot, 0], 0.0)
                ids, m = np.arange(uid, uid + b - a), b - a
                uid += m
                nil = lambda kind, size: pa.nulls(size, kind)
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id")[a:b], pa.array(np.diff(at) + 1), pa.array(sums(seen[place], at) + (ends > 0)), pa.array(sums(base[place], at) + np.log10(ends + 1.0) - floor), pa.array(sums(logp, bounds)), nil(pa.int64(), m), nil(pa.int64(), m)], names)
                for column, missing, owner in (("h", hashes[place < 0].view(np.int64), np.repeat(ids, np.diff(at))[place < 0]), ("key", keys[slot < 0], np.repeat(ids, np.diff(bounds))[slot < 0])):
                    if m := len(missing):
                        rest = {"h": nil(pa.int64(), m), "key": nil(pa.int64(), m), column: pa.array(missing)}
                        yield pa.RecordBatch.from_arrays([pa.array(owner), nil(batch.column("doc_id").type, m), nil(pa.int64(), m), nil(pa.int64(), m), nil(pa.float64(), m), nil(pa.float64(), m), rest["h"], rest["key"]], names)

    names = ["uid", "doc_id", "n_tokens", "n_known", "base_score", "score", "h", "key"]
    out = written(map_arrow(rows.select("doc_id", "text"), run, f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, h long, key long"), "text-scores")
    rare = out.where("h is not null").select("uid", "h").join(types, "h").select("uid", (F.col("n") > 0).cast("long").alias("k"), (F.log10(F.col("n") + 1.0) - floor).alias("base"), F.lit(0.0).alias("more"))
    rare = rare.unionByName(out.where("key is not null").select("uid", "key").join(scored.where(F.col("n") < least), "key").select("uid", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("base"), F.col("logp").alias("more")))
    rare = rare.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("k", "base", "more")])
    plus = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return out.where("h is null and key is null").join(rare, "uid", "left").select("doc_id", "n_tokens", plus("n_known", "k"), F.lit(n).cast("long").alias("train_tokens"), plus("base_score", "base"), plus("score", "more"))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 7) == 2


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text of documents."""
    out = score_texts(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id")))
    return out.withColumn("held_out", held_out(F.col("doc_id")))
