"""Jaccard self-join of documents on word shingles: size-aware, heavy and light.

Small sets enumerate the subsets that a partner must share; sets with a common subset are links as they stand.
Large sets are joined through inverted lists over a prefix of their shingles: of two sets with a Jaccard
similarity of t or more, the first (1 - t) * size + r elements in any common order have r in common. So a set
with fewer shared elements than that goes before anything is compared. The order puts frequent shingles (heavy)
last, so that shared passages do not make long lists. The size where one way gives over to the other is that
where its keys begin to cost more. Sets that are equal are one class throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast, Lookup, map_arrow, mix, ship, slices, span_hash, table, utf8, words, written

#: Words of a shingle; similarity in hundredths.
K, PERCENT = 5, 80
#: A subset key costs one row; an inverted-list key costs its row and the candidates that come of it.
LIST_COST = 16
#: Sets that hold a shingle for it to be heavy; heavy shingles at most. Either changes the order, never the result.
HEAVY, MOST_HEAVY = 16, 1_000_000
#: One element in so many of a set must be shared within the prefixes, and each prefix is longer by that.
SHARE = 20
#: Sets in a list whose pairs are enumerated at most; what representatives leave apart of longer lists is compared
#: in blocks of so many sets, over so many shingles at a time, and blocks have about so many shingles at most.
LONG, BLOCK, COLUMNS, ELEMENTS = 32, 1_024, 2_048, 1_000_000
#: Sizes are told apart in bands, each so many times the one before; links lie in one band or in two neighbours,
#: as it is more than 100 / PERCENT.
BAND = 1.3
#: Classes whose keys are broadcast at most (8 MB); more of them are joined by a shuffle.
MOST_BROADCAST = 1_000_000
_WEIGHTS = mix(np.arange(11, 11 + K, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; of one with fewer than K words, the whole sequence."""
    data, start, end, at = words(data, offsets)
    one = span_hash(data, start, end)
    many = np.zeros(max(0, len(one) - K + 1), np.uint64)
    for j in range(K):
        many += one[j : j + len(many)] * _WEIGHTS[j]
    many = mix(many)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= K:
            out.append(np.unique(many[a : b - K + 1]))
        else:
            out.append(mix((one[a:b] * _WEIGHTS[: b - a]).sum(keepdims=True) + np.uint64(b - a)) if b > a else one[:0])
    return out


def set_key(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def overlap(s: int, t: int) -> int:
    """The least intersection of linked sets of sizes s and t: 100 i >= PERCENT (s + t - i)."""
    return -(-PERCENT * (s + t) // (100 + PERCENT))


def partners(s: int) -> range:
    """Sizes that a set linked with one of size s can have."""
    return range(-(-PERCENT * s // 100), 100 * s // PERCENT + 1)


def needed(s: int) -> int:
    """Elements that the prefix of a set of size s must share with a partner's, unless the partner needs fewer."""
    return max(1, s // SHARE)


def prefix(s: int) -> int:
    return s - -(-PERCENT * s // 100) + needed(s)


def boundary() -> int:
    """The largest size up to which subsets cost no more than inverted lists."""
    s = 1
    while sum(comb(s + 1, overlap(s + 1, t)) for t in partners(s + 1) if overlap(s + 1, t) <= min(s + 1, t)) <= LIST_COST * prefix(s + 1):
        s += 1
    return s


def subset_keys(shingles: np.ndarray, most: int) -> np.ndarray:
    """Keys of the subsets of a small set, for each size of a partner of at most ``most``.

    Bit 1 tells that the partner has the same size: then all that share the key are links. Otherwise only sets of
    different sizes are. Bit 0 is set in all.
    """
    s, keys = len(shingles), []
    for t in partners(s):
        n = overlap(s, t)
        if t <= most and n <= min(s, t):
            for chosen in combinations(range(s), n):
                key = int(mix(mix(shingles[list(chosen)]).sum(keepdims=True) + np.uint64(min(s, t) * 1009 + max(s, t)))[0])
                keys.append(key & ~3 | 2 * (s == t) | 1)
    return np.array(keys, np.uint64)


def _each(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[tuple[pa.RecordBatch, list, list[np.ndarray]]]:
    """Slices of documents with their sets; with ``once``, sets seen lately in this task are skipped."""
    seen: set[int] = set()
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            keys = [set_key(x) if len(x) else None for x in sets]
            if once:
                new = [k for k, x in enumerate(keys) if x is not None and x not in seen and not seen.add(x)]
                keys, sets = [keys[k] for k in new], [sets[k] for k in new]
                if len(seen) > 300_000:
                    seen.clear()
            yield batch.slice(a, b - a), keys, sets


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, keys, sets in _each(batches, once=False):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n_shingles", "class"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several sets of some megabytes of text have, with the number of them."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        each, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(each[counts > 1]), pa.array(counts[counts > 1].astype(np.int64))], ["h", "n"])

    for _, _, sets in _each(batches, once=True):
        held += sets
        n += sum(map(len, sets))
        if n > 4_000_000:
            yield out()
            held, n = [], 0
    yield out()


def find_heavy(docs: DataFrame) -> np.ndarray:
    """Frequent shingles, the most frequent MOST_HEAVY. Found by chance repetition within a task's share of the
    rows, which a shingle in many sets cannot escape; any choice gives the same links."""
    counts = map_arrow(docs.select("text"), _frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY)
    return np.sort(counts.orderBy(F.desc("n"), "h").limit(MOST_HEAVY).select("h").toArrow().column("h").to_numpy().view(np.uint64))


def postings(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """Rows key, class: the keys of every set. Subset keys are odd, keys of inverted lists even."""
    sent = broadcast(docs.sparkSession, heavy)
    most, even = boundary(), np.uint64(0xFFFFFFFFFFFFFFFE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = Lookup(sent.value)
        for _, keys, sets in _each(batches, once=True):
            if not sets:
                continue
            late = np.split(often.find(np.concatenate(sets)) >= 0, np.cumsum([len(x) for x in sets])[:-1])
            found, owners = [], []
            for key, x, last in zip(keys, sets, late, strict=True):
                if len(x) <= most:
                    found.append(subset_keys(x, most))
                    owners.append(np.full(len(found[-1]), key, np.int64))
                if 100 * len(x) >= PERCENT * most:  # it may have a partner beyond the boundary
                    found.append(np.unique(np.concatenate([x[~last], x[last]])[: prefix(len(x))] & even))
                    owners.append(np.full(len(found[-1]), key, np.int64))
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), pa.array(np.concatenate(owners))], ["key", "class"])

    return map_arrow(docs.select("text"), run, "key long, class long")


def arrays(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, shingles of the classes given, one row each."""
    few = classes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    wanted = broadcast(docs.sparkSession, classes.toArrow().column(0).to_numpy().view(np.uint64)) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(wanted.value) if few else None
        for _, keys, sets in _each(batches, once=True):
            keep = np.flatnonzero(known.find(np.array(keys, np.int64).view(np.uint64)) >= 0) if few else range(len(keys))
            chosen = [sets[k] for k in keep]
            bounds = np.cumsum([0, *map(len, chosen)]).astype(np.int32)
            flat = _signed(np.concatenate([np.zeros(0, np.uint64), *chosen]))
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in keep], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), flat)], ["class", "shingles"])

    found = map_arrow(docs.select("text"), run, "class long, shingles array<long>")
    return (found if few else found.join(classes, "class", "left_semi")).dropDuplicates(["class"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the written, distinct pairs a, b that are links. A set that is b of many pairs is sent out once for
    every BLOCK of them."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    left = sets.toDF("a", "x")
    right = sets.toDF("b", "y").join(parts, "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    both = F.size(F.array_intersect("x", "y"))
    return dealt.join(left, "a").join(right, ["b", "part"]).where(100 * both >= PERCENT * (F.size("x") + F.size("y") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that the written edges a, b lead to. Labels fall and jump until none changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.toDF("b", "other"), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        lower = labels.join(near, "node").select("node", F.least("root", "other").alias("root"), (F.col("other") < F.col("root")).alias("moved"))
        up = labels.toDF("root", "top")
        new = written(lower.join(up, "root", "left").select("node", F.least("root", "top").alias("root"), (F.col("moved") | F.coalesce(F.col("top") < F.col("root"), F.lit(False))).alias("moved")), "labels")
        labels = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return labels


def _subset_links(subsets: DataFrame) -> DataFrame:
    """a, b: a few links of each subset key that join all that it links."""
    ends = written(subsets.groupBy("key").agg(F.min(F.struct("size", "class")).alias("lo"), F.min(F.struct((-F.col("size")).alias("minus"), "class")).alias("hi")), "subset-ends")
    x = subsets.join(ends, "key")
    other = F.when(F.col("key").bitwiseAND(F.lit(2)) == 2, F.col("lo.class")).when(F.col("size") == F.col("lo.size"), F.col("hi.class")).otherwise(F.col("lo.class"))
    fit = (F.col("key").bitwiseAND(F.lit(2)) == 2) | (F.col("lo.size") != -F.col("hi.minus"))
    return x.where(fit).select(F.col("class").alias("a"), other.alias("b")).where("a <> b").distinct()


def link_classes(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """class, root for every class that has a link; ``sizes``: class, size. No pair that can be a link goes unseen."""
    keys = postings(docs, find_heavy(docs))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    lists = written(keys.join(shared, "key", "left_semi").distinct(), "lists")
    subsets, lists = lists.where("key & 1 = 1"), lists.where("key & 1 = 0")
    need = lambda size: F.greatest(F.lit(1), F.floor(size / SHARE))
    least = F.ceil(F.col("size") * PERCENT / 100)  # of a partner, which may need fewer
    for _ in range(2):  # a set with too few shared keys has no partner; without it, others have fewer
        kept = lists.groupBy("class").agg(F.count("*").alias("n")).join(sizes, "class").where(F.col("n") >= need(least)).select("class", "size")
        alive = lists.select("key", "class").join(kept, "class")
        lists = written(alive.join(alive.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi"), "lists")
    held = written(arrays(docs, written(lists.select("class").distinct(), "involved")), "sets")
    links = _subset_links(subsets.join(sizes, "class")).select("a", "b")
    counted = written(lists.join(lists.groupBy("key").agg(F.count("*").alias("n")), "key"), "counted-lists")
    # short lists: all pairs, of which those with enough keys in common are compared
    short = counted.where(F.col("n") <= LONG).select("key", "class", "size")
    close = 100 * F.least("s", "t") >= PERCENT * F.greatest("s", "t")
    pairs = short.toDF("key", "a", "s").join(short.toDF("key", "b", "t"), "key").where((F.col("a") < F.col("b")) & close).groupBy("a", "b", F.least("s", "t").alias("size")).agg(F.count("*").alias("n"))
    pairs = pairs.where(F.col("n") >= need(F.col("size"))).select("a", "b")
    # long lists, once for the sizes of every two neighbouring bands: each member with a representative
    band = F.floor(F.log(BAND, F.col("size"))).cast("int")
    long = counted.where(F.col("n") > LONG).select("key", "class", "size", F.explode(F.array(band, band - 1)).alias("band"))
    heads = long.groupBy("key", "band").agg(F.min(F.struct(F.xxhash64("class").alias("order"), F.col("class").alias("b"), F.col("size").alias("t"))).alias("head")).select("key", "band", "head.b", "head.t")
    stars = long.select("key", "band", F.col("class").alias("a"), F.col("size").alias("s")).join(heads, ["key", "band"]).where((F.col("a") != F.col("b")) & close).select("a", "b")
    links = written(links.union(verify(written(pairs.union(stars).distinct(), "pairs"), held)), "links")
    roots = components(links)
    apart = written(_apart(long, roots), "apart")
    if not apart.limit(1).count():
        return roots.toDF("class", "root")
    return components(written(roots.toDF("a", "b").union(_crowds(apart, held)), "links")).toDF("class", "root")


def _apart(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of those lists (key, band) whose sets are not all joined yet, with the root of each."""
    named = lists.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    several = named.groupBy("key", "band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return named.join(several.select("key", "band"), ["key", "band"], "left_semi")


def _blocks(apart: DataFrame) -> DataFrame:
    """class, crowd, i, j: a set and two blocks of its crowd that are to be compared, of which it is in one.

    A crowd is what lists lead to. Its largest group of joined sets is the main one, in blocks of its own: two of
    those are never compared, nor are blocks of sizes that no link has.
    """
    first = apart.groupBy("key", "band").agg(F.min("class").alias("b"))
    crowd = components(written(apart.join(first, ["key", "band"]).select(F.col("class").alias("a"), "b").distinct(), "crowd-edges")).toDF("class", "crowd")
    sets = written(apart.select("class", "size", "root").distinct().join(crowd, "class"), "crowd-sets")
    main = sets.groupBy("crowd", "root").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max(F.struct("n", "root")).alias("most")).select("crowd", F.col("most.root").alias("main"))
    sets = sets.join(main, "crowd").select("crowd", "class", "size", F.floor(F.log(BAND, F.col("size"))).cast("int").alias("band"), (F.col("root") != F.col("main")).alias("rest"))
    count = sets.groupBy("crowd", "band", "rest").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / ELEMENTS)).cast("int").alias("blocks"))
    block = F.struct("band", "rest", "block")
    units = written(count.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("crowd", "band", "rest", block.alias("unit")), "crowd-blocks")
    above = units.select("crowd", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("rest").alias("also"), F.col("unit").alias("j"))
    met = units.withColumnRenamed("unit", "i").join(above, ["crowd", "band"]).where((F.col("rest") | F.col("also")) & (F.col("i") <= F.col("j")))
    met = met.select("crowd", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("unit"))
    placed = sets.join(count, ["crowd", "band", "rest"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    return placed.select("crowd", "class", block.alias("unit")).join(met, ["crowd", "unit"]).select("class", "crowd", "i", "j")


def _crowds(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that join what is still apart, each pair of blocks in a task that counts overlaps over its inverted
    lists and gives a forest of its links alone."""
    placed = written(_blocks(apart), "crowds")

    def run(group: pa.Table) -> pa.Table:
        shingles = group.column("shingles").combine_chunks()
        n, classes = len(shingles), group.column("class").to_numpy()
        sizes = pa.compute.list_value_length(shingles).to_numpy().astype(np.float32)
        _, at, counts = np.unique(shingles.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes.astype(np.int64))
        keep = counts[at] > 1
        at, owner = (np.cumsum(counts > 1) - 1)[at[keep]], owner[keep]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        both = np.zeros((n, n), np.float32)
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
            a, b = np.searchsorted(at, (lo, lo + COLUMNS))
            m = np.zeros((n, COLUMNS), np.float32)
            m[owner[a:b], at[a:b] - lo] = 1
            both += m @ m.T
        linked = 100 * both >= PERCENT * (sizes[:, None] + sizes[None] - both)
        ends: list[tuple[int, int]] = []
        left = np.ones(n, bool)
        for k in range(n):
            stack = [k] if left[k] else []
            left[k] = False
            while stack:
                u = stack.pop()
                new = np.flatnonzero(linked[u] & left)
                left[new] = False
                stack += new.tolist()
                ends += [(u, v) for v in new.tolist()]
        e = np.array(ends, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(classes[e[:, 0]], pa.int64()), "b": pa.array(classes[e[:, 1]], pa.int64())})

    ship(sets.sparkSession)
    return placed.join(sets, "class").groupBy("crowd", "i", "j").applyInArrow(run, "a long, b long")


def join_similar(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_shingles, component_id.

    Words are runs of characters other than blank and tab to carriage return, A-Z in lower case; shingles are of
    five. Documents link at a Jaccard similarity of 0.8 or more. component_id is the smallest doc_id that links
    lead to; null ids are passed over, unless all are null. A text without words, a null one too, has no shingles
    and links with nothing: its own id stands. Repeated rows get equal results; an empty table gives no rows. Sets
    are told apart by 64-bit keys.
    """
    members = written(map_arrow(docs.select("doc_id", "text"), _members, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, class long"), "members")
    first = members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("size"))
    roots = link_classes(docs, first.select("class", "size"))
    named = first.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = written(named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("class", "component_id"), "named")
    known = members.where("class is not null").join(named, "class").select("doc_id", "n_shingles", "component_id")
    return known.unionByName(members.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op7_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every whole document."""
    return join_similar(table(spark, sf_dir, "documents"))
