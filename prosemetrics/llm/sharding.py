"""Sharding by a k-d tree over document metadata.

A node is split at the distributed weighted median of its widest dimension, weighted by bytes, until each leaf
has one shard's share. The medians come from histograms: each round is one aggregation over the compact
metadata table, whose result is at most nodes x BINS rows, and narrows the cut to one bin, until that bin holds
one value. Where the rows of the value at the cut are to be divided, a hash of the text divides them: equal texts
have equal coordinates and stay together, unless they are more than a shard holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Bins of one histogram.
BINS = 2048
#: Parts of a shard that a group of equal texts larger than a shard is divided into.
PARTS = 32
#: Groups of equal texts that are broadcast at most (some 40 MB); more of them are joined by a shuffle.
MOST_BROADCAST = 500_000


@dataclass
class Node:
    """A box of the tree. ``cut`` has (dimension, value) pairs: rows below it in that lexicographic order go left."""

    first: int
    shards: int
    box: list[tuple[int, int]] = field(default_factory=list)
    weight: int = 0
    cut: list[tuple[str, int]] = field(default_factory=list)
    kids: list[Node] = field(default_factory=list)


def _left(cut: list[tuple[str, int]]) -> Column:
    (dim, value), rest = cut[0], cut[1:]
    below = F.col(dim) < F.lit(value)
    return below | ((F.col(dim) == F.lit(value)) & _left(rest)) if rest else below


def leaf(node: Node) -> Column:
    """The first shard of the leaf that a row falls in."""
    return F.when(_left(node.cut), leaf(node.kids[0])).otherwise(leaf(node.kids[1])) if node.kids else F.lit(node.first)


def kd_tree(rows: DataFrame, dims: list[str], tie: str, weight: str, shards: int) -> Node:
    """The tree over ``rows``. All of ``dims`` and ``tie`` are non-null longs; ``tie`` orders the rows of one value."""
    every = [*dims, tie]

    def boxes(by: Column) -> dict:
        ends = [f(d).alias(f"{n}_{d}") for d in every for n, f in (("lo", F.min), ("hi", F.max))]
        return {r["node"]: ([(r[f"lo_{d}"], r[f"hi_{d}"]) for d in every], r["w"]) for r in rows.groupBy(by.alias("node")).agg(*ends, F.sum(weight).alias("w")).collect()}

    root = Node(0, shards)
    root.box, root.weight = boxes(F.lit(0)).get(0, ([(0, 0)] * len(every), 0))
    spread = [max(1, hi - lo) for lo, hi in root.box[: len(dims)]]
    level = [root]
    while level := [n for n in level if n.shards > 1 and n.weight]:
        order = {}
        for n in level:
            wide = [(hi - lo) / s for (lo, hi), s in zip(n.box, spread, strict=False)]
            order[n.first] = [dims[max(range(len(dims)), key=lambda i: (wide[i], -i))], tie]
        _cut(rows.withColumn("node", leaf(root)), every, order, weight, level)
        for n in level:
            half = n.shards // 2
            n.kids = [Node(n.first, half), Node(n.first + half, n.shards - half)]
        found = boxes(leaf(root))
        level = [k for n in level for k in n.kids]
        for k in level:
            k.box, k.weight = found.get(k.first, ([(0, 0)] * len(every), 0))
    return root


def _cut(marked: DataFrame, every: list[str], order: dict[int, list[str]], weight: str, level: list[Node]) -> None:
    share = {n.first: n.weight * (n.shards // 2) / n.shards for n in level}
    box = {n.first: dict(zip(every, n.box, strict=False)) for n in level}
    node = {n.first: n for n in level}
    span, below = {k: (box[k][order[k][0]][0], box[k][order[k][0]][1] + 1) for k in node}, dict.fromkeys(node, 0)
    open_ = set(node)
    while open_:
        value, low, step = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")
        for k in sorted(open_):
            (lo, hi), dim = span[k], F.col(order[k][len(node[k].cut)])
            mine, inside = F.col("node") == k, (dim >= lo) & (dim < hi)
            for d, v in node[k].cut:
                inside &= F.col(d) == F.lit(v)
            value = F.when(mine & inside, dim).otherwise(value)
            low, step = F.when(mine, F.lit(lo)).otherwise(low), F.when(mine, F.lit(-(-(hi - lo) // BINS))).otherwise(step)
        binned = marked.select("node", F.col(weight).alias("w"), value.alias("v"), low.alias("lo"), step.alias("step")).where("v is not null")
        found: dict[int, list] = {}
        for r in binned.groupBy("node", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("w").alias("w")).collect():
            found.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for k in list(open_):
            (lo, hi), at, dims = span[k], below[k], order[k]
            step = -(-(hi - lo) // BINS)
            for b, w in sorted(found[k]):
                if at + w > share[k]:
                    break
                at += w
            else:
                at -= w
            below[k] = at
            if step > 1:
                span[k] = (lo + b * step, min(hi, lo + (b + 1) * step))
                continue
            before, after = share[k] - at, at + w - share[k]
            if min(before, after) > 0 and len(node[k].cut) + 1 < len(dims):
                node[k].cut.append((dims[len(node[k].cut)], lo + b))
                span[k] = (box[k][dims[len(node[k].cut)]][0], box[k][dims[len(node[k].cut)]][1] + 1)
            else:
                node[k].cut.append((dims[len(node[k].cut)], lo + b + (after < before)))
                open_.discard(k)


def coordinates(docs: DataFrame, shards: int, by: list[str]) -> DataFrame:
    """doc_id, size, text_crc32, uid, the dimensions of the tree, and tie, as a written table.

    Dimensions: the columns ``by`` (as hashes of BINS values, which need no order) and the number of characters on a
    logarithmic scale. A group of equal texts takes the least values of its members. Groups are known by 96 bits.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(BINS)).alias(f"by_{c}")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"), F.monotonically_increasing_id().alias("uid"), *[code(c) for c in by], (F.log2(F.length(text) + 1) * 64).cast("long").alias("scale"))
    rows = written(rows, "kd-rows")
    share = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    group = ["same", "text_crc32"]
    groups = rows.groupBy(*group).agg(F.sum("size").alias("total"), F.count("*").alias("copies"), *[F.min(f"by_{c}").alias(f"least_{c}") for c in by]).where("copies > 1").drop("copies")
    groups = written(groups, "kd-groups")
    few = groups.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = rows.join(F.broadcast(groups) if few else groups, group, "left")
    parts = F.when(F.col("total") > share, F.ceil(F.col("total") / max(1.0, share) * PARTS)).otherwise(1)
    part = F.pmod(F.xxhash64("uid"), F.coalesce(parts, F.lit(1)))
    tie = F.pmod(F.xxhash64(*group, part), F.lit(BINS * BINS)).alias("tie")
    return written(rows.select("doc_id", "size", "text_crc32", "uid", *[F.coalesce(f"least_{c}", f"by_{c}").alias(f"by_{c}") for c in by], "scale", tie), "kd-metadata")


def shard_documents(docs: DataFrame, shards: int = 40, by: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` in shards of nearly equal bytes, by a k-d tree over metadata.

    Dimensions are the columns ``by`` (lang and source, where there are such) and the number of characters. Equal
    texts share a shard, unless together they are larger than one. Returns doc_id, size (UTF-8 bytes plus 16),
    text_crc32, shard and slot, gapless from 0 in each shard.

    Every row counts, repeated ones and those with a null doc_id too. A null text counts as empty: size 16. A null
    in ``by`` is a value like others. A text of any length lies in one shard, which is larger if it is. An empty
    table gives no rows, and fewer groups than shards leave some shards empty. Other columns are not read.
    """
    by = [c for c in ("lang", "source") if c in docs.columns] if by is None else by
    rows = coordinates(docs, shards, by)
    tree = kd_tree(rows, [*[f"by_{c}" for c in by], "scale"], "tie", "size", shards)
    # slots: runs of row numbers are counted first, so that no task holds a whole shard
    placed = rows.withColumns({"shard": leaf(tree).cast("int"), "run": F.shiftright("uid", 14)})
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "run").orderBy("uid")) - 1)
    return inside.join(starts, ["shard", "run"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("k")).cast("long").alias("slot"))


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``bytes``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    out = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
