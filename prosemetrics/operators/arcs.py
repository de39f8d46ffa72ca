"""Progression curves out of chunk embeddings, their archetypes and the validity of clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import centred, cosine, distance, dot, moving_average, resample, standard, total
from ..sources.scratch import stored
from ..sources.shipping import map_arrow, ship
from .ordering import placed, running

#: Books that the Ward merge is computed for at most: their arcs are broadcast, 16 MB with 100 points.
MOST_MERGED = 20_000


def centroid(chunks: DataFrame) -> DataFrame:
    """One row, centroid: the mean of all chunk vectors, so that longer books weigh more."""
    return mean_vectors(chunks, [], "embedding").select(F.col("mean").alias("centroid"))


def mean_vectors(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by..., mean: means component by component, combined before the shuffle."""
    each = rows.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lists = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("l"))  # one entry a dimension
    return lists.select(*by, F.transform("l", lambda s: s["m"]).alias("mean"))


def chunk_distances(chunks: DataFrame, book: str, order: str, centre: DataFrame | None = None) -> DataFrame:
    """book, order, dist: 1 - cosine to the centroid, which is one broadcast row; ``centre``, or that of the chunks."""
    x = chunks.crossJoin(F.broadcast(centroid(chunks) if centre is None else centre))
    return x.select(book, order, (1 - cosine(F.transform("embedding", lambda v: v.cast("double")), F.col("centroid"))).alias("dist"))


def arcs(chunks: DataFrame, book: str, order: str, points: int = 100, centre: DataFrame | None = None) -> DataFrame:
    """book, n_chunks, arc: distances in order, smoothed and resampled; books of under two chunks have none."""
    d = chunk_distances(chunks, book, order, centre).groupBy(book).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "dist"))), lambda s: s["dist"]).alias("d"))
    return d.where(F.size("d") >= 2).select(book, F.size("d").cast("long").alias("n_chunks"), resample(moving_average(F.col("d")), points).alias("arc"))


def centred_arcs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("arc", centred(F.col("arc")))


def gram(rows: DataFrame, vector: str = "arc") -> np.ndarray:
    """The points x points matrix of summed products: all that a decomposition of the arcs needs."""
    size = rows.select(F.size(vector).alias("n")).first()
    n = size["n"] if size else 0
    sums = rows.select(F.posexplode(vector).alias("i", "x"), vector).select("i", "x", F.posexplode(vector).alias("j", "y"))
    out = np.zeros((n, n))
    for r in sums.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect():  # points squared
        out[r["i"], r["j"]] = r["s"]
    return out


def modes(rows: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, largest first, and the first m right singular vectors, each with a positive largest entry."""
    values, vectors = np.linalg.eigh(gram(rows))
    order = np.argsort(values)[::-1]
    v = vectors[:, order[:m]].T
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return np.sqrt(np.maximum(0, values[order])), v


def archetypes(rows: DataFrame, book: str, k: int = 6) -> DataFrame:
    """book, weights, cluster, cluster_name: 2 * strongest mode + (negative weight); an odd k is raised to the next even one."""
    x = centred_arcs(rows)
    _, v = modes(x, (k + k % 2) // 2)
    w = F.array(*[dot(F.col("arc"), F.array(*[F.lit(float(a)) for a in mode])) for mode in v])
    x = x.select(book, "arc", w.alias("weights"))
    strongest = F.array_position(F.transform("weights", F.abs), F.array_max(F.transform("weights", F.abs))) - 1
    x = x.withColumn("cluster", (2 * strongest + (F.element_at("weights", (strongest + 1).cast("int")) < 0).cast("int")).cast("int"))
    names = F.array(*[F.lit(name) for place, mode in enumerate(v) for name in mode_labels(mode, place)])
    return x.withColumn("cluster_name", F.get(names, F.col("cluster")))


def cluster_curves(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    each = rows.select(cluster, F.posexplode("arc").alias("point", "x"))
    return each.groupBy(cluster, "point").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def representatives(rows: DataFrame, book: str, cluster: str = "cluster", n: int = 3) -> DataFrame:
    """The n books of each cluster whose standardised arcs lie nearest to its standardised mean."""
    means = mean_vectors(rows, [cluster], "arc")
    near = rows.join(F.broadcast(means), cluster).select(cluster, book, distance(standard(F.col("arc")), standard(F.col("mean"))).alias("dist"))
    return near.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy("dist", book))).where(F.col("place") <= n)


def _spread(rows: DataFrame, cluster: str) -> DataFrame:
    """cluster, n, mean, within (sum of squared distances to it), scatter (mean distance to it)."""
    x = rows.join(F.broadcast(mean_vectors(rows, [cluster], "arc")), cluster).withColumn("gap", distance(F.col("arc"), F.col("mean")))
    moments = x.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(F.col("gap") * F.col("gap")).alias("within"), F.avg("gap").alias("scatter"))
    return moments.join(F.broadcast(mean_vectors(rows, [cluster], "arc")), cluster)


def calinski_harabasz(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    s = _spread(rows, cluster).crossJoin(F.broadcast(mean_vectors(rows, [], "arc").withColumnRenamed("mean", "grand")))
    gap = distance(F.col("mean"), F.col("grand"))
    parts = s.agg(F.sum(F.col("n") * gap * gap).alias("between"), F.sum("within").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return parts.select(F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1)).alias("calinski_harabasz"))


def davies_bouldin(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    s = _spread(rows, cluster)
    a, b = s.select(F.col(cluster).alias("a"), F.col("scatter").alias("sa"), F.col("mean").alias("ma")), s.select(F.col(cluster).alias("b"), F.col("scatter").alias("sb"), F.col("mean").alias("mb"))
    worst = a.join(F.broadcast(b), F.col("a") != F.col("b")).groupBy("a").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), distance(F.col("ma"), F.col("mb")))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


#: Arcs of a block; two blocks make a tile of distances, which is all that a task holds.
TILE = 512


def blocked(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with block, of up to ``size`` rows in the order of the key."""
    x = running(placed(rows, [], [key]), [], [key], {"_place": F.lit(1)})
    return x.select(*rows.columns, F.floor((F.col("_place") - 1) / size).cast("int").alias("block"))


def silhouette(rows: DataFrame, book: str, cluster: str = "cluster") -> DataFrame:
    """The mean silhouette over all pairs: quadratic, as its definition is; a lone member counts 0.

    Blocks of arcs meet in tiles, each pair of blocks once; a tile gives the distances' sums by arc and other cluster.
    """
    x = stored(blocked(rows.where(F.col(cluster).isNotNull()).select(F.col(book).alias("i"), F.col(cluster).alias("c"), F.col("arc").alias("x")), "i", TILE))
    blocks = (x.agg(F.max("block")).first()[0] or 0) + 1
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    meet = x.select("*", other).select("i", "c", "x", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))

    def tile(tables: pa.Table) -> pa.Table:
        block, arc = tables.column("block").to_numpy(), np.array(tables.column("x").to_pylist())
        kinds, kind = np.unique(tables.column("c").to_numpy(zero_copy_only=False), return_inverse=True)
        first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        gaps = np.stack([np.sqrt(((arc[second] - arc[k]) ** 2).sum(1)) for k in first])
        sides = [(first, second, gaps)] + ([(second, first, gaps.T)] if block.min() < block.max() else [])
        out = [(own[k], g, d[k, kind[others] == g].sum(), int((kind[others] == g).sum() - (block.min() == block.max() and kind[own[k]] == g))) for own, others, d in sides for k in range(len(own)) for g in np.unique(kind[others])]
        at, to, total, n = zip(*out, strict=True)
        return pa.table({"i": tables.column("i").take(pa.array(at)), "ci": tables.column("c").take(pa.array(at)), "cj": pa.array(kinds[list(to)], tables.schema.field("c").type), "d": pa.array(total, pa.float64()), "n": pa.array(n, pa.int64())})

    i, c = dict(x.dtypes)["i"], dict(x.dtypes)["c"]
    ship(rows.sparkSession)
    sums = meet.groupBy("a", "b").applyInArrow(tile, f"i {i}, ci {c}, cj {c}, d double, n long")
    means = sums.groupBy("i", "ci", "cj").agg(F.try_divide(F.sum("d"), F.sum("n")).alias("d"))
    each = means.groupBy("i").agg(F.min(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("own"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("other"))
    return each.agg(F.avg(F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0))).alias("silhouette"))


def explained(rows: DataFrame, m: int = 3) -> float:
    s, _ = modes(centred_arcs(rows), m)
    return float((s[:m] ** 2).sum() / max(1e-300, (s**2).sum()))


#: Arcs that one task shuffles and multiplies, and product matrices that one adds up.
BLOCK, TOGETHER = 4_096, 64


def permutation_test(rows: DataFrame, book: str, m: int = 3, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """real, null_mean, p: explained variance against arcs whose points are shuffled, row by row, ``rounds`` times.

    Blocks of arcs, told by a hash of the book, give the product matrix of each round; these add up by round, as a
    decomposition needs no more. Equal arcs are arcs each; a book is to name one row.
    """
    x = stored(centred_arcs(rows).select(book, "arc"))
    blocks = max(1, -(-x.count() // BLOCK))
    real = explained(x, m)

    def products(group: pa.Table) -> pa.Table:
        order = np.argsort(np.array([str(k) for k in group.column(book).to_pylist()]), kind="stable")
        arc = np.array(group.column("arc").to_pylist())[order]
        block = int(group.column("block")[0].as_py())
        grams = []
        for k in range(rounds):
            shuffled = np.random.default_rng([seed, block, k]).permuted(arc, axis=1)
            grams.append((shuffled.T @ shuffled).tobytes())
        return pa.table({"round": pa.array(range(rounds), pa.int64()), "block": pa.array([block] * rounds, pa.int64()), "gram": pa.array(grams, pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g.as_py()) for g in group.column("gram"))
        return pa.table({"round": group.column("round").slice(0, 1), "block": pa.array([group.column("block")[0].as_py() // TOGETHER], pa.int64()), "gram": pa.array([total.tobytes()], pa.binary())})

    def shares(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g.as_py()) for g in group.column("gram"))
        n = int(round(len(total) ** 0.5))
        values = np.sort(np.maximum(0, np.linalg.eigvalsh(total.reshape(n, n))))[::-1]
        return pa.table({"null": pa.array([values[:m].sum() / max(1e-300, values.sum())])})

    marked = x.withColumn("block", F.pmod(F.xxhash64(F.col(book).cast("string")), F.lit(blocks)))
    ship(rows.sparkSession)
    schema = "round long, block long, gram binary"
    grams = marked.groupBy("block").applyInArrow(products, schema)
    while blocks > TOGETHER:  # sums in stages: a group never holds more matrices than that
        grams, blocks = grams.groupBy("round", F.floor(F.col("block") / TOGETHER)).applyInArrow(added, schema), -(-blocks // TOGETHER)
    nulls = grams.groupBy("round").applyInArrow(shares, "null double")
    return nulls.agg(F.lit(real).alias("real"), F.avg("null").alias("null_mean"), ((F.count_if(F.col("null") >= real) + 1) / (F.count("*") + 1)).alias("p"))


def _joined(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, n: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Ward's distance of clusters of n arcs to the union of two, na and nb arcs large and ``gap`` apart."""
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.maximum(0, ((na + n) * a * a + (nb + n) * b * b - n * gap * gap) / (na + nb + n)))


def _nearest(row: np.ndarray) -> tuple[int, float]:
    at = int(np.argmin(row))
    return at, float(row[at])


def _first_distances(rows: DataFrame, arc: np.ndarray, block: int) -> DataFrame:
    """at, row, to, gap: the Euclidean distances between rows of the L1 distance matrix of all arcs, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("id").to_numpy()
            for k in range(0, len(mine), block):
                at = mine[k : k + block]
                own, square = np.stack([np.abs(arc - arc[i]).sum(1) for i in at]), np.empty((len(at), len(arc)))
                for j in range(len(arc)):  # one row of the matrix at a time
                    square[:, j] = ((own - np.abs(arc - arc[j]).sum(1)) ** 2).sum(1)
                square[np.arange(len(at)), at] = np.inf
                for i, row in zip(at.tolist(), np.sqrt(square), strict=True):
                    yield _ward_row(i, row)

    return map_arrow(rows, run, WARD)


WARD = "at int, row binary, to int, gap double"


def _ward_row(at: int, row: np.ndarray) -> pa.RecordBatch:
    to, gap = _nearest(row)
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([row.tobytes()], pa.binary()), pa.array([to], pa.int32()), pa.array([gap], pa.float64())], ["at", "row", "to", "gap"])


def ward_merges(rows: DataFrame, book: str) -> DataFrame:
    """step, left, right, height, size: Ward's merges of the rows of the L1 distance matrix, nearest pair first.

    Clusters that are each other's nearest are merged together, round by round, which gives the tree that merging the
    nearest pair alone would. Each cluster's distances are one row of a table; a round writes the rows of the clusters
    that remain. What reaches the driver is a number and a distance for each arc, and the arcs themselves, once: so
    there is a bound on them, MOST_MERGED, and an error beyond it. Arcs are numbered from 0 in the order of the book.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(book).alias("book"), "arc").limit(MOST_MERGED + 1).toArrow()
    if held.num_rows > MOST_MERGED:
        raise ValueError(f"more than {MOST_MERGED} arcs")
    schema = "step long, left long, right long, height double, size long"
    if held.num_rows < 2:
        return spark.createDataFrame([], schema)
    arc = np.array(held.sort_by("book").column("arc").to_pylist(), float)
    count = len(arc)
    parts = max(1, min(spark.sparkContext.defaultParallelism * 2, count // 16))
    table = stored(_first_distances(spark.range(0, count, 1, parts), arc, 256))
    sizes, names, merges = np.ones(count), np.arange(count), []
    while len(sizes) > 1:
        near = table.select("at", "to", "gap").toArrow()  # no row of distances is read for this
        to, gap = np.empty(len(sizes), np.int64), np.empty(len(sizes))
        to[near.column("at").to_numpy()], gap[near.column("at").to_numpy()] = near.column("to").to_numpy(), near.column("gap").to_numpy()
        at = np.arange(len(sizes))
        left = np.flatnonzero((to[to] == at) & (at < to))
        if not len(left):  # rounding alone can leave none: then the nearest pair
            left = np.array([np.lexsort((at, gap))[0]])
        right = to[left]
        left, right = np.minimum(left, right), np.maximum(left, right)
        heights = gap[left]
        merges += [(h, names[a], names[b], sizes[a] + sizes[b], count + len(merges) + k) for k, (h, a, b) in enumerate(zip(heights, left, right, strict=True))]
        keep = np.setdiff1d(at, right)
        place = np.empty(len(at), np.int64)  # the new place of each cluster
        place[keep] = np.arange(len(keep))
        place[right] = place[left]
        names[left] = count + len(merges) - len(left) + np.arange(len(left))
        before, heads, tails = sizes, left, right
        sizes, names = np.bincount(place, before), names[keep]
        if len(sizes) > 1:
            table = stored(_merged(table, place, before, sizes, heads, tails, heights, keep))
    tall: dict[int, float] = {}
    for h, a, b, _, own in merges:  # no lower than its halves, as rounding may have it
        tall[own] = max(float(h), tall.get(a, 0.0), tall.get(b, 0.0))
    merges.sort(key=lambda m: (tall[m[4]], m[4]))
    label = {m[4]: count + step for step, m in enumerate(merges)}
    out = [(step, int(label.get(a, a)), int(label.get(b, b)), tall[own], int(n)) for step, (_, a, b, n, own) in enumerate(merges)]
    return spark.createDataFrame(out, schema)


def _merged(table: DataFrame, place: np.ndarray, before: np.ndarray, sizes: np.ndarray, heads: np.ndarray, tails: np.ndarray, heights: np.ndarray, keep: np.ndarray) -> DataFrame:
    """The rows of the clusters that a round leaves: columns of merged clusters first, then their two rows."""
    def new_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place[batch.column("at").to_numpy()].astype(np.int32)), batch.column("at"), batch.column("row")], ["place", "at", "row"])

    def columns(row: np.ndarray, n: float) -> np.ndarray:
        row[heads] = _joined(row[heads], row[tails], before[heads], before[tails], n, heights)
        return row[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # place, old place and row of a cluster whose other half may follow
        for batch in batches:
            for p, at, raw in zip(batch.column("place").to_pylist(), batch.column("at").to_pylist(), batch.column("row").to_pylist(), strict=True):
                row = columns(np.frombuffer(raw).copy(), before[at])
                if waiting and waiting[0] == p:
                    k = np.searchsorted(heads, waiting[1])
                    both = _joined(waiting[2], row, before[waiting[1]], before[at], sizes, heights[k])
                    both[p] = np.inf
                    waiting = (p, at, both)
                    continue
                if waiting:
                    yield _ward_row(waiting[0], waiting[2])
                row[p] = np.inf
                waiting = (p, at, row)
        if waiting:
            yield _ward_row(waiting[0], waiting[2])

    named = map_arrow(table.select("at", "row"), new_places, "place int, at int, row binary")
    return map_arrow(named.repartition("place").sortWithinPartitions("place", "at"), run, WARD)


def search(books: DataFrame, book: str, title: str, ids: list[str] = (), titles: list[str] = (), literal: bool = False) -> DataFrame:
    """Rows whose trimmed id is among ``ids`` or whose title matches one of ``titles`` (patterns, or literal), once."""
    found: Column = F.trim(F.col(book).cast("string")).isin(list(ids))
    for t in titles:
        found |= F.coalesce(F.contains(F.lower(title), F.lit(t.lower())) if literal else F.col(title).rlike(f"(?i){t}"), F.lit(False))
    return books.where(found).distinct()


# The archetypes of the first three modes, as their weight is positive or negative.
ARCHETYPES = (("1. Rags to Riches", "2. Riches to Rags"), ("3. Man in a Hole", "4. Icarus"), ("5. Cinderella", "6. Oedipus"))


def mode_labels(mode: np.ndarray, place: int) -> tuple[str, str]:
    """The names of a mode's two clusters: by its rise, by its middle against its ends, by its halves."""
    if place >= len(ARCHETYPES):
        return f"Mode {place + 1} (+)", f"Mode {place + 1} (-)"
    quarter, half = len(mode) // 4, len(mode) // 2
    first = (
        lambda: mode[-1] > mode[0],
        lambda: mode[quarter:-quarter].mean() < (mode[:quarter].mean() + mode[-quarter:].mean()) / 2,
        lambda: mode[:half].mean() > mode[half:].mean(),
    )[place]()
    return ARCHETYPES[place] if first else ARCHETYPES[place][::-1]


def with_metadata(rows: DataFrame, meta: DataFrame, book: str, order: list[str]) -> DataFrame:
    """Every arc, one a book, with its book's first metadata row by ``order``, or nulls."""
    first = Window.partitionBy(book).orderBy(*order)
    one = meta.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
    return rows.dropDuplicates([book]).join(one, book, "left")


def title_or(title: Column, other: Column) -> Column:
    """The title unless it is null, blank or the text of a missing number."""
    return F.when(title.isNull() | F.trim(title).isin("", "nan"), other).otherwise(title)
