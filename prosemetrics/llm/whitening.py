"""Whitening of embeddings by a tiled covariance.

Pairs of dimensions are dealt to tiles. The rows lie in blocks; each block's columns are cut into column blocks, which
are shuffled by row block to the tiles that need them. A tile multiplies its two column blocks, the products are summed
over all row blocks, and the driver assembles one number for each pair of dimensions and decomposes the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written

#: Dimensions on a side of a tile, and rows of a block.
TILE, ROWS = 32, 1_024
#: Bytes of sums that a task holds before it passes them on.
HELD = 32 << 20
#: Whole numbers for each unit of an embedding.
SCALE = 256


def entries(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each component, in double precision; beyond the range of long, the end of that range."""
    return F.transform(embedding.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector is there and finite. x: ``entries``.

    Vectors of another length than the most frequent one (of equally many, the longest) take no part, nor do empty ones.
    """
    fine = F.forall(F.col("embedding").cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.coalesce(fine, F.lit(False)) & (F.size("embedding") > 0))
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (common["d"] if common else 0)).select("vec_id", entries(F.col("embedding")).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """How many rows x of whole numbers there are, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            x = matrix(batch.column("x"))
            if len(x):  # halves: their sums stay within 64 bits for two thousand million rows of a task
                n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high), dtype=np.int32)), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = map_arrow(fit.select("x"), run, "at int, n long, high long, low long").groupBy("at").agg(F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("at").collect()  # a row for each dimension
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def covariance(rows: DataFrame, n: int, centre: np.ndarray, project: np.ndarray | None = None, tile: int = TILE, block: int = ROWS) -> np.ndarray:
    """The covariance, divisor n, of the n ``rows`` x, less ``centre``, and where given times ``project``."""
    dims = len(centre) if project is None else project.shape[1]
    parts = -(-dims // tile)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            x = matrix(batch.column("x"))
            for at in range(0, len(x), block):
                own = x[at : at + block] - centre
                own = own if project is None else own @ project
                columns = [np.ascontiguousarray(own[:, p * tile : (p + 1) * tile]) for p in range(parts)]
                pairs = [(i, j, p) for i in range(parts) for j in range(i, parts) for p in ({i, j})]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(pairs), pa.int64()), *[pa.array(c, pa.int32()) for c in zip(*pairs, strict=True)], pa.array([len(own)] * len(pairs), pa.int32()), pa.array([columns[p].tobytes() for *_, p in pairs], pa.binary())], ["row_block", "i", "j", "part", "n", "data"])
                number += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, left = {}, None

        def out() -> pa.RecordBatch:
            at, values = list(sums), [sums[k].reshape(-1) for k in sums]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), pa.array(np.concatenate(values)))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in at], pa.int32()), pa.array([k[1] for k in at], pa.int32()), lists], ["i", "j", "products"])

        for batch in batches:
            for r in range(batch.num_rows):
                number, i, j, part, n = (batch.column(c)[r].as_py() for c in ("row_block", "i", "j", "part", "n"))
                own = np.frombuffer(batch.column("data")[r].as_py(), np.float64).reshape(n, -1)
                if part == i:
                    left = own
                if part == j:
                    product = left.T @ own
                    sums[i, j] = sums[i, j] + product if (i, j) in sums else product
                    if len(sums) * tile * tile * 8 > HELD:
                        yield out()
                        sums.clear()
        if sums:
            yield out()

    blocks = map_arrow(rows.select("x"), cut, "row_block long, i int, j int, part int, n int, data binary")
    met = blocks.repartition("row_block", "i", "j").sortWithinPartitions("row_block", "i", "j", "part")
    tiles = map_arrow(met, multiply, "i int, j int, products array<double>")
    cells = tiles.select("i", "j", F.posexplode("products").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("v"))
    found, total = cells.toArrow(), np.zeros((dims, dims))  # one row for each pair of dimensions
    i, j, at, v = (found.column(c).to_numpy() for c in ("i", "j", "at", "v"))
    width = np.minimum(dims - j * tile, tile)
    a, b = i * tile + at // np.maximum(1, width), j * tile + at % np.maximum(1, width)
    total[a, b] = v
    total[b, a] = v
    return total / max(1, n)


@dataclass
class Whitening:
    """What ``fit`` found: n and sums of the fit list, all eigenvalues falling, the first components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    error: float | None = None

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def live(self) -> int:
        """Components whose eigenvalue is more than the error of its computation."""
        least = 4 * len(self.values) * np.finfo(float).eps * max(0.0, self.values[0])
        return int((self.values[: self.axes.shape[1]] > least).sum())

    @property
    def project(self) -> np.ndarray:
        return self.axes[:, : self.live] / np.sqrt(self.values[: self.live])


def fit(rows: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of the distinct x of ``rows``; None if there are none.

    Its axes have their largest entry positive. ``error`` is the largest absolute entry of the whitened fit list's
    covariance, measured, less the identity; None if no component has variance.
    """
    distinct_rows = written(rows.select("x").distinct(), "fit-list")
    n, total = totals(distinct_rows)
    if not n:
        return None
    values, axes = np.linalg.eigh(covariance(distinct_rows, n, np.array([s / n for s in total])))
    axes = axes[:, ::-1][:, : min(components, len(total))]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), range(axes.shape[1])] < 0, -1.0, 1.0)
    out = Whitening(n, total, values[::-1], axes)
    if out.live:
        out.error = float(np.abs(covariance(distinct_rows, n, out.centre, out.project) - np.eye(out.live)).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2, exact; None where it is no 64-bit number."""
    most = n * max(-int(x.min()), int(x.max())) + max(map(abs, sums))
    if x.shape[1] * most * most < 1 << 63:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, found: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component.

    ``whitened`` is null for a component without variance, ``explained`` if nothing varies, ``deviation`` beyond 64 bits.
    """
    count, live, whole = found.axes.shape[1], found.live, float(found.values.sum())
    shares = [float(max(0.0, v)) / whole if live else None for v in found.values[:count]]
    n, sums, centre, project, error = found.n, found.sums, found.centre, found.project, found.error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = matrix(batch.column("x")), batch.num_rows
            if not rows:
                continue
            white = np.full((rows, count), np.nan)
            white[:, :live] = (x - centre) @ project
            column = pa.array(white.reshape(-1), mask=np.tile(np.arange(count) >= live, rows))
            each = np.repeat(np.arange(rows), count)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)), pa.array(np.full(len(each), n)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)), column, pa.array(shares * rows, pa.float64()), pa.array([error] * len(each), pa.float64())], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows.select(F.col("vec_id").cast("long"), "x"), run, SCHEMA)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component (up to 4), n, deviation, whitened, explained, identity_error of every usable row of embeddings.

    Rows whose vector is null, empty, not finite or of another length than most take no part; a null or repeated
    vec_id stays. Equal vectors count once in the fit list. A table without usable rows gives no rows.
    """
    rows = usable(table(spark, sf_dir, "embeddings"))
    found = fit(rows)
    return spark.createDataFrame([], SCHEMA) if found is None else whiten(rows, found)
