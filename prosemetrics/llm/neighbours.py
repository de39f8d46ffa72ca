"""Nearest neighbours by randomly rotated one-bit codes.

A vector is centred, scaled to length one and rotated at random; its code is the sign of each component, packed
into bits, with two scalars: its distance from the centre and the inner product of the code with the vector. From
them, a query's inner product with the vector is estimated, with a bound on the error that fails rarely. Only
vectors whose bound could be nearer than the best found so far are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast, map_arrow, scratch, table, written

#: Rows that the centre and the common length are taken from, the first by a hash of their id.
SAMPLE = 10_000
#: Standard deviations of the estimate's error that the bound allows for.
SIGMAS = 3.0
#: Queries that are broadcast and answered at a time; rows compared with them at once.
QUERY_BLOCK, ROW_BLOCK = 2_048, 4_096


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """Rows with an id and a vector of ``dims`` finite components, not all zero."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select("vec_id", x.alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") == dims) & F.coalesce(fine, F.lit(False)) & F.exists("embedding", lambda v: v != 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dims)


def build_index(vectors: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """vec_id, embedding, code, far, match of every usable row, written; the centre; and the length of vectors.

    The length is the most frequent one in the sample; vectors of other lengths take no part.
    """
    some = vectors.where("vec_id is not null and size(embedding) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "embedding")
    sizes = some.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = sizes["n"] if sizes else 1
    held = usable(some, dims).select("embedding").toArrow().column("embedding").combine_chunks()
    centre = _matrix(held, dims).mean(0) if len(held) else np.zeros(dims)
    turn = rotation(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (_matrix(batch.column("embedding"), dims) - centre) @ turn
            far = np.sqrt((x * x).sum(1))
            x /= np.maximum(far, 1e-300)[:, None]
            bits = np.packbits(x > 0, axis=1)
            match = np.abs(x).sum(1) / np.sqrt(dims)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(far), pa.array(match)], [*batch.schema.names, "code", "far", "match"])

    index = map_arrow(usable(vectors, dims), run, "vec_id long, embedding array<double>, code binary, far double, match double")
    return written(index, "code-index"), centre, dims


class Search:
    """The k nearest of all rows seen so far, for each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.dims = queries.shape[1]
        turned = (queries - centre) @ rotation(self.dims)
        self.turned, self.length = turned, np.sqrt((turned * turned).sum(1))
        self.near = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, far: np.ndarray, match: np.ndarray) -> None:
        signs = np.unpackbits(codes, axis=1, count=self.dims).astype(np.float32) * 2 - 1
        inner = signs @ self.turned.T.astype(np.float32) / np.sqrt(self.dims)
        match = np.maximum(match, 1e-12)
        slack = SIGMAS * np.sqrt(np.maximum(0, 1 - match**2)) / match / np.sqrt(max(1, self.dims - 1))
        for q in range(len(self.ids)):
            other = ids != self.ids[q]
            base = far * far + self.length[q] ** 2
            guess = base - 2 * far * inner[:, q] / match
            low = guess - 2 * far * slack * self.length[q]
            bar = self.near[q, -1] ** 2
            done = np.zeros(len(ids), bool)
            if np.isinf(bar):  # the first rows: the best guesses set the bar
                pool = np.flatnonzero(other)
                first = pool[np.argsort(guess[pool], kind="stable")[: 2 * self.k]]
                self._exact(q, first, ids, vectors)
                done[first] = True
                bar = self.near[q, -1] ** 2
            self._exact(q, np.flatnonzero(other & ~done & (low <= bar * (1 + 1e-9))), ids, vectors)

    def _exact(self, q: int, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        if len(rows):
            gap = vectors[rows] - self.queries[q]
            total = np.zeros(len(rows))
            for column in (gap * gap).T:  # component by component, as SQL adds them up
                total += column
            near = np.concatenate([self.near[q], np.sqrt(total)])
            who = np.concatenate([self.who[q], ids[rows]])
            best = np.lexsort((who, near))[: self.k]
            self.near[q], self.who[q] = near[best], who[best]


def nearest(index: DataFrame, queries: DataFrame, centre: np.ndarray, dims: int, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of all other rows by exact distance, ties to smaller ids.

    ``queries`` are rows of the index. Candidates are compared exactly unless their error bound rules them out.
    Blocks of QUERY_BLOCK queries are answered one after another. Rows that repeat an id are candidates each;
    a query's own id is none. An id that repeats among the queries is asked once, with its smallest vector.
    """
    spark = index.sparkSession
    asked = written(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))  # by a hash: a block may hold more than its share
    path = scratch(spark, "neighbours")
    for block in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        ids = got.column("vec_id").to_numpy()
        sent = broadcast(spark, (ids, _matrix(got.column("embedding").combine_chunks(), dims) if len(ids) else np.zeros((0, dims)), centre))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = Search(*sent.value, k)
            for batch in batches:
                for at in range(0, batch.num_rows, ROW_BLOCK):
                    part = batch.slice(at, ROW_BLOCK)
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    search.add(part.column("vec_id").to_numpy(), _matrix(part.column("embedding"), dims), codes, part.column("far").to_numpy(), part.column("match").to_numpy())
            q, r = np.nonzero(np.isfinite(search.near))
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[q], pa.int64()), pa.array(search.who[q, r]), pa.array(search.near[q, r])], ["query_id", "vec_id", "score"])

        map_arrow(index, run, "query_id long, vec_id long, score double").write.mode("append").parquet(path)
        sent.unpersist()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(path)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest of every usable row whose vec_id is divisible by 100."""
    index, centre, dims = build_index(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return nearest(index, index.where("vec_id % 100 = 0").select("vec_id", "embedding"), centre, dims, k=10)


ORACLE = """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null),
u as (select * from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
d as (select q.vec_id as query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as score from u q join u c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank, vec_id, score from d
qualify row_number() over (partition by query_id order by score, vec_id) <= 10
"""
