"""A table of curves that resumes: state of the centroid that merges, and a curve for each book that is put in place.

A stream takes in the files that are new. Each of its batches leaves the sum and count of the vectors of each book in it,
from which the centroid of all books is made at any time; a batch that is run again writes the same place again. Curves
are then written for the books that need one, under the number of the last batch; a run that was broken off there leaves
no mark of success, and the next one writes that place again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arcs
from ..sources.readers import exists


@dataclass
class ArcTable:
    """The table under ``folder`` (on storage that all share) of the chunks (book, order, embedding) in ``source``.

    A book's chunks are those of the last batch that holds any of it: a book that comes again replaces what it was. With
    ``recentre``, new books move the centroid and with it all curves, so that the table is that of one run over all that
    is there now; without, a curve keeps the centroid of its own run, and only new or changed books are worked on.
    """

    spark: SparkSession
    source: str
    folder: str
    schema: str
    book: str
    order: str
    recentre: bool = True
    files_at_once: int | None = None

    def run(self) -> None:
        """Takes in what is new and brings the curves up to date. Nothing new: nothing is done."""
        self.absorb()
        self.refresh()

    def absorb(self) -> None:
        stream = self.spark.readStream.schema(self.schema)
        if self.files_at_once:
            stream = stream.option("maxFilesPerTrigger", self.files_at_once)
        rows = stream.parquet(self.source).select(self.book, "embedding", F.col("_metadata.file_path").alias("file"))
        query = rows.writeStream.foreachBatch(self._keep).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def _keep(self, batch: DataFrame, number: int) -> None:
        each = batch.select(self.book, "file", F.posexplode("embedding").alias("pos", "x"))
        sums = each.groupBy(self.book, "file", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
        rows = sums.groupBy(self.book, "file").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("sums"), F.max("n").alias("n"))  # an entry for each dimension
        rows.write.mode("overwrite").parquet(f"{self.folder}/books/batch={number}")

    def books(self) -> DataFrame:
        """book, file, sums, n, batch of the last batch of each book."""
        rows = self.spark.read.parquet(f"{self.folder}/books")
        last = rows.groupBy(F.col(self.book).alias("_book")).agg(F.max("batch").alias("_batch"))
        return rows.join(last, rows[self.book].eqNullSafe(F.col("_book")) & (F.col("batch") == F.col("_batch"))).drop("_book", "_batch")

    def centroid(self) -> DataFrame:
        """One row, centroid: the mean of all vectors there are now."""
        each = self.books().select("n", F.posexplode("sums").alias("pos", "s")).groupBy("pos").agg((F.sum("s.s") / F.sum("n")).alias("m"))
        return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))

    def _runs(self) -> list[int]:
        """The runs whose curves were written to the end."""
        if not exists(self.spark, f"{self.folder}/arcs"):
            return []
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/arcs/run=*/_SUCCESS")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place)
        return sorted(int(str(x.getPath().getParent().getName()).removeprefix("run=")) for x in found)

    def refresh(self) -> None:
        if not exists(self.spark, f"{self.folder}/books"):
            return
        done, books = self._runs(), self.books()
        last = books.agg(F.max("batch")).first()[0]
        if last is None or last in done:
            return
        stale = books if self.recentre or not done else books.where(F.col("batch") > done[-1])
        asked = stale.select(F.col(self.book).alias("_book"), F.col("file").alias("_file"))
        chunks = self.spark.read.schema(self.schema).parquet(self.source).select("*", F.col("_metadata.file_path").alias("_from"))
        chunks = chunks.join(asked, chunks[self.book].eqNullSafe(F.col("_book")) & (F.col("_from") == F.col("_file")), "left_semi")
        out = arcs.arcs(chunks, self.book, self.order, centre=self.centroid())
        out.write.mode("overwrite").parquet(f"{self.folder}/arcs/run={last}")

    def table(self) -> DataFrame:
        """book, n_chunks, arc: the newest curve of each book; a book that shrank below two chunks has none."""
        done = self._runs()
        if not done:
            raise ValueError("there is no finished run")
        rows = self.spark.read.option("basePath", f"{self.folder}/arcs").parquet(*[f"{self.folder}/arcs/run={r}" for r in done])
        newest = rows.groupBy(self.book).agg(F.max_by(F.struct("run", "n_chunks", "arc"), "run").alias("r"))
        born = self.books().groupBy(F.col(self.book).alias("_book")).agg(F.max("batch").alias("_batch"))
        return newest.join(born, newest[self.book].eqNullSafe(F.col("_book")) & (F.col("r.run") >= F.col("_batch"))).select(self.book, "r.n_chunks", "r.arc")
