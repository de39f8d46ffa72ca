"""Sinks: tables, side-cars, reports and the parts of a workbook."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(rows: DataFrame, path: str, by: list[str] = (), encoding: str = "UTF-8") -> None:
    """With a header; a quote within a field is doubled, line breaks stay within quotes."""
    rows.write.mode("overwrite").partitionBy(*by).option("escape", '"').option("encoding", encoding).csv(path, header=True)


def parquet(rows: DataFrame, path: str, append: bool = False) -> None:
    """Appending adds files; nothing is read and written again."""
    rows.write.mode("append" if append else "overwrite").parquet(path)


def json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def wide_arcs(rows: DataFrame, points: int = 100) -> DataFrame:
    """point_0 ... of an array column arc, as table files have them."""
    return rows.select(*[c for c in rows.columns if c != "arc"], *[F.get("arc", F.lit(i)).alias(f"point_{i}") for i in range(points)])


def report(metrics: DataFrame, path: str) -> None:
    """Markdown lines of metrics(metric, value, interpretation)."""
    lines = metrics.select(F.format_string("| %s | %.4f | %s |", "metric", "value", "interpretation").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)  # a few lines


def workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A CSV folder for each sheet and an index of them."""
    for name, rows in sheets.items():
        csv(rows, f"{path}/{name}")
    if sheets:
        spark = next(iter(sheets.values())).sparkSession
        json(spark.createDataFrame([(k, n) for k, n in enumerate(sheets)], "position int, sheet string"), f"{path}/index")


def texts(rows: DataFrame, path: str) -> None:
    rows.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def named_texts(rows: DataFrame, path: str) -> None:
    """A folder name=<name> for each row of name and text, with the text and a line break in one file; names are to differ."""
    rows.select("name", F.col("text").alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def failures(items: DataFrame, done: DataFrame, key: str, path: str) -> None:
    """The keys that have no result, in order, as a text file in a folder."""
    missing = items.select(F.col(key).cast("string").alias("value")).distinct().join(done.select(F.col(key).cast("string").alias("value")), "value", "left_anti")
    missing.orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def arrays(rows: DataFrame, path: str) -> None:
    """A table of name, row, embedding as Parquet parted by name, which ``parquet`` readers and ``.npy`` tools find by folder."""
    rows.repartition("name").sortWithinPartitions("name", "row").write.mode("overwrite").partitionBy("name").parquet(path)
