"""Readers: text folders, delimited files, arrays, JSON side-cars and id lists."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean_text, stem
from .shipping import map_arrow, map_pandas


def texts(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """name, text: a row per file of a folder or glob, named by its stem or by a folder name=<name>; unreadable files are passed over."""
    rows = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True)
    text = clean_text(F.col("value")) if clean else F.col("value")
    name = F.col("name").cast("string") if "name" in rows.columns else stem(F.col("_metadata.file_path"))
    return rows.select(name.alias("name"), text.alias("text"))


def first_fit(data: bytes, encodings: tuple[str, ...]) -> str:
    """The text in the first encoding that the bytes are valid in; the last one's error if there is none."""
    for encoding in encodings[:-1]:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode(encodings[-1])


def _decode(data: bytes) -> str:
    return first_fit(data, ("utf-8-sig", "cp1252", "latin-1"))


def decoded_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, text: UTF-8 if a file is that, else Windows-1252, else Latin-1."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": b["content"].map(lambda x: _decode(bytes(x)))})

    rows = map_pandas(spark.read.format("binaryFile").load(path).select("path", "content"), run, "path string, text string")
    return rows.select(stem(F.col("path")).alias("name"), "text")


def id_list(lines: DataFrame) -> DataFrame:
    """id, pos of lines(pos, line): digits only, each once, at its first place."""
    line = F.trim("line")
    return lines.select("pos", line.alias("id")).where(F.col("id").rlike("^[0-9]+$")).groupBy("id").agg(F.min("pos").alias("pos"))


#: Encodings that Spark reads itself.
SPARKS_OWN = ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32")


def delimited(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV table with a header; names and strings are trimmed, NaN becomes null.

    Files in an encoding that Spark does not read are parsed one by one, as ``any_encoding`` does.
    """
    if encoding.lower() not in SPARKS_OWN:
        return any_encoding(spark, path, schema, (encoding,))
    rows = spark.read.schema(schema).option("encoding", encoding).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.select(*[F.nanvl(F.col(n), F.lit(None)).alias(n.strip()) if t in ("double", "float") else F.col(n).alias(n.strip()) for n, t in rows.dtypes])


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """name, row, embedding of .npy matrices; empty or unreadable ones give no rows."""

    def run(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                try:
                    x = np.atleast_2d(np.load(io.BytesIO(bytes(content)), allow_pickle=False))
                except (ValueError, EOFError, OSError):
                    continue
                if x.size:
                    yield pd.DataFrame({"path": p, "row": np.arange(len(x)), "embedding": list(x.astype(np.float32))})

    rows = map_pandas(spark.read.format("binaryFile").load(path).select("path", "content"), run, "path string, row long, embedding array<float>")
    return rows.select(stem(F.col("path")).alias("name"), "row", "embedding")


def side_car(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON file of one value or an array of them; with ``lines``, a value on each line, as the sink writes them."""
    return spark.read.json(path, multiLine=not lines)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def table_or_csv(spark: SparkSession, path: str, other: str | None = None) -> DataFrame:
    """The Parquet table at ``path`` if there is one, else the CSV table ``other`` (by default ``path`` with that ending)."""
    if not path.endswith(".csv") and exists(spark, path):
        return spark.read.parquet(path)
    return spark.read.csv(other or (path if path.endswith(".csv") else path.removesuffix(".parquet") + ".csv"), header=True, inferSchema=True)


def any_encoding(spark: SparkSession, path: str, schema: str, encodings: tuple[str, ...] = ("utf-8-sig", "latin-1")) -> DataFrame:
    """A CSV table whose files are UTF-8 or, those that are not, Latin-1; each file is read as a whole by one task.

    ``encodings``: others to try, the first that fits a file; a file that none fits raises UnicodeDecodeError.

    The first record of a file names its columns, in any order, case and between blanks; a column of ``schema`` that it
    lacks is null, others are passed over. Quoted fields may hold commas, doubled quotes and line breaks. Values and
    names are trimmed; an empty value, one that is no value of its column's type, and NaN are null. Blank records and
    files without a record give no rows.
    """
    wanted = StructType.fromDDL(schema)
    names = [f.name for f in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                records = csv.reader(io.StringIO(first_fit(content.as_py(), encodings), newline=""))
                header = [x.strip().lower() for x in next(records, [])]
                places = [header.index(n.strip().lower()) if n.strip().lower() in header else None for n in names]
                while rows := [r for r in itertools.islice(records, 4096)]:
                    rows = [[x.strip() or None for x in r] for r in rows]
                    rows = [r for r in rows if any(r)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[p] if p is not None and p < len(r) else None for r in rows], pa.string()) for p in places], [f"c{k}" for k in range(len(names))])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = map_arrow(files, run, ", ".join(f"c{k} string" for k in range(len(names))))
    typed = [F.expr(f"try_cast(c{k} as {f.dataType.simpleString()})") for k, f in enumerate(wanted)]
    return rows.select(*[(F.nanvl(c, F.lit(None)) if f.dataType.simpleString() in ("double", "float") else c).alias(f.name.strip()) for c, f in zip(typed, wanted, strict=True)])


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The last path, in lexicographic order, of those that match; result files carry their date in the name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return max((str(x.getPath()) for x in found or []), default=None)
