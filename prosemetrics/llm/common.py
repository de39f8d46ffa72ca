"""Shared pieces: tables, the shared scratch folder, and text held as flat byte arrays.

Texts reach Python as Arrow columns, whose UTF-8 bytes lie in one buffer. The functions here work on that
buffer with NumPy, a bounded slice of documents at a time, and never build a Python string per word.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import _FOLD, _KEEP, _SPACE, LONG_SPAN, SLICE_BYTES, Lookup, _blocks, mix, slices, span_hash, sums, utf8, words  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


_shipped: set[str] = set()
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":  # texts are long: Spark's own setting would hold tens of megabytes
        spark.conf.set(BATCH_ROWS, "1000")
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()  # the driver's file server reads it as long as the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"prosemetrics-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(top)))
    context.addPyFile(path)


def release() -> None:
    """Gives memory that a task no longer needs back: workers live on from one task and stage to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors, whose workers are taken over and left small."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what grouped functions of an earlier stage left in this worker
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


_made: list[tuple[SparkSession, str]] = []


_held: list = []


def forget(since: int = 0, but: int = 0) -> None:
    """Deletes the scratch folders made after the first ``since``, but not the last ``but``: their readers have ended."""
    until = len(_made) - but
    for spark, path in _made[since:until]:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has ended; the folder then stays for the cluster's own cleaning
            break
    del _made[since:until]


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that no one holds any more; it waits for a collection to do so."""
    gc.collect()
    spark._jvm.System.gc()


def made() -> int:
    """How many scratch folders there are now."""
    return len(_made)


def broadcast(spark: SparkSession, value):
    """A broadcast that ``drop_broadcasts`` takes back."""
    _held.append(spark.sparkContext.broadcast(value))
    return _held[-1]


def drop_broadcasts() -> None:
    """Frees the executors' copies of what was broadcast here; a plan that is run again fetches them anew."""
    while _held:
        try:
            _held.pop().unpersist()
        except Exception:  # its session has ended
            _held.clear()


atexit.register(forget)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. In local mode only, a temporary one stands in where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/prosemetrics"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that are no part of a word of letters, digits and characters beyond ASCII.
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

def _same(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span holds the bytes of that at its place ``other``."""
    size = end - start
    if (size != size[other]).any():
        return False
    at, blocks = np.flatnonzero((other != np.arange(len(other))) & (size > 0)), _blocks(data)
    for k in range(0, LONG_SPAN, 8):
        if not len(at):
            return True
        if (((blocks[start[at] + k] ^ blocks[start[other[at]] + k]) & _KEEP[np.clip(size[at] - k, 0, 8)]) != 0).any():
            return False
        at = at[size[at] > k + 8]
    return all((data[start[k] : end[k]] == data[start[other[k]] : end[other[k]]]).all() for k in at)


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one span for each distinct content, and which of those each span has. Bytes decide, not hashes."""
    _, where, back = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
    if _same(data, start, end, where[back]):
        return where, back
    found: dict[bytes, int] = {}
    back = np.array([found.setdefault(data[a:b].tobytes(), len(found)) for a, b in zip(start, end, strict=True)], np.int64)
    return np.unique(back, return_index=True)[1], back


def row_key(doc_id: Column, text: Column) -> Column:
    """Sixteen bytes that tell rows of other ids or texts apart; a null id and a null text have keys of their own."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    return F.unhex(F.substring(F.sha2(F.concat_ws("|", part(doc_id.cast("string")), part(text)).cast("binary"), 256), 1, 32))


def remainder(doc_id: Column, of: int) -> Column:
    """CRC-32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))
