"""Tables that are written once and read several times, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new place under ``spark.checkpoint.dir``, deleted as the process ends.

    In local mode a temporary folder stands in where the setting is missing; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="prosemetrics-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return f"file://{own}/{name}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` as a Parquet table in a ``folder``: what made it is not run again, nor lost with an executor."""
    path = folder(rows.sparkSession, "stored")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _delete(spark, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended; the folder then stays for the cluster's own cleaning
        return


#: Bytes for each core below which a table counts as small.
SMALL = 32 << 20


def estimated(rows: DataFrame) -> int:
    """Bytes of ``rows`` as Spark's optimizer estimates them; no job is run."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by their keys over all cores if they are few bytes, which may lie in a single row group.

    A large table has row groups for all cores; its rows stay where they are read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if estimated(rows) < cores * SMALL else rows
