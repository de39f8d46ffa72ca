"""Python functions over Arrow batches, with this package at hand on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
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


def map_arrow(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def map_pandas(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(rows.sparkSession)
    return rows.mapInPandas(function, schema)
