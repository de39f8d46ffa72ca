"""Texts by id from a server that has them under one of several addresses: failover, waiting, and a table of failures.

``fetch`` is for a table of ids of any length, ``data_source`` for a list of them in ``spark.read``. What opens an address
is a parameter, so that any client, proxy or script can stand in.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import strip_boilerplate
from .readers import _decode
from .scratch import stored
from .shipping import map_arrow, ship

SCHEMA = "id string, url string, text string, attempts int, error string"
#: Answers that ask for a longer wait before the same address is tried again.
BUSY = (403, 429, 503)


@dataclass
class Reply:
    status: int
    body: bytes = b""
    charset: str | None = None


Opener = Callable[[str], Reply]


def web(url: str, seconds: float = 60.0, agent: str = "text-fetch/1.0") -> Reply:
    """The answer of a web server, whatever its status. Raises OSError if there is none."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=seconds) as answer:
            return Reply(answer.status, answer.read(), answer.headers.get_content_charset())
    except urllib.error.HTTPError as e:
        return Reply(e.code)


def decoded(reply: Reply) -> str:
    """By the charset that the server names, if it is known; else UTF-8, Windows-1252 or Latin-1, the first that fits."""
    try:
        return reply.body.decode(reply.charset, "replace") if reply.charset else _decode(reply.body)
    except LookupError:
        return _decode(reply.body)


@dataclass(frozen=True)
class Policy:
    """Addresses with ``{id}``, in the order in which they are tried; tries of each; seconds between requests."""

    templates: tuple[str, ...]
    tries: int = 3
    delay: float = 1.0
    jitter: float = 1.0

    def get(self, key: str, opener: Opener, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int, str | None]:
        """url, text, attempts, error. An address without a text yields to the next one, a busy or silent one is waited for."""
        attempts, error = 0, "no address"
        for template in self.templates:
            url = template.replace("{id}", key)
            for k in range(self.tries):
                attempts += 1
                try:
                    reply = opener(url)
                except OSError as e:
                    error, wait = f"{type(e).__name__}: {e}", self.delay * 2**k
                else:
                    text = decoded(reply) if 200 <= reply.status < 300 else ""
                    if text.strip():
                        return url, text, attempts, None
                    error = f"status {reply.status}" if reply.status >= 300 else "blank"
                    if reply.status not in BUSY:
                        break
                    wait = self.delay * 5 ** (k + 1)
                sleep(wait + self.jitter * random.random())
        return None, None, attempts, error


def fetch(ids: DataFrame, policy: Policy, opener: Opener = web, workers: int = 2, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """id, url, text, attempts, error of each distinct id of ``ids``; null ids are none, error is null where there is a text.

    ``workers`` tasks ask at a time, each with a pause of ``policy.delay`` after a text. To be stored before it is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column("id").to_pylist():
                url, text, attempts, error = policy.get(key, opener, sleep)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key, pa.string()), (url, pa.string()), (text, pa.string()), (attempts, pa.int32()), (error, pa.string()))], ["id", "url", "text", "attempts", "error"])
                if error is None:
                    sleep(policy.delay)

    keys = ids.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct().repartition(workers, "id")
    return map_arrow(keys, run, SCHEMA)


def download(ids: DataFrame, policy: Policy, target: str, failed: str, opener: Opener = web, workers: int = 2, least: int = 1000, raw: str | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
    """Appends id, text without licence and credits to the table ``target``, and writes id, attempts, error to ``failed``.

    Ids that ``target`` has are passed over, so that a broken run goes on. A text of under ``least`` characters is a failure.
    ``raw``: a table that the texts are appended to as they came.
    """
    from .readers import exists

    spark = ids.sparkSession
    ids = ids.select(F.col("id").cast("string").alias("id"))
    if exists(spark, target):
        ids = ids.join(spark.read.parquet(target).select("id"), "id", "left_anti")
    got = stored(fetch(ids, policy, opener, workers, sleep).withColumn("stripped", strip_boilerplate(F.col("text"))))
    short = F.length("stripped") < least
    if raw:
        got.where("error is null").select("id", "text").write.mode("append").parquet(raw)
    got.where(F.col("error").isNull() & ~short).select("id", F.col("stripped").alias("text")).write.mode("append").parquet(target)
    reason = F.coalesce("error", F.format_string("only %d characters", F.length("stripped")))
    got.where(F.col("error").isNotNull() | short).select("id", "attempts", reason.alias("error")).write.mode("overwrite").parquet(failed)


@dataclass
class _Part(InputPartition):
    number: int


def data_source(opener: Opener = web, sleep: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """A source "texts_by_id" for ``spark.dataSource.register``, whose addresses are opened by ``opener``.

    Options: ids (parted by commas), templates (parted by blanks), tries, delay, jitter, workers.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.ids = sorted({x.strip() for x in options.get("ids", "").split(",")} - {""})
            self.policy = Policy(tuple(options.get("templates", "").split()), int(options.get("tries", 3)), float(options.get("delay", 1.0)), float(options.get("jitter", 1.0)))
            self.workers = int(options.get("workers", 2))

        def partitions(self) -> list[InputPartition]:
            return [_Part(k) for k in range(self.workers)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for key in self.ids:
                if zlib.crc32(key.encode()) % self.workers == partition.number:
                    got = self.policy.get(key, opener, sleep)
                    yield (key, *got)
                    if got[3] is None:
                        sleep(self.policy.delay)

    class TextsById(DataSource):
        @classmethod
        def name(cls) -> str:
            return "texts_by_id"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader({k.lower(): v for k, v in self.options.items()})

    return TextsById


def register(spark, opener: Opener = web, sleep: Callable[[float], None] = time.sleep) -> None:
    ship(spark)
    spark.dataSource.register(data_source(opener, sleep))
