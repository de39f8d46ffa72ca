"""WARC archives: writing transactions, and assembling captures out of the records read back.

A transaction is a request, a response or revisit, and a metadata record; the first and last name the middle one
in WARC-Concurrent-To. Writing is Spark's text sink, whose line separator is the end of a record, so that its
commit protocol covers lost executors. Reading parses each file by Content-Length alone, so that payloads may
hold anything, and joins the records through their identifiers.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scratch, table, written

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 100
#: Groups of equal payloads that are broadcast at most, some 10 MB; more of them are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Transactions in one file at most, and bytes of payload that their mean size makes of them; a file is parsed by one task.
PER_FILE, FILE_BYTES = 2_000, 64 << 20

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, kind string, record_id string, concurrent_to string, target_uri string, declared_digest string, payload_digest string, payload_bytes long, http_head string, payload binary, fields string"


def _lines(*parts: tuple[str, Column]) -> Column:
    """Header lines; those with a null value are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in parts])


def _record(kind: Column, ident: Column, uri: Column, media: Column, block: Column, *more: tuple[str, Column]) -> Column:
    head = _lines(("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", F.lit("1970-01-01T00:00:00Z")), ("WARC-Target-URI", uri), *more, ("Content-Type", media), ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), block)


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes a gzip WARC file per task: a transaction for each row of page_id, url, html.

    Payload: html in UTF-8; a null is empty. Of equal payloads of LEAST_BYTES or more, the smallest page_id is
    the response, the others revisit it by its digest; rows that repeat that page_id are responses too, and where
    all page_ids are null, all are. A null url leaves out the target; control characters and blanks in it are
    percent-signed in headers only. An empty table writes an archive without records.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("string").alias("page"), "page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"), F.monotonically_increasing_id().alias("uid"))
    mean = rows.agg(F.avg("n")).first()[0] or 0
    firsts = rows.where(F.col("n") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    firsts = written(firsts, "warc-firsts")
    few = firsts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ident = lambda role: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", F.lit(role), "uid", "digest")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    uri, main = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), ident("main")
    host = F.regexp_extract(uri, r"^\w+://([^/?#]*)", 1)
    path_ = F.regexp_extract(uri, r"^\w+://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(path_.startswith("/"), path_).otherwise(F.concat(F.lit("/"), path_)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha256:"), "digest")
    request = _record(F.lit("request"), ident("request"), uri, F.lit("application/http;msgtype=request"), F.coalesce(asked, F.lit("")), ("WARC-Concurrent-To", main))
    answer = _record(F.when(again, "revisit").otherwise("response"), main, uri, F.lit("application/http;msgtype=response"), F.when(again, head).otherwise(F.concat(head, "html")), ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))))
    about = _record(F.lit("metadata"), ident("metadata"), uri, F.lit("application/json"), F.to_json(F.struct("page_id", "url")), ("WARC-Concurrent-To", main))
    # the sink adds the last end of record
    rows.select(F.concat_ws("\r\n\r\n", request, answer, about).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, min(PER_FILE, int(FILE_BYTES // (mean + 1000))))).option("compression", "gzip").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers, names in lower case, and block of each record. Raises ValueError where the bytes are no WARC."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for line in bytes(view[at:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        at = end + 4 + int(head["content-length"])
        if at > len(data):
            raise ValueError("a record is cut off")
        yield head, view[end + 4 : at]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
    for batch in batches:
        for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            out, size = [], 0
            for head, block in parse_warc(data):
                http = payload = fields = digest = None
                if "application/http" in head.get("content-type", ""):
                    block = bytes(block)
                    http, mark, payload = block.partition(b"\r\n\r\n")
                    http = http.decode("utf-8", "replace")
                    if head["warc-type"] == "response":
                        digest = hashlib.sha256(payload).hexdigest()
                    else:
                        payload = None
                else:
                    fields = bytes(block).decode("utf-8", "replace")
                out.append((file.as_py(), head["warc-type"], head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-payload-digest"), digest, None if payload is None else len(payload), http, payload, fields))
                size += len(block)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the .gz or plain WARC files in ``path``, payloads and their digests included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc,txt}").load(path).select("path", "content")
    return map_arrow(files, _records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with the request and metadata concurrent to it.

    Where several requests or metadata records name one capture, that with the smallest record id is taken; where
    none does, the struct is null. Requests and metadata that name no capture give no row.
    """
    main = records.where(F.col("kind").isin("response", "revisit"))
    of = lambda kind, *cols: records.where(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct(F.col("record_id").alias("id"), *cols)).alias(kind))
    main = main.select("record_id", "target_uri", F.struct("kind", "declared_digest", "payload_digest", "payload_bytes", "http_head", "payload").alias("response"))
    return main.join(of("request", "http_head"), "record_id", "left").join(of("metadata", "fields"), "record_id", "left")


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with page_id, url and, for revisits, the page_id, size and digest of the response that they repeat."""
    known = captures.withColumns({"about": F.from_json("metadata.fields", "page_id long, url string"), "declared": F.regexp_replace("response.declared_digest", "^sha256:", "")})
    known = known.select("record_id", "about.page_id", "about.url", "request", "response", "metadata", F.coalesce("response.payload_digest", "declared").alias("digest"))
    full = known.where("response.kind = 'response'").groupBy("digest").agg(F.min("page_id").alias("origin"), F.max("response.payload_bytes").alias("origin_bytes"))
    back = known.where("response.kind = 'revisit'").join(full, "digest")
    first = known.where("response.kind = 'response'").withColumns({"origin": F.lit(None).cast("long"), "origin_bytes": F.col("response.payload_bytes")})
    return first.unionByName(back)


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives written."""
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = written(read_records(spark, path).withColumn("payload", F.lit(None).cast("binary")), "warc-records")  # no payloads there: their digests and sizes are known
    captures = resolve(assemble(records))
    return captures.select("page_id", F.col("origin_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("origin").alias("refers_to"))


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
k as (select page_id, octet_length(encode(html)) as n, sha256(html) as d from p),
f as (select d, min(page_id) as first from k where n >= 100 group by d)
select k.page_id, cast(n as bigint) as payload_bytes, k.d as payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from k left join f on k.d = f.d and k.n >= 100
"""
