"""WARC archives with revisit resolution.

Headers alone are shuffled by payload digest. The record with the least id of equal
payloads stays a response, the others become revisits that name it; archives are written
with fresh headers, and no revisit carries a payload. Archives are plain WARC/1.1 files:
Spark's text sink writes a row of whole records as a file and ends it by the two line ends the format
asks for, so that retries and lost executors are the commit protocol's affair.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import new_path, picked, staged, with_groups

FILE_BYTES = 24 << 20
SEPARATOR = b"\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id {id}, uri string, record_type string, refers_to {id}, payload_digest string, payload_bytes bigint, intact boolean"


def base32_sha1(raw: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hex digits are four base-32 digits."""
    digits = F.sha1(raw)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Per page: id, uri, payload, its bytes and digest. A null payload is empty; a null uri is blank."""
    rows = picked(pages, page_id=id_col, uri=uri_col, payload=payload_col)
    payload = F.coalesce(F.col("payload"), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col("uri").cast("string"), F.lit("")), "[\r\n]", "")
    return rows.select(
        "page_id", clean.alias("uri"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("payload_digest"),
    )


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per digest that more than one row has: the least id, ``original``, and the rows, ``n``. Only ids and digests are shuffled."""
    return (
        heads.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("original").isNotNull())
    )


def resolved(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``heads`` with ``record_type`` and ``refers_to`` (null for responses).

    Rows that repeat the least id itself are responses too; a null id never is referred to. Payloads of more than a
    1,024th of all pages are dealt over many tasks.
    """
    revisit = F.col("original").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    originals = staged(resolve(heads, min_bytes), "originals")
    return with_groups(heads, originals, "payload_digest", "page_id", heads.count()).select(
        *heads.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def record(when: str) -> Column:
    """The record's text, without the two line ends after it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(_HTTP), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), own, F.lit(">")),
        F.lit(f"WARC-Date: {when}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _filled(batches: Iterator[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records one after the other, as many a row as ``file_bytes`` hold."""
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for value in batch.column(0):
            raw = value.as_buffer().to_pybytes()
            if held and size + len(raw) > file_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)], pa.binary()).cast(pa.string())], ["value"])
                held, size = [], 0
            held.append(raw)
            size += len(raw) + len(SEPARATOR)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)], pa.binary()).cast(pa.string())], ["value"])


def write_archive(records: DataFrame, path: str, when: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write resolved records as WARC files of at most ``file_bytes``, by their own bytes; a longer record has a file to itself."""
    files = records.select(record(when).alias("value")).mapInArrow(lambda it: _filled(it, file_bytes), "value string")
    files.write.option("lineSep", SEPARATOR.decode()).option("maxRecordsPerFile", 1).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(raw):
        head_end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:head_end].split(b"\r\n")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        first = head_end + 4
        last = first + int(head[b"content-length"])
        yield head, raw[first:last]
        at = last + 4


def _named(value: bytes | None) -> str | None:
    if value is None:
        return None
    return value.decode().removeprefix("<urn:page:").removesuffix(">") or None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "intact"]
    for batch in batches:
        for raw in batch.column(0):
            rows = []
            for head, block in parse(raw.as_buffer().to_pybytes()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                digest, kind = head[b"warc-payload-digest"].decode().removeprefix("sha1:"), head[b"warc-type"].decode()
                whole = kind == "revisit" or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
                rows.append((_named(head[b"warc-record-id"]), head[b"warc-target-uri"].decode(), kind, _named(head.get(b"warc-refers-to")), digest, size, whole))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """A row per record, from its headers; ``intact``: a response's payload has the length and digest they state."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = files.mapInArrow(_read, RECORD.format(id="string"))
    return rows.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def dedup_archive(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, path: str | None = None
) -> DataFrame:
    """Write deduplicated archives of ``pages`` to ``path`` (a new shared folder) and read them back.

    Null payloads are empty ones and equal each other. Extra columns are ignored; an empty table
    gives an archive without records.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    heads = headers(pages, id_col, uri_col, payload_col)
    digests = staged(heads.drop("payload", "uri"), "digests")
    whom = staged(resolved(digests, min_bytes).filter(F.col("record_type") == "revisit").select("page_id", "payload_digest", "refers_to").distinct(), "revisits")
    if whom.isEmpty():
        records = heads.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast(heads.schema["page_id"].dataType))
    else:
        link = heads["page_id"].eqNullSafe(whom["page_id"]) & (heads["payload_digest"] == whom["payload_digest"])
        records = heads.join(whom, link, "left").select(*[heads[c] for c in heads.columns], F.when(whom["payload_digest"].isNotNull(), "revisit").otherwise("response").alias("record_type"), whom["refers_to"])
    write_archive(records, path)
    return read_archive(spark, path, heads.schema["page_id"].dataType.simpleString())
