"""Content-addressed web archive: payload bytes once per digest, exact headers per record.

Records are written as WARC files: a response carries the payload, a revisit only refers
to it.  Reading splits the archives into a store of payloads, keyed and verified by SHA-256,
and a table of headers; joining the two gives the original records back.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import text_of
from tagloom.session import shared_dir

#: A reader holds one file in memory, so files have few records.
RECORDS_PER_FILE = 1000
END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hex digest whose length is a multiple of five."""
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(header, payload) of a WARC record per page; payload is empty for revisits.

    Of pages with equal payloads of at least ``least_bytes`` bytes the largest page_id is the
    response, the others revisit it; rows that repeat that page_id are responses too.  A null
    page_id counts as smaller than all others.  Null html is an empty payload, a null url leaves out the target.
    """
    df = pages.select("page_id", "url", text_of("html").alias("payload"))
    df = df.withColumn("address", F.sha2("payload", 256))
    first = df.groupBy("address").agg(F.max("page_id").alias("response"))
    df = df.join(first, "address")
    size = F.octet_length("payload")
    revisit = (size >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.sha1("payload"))),
        F.concat(F.lit("WARC-Content-Address: sha256:"), F.col("address")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("response").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(size).cast("string")),
    ]
    return df.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END)).alias("header"), F.when(revisit, "").otherwise(F.col("payload")).alias("payload"))


def write(record: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Write records as WARC files; the text writer's line separator is the end of a record."""
    (record.select(F.concat("header", "payload").alias("value")).write
     .option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


_LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]+)\r\n")
_ADDRESS = re.compile(rb"\r\nWARC-Content-Address: sha256:([0-9a-f]{64})\r\n")
_RESPONSE = b"\r\nWARC-Type: response\r\n"


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of each record of one file, by Content-Length."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at) + 4
        end = head + int(_LENGTH.search(data, at, head)[1])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("broken archive: no end of record")
        yield data[at:head], data[head:end]
        at = end + 4


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(header, payload: binary) per record of the archives in ``folder``; payloads that miss their digest fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                rows = list(split_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                for header, payload in rows:
                    address = _ADDRESS.search(header)
                    if not address:
                        raise ValueError("record misses its content address")
                    if _RESPONSE in header and hashlib.sha256(payload).hexdigest().encode() != address[1]:
                        raise ValueError("payload misses its digest")
                yield pa.RecordBatch.from_arrays([pa.array([h.decode() for h, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.binary())], ["header", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, "header string, payload binary")


def field(name: str) -> Column:
    value = F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    return F.nullif(value, F.lit(""))


def store(archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads: address, payload and its size and SHA-1; headers: address, header): payload bytes once, headers as they were.

    Size and digest are computed where the bytes are read, so bytes that nobody asks for are not shuffled.
    """
    addressed = archive.withColumn("address", F.regexp_extract(field("WARC-Content-Address"), "^sha256:([0-9a-f]+)$", 1))
    full = addressed.where(field("WARC-Type") == "response").select(
        "address", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"))
    payloads = full.groupBy("address").agg(*[F.any_value(c).alias(c) for c in full.columns[1:]])
    return payloads, addressed.select("address", "header")


def restore(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """Every record with its full payload: address, header, payload.  A header without a payload fails."""
    joined = headers.join(payloads.withColumn("w_stored", F.lit(True)), "address", "left")
    lost = F.raise_error(F.concat(F.lit("no payload of "), F.coalesce("address", F.lit("a record without an address"))))
    return joined.where(F.coalesce("w_stored", lost.cast("boolean"))).drop("w_stored")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and restore each record with its fields.

    The digests are computed from the stored bytes, once per payload.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc"
    write(records(pages), folder)
    payloads, headers = store(read(spark, folder))
    page = lambda name: F.nullif(F.regexp_extract(field(name), "<urn:page:([^>]*)>", 1), F.lit("")).cast("long")
    return restore(payloads, headers).select(
        page("WARC-Record-ID").alias("page_id"), "payload_bytes", "payload_digest", field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"), "header", "payload",
    )
