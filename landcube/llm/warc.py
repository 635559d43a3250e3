"""A content-addressed WARC archive.

Two tables make an archive: ``headers``, one row per record with its exact header
bytes, and ``payloads``, one row per distinct payload under its SHA-256 (checked
against a second digest and the length when written, recomputed when read).
Original records come back by a join of both.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the
smallest ``page_id`` is a response and the others are revisits of it; smaller
payloads are all responses, though their bytes are stored once as well.

Null html counts as empty, a null url as an empty one. Rows that repeat the
smallest ``page_id`` of a payload are each a response; other repeated rows are
each a revisit. A null ``page_id`` is larger than any; if all of a payload's ids
are null, all are responses. Further columns are ignored. An empty table gives an
empty archive.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written

REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
#: A fixed value of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _squeeze(batches):
    """(digest, z): each payload compressed once a task, however many copies it has there;
    a task remembers 32 bytes for each payload of its partition."""
    z, seen = zstandard.ZstdCompressor(level=3), set()
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            new = {}
            for x in b.column(0).slice(lo, 256).to_pylist():
                x = (x or "").encode()
                d = hashlib.sha256(x).digest()
                if d not in seen:
                    seen.add(d)
                    new[d.hex()] = z.compress(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string()), pa.array(list(new.values()), pa.binary())], names=["digest", "z"])


def _header(base: str = "urn:landcube:page:") -> F.Column:
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    rid = lambda c: F.concat(F.lit(f"<{base}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    revisit = F.col("revisit")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", rid(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", rid(F.col("keeper"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write ``pages(page_id, url, html)`` as an archive in the folder ``path``."""
    spark = pages.sparkSession
    store = Written(spark)
    html = F.coalesce("html", F.lit(""))
    index = pages.select("page_id", "url", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n"), F.xxhash64(html).alias("second"))
    keepers = store.write(index.groupBy("digest", "n", "second").agg(F.min("page_id").alias("keeper")), "keepers")
    clash = keepers.groupBy("digest").count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"two payloads share the digest {clash[0]['digest']}")
    few = keepers.select("digest", "keeper")
    records = index.join(few, "digest").withColumn("revisit", (F.col("n") >= revisit_bytes) & F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(True)) & F.col("keeper").isNotNull())
    records.select("page_id", "digest", _header().alias("header")).write.parquet(f"{path}/headers")
    # equal payloads of several tasks are compressed alike: any of them may stay
    bytes_ = pages.select("html").mapInArrow(_squeeze, "digest string, z binary")
    bytes_.groupBy("digest").agg(F.first("z").alias("z")).write.parquet(f"{path}/payloads")
    store.drop(keepers)


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")


def _open(payloads: DataFrame, with_bytes: bool) -> DataFrame:
    """(digest, payload_bytes[, payload]) of the stored payloads, each verified."""

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                data = [z.decompress(x) for x in part.column(1).to_pylist()]
                for want, x in zip(part.column(0).to_pylist(), data):
                    if hashlib.sha256(x).hexdigest() != want:
                        raise ValueError(f"the payload stored as {want} is not what was written")
                cols = [part.column(0), pa.array([len(x) for x in data], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(data, pa.binary())] * with_bytes, names=["digest", "payload_bytes"] + ["payload"] * with_bytes)

    return payloads.select("digest", "z").mapInArrow(run, "digest string, payload_bytes long" + ", payload binary" * with_bytes)


def _field(name: str) -> F.Column:
    return F.regexp_extract("header", f"\r\n{name}: ([^\r]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) as
    the headers' own bytes and the verified payloads have them."""
    headers, payloads = _tables(spark, path)
    rid = lambda c: F.nullif(F.regexp_extract(c, ":([^:>]*)>$", 1), F.lit("")).cast(id_type)
    parsed = headers.select(
        rid(_field("WARC-Record-ID")).alias("page_id"), _field("WARC-Target-URI").alias("url"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("digest"),
        _field("WARC-Type").alias("record_type"), rid(_field("WARC-Refers-To")).alias("refers_to"))
    return parsed.join(_open(payloads, False), "digest").select(
        "page_id", "url", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, record, payload): the original records, byte by byte.

    A revisit's record has no block; its payload comes from the response's.
    """
    headers, payloads = _tables(spark, path)
    got = headers.join(_open(payloads, True), "digest")
    block = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return got.select("page_id", _field("WARC-Type").alias("record_type"), F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"), "payload")
