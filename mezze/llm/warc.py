"""WARC archives with revisit records for repeated payloads.

Only headers (page, digest, length) are shuffled by payload digest, to find each digest's first page. Records are written
with fresh headers through Spark's own text writer, so a task that is run again leaves no double files; read back, revisits
are joined to the responses they refer to.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mezze.llm.common import saved, scratch_path

#: Payloads under so many bytes are never made revisits.
LEAST = 0
#: Bytes of payloads that one archive file is meant to hold; a task with more writes several.
FILE_BYTES = 32 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Ends each record; Spark's writer puts it after every row.
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of the text's UTF-8 bytes: five hex digits make four letters."""
    letter = lambda v, s: F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1))
    hexes = F.sha1(text)
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(hexes, g * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    return F.array_join(F.transform(groups, lambda v: F.concat(*[letter(v, s) for s in (15, 10, 5, 0)])), "")


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_digest, payload_bytes, refers_to: null for a response, else the page whose payload is the same.

    Of equal payloads of at least `least` bytes, the smallest page_id is the response. Repeated rows of that page are
    responses, too. A null page_id refers to the smallest one, if there is any. Null html is an empty payload.
    """
    html = F.coalesce("html", F.lit(""))
    heads = saved(pages.select("page_id", base32_sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes")), "warc-heads")
    firsts = saved(heads.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1"), "warc-firsts")
    joined = heads.join(firsts.select("payload_digest", "first_id"), "payload_digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.col("first_id"))
    return joined.select("page_id", "payload_digest", "payload_bytes", refers.alias("refers_to"))


def _record(kind: Column) -> Column:
    """Headers and block of a record, without the end. A revisit has no block."""
    uid = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    target = F.regexp_replace(F.coalesce("url", F.lit("urn:unknown")), r"[\x00-\x20\x7F]", "")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), uid(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(F.col("refers_to").isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Refers-To: "), uid(F.col("refers_to")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.lit(0)).cast("string"),
        F.lit(END), F.when(F.col("refers_to").isNull(), F.coalesce("html", F.lit(""))).otherwise(""),
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """Write `pages` (page_id, url, html) as gzipped archives under `path`, each distinct payload once.

    Pages are joined to the few revisits by page and digest, so payloads are not sorted by digest. A null url becomes
    urn:unknown. Files end in .txt.gz, as Spark names them, and are WARC files inside.
    """
    spark = pages.sparkSession
    decided = saved(resolve(pages, least), "warc-decided")
    n, total = decided.agg(F.count("*"), F.sum("payload_bytes")).first()
    records = max(1, file_bytes * n // max(1, total or 0))
    revisits = decided.filter("refers_to IS NOT NULL").select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), "refers_to").distinct()
    html = F.coalesce("html", F.lit(""))
    headed = pages.select("page_id", "url", "html", base32_sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    joined = headed.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    record = _record(F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    joined.select(record.alias("value")).write.option("maxRecordsPerFile", records).option("lineSep", END).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, found by its Content-Length."""
    at = 0
    while (start := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", start)
        head = dict(line.split(": ", 1) for line in data[start:end].decode("utf-8").split("\r\n")[1:])
        head = {k.lower(): v for k, v in head.items()}
        block = data[end + 4 : end + 4 + int(head["content-length"])]
        yield head, block
        at = end + 4 + len(block) + 4


HEADS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, html string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The columns of HEADS for each record: a response's digest and length are those of its block, a revisit's are its header's and null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        page = lambda x: int(x[10:-1]) if x and x[10:-1] != "null" else None
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for head, block in parse(zlib.decompress(content, 31)):
                    response = head["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(block).digest()).decode() if response else head["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((page(head["warc-record-id"]), head["warc-type"], len(block) if response else None, digest, page(head.get("warc-refers-to")), head["warc-target-uri"], block.decode("utf-8") if response else None))
                if not rows:
                    continue
                frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in HEADS.split(", ")])
                yield frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(run, HEADS)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take the length of the response they refer to."""
    heads = saved(records.drop("html", "url"), "warc-read")
    originals = heads.filter("record_type = 'response'").select(F.col("page_id").alias("o_id"), F.col("payload_digest").alias("o_digest"), F.col("payload_bytes").alias("o_bytes")).distinct()
    revisits = heads.filter("record_type = 'revisit'").join(originals, (F.col("refers_to") == F.col("o_id")) & (F.col("payload_digest") == F.col("o_digest")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return heads.filter("record_type = 'response'").select(columns).unionByName(revisits.withColumn("payload_bytes", F.col("o_bytes")).select(columns))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder, read them back and resolve their revisits; an empty table gives no rows."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return resolved(read_archives(pages.sparkSession, path))
