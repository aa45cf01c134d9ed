"""Content-addressed web archive: payloads stored once by digest, record headers beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save

CRLF = "\r\n"
ID = "urn:page:"


def write_archive(pages: DataFrame, folder: str, revisit_from: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one WARC/1.1 record per row of ``pages`` (``page_id, url, html``) to ``folder``.

    ``payloads`` holds each distinct payload once, by SHA-1 and SHA-256; ``headers`` holds the exact
    header bytes of every record with the digests. Of the records with equal payloads of at least
    ``revisit_from`` bytes, the one with the largest page_id (then the largest url) is a response,
    the others are revisit records that refer to it and have no block; smaller ones are all
    responses.

    A null html is an empty payload, a null url an empty target, a null page_id an id without
    number, smaller than all others. Of repeated rows, exactly one may be the response. Line breaks in
    a url are percent-encoded. An empty table gives an empty archive; further columns are ignored.

    Only digests are grouped. A payload is shuffled only when its digest occurs more than once, and
    only if the table of such digests is too large to be sent to all executors.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    base = pages.select("page_id", url.alias("url"), payload.alias("payload")).select(
        "page_id", "url", F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), F.length("payload").cast("long").alias("bytes"), "payload")
    keys = ["sha1", "sha256", "bytes"]
    marks = save(base.drop("payload").groupBy("page_id", "url", *keys).agg(F.count("*").alias("n")), "records")
    first = marks.groupBy(*keys).agg(F.max(F.struct("page_id", "url")).alias("first"), F.sum("n").alias("copies"))
    first = save(first.where("copies > 1"), "repeated")

    once = base.join(first, keys, "left_anti").select(*keys, "payload")
    again = base.join(first, keys, "left_semi").groupBy(*keys).agg(F.first("payload").alias("payload"))
    once.unionByName(again).write.parquet(f"{folder}/payloads")

    records = marks.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    records = records.join(first.drop("copies"), keys, "left")
    is_first = (F.struct("page_id", "url").eqNullSafe(F.col("first"))) & (F.col("copy") == 1)
    revisit = (F.col("bytes") >= revisit_from) & F.col("first").isNotNull() & ~is_first
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = F.coalesce(F.col("first.page_id").cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{ID}"), number, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{ID}"), target, F.lit(">"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2))
    records.select(*keys, F.encode(header, "UTF-8").alias("header")).write.parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Rebuild every record of an archive from its header and, for responses, its payload.

    Returns ``record`` (the bytes of the WARC record), ``header``, ``payload`` (of revisits too) and
    ``verified``: the stored payload has the digests under which it is filed. A header whose payload
    is missing keeps its row with a null payload and ``verified`` false.
    """
    keys = ["sha1", "sha256", "bytes"]
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    stored = payloads.select(*keys, "payload", (
        (F.sha1("payload") == F.col("sha1")) & (F.sha2("payload", 256) == F.col("sha256")) & (F.length("payload") == F.col("bytes"))).alias("verified"))
    both = headers.join(stored, keys, "left")
    text = F.decode("header", "UTF-8")
    block = F.when(text.contains("WARC-Type: revisit"), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    record = F.concat("header", block, F.encode(F.lit(CRLF * 2), "UTF-8"))
    return both.select(record.alias("record"), text.alias("header"), "payload", F.coalesce("verified", F.lit(False)).alias("verified"))


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of records as ``read_archive`` returns them; a header field that is missing is null."""
    def field(name: str, rest: str):
        found = F.regexp_extract("header", rf"(?m)^{name}: {rest}\r?$", 1)
        return F.when(found != "", found)

    return records.select(
        field("WARC-Record-ID", f"<{ID}([0-9-]*)>").cast("long").alias("page_id"),
        field("WARC-Target-URI", "(.*)").alias("url"),
        field("WARC-Type", "(.*)").alias("record_type"),
        field("WARC-Payload-Digest", "sha1:(.*)").alias("payload_digest"),
        field("WARC-Refers-To", f"<{ID}([0-9-]*)>").cast("long").alias("refers_to"),
        F.length("payload").cast("long").alias("payload_bytes"), "payload", "verified")
