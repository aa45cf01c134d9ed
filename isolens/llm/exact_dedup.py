"""Exact deduplication by a tree merge of digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, text_of

DIGEST = ["text_sha256", "bytes", "check"]


def exact_dedup(docs: DataFrame, keep: str = "smallest", runs: int = 4096, fan_in: int = 16) -> DataFrame:
    """Group rows with identical texts.

    Every partition of the input makes a run with one row per digest. In each round, ``fan_in``
    neighbouring runs exchange their rows by digest and merge them, keeping the count and the
    ``keep`` ("smallest" or "largest") doc_id of each digest, until one run is left, which is spread
    over all tasks by digest. So a text that fills a third of the table reaches any task as at most
    ``fan_in`` rows. The digest of a level is SHA-256 together with the length in bytes and an
    XXH64 of the text; rows merge only when all three agree.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.
    A null text counts as empty. A null doc_id never is a keep_id unless all ids of the group are
    null. Rows that repeat both doc_id and text are one document to this operator: all of them are
    kept, or none. An empty table gives an empty result; further columns are ignored.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = text_of()
    rows = save(docs.select(
        "doc_id", F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(text).alias("check"), F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run")), "digests")
    level = rows.groupBy("run", *DIGEST).agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    while runs > 1:
        runs = -(-runs // fan_in)
        up = F.floor(F.col("run") / fan_in).cast("int") if runs > 1 else F.lit(0)
        level = level.withColumn("run", up).groupBy("run", *DIGEST).agg(
            best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return rows.join(level.drop("run"), DIGEST).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
