"""Sinks: twin CSV / TSV, partitioned Parquet, text, checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Endings of files that Spark unpacks while it reads text.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"


def write_both(df: DataFrame, base: str, mode: str = "overwrite") -> None:
    """``<base>_csv`` and ``<base>_tsv`` with header; null is written as an empty field."""
    for sep, ext in ((",", "csv"), ("\t", "tsv")):
        df.write.mode(mode).option("header", True).option("sep", sep).option("nullValue", "").option("emptyValue", "").csv(f"{base}_{ext}")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet in ``by=value`` folders; small folders get one file, a hot one is split over many tasks."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("value").write.mode(mode).text(path)


def file_checksums(spark: SparkSession, path, algorithm: str = "md5", chunk: int = 1 << 20) -> DataFrame:
    """Path, length and digest of each file, of any size.

    Files are read in parallel as raw stretches between line feeds, joined to chunks of about ``chunk`` bytes;
    the chunks of a file are put in order by a sort that can spill, and stream through one digest, so memory
    does not grow with the file. A stretch of 2 GB without a line feed cannot be read. Spark would
    unpack compressed text on the way, so files with such an ending are read whole (up to 2 GB each).
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def whole(content: pd.Series) -> pd.Series:
        return content.map(lambda x: hashlib.new(algorithm, x).hexdigest())

    files = spark.read.format("binaryFile").load(path)
    # scans leave empty files out, so those come from the list of names that Spark's reader holds
    names = spark.createDataFrame([(n,) for n in files.inputFiles()], "name string")
    names = names.select(F.url_decode(F.replace(F.regexp_replace("name", "^file:/+", "file:/"), F.lit("+"), F.lit("%2B"))).alias("path"))
    name = F.col("_metadata.file_path")
    packed = name.rlike(PACKED)
    files = files.select("path", name.alias("__file"), "length", "content")
    small = files.where(F.col("__file").rlike(PACKED)).select("path", "length", whole("content").alias(algorithm))
    raw = spark.read.option("lineSep", "\n").text(path).where(~packed)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                     F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, number = None, [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [at[0]], "size": [at[1]], "start": [at[2]], "number": pa.array([number], pa.int64()), "data": [b"".join(held)]})

        for b in batches:
            for *place, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (place != at or size >= chunk):
                    yield row()
                    held, size, number = [], 0, number + 1
                at = place
                held += [line, b"\n"]
                size += len(line) + 1
        if held:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, size, seen, sha = None, 0, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [path], "digest": [sha.hexdigest()]})

        for b in batches:
            for p, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != path:
                    if path is not None:
                        yield row()
                    path, size, seen, sha = p, n, 0, hashlib.new(algorithm)
                sha.update(data[:size - seen])  # the last line may lack the line feed that reading gave it
                seen += len(data)
        if path is not None:
            yield row()

    parts = raw.mapInArrow(chunks, "path string, size long, start long, number long, data binary")
    ordered = parts.repartition("path").sortWithinPartitions("path", "start", "number").select("path", "size", "data")
    found = ordered.mapInArrow(digests, "path string, digest string")
    large = files.drop("content").where(~F.col("__file").rlike(PACKED)).join(found.withColumnRenamed("path", "__file"), "__file")
    empty = names.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(hashlib.new(algorithm).hexdigest()).alias(algorithm))
    return large.select("path", "length", F.col("digest").alias(algorithm)).unionByName(small).unionByName(empty)
