"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Words are runs of anything but the ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a copy that outlives executors; the folder is deleted when the
    driver ends. The shuffle files behind it are of no more use, so the driver is asked to collect
    its garbage, which makes executors delete them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Empty the folders of saved tables that nothing reads any more: an empty table is written over each."""
    for df in tables:
        files = df.inputFiles()
        if files:
            df.sparkSession.range(0).write.mode("overwrite").parquet(unquote(files[0].rpartition("/")[0]))


def sent_if_small(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``df`` saved, and marked for broadcast if it has at most ``rows`` rows; larger ones are shuffled."""
    df = save(df, name)
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def text_of(name: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the words of a text, in order."""
    blanks = F.translate(c, "\t\n\x0b\x0c\r", " " * 5)
    return F.filter(F.split(blanks, " "), lambda w: w != "")


def text_key(c: Column) -> Column:
    """128 bits that stand for a text (two XXH64 with different leading values, and its length)."""
    return F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2"), F.octet_length(c).alias("n"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: one row ``(node, component)`` per node of an edge.

    The component is named by its smallest node. Large-star and small-star rounds alternate until
    the edges no longer change; each round joins edges with one minimum per node, so no
    neighbourhood is gathered, and a hub is split by the skew-join rule. The number of rounds grows
    with the logarithm of the longest chain.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = save(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        e = save(small.select("p.u", "p.v").where("u != v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
