"""Exact ranks and samples that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relations import as_list, null_safe_join

BUCKETS = 4096


def hash_order(key: Column | str, seed: int) -> Column:
    return F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(seed))


def hash_bucket(h: Column, buckets: int = BUCKETS) -> Column:
    """Buckets that keep the order of a 64-bit hash."""
    shift = 64 - (buckets.bit_length() - 1)
    return F.shiftright(h, shift).cast("int")


def exact_rank(df: DataFrame, keys, order: Sequence[Column], bucket: Column, out: str = "rank") -> DataFrame:
    """Row number per key over a total order.

    ``bucket`` must not decrease along the order.  Bucket sizes give each bucket its offset, and only
    rows of one (key, bucket) meet in a task.
    """
    keys = as_list(keys)
    b = df.withColumn("__b", bucket)
    sizes = b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = W.partitionBy(*keys, "__b").orderBy(*order)
    return (null_safe_join(b, sizes, [*keys, "__b"], "left")
            .withColumn(out, F.row_number().over(inner) + F.col("__off")).drop("__b", "__off"))


def with_row_id(df: DataFrame, order: str, bucket: Column, keys=(), out: str = "row_id") -> DataFrame:
    """Running row number over a unique order column."""
    return exact_rank(df, keys, [F.col(order)], bucket, out)


def sample_up_to(df: DataFrame, take: Column | int | str, by=(), key: str = "id", seed: int = 1) -> DataFrame:
    """Up to ``take`` rows per stratum in a seeded hash order; repeatable on any partitioning.

    ``take`` may be a column that is constant within a stratum.  Bucket sizes tell which buckets of
    the hash order lie inside the sample; only the rows of the bucket that the cut runs through are
    ordered.
    """
    by = as_list(by)
    take = F.lit(take) if isinstance(take, int) else F.col(take) if isinstance(take, str) else take
    d = df.withColumns({"__h": hash_order(key, seed), "__take": take}).withColumn("__b", hash_bucket(F.col("__h")))
    sizes = d.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, 0))
    d = null_safe_join(d, sizes.withColumn("__upto", upto), [*by, "__b"], "left").where(F.col("__upto") - F.col("__n") < F.col("__take"))
    inner = W.partitionBy(*by, "__b").orderBy("__h", key)
    cut = d.where(F.col("__upto") > F.col("__take")).withColumn("__rank", F.row_number().over(inner) + F.col("__upto") - F.col("__n"))
    cut = cut.where(F.col("__rank") <= F.col("__take"))
    return d.where(F.col("__upto") <= F.col("__take")).select(df.columns).unionByName(cut.select(df.columns))


def best_per_key(df: DataFrame, keys, order: Sequence[tuple[str, bool]], ties: Sequence[str] = ()) -> DataFrame:
    """First row per key after a multi-column sort, without sorting: a struct minimum per key.

    ``order`` lists (column, ascending); descending columns must be numeric or boolean.  Nulls come
    last in both directions.  ``ties`` (then all other columns) settle equal rows.
    """
    keys = as_list(keys)
    lead = []
    for i, (c, asc) in enumerate(order):
        v = F.col(c).cast("int") if dict(df.dtypes)[c] == "boolean" else F.col(c)
        lead.append(F.col(c).isNull().alias(f"n{i}"))
        lead.append((v if asc else -v).alias(f"o{i}"))
    rest = [F.col(c).alias(f"t{i}") for i, c in enumerate(ties)]
    row = F.struct(*[c for c in df.columns if c not in keys]).alias("row")
    g = df.groupBy(*keys).agg(F.min(F.struct(*lead, *rest, row)).alias("__m"))
    return g.select(*[F.col(c) if c in keys else F.col(f"__m.row.{c}").alias(c) for c in df.columns])


def top_k(df: DataFrame, key: str, k: int, weight: str | None = None) -> DataFrame:
    """Most frequent values; ties go to the smaller value."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(key).agg(n.alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def order_by_levels(df: DataFrame, column: str, levels: Sequence[str], *then) -> DataFrame:
    """Sort by an explicit level order; unknown levels come last."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    return df.orderBy(F.when(F.coalesce(pos, F.lit(0)) == 0, F.lit(len(levels) + 1)).otherwise(pos), *then)


def level_index(column: str, levels: Sequence[str]) -> Column:
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    return F.when(pos > 0, pos.cast("int"))


def truncate(df: DataFrame, by, order: Sequence[Column], bucket: Column, n: Column | int) -> DataFrame:
    """First ``n`` rows per key in arrival order."""
    n = F.lit(n) if isinstance(n, int) else n
    return exact_rank(df, by, order, bucket, "__rank").where(F.col("__rank") <= n).drop("__rank")
