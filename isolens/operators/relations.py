"""Joins, set operations and guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_size

KEY = "__key_"


def as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Equi join in which null keys match each other; the right key columns are dropped."""
    on = as_list(on)
    right = right.withColumnsRenamed({k: KEY + k for k in on})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[KEY + k]) for k in on])
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[KEY + k for k in on])


def select_cohort(master: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows of ``master`` whose key occurs in ``keys`` (null matches null)."""
    return null_safe_join(master, keys.select(*as_list(on)), on, "left_semi")


def exclude(df: DataFrame, other: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows whose key does not occur in ``other`` (null matches null)."""
    return null_safe_join(df, other.select(*as_list(on)), on, "left_anti")


def filter_by_ids(df: DataFrame, ids: DataFrame, on: str, keep: bool = True) -> DataFrame:
    """Keep or drop rows by exact id; an id that is a prefix of another never matches it."""
    return df.join(ids.select(on), on, "left_semi" if keep else "left_anti")


def unique_or_fail(df: DataFrame, on: Sequence[str] | str, label: str = "right side") -> DataFrame:
    """The same rows, failing at run time if a key occurs twice.  Combines before the shuffle."""
    on = as_list(on)
    rest = [c for c in df.columns if c not in on]
    g = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*rest)).alias("__v"))
    guarded = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"duplicate key in {label}: {', '.join(on)}")).cast(
        g.schema["__v"].dataType)).otherwise(F.col("__v"))
    return g.select(*on, guarded.alias("__v")).select(*on, "__v.*")


def left_join_1to1(a: DataFrame, b: DataFrame, on: Sequence[str] | str, validate: bool = True) -> DataFrame:
    return null_safe_join(a, unique_or_fail(b, on) if validate else b, on, "left")


def compare_on_key(a: DataFrame, b: DataFrame, keys, suffixes=("_a", "_b")) -> DataFrame:
    """Inner join on the key with every other column suffixed by side."""
    keys = as_list(keys)
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in a.columns if c not in keys})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in b.columns if c not in keys})
    return null_safe_join(left, right, keys, "inner")


def compare_counts(a: DataFrame, b: DataFrame, key, value: str = "n") -> DataFrame:
    """Full outer comparison of two count tables, absent counts read as zero and null keys equal."""
    key = as_list(key)
    zero = F.lit(None).cast("bigint")
    left = a.select(*key, F.col(value).alias("old_n"), zero.alias("new_n"))
    right = b.select(*key, zero.alias("old_n"), F.col(value).alias("new_n"))
    joined = left.unionByName(right).groupBy(*key).agg(F.max("old_n").alias("old_n"), F.max("new_n").alias("new_n"))
    old, new = F.coalesce("old_n", F.lit(0)), F.coalesce("new_n", F.lit(0))
    return joined.select(*key, old.alias("old_n"), new.alias("new_n"), (new - old).alias("difference"))


def expect(df: DataFrame, predicate: Column, message: str) -> DataFrame:
    """The same rows; the job fails on the first row for which the predicate is not true."""
    return df.where(F.assert_true(F.coalesce(predicate, F.lit(False)), message).isNull())


def merge_audited(meta: DataFrame, audit: DataFrame, labels: DataFrame, key, rules: Sequence[tuple[Column, str]],
                  label_key: str, take: Sequence[str]) -> DataFrame:
    """Exact merge of a metadata table with its audit and the label table, under field rules.

    Both sides must hold the same keys once; every rule must hold on every merged row.
    """
    key = as_list(key)
    a = unique_or_fail(audit, key, "audit").withColumn("__hit", F.lit(True))
    m = unique_or_fail(meta, key, "metadata").withColumn("__have", F.lit(True))
    merged = m.join(a, key, "full_outer")
    merged = expect(merged, F.col("__hit") & F.col("__have"), "key sets of metadata and audit differ")
    merged = merged.join(unique_or_fail(labels, label_key, "labels"), label_key, "left")
    for predicate, message in rules:
        merged = expect(merged, predicate, message)
    return merged.select(*meta.columns, *take)


def flag_members(df: DataFrame, ids: DataFrame, on: Sequence[str] | str, name: str) -> DataFrame:
    """Boolean column: does the key occur in ``ids``."""
    on = as_list(on)
    marks = ids.select(*on).distinct().withColumn(name, F.lit(True))
    return null_safe_join(df, marks, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def enrich(df: DataFrame, info: DataFrame, on: str, order: Sequence[str] = ()) -> DataFrame:
    """Left join with one info row per key (smallest by ``order``, or by the values themselves)."""
    rest = [c for c in info.columns if c != on]
    lead = list(order) + [c for c in rest if c not in order]
    one = info.groupBy(on).agg(F.min(F.struct(*lead)).alias("__i")).select(on, *[F.col(f"__i.{c}").alias(c) for c in rest])
    return df.join(one, on, "left")


def group_pairs(groups: DataFrame, col: str, order: Column | None = None) -> DataFrame:
    """All unordered pairs of the (few) group labels."""
    labels = groups.select(col).where(F.col(col).isNotNull()).distinct()
    packed = labels.agg(F.array_sort(F.collect_set(col)).alias("g")) if order is None else labels.agg(
        F.transform(F.array_sort(F.collect_set(F.struct(order.alias("o"), F.col(col).alias("v")))), lambda s: s["v"]).alias("g"))
    return (packed.select(F.posexplode("g").alias("i", "group1"), "g")
            .select("group1", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("group2")))


def with_denominator(df: DataFrame, base: DataFrame, keys, n: str = "n", total: str = "n_total") -> DataFrame:
    """Attach the true group size counted on ``base`` and the percent of it."""
    keys = as_list(keys)
    den = base.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
    return null_safe_join(df, den, keys, "left").withColumn("pct", 100.0 * F.try_divide(F.col(n), F.col(total)))


def lookup_priority(queries: DataFrame, ref: DataFrame, query: str, key_cols: Sequence[str], resolved: Sequence[str],
                    dedupe: bool = True) -> DataFrame:
    """Find each query in several key columns of ``ref``; the first column that matches wins.

    Ties inside a key column go to the smallest row.  With ``dedupe`` one query (the smallest) is
    kept per resolved id, the first non-null of ``resolved``.
    """
    row = F.struct(*[F.col(c) for c in ref.columns])
    keyed = ref.select(
        F.explode(F.array(*[F.struct(F.lower(F.trim(F.col(c).cast("string"))).alias("k"), F.lit(i).alias("prio"))
                            for i, c in enumerate(key_cols)])).alias("e"), row.alias("row"),
    ).where(F.col("e.k").isNotNull() & (F.col("e.k") != ""))
    best = keyed.groupBy(F.col("e.k").alias("__k")).agg(F.min(F.struct(F.col("e.prio").alias("prio"), "row")).alias("b"))
    hits = (queries.select(query).distinct().withColumn("__k", F.lower(F.trim(F.col(query)))).join(best, "__k")
            .select(F.col(query).alias("query"), (F.col("b.prio") + 1).alias("match_rank"), "b.row.*"))
    if dedupe:
        uid = F.coalesce(*[F.col(c).cast("string") for c in resolved])
        hits = (hits.groupBy(uid.alias("resolved_id"))
                .agg(F.min_by(F.struct(*hits.columns), "query").alias("h")).select("resolved_id", "h.*"))
    return hits


def pick_first_source(df: DataFrame, ref: DataFrame, alt: DataFrame, on: str, value: str,
                      names=("reference", "rescued"), blank: Column | None = None,
                      blank_status: str = "blank", none_status: str = "not_found") -> DataFrame:
    """Value from the first source that has one, with the source named; both sources keyed once."""
    def one(side, tag):
        return side.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(on).agg(F.max(value).alias(tag))

    j = df.join(one(ref, "__r"), on, "left").join(one(alt, "__a"), on, "left")
    skip = blank if blank is not None else F.lit(False)
    r, a = F.when(~skip, F.col("__r")), F.when(~skip, F.col("__a"))
    source = F.when(r.isNotNull(), F.lit(names[0])).when(a.isNotNull(), F.lit(names[1])).otherwise(F.lit("N/A"))
    status = (F.when(skip, F.lit(blank_status)).when(r.isNotNull(), F.lit("matched_" + names[0]))
              .when(a.isNotNull(), F.lit(names[1] + "_representative")).otherwise(F.lit(none_status)))
    return (j.withColumn("value_source", source).withColumn("value_status", status)
            .withColumn("value", F.coalesce(r, a, F.lit("N/A"))).drop("__r", "__a"))


# --- set operations -------------------------------------------------------------------------


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_by(df: DataFrame, keys, order: Sequence[str] = ()) -> DataFrame:
    """First row per key by ``order`` (then by all other columns); combines before the shuffle."""
    keys = as_list(keys)
    rest = list(order) + [c for c in df.columns if c not in keys and c not in order]
    if not rest:
        return df.distinct()
    g = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r"))
    return g.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def compare_sets(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Sizes of both key sets, their overlap and differences, equality and subset flags (one row)."""
    on = as_list(on)
    tagged = union_all(a.select(*on).distinct().withColumn("__a", F.lit(1)).withColumn("__b", F.lit(0)),
                       b.select(*on).distinct().withColumn("__a", F.lit(0)).withColumn("__b", F.lit(1)))
    per = tagged.groupBy(*on).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    both = (F.col("__a") == 1) & (F.col("__b") == 1)
    out = per.agg(
        F.count_if(F.col("__a") == 1).alias("n_a"), F.count_if(F.col("__b") == 1).alias("n_b"),
        F.count_if(both).alias("n_both"),
        F.count_if((F.col("__a") == 1) & (F.col("__b") == 0)).alias("only_a"),
        F.count_if((F.col("__a") == 0) & (F.col("__b") == 1)).alias("only_b"),
    )
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0)).withColumn("a_in_b", F.col("only_a") == 0)


def label_by_precedence(base: DataFrame, sets: Sequence[tuple[str, DataFrame]], on: str, default: str,
                        label: str = "label") -> DataFrame:
    """Label of the first set (in the given order) that holds the id, else ``default``."""
    tagged = union_all(*[s.select(on).withColumn("__o", F.lit(i)).withColumn("__l", F.lit(name))
                         for i, (name, s) in enumerate(sets)])
    first = tagged.groupBy(on).agg(F.min(F.struct("__o", "__l")).alias("__f"))
    return base.join(first, on, "left").select(
        *base.columns, F.coalesce(F.col("__f.__l"), F.lit(default)).alias(label))


def find_duplicates(df: DataFrame, keys) -> DataFrame:
    """Rows whose key occurs more than once."""
    keys = as_list(keys)
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys)
    return null_safe_join(df, repeated, keys, "left_semi")


def resolve_duplicates(df: DataFrame, key: str, call: str, value: str | None = None) -> DataFrame:
    """One row per key: number of rows and of distinct calls, the agreed call, the largest value.

    ``conflict`` marks keys whose rows disagree; their call is null.
    """
    # two-step distinct count, so a key with very many rows never lands in one buffer
    per_call = df.where(F.col(key).isNotNull()).groupBy(key, call).agg(
        F.count(F.lit(1)).alias("__n"), *([F.max(value).alias("__v")] if value else []))
    g = per_call.groupBy(key).agg(
        F.sum("__n").alias("n_rows"), F.count(call).alias("n_calls"), F.max(call).alias("__c"),
        *([F.max("__v").alias(f"max_{value}")] if value else []))
    return (g.withColumn("conflict", F.col("n_calls") > 1)
            .withColumn(call, F.when(F.col("n_calls") <= 1, F.col("__c"))).drop("__c"))


def flag_in_interval(points: DataFrame, intervals: DataFrame, by: str, pos: str, start: str, end: str,
                     name: str = "masked", bucket: int = 1024) -> DataFrame:
    """Flag points that lie in a closed interval of the same ``by`` value.

    Intervals are cut into position buckets so the match is an equi join on (by, bucket); distinct
    positions are matched once and the flag is joined back, so no point is multiplied. Points are dealt out by
    (by, position), so a task's share does not grow with the table.
    """
    def slot(c):
        return F.floor(F.col(c) / F.lit(bucket))

    iv = intervals.select(F.col(by), F.col(start).alias("__s"), F.col(end).alias("__e")).where(F.col("__s") <= F.col("__e"))
    iv = iv.select("*", F.explode(F.sequence(slot("__s"), slot("__e"))).alias("__b"))
    pts = by_size(points.select(by, pos).where(F.col(pos).isNotNull()), by, pos).distinct().withColumn("__b", slot(pos))
    hit = pts.join(iv, (pts[by] == iv[by]) & (pts["__b"] == iv["__b"])
                   & (pts[pos] >= iv["__s"]) & (pts[pos] <= iv["__e"]), "left_semi")
    return (by_size(points, by, pos).join(hit.select(by, pos, F.lit(True).alias(name)), [by, pos], "left")
            .select(*points.columns, F.coalesce(F.col(name), F.lit(False)).alias(name)))
