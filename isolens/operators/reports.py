"""Count, prevalence, burden and weight reports.

Row-level work is a projection or a combinable aggregate; windows run only over the resulting count
tables, whose size depends on the number of categories and not on the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..session import saved
from .ranking import exact_rank, hash_bucket, level_index, top_k
from .relations import as_list, null_safe_join, union_all

#: Combinations of seen values that a completed grid may have.
MOST_CELLS = 10_000_000_000


def counts(df: DataFrame, keys, name: str = "n", keep_null: bool = True) -> DataFrame:
    keys = as_list(keys)
    if not keep_null:
        df = df.dropna(subset=keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_share(df: DataFrame, keys, col: str = "n", total: str = "total", pct: str = "pct") -> DataFrame:
    """Group total beside each row of a count table, and the percent of it."""
    w = W.partitionBy(*as_list(keys))
    return df.withColumn(total, F.sum(col).over(w)).withColumn(pct, 100.0 * F.try_divide(F.col(col), F.col(total)))


def counts_with_total(df: DataFrame, keys, within=(), name: str = "n", total: str = "total", pct: str = "pct") -> DataFrame:
    """Counts by ``keys`` with the total of ``within`` beside each row, for keys without bound.

    One grouping-sets pass gives counts and totals; the totals, few next to the counts, are joined back, so
    no group of counts meets in one task as it would in a window.
    """
    keys, within = as_list(keys), as_list(within)
    g = df.groupingSets([keys, within], *keys).agg(F.count(F.lit(1)).alias(name), F.grouping_id().alias("__g"))
    g = saved(g, "counts")
    rows = g.where("__g = 0").drop("__g")
    totals = g.where("__g > 0").select(*within, F.col(name).alias(total))
    rows = null_safe_join(rows, totals, within, "left") if within else rows.withColumn(total, one_value(totals, F.max(total)))
    return rows.withColumn(pct, 100.0 * F.try_divide(F.col(name), F.col(total)))


def pct_within(df: DataFrame, keys, within) -> DataFrame:
    return with_share(counts(df, keys), within)


def normalise(df: DataFrame, keys, col: str, out: str = "p") -> DataFrame:
    """x / sum(x) in the group, 0 where the group sums to 0."""
    total = F.sum(col).over(W.partitionBy(*as_list(keys)))
    return df.withColumn(out, F.when(total > 0, F.col(col) / total).otherwise(F.lit(0.0)))


def lump_rare(df: DataFrame, col: str, n: int, other: str = "Other") -> DataFrame:
    """Replace categories with fewer than ``n`` rows."""
    keep = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n).select(col, F.lit(True).alias("__k"))
    out = null_safe_join(df, keep, col, "left")
    return out.withColumn(col, F.when(F.col("__k"), F.col(col)).otherwise(F.lit(other))).drop("__k")


def one_value(df: DataFrame, value: Column) -> Column:
    """An aggregate of ``df`` as a scalar subquery, usable in any projection."""
    return df.agg(value.alias("v")).scalar()


def _numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The values seen in a column, null among them, numbered from 0 in a hash order, and their count."""
    h = F.xxhash64(F.struct(name))
    seen = saved(df.select(name).distinct().withColumn("__h", h), "seen")
    ids = exact_rank(seen, (), [F.col("__h"), F.col(name)], hash_bucket(F.col("__h")), "__id")
    return ids.select(name, (F.col("__id") - 1).cast("long").alias(f"__{name}")), seen.count()


def complete(df: DataFrame, dims: dict[str, Sequence | None], fill: dict, most: int = MOST_CELLS) -> DataFrame:
    """Every combination of the dimension values, missing measures filled.

    ``None`` takes the values seen in the (already aggregated) table, null too; a list names them and should be
    short. Several seen dimensions are numbered, and the numbers of all their combinations, a plain range, are
    joined back to the values; no list of values is held in one place. More than ``most`` combinations are refused.
    """
    seen = [n for n, values in dims.items() if values is None]
    if len(seen) > 1:
        parts = [(n, *_numbered(df, n)) for n in seen]
        cells = math.prod(count for _, _, count in parts) * math.prod(len(v) for v in dims.values() if v is not None)
        if cells > most:
            raise ValueError(f"{cells} combinations of {list(dims)}, more than {most}")
        grid, step = df.sparkSession.range(math.prod(count for _, _, count in parts)), 1
        for name, ids, count in parts:
            grid = grid.withColumn(f"__{name}", F.floor(F.col("id") / step).cast("long") % count).join(ids, f"__{name}").drop(f"__{name}")
            step *= count
        grid = grid.drop("id")
    else:
        grid = df.select(*seen).distinct() if seen else None
    for name, values in dims.items():
        if values is not None:
            one = df.sparkSession.createDataFrame([(v,) for v in values], f"{name} {dict(df.dtypes)[name]}") if grid is None else None
            grid = one if grid is None else grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    grid = grid.select(*dims)
    out = null_safe_join(grid, df, list(dims), "left")
    return out.select(*[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in df.columns])


def group_sizes(df: DataFrame, col: str, order: Sequence[str], name: str = "n") -> DataFrame:
    """Counts in a fixed label order, zero for labels without rows."""
    c = complete(counts(df.where(F.col(col).isin(*order)), col, name), {col: order}, {name: 0})
    return c.withColumn("position", level_index(col, order))


# --- markers ---------------------------------------------------------------------------------


def explode_tokens(df: DataFrame, array_col: str, out: str = "marker", outer: bool = False) -> DataFrame:
    fn = F.explode_outer if outer else F.explode
    return df.withColumn(out, fn(array_col)).drop(array_col)


def marker_counts(df: DataFrame, keys, markers: str) -> DataFrame:
    """Rows per key and marker (``n``) beside the rows of the key (``n_total``), from one pass over the rows."""
    keys = as_list(keys)
    d = df.select(*keys, F.explode(F.array_append(markers, F.lit(None).cast("string"))).alias("marker"))
    c = counts(d, [*keys, "marker"])
    # the null marker, one of each row, counts the rows of the key; the window runs over the few markers of a key
    c = c.withColumn("n_total", F.max(F.when(F.col("marker").isNull(), F.col("n"))).over(W.partitionBy(*keys)))
    return c.where("marker IS NOT NULL")


def marker_frequency(df: DataFrame, id_col: str, markers: str, clamp_hi: bool = True,
                     susceptible: str = "Q/FQ-susceptible", kind: str = "QR/FQR marker") -> DataFrame:
    """Isolates per marker with rate and interval, plus one row for isolates without any marker.

    ``markers`` is an array column holding each marker of the isolate once; one row per isolate.
    """
    # one pass: every isolate also emits one null marker, which counts all isolates and the bare ones
    d = df.select(F.explode(F.array_append(markers, F.lit(None).cast("string"))).alias("marker"), (F.size(markers) == 0).alias("bare"))
    c = d.groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.count_if("bare").alias("z"))
    c = c.select("marker", F.when(F.col("marker").isNull(), F.col("z")).otherwise(F.col("n")).alias("n_isolates"),
                 F.max(F.when(F.col("marker").isNull(), F.col("n"))).over(W.partitionBy()).alias("n_total"))
    none = F.col("marker").isNull()
    rows = c.select(F.coalesce("marker", F.lit(susceptible)).alias("marker"), F.when(none, F.lit(susceptible)).otherwise(F.lit(kind)).alias("type"),
                    "n_isolates", "n_total")
    ci = stats.rate_ci("n_isolates", "n_total", clamp_hi)
    return rows.select("marker", "type", "n_isolates", "n_total", *[v.alias(k) for k, v in ci.items()])


def marker_burden(df: DataFrame, id_col: str, markers: str, sep: str = ";") -> DataFrame:
    """Number and sorted packed list of markers per isolate that has any; a projection, no shuffle."""
    return df.where(F.size(markers) > 0).select(
        id_col, F.size(markers).alias("n_markers"), F.array_join(F.array_sort(markers), sep).alias("markers"))


def burden_bins(burden: DataFrame) -> DataFrame:
    n = F.col("n_markers")
    b = F.when(n == 1, F.lit("1 marker")).when(n == 2, F.lit("2 markers")).when(n > 2, F.lit(">2 markers"))
    c = burden.select(b.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n_isolates"))
    return with_share(c, [], "n_isolates", "total", "pct_isolates").drop("total")


def marker_combinations(burden: DataFrame, lo: int, hi: int | None = None) -> DataFrame:
    """Counts of exact marker combinations with between ``lo`` and ``hi`` markers."""
    n = F.col("n_markers")
    sel = burden.where((n >= lo) & (n <= hi) if hi is not None else n >= lo)
    return counts_with_total(sel, ["n_markers", "markers"], (), "n_isolates").drop("total")


def genotype_signatures(df: DataFrame, year: str, markers: str, flags: dict[str, Column],
                        none: str = "QS/FQS (no marker)", sep: str = " + ") -> DataFrame:
    sig = F.when(F.size(markers) == 0, F.lit(none)).otherwise(F.array_join(F.array_sort(F.array_distinct(markers)), sep))
    return df.groupBy(year, sig.alias("signature")).agg(
        F.count(F.lit(1)).alias("n_available"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def topk_prevalence(df: DataFrame, id_cols, markers: str, keys, k: int = 5, basis: DataFrame | None = None,
                    others: str = "others") -> DataFrame:
    """Prevalence of the top-k markers and of all others, by key, over the true number of isolates.

    The k names come from ``basis`` (marker, one row per counted occurrence) or from the exploded
    markers; each isolate counts once per group, which the distinct inside its own array ensures.
    """
    keys = as_list(keys)
    base = basis if basis is not None else df.select(F.explode(markers).alias("marker"))
    return _group_prevalence(df, keys, markers, one_value(top_k(base, "marker", k), F.collect_set("marker")), others, None)


def _group_prevalence(df: DataFrame, keys: list[str], markers: str, top: Column, others: str, none: str | None) -> DataFrame:
    """Isolates per key and marker group with the true denominator, in one pass over the isolates.

    Each isolate also emits one null group; its count is the denominator.
    """
    groups = F.array_distinct(F.transform(markers, lambda m: F.when(F.array_contains("__top", m), m).otherwise(F.lit(others))))
    if none is not None:
        groups = F.when(F.size(markers) == 0, F.array(F.lit(none))).otherwise(groups)
    rows = df.withColumn("__top", top).select(*keys, F.explode(F.array_append(groups, F.lit(None).cast("string"))).alias("marker_group"))
    c = rows.groupBy(*keys, "marker_group").agg(F.count(F.lit(1)).alias("n"))
    total = F.max(F.when(F.col("marker_group").isNull(), F.col("n"))).over(W.partitionBy(*keys))
    c = c.withColumn("n_total", total).where(F.col("marker_group").isNotNull())
    return c.withColumn("pct", 100.0 * F.try_divide("n", "n_total"))


def bucket_stack(df: DataFrame, cohort: str, period: str, bucket: str, periods: Sequence[str], buckets: Sequence[str]) -> DataFrame:
    """Cohort × period stack of exclusive buckets, zero-filled; percents of a period sum to 100."""
    c = counts(df.where(F.col(period).isNotNull()), [period, bucket], "count")
    c = complete(c, {period: periods, bucket: buckets}, {"count": 0})
    return with_share(c, period, "count", "total_n", "percent").withColumn("cohort", F.lit(cohort))


def multi_stack(df: DataFrame, keys, markers: str, top: DataFrame, none: str = "QS/FQS", others: str = "others") -> DataFrame:
    """Co-presence stack: one row per marker group of an isolate, unmarked isolates as their own group.

    Percents use the true number of isolates, so a stack may exceed 100.
    """
    return _group_prevalence(df, as_list(keys), markers, one_value(top, F.collect_set("marker")), others, none)


def marker_multiplicity(df: DataFrame, flag: Column, markers: str) -> DataFrame:
    """Flagged genomes by number of extracted markers (0, 1, more)."""
    n = F.size(markers)
    label = F.when(n == 0, F.lit("0 markers detected")).when(n == 1, F.lit("1 marker")).otherwise(F.lit(">1 marker"))
    return with_share(counts(df.where(flag).select(label.alias("marker_class")), "marker_class"), [])


def stack_check(stack: DataFrame, denom: DataFrame, key: str, count: str = "count", total: str = "total_n") -> DataFrame:
    s = stack.groupBy(key).agg(F.sum(count).alias("plotted_count"))
    return s.join(denom, key, "left").withColumn("difference", F.col("plotted_count") - F.col(total))


# --- selection accounting --------------------------------------------------------------------


def source_audit(df: DataFrame, by: str, year: str, lo: int, hi: int, selected: Column, analyzed: Column) -> DataFrame:
    y = F.col(year)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_available"), F.count_if(y.isNull()).alias("n_missing_year"),
        F.count_if(y.isNotNull() & ~y.between(lo, hi)).alias("n_outside"),
        F.count_if(y.between(lo, hi)).alias("n_temporal"),
        F.count_if(selected).alias("n_selected"), F.count_if(analyzed).alias("n_analyzed"))


def sampling_weights(df: DataFrame, keys, selected: Column, analyzed: Column, dims: dict | None = None) -> DataFrame:
    """Available, selected and analysed genomes per stratum, their percents and the weight N/n.

    With ``dims`` every combination is present; percents and weights of empty strata are null.
    """
    keys = as_list(keys)
    t = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_available"), F.count_if(selected).alias("n_selected"),
                              F.count_if(analyzed).alias("n_analyzed"))
    if dims:
        t = complete(t, dims, {"n_available": 0, "n_selected": 0, "n_analyzed": 0})
    return t.select("*", stats.rate("n_selected", "n_available").alias("pct_selected"),
                    stats.rate("n_analyzed", "n_available").alias("pct_analyzed"),
                    F.when(F.col("n_analyzed") > 0, F.col("n_available") / F.col("n_analyzed")).alias("weight"))


def sampling_summary(total: DataFrame, selected: DataFrame, keys, within) -> DataFrame:
    both = union_all(counts(total, keys).withColumn("dataset", F.lit("Total")),
                     counts(selected, keys).withColumn("dataset", F.lit("Selected")))
    return with_share(both, ["dataset", *as_list(within)])


def label_audit(df: DataFrame, label: str, year: str, source: str, status: str) -> DataFrame:
    """All views of the label audit from one scan: overall, per year, per label and year, by source, by status."""
    lab = df.select(F.col(label).alias("label"), F.col(year).alias("year"), F.col(source).alias("source"),
                    F.col(status).alias("status"))
    marked = lab.where(F.col("label").isNotNull())
    sets = marked.groupingSets(
        [["year"], ["label"], ["year", "label"], ["year", "source"], ["year", "status"]],
        "year", "label", "source", "status",
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    # grouping_id bits: year, label, source, status (1 = rolled up)
    view = (F.when(F.col("gid") == 7, F.lit("per_year")).when(F.col("gid") == 11, F.lit("per_label"))
            .when(F.col("gid") == 3, F.lit("per_year_label")).when(F.col("gid") == 5, F.lit("per_year_source"))
            .otherwise(F.lit("per_year_status")))
    views = sets.select(view.alias("view"), F.col("year").cast("string").alias("year"), "label", "source", "status", "n")
    repeats = views.where((F.col("view") == "per_year_label") & (F.col("n") > 1)).withColumn("view", F.lit("repeated_label"))
    overall = lab.agg(F.count("label").alias("n_labelled"), F.count(F.lit(1)).alias("n_total"))
    head = overall.select(F.inline(F.array(
        F.struct(F.lit("labelled").alias("view"), F.col("n_labelled").alias("n")),
        F.struct(F.lit("total").alias("view"), F.col("n_total").alias("n")))))
    return union_all(views, repeats, head)


def one_per_year_test(df: DataFrame, label: str, year: str) -> DataFrame:
    per = df.where(F.col(label).isNotNull()).groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    worst = per.agg(F.max("n").alias("max_per_year"))
    return worst.withColumn("result", F.when(F.col("max_per_year").isNull(), F.lit("NONE"))
                            .when(F.col("max_per_year") <= 1, F.lit("PASS")).otherwise(F.lit("FAIL")))


def composition_table(df: DataFrame, group: str, attr: str, groups: Sequence[str]) -> DataFrame:
    """Group × category counts, percent within the group and share of the category in the group."""
    d = df.where(F.col(group).isin(*groups) & F.col(attr).isNotNull())
    c = complete(counts(d, [group, attr]), {group: groups, attr: None}, {"n": 0})
    c = with_share(c, group, "n", "group_n", "within_pct")
    return with_share(c, attr, "n", "category_n", "share_pct")


def source_decomposition(df: DataFrame, group: str, animal: str, status: str | None = None) -> DataFrame:
    keys = [group, animal] + ([status] if status else [])
    return with_share(counts(df, keys), [group] if status is None else [group, animal])


def subset_breakdowns(df: DataFrame, cols: Sequence[str], blank: str = "[Missing]") -> DataFrame:
    """Counts and percents of several columns at once: unpivot, then one group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(
        F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(blank)).alias("value")) for c in cols]))
    return counts_with_total(df.select(pairs.alias("p")).select("p.*"), ["field", "value"], "field")


def year_counts(df: DataFrame, year: str, lo: int, hi: int, by: dict[str, Sequence] | None = None) -> DataFrame:
    by = by or {}
    c = counts(df.where(F.col(year).between(lo, hi)), [year, *by])
    return complete(c, {year: list(range(lo, hi + 1)), **by}, {"n": 0})


def metrics(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Long (metric, value) table from one aggregate pass."""
    one = df.agg(*[e.cast("bigint").alias(k) for k, e in exprs.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in exprs])))


def metrics_json(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.agg(F.to_json(F.struct(*[e.cast("bigint").alias(k) for k, e in exprs.items()])).alias("metrics"))


# --- diversity -------------------------------------------------------------------------------


def composition(df: DataFrame, group: str, categories: Sequence[str]) -> DataFrame:
    """Mean of 0/1 indicators per group and category, normalised inside the group."""
    means = df.groupBy(group).agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in categories])
    long = means.select(group, F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(f"`{c}`").alias("prevalence")) for c in categories])))
    return normalise(long, group, "prevalence")


def hill_numbers(comp: DataFrame, group: str, p: str = "p") -> DataFrame:
    """Effective numbers of categories of order 0, 1 and 2 from shares."""
    pos = F.col(p) > 0
    x = F.when(pos, F.col(p))
    return comp.groupBy(group).agg(
        F.count_if(pos).alias("q0"),
        F.when(F.count_if(pos) > 0, F.exp(-F.sum(x * F.ln(x)))).otherwise(F.lit(0.0)).alias("q1"),
        F.coalesce(F.try_divide(F.lit(1.0), F.sum(x * x)), F.lit(0.0)).alias("q2"))


def year_group(df: DataFrame, year: str, n: int = 3) -> DataFrame:
    """Label of the n-year block counted from the smallest year (one value, joined back)."""
    y, y0 = F.col(year), F.col("__y0")
    start = y0 + F.floor((y - y0) / n).cast("int") * n
    return df.withColumn("__y0", one_value(df, F.min(year))).withColumn("year_group", F.when(y.isNotNull(), F.concat_ws("-", start, start + (n - 1)))).drop("__y0")
