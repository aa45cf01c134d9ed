"""Quality criteria: status codes, reason texts, audit decisions, lists, dashboards and guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.formatting import fixed, join_reasons
from .relations import as_list, compare_on_key, null_safe_join, union_all
from .reports import one_value


def qc_status(rules: Sequence[tuple[Column, str]]) -> Column:
    """Names of the failing rules joined by ``|``, else PASS.  A null comparison does not fail."""
    return join_reasons([(F.coalesce(cond, F.lit(False)), name) for cond, name in rules])


def criterion_status(passed: Column) -> Column:
    """PASS, FAIL, or MISSING when the criterion is null."""
    return F.when(passed.isNull(), F.lit("MISSING")).when(passed, F.lit("PASS")).otherwise(F.lit("FAIL"))


def compose_status(criteria: dict[str, Column]) -> Column:
    """One code from three-state criteria: missing ones named first, then all-pass, then the failures."""
    n = len(criteria)
    words = {1: "ONE", 2: "TWO", 3: "THREE", 4: "FOUR", 5: "FIVE"}
    count_word = words.get(n, str(n))

    def named(state):
        return F.array_compact(F.array(*[F.when(c == state, F.lit(k)) for k, c in criteria.items()]))

    missing, failed = named("MISSING"), named("FAIL")
    return (
        F.when(F.size(missing) > 0, F.concat(F.lit("MISSING_"), F.array_join(missing, "_")))
        .when(F.size(failed) == 0, F.lit(f"PASS_ALL_{count_word}"))
        .when(F.size(failed) == n, F.lit(f"FAIL_ALL_{count_word}"))
        .when(F.size(failed) == 1, F.concat(F.lit("FAIL_"), F.array_join(failed, "_"), F.lit("_ONLY")))
        .otherwise(F.concat(F.lit("FAIL_"), F.array_join(failed, "_")))
    )


def failure_reasons(coverage: str, coverage_status: str, calls: Sequence[tuple[str, str, str]], wanted: str,
                    min_coverage: float) -> Column:
    """Reasons with formatted numbers and the offending call; empty text when nothing fails.

    ``calls`` lists (tool name, status column, call column).
    """
    cov = F.col(coverage)
    low = F.when(cov.isNotNull(), F.concat(F.lit("Low Coverage ("), fixed(cov, 2), F.lit(f"X < {min_coverage:.0f}X)"))).otherwise(F.lit("Coverage QC Failed"))
    parts = [(F.col(coverage_status) == "FAIL", low), (F.col(coverage_status) == "MISSING", F.lit("Missing Coverage Data"))]
    for tool, status, call in calls:
        text = F.nullif(F.trim(F.col(call)), F.lit(""))
        bad = F.when(text.isNotNull(), F.concat(F.lit(f"{tool} Not {wanted} ("), text, F.lit(")"))).otherwise(F.lit(f"{tool} Not {wanted}"))
        parts += [(F.col(status) == "FAIL", bad), (F.col(status) == "MISSING", F.lit(f"Missing {tool} Data"))]
    return join_reasons(parts, " | ", None)


def audit_label(final: str, in_tree: Column, has_record: Column, reasons: Column, coverage: str, coverage_status: str,
                call_statuses: Sequence[str], ambiguous_call: str, wanted: str, min_coverage: float, all_pass: str) -> Column:
    """Decision text per genome: tree membership first, then screening exclusion, then ordinary failure."""
    calls_ok = reduce(lambda a, b: a & b, [F.col(c) == "PASS" for c in call_statuses])
    exception = F.concat(
        F.lit(f"PASS: Historical coverage exception; confirmed {wanted} by both typing tools; coverage "), fixed(coverage, 2),
        F.lit(f"X (<{min_coverage:.0f}X); retained in final tree"))
    flagged = F.concat(F.lit("PASS: Present in historical final tree despite retrospective QC flag"),
                       F.when(reasons != "", F.concat(F.lit(" ["), reasons, F.lit("]"))).otherwise(F.lit("")))
    screened = F.concat(F.lit("FAIL: Excluded during initial composition/phylogenetic screening"),
                        F.when(F.col(ambiguous_call).rlike(r"(?i)\bor\b"), F.concat(F.lit("; ambiguous call ("), F.col(ambiguous_call), F.lit(")")))
                        .otherwise(F.lit("")))
    ok = F.col(final) == all_pass
    return (
        F.when(~has_record, F.lit("FAIL: Missing from retrospective QC audit"))
        .when(in_tree & ok, F.lit("PASS"))
        .when(in_tree & calls_ok & (F.col(coverage_status) == "FAIL"), exception)
        .when(in_tree, flagged)
        .when(ok, screened)
        .when(reasons != "", F.concat(F.lit("FAIL: "), reasons))
        .otherwise(F.concat(F.lit("FAIL: Retrospective QC status "), F.col(final)))
    )


def status_lists(df: DataFrame, id_col: str, lists: dict[str, Column]) -> DataFrame:
    """Named id lists from row predicates, one pass; a row may be on several lists."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in lists.items()]))
    return df.where(F.col(id_col).isNotNull()).select(F.explode(names).alias("list"), F.col(id_col)).distinct()


def standard_status_lists(statuses: dict[str, Column]) -> dict[str, Column]:
    """Predicates for single, pairwise, all and any failure, all pass, and missing."""
    names = list(statuses)
    out: dict[str, Column] = {}
    for n in names:
        for state in ("PASS", "FAIL", "MISSING"):
            out[f"{n}_{state.lower()}"] = statuses[n] == state
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            out[f"{a}_{b}_fail"] = (statuses[a] == "FAIL") & (statuses[b] == "FAIL")
    for tag, state in (("all_pass", "PASS"), ("all_fail", "FAIL")):
        out[tag] = reduce(lambda x, y: x & y, [s == state for s in statuses.values()])
    for tag, state in (("any_fail", "FAIL"), ("any_missing", "MISSING")):
        out[tag] = reduce(lambda x, y: x | y, [s == state for s in statuses.values()])
    return out


def qc_dashboard(df: DataFrame, status: str, depths: Sequence[str] = ()) -> DataFrame:
    """Totals, pass count and rate, failure breakdown, and depth bands per depth column."""
    total = one_value(df, F.count(F.lit(1)))
    per = df.groupBy(F.col(status).alias("item")).agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit("status"))
    parts = [per]
    for d in depths:
        v = F.col(d)
        # Depth bands.
        band = F.when(v >= 30, F.lit(">=30x")).when(v >= 25, F.lit("25-29x")).when(v >= 20, F.lit("20-24x")).otherwise(F.lit("<20x"))
        parts.append(df.groupBy(band.alias("item")).agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit(d)))
    out = union_all(*parts)
    return out.select("section", "item", "n", (100.0 * F.col("n") / total).alias("pct"))


def read_depth(reads: DataFrame, sample: str, read_no: str, length: str, mate: str, genome_size: int, head: int = 10000) -> DataFrame:
    """Reads, whole-number mean length of the first ``head`` first-mate reads, bases and fold coverage."""
    first = (F.col(mate) == 1) & (F.col(read_no) <= head)
    g = reads.groupBy(sample).agg(F.count(F.lit(1)).alias("reads"), F.floor(F.avg(F.when(first, F.col(length)))).alias("mean_length"))
    g = g.withColumn("mean_length", F.coalesce("mean_length", F.lit(0)))
    g = g.withColumn("bases", F.col("reads") * F.col("mean_length"))
    return g.withColumn("fold_coverage", F.col("bases") / F.lit(float(genome_size)))


def depth_loss(before: DataFrame, after: DataFrame, sample: str, bases: str, genome_size: int) -> DataFrame:
    """Depth before and after cleaning, two decimals, and the loss; a sample with nothing left has depth 0."""
    b = before.groupBy(sample).agg(F.round(F.sum(bases) / genome_size, 2).alias("initial_depth"))
    a = after.groupBy(sample).agg(F.round(F.sum(bases) / genome_size, 2).alias("final_depth"))
    j = b.join(a, sample, "left").fillna(0.0, subset=["final_depth"])
    return j.withColumn("depth_loss", F.round(F.col("initial_depth") - F.col("final_depth"), 2))


def audit_formats(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Per field: was it there, non-missing values, values that break the pattern."""
    aggs = []
    for c, p in patterns.items():
        if c not in df.columns:
            continue
        v = F.trim(F.col(c).cast("string"))
        present = v.isNotNull() & ~v.isin("", "NA")
        aggs += [F.count_if(present).alias(f"{c}__n"), F.count_if(present & ~v.rlike(p)).alias(f"{c}__bad")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("field"), F.lit(c in df.columns).alias("checked"),
                     (F.col(f"{c}__n") if c in df.columns else F.lit(None).cast("bigint")).alias("nonmissing"),
                     (F.col(f"{c}__bad") if c in df.columns else F.lit(None).cast("bigint")).alias("invalid")) for c in patterns]
    return one.select(F.inline(F.array(*rows)))


def check_counts(observed: DataFrame, expected: DataFrame, keys, n: str = "n") -> DataFrame:
    """Expected counts against observed ones; a key that was not observed counts 0."""
    obs = observed.withColumnRenamed(n, "observed")
    out = null_safe_join(expected.withColumnRenamed(n, "expected"), obs, as_list(keys), "left").fillna(0, subset=["observed"])
    return out.withColumn("difference", F.col("observed") - F.col("expected")).withColumn("ok", F.col("difference") == 0)


def mismatch_report(a: DataFrame, b: DataFrame, key, fields: Sequence[str]) -> DataFrame:
    """Rows of the two tables that disagree in any field, with a flag per field; null equals null."""
    j = compare_on_key(a.select(*as_list(key), *fields), b.select(*as_list(key), *fields), key)
    flags = {f"{f}_mismatch": ~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")) for f in fields}
    return j.withColumns(flags).where(reduce(lambda x, y: x | y, [F.col(c) for c in flags]))


def changed_rows(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``before`` (as a multiset over ``cols``) that ``after`` no longer has; empty when unchanged."""
    return before.select(*cols).exceptAll(after.select(*cols))


def repair_delta(raw: DataFrame, fixed: DataFrame, key, cols: Sequence[str], reason: str = "field_value_changed_by_normalization") -> DataFrame:
    """Long (key, field, before, after, reason) of the cells that a repair changed."""
    j = compare_on_key(raw.select(*as_list(key), *cols), fixed.select(*as_list(key), *cols), key, ("__b", "__a"))
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}__b").cast("string").alias("before"),
                               F.col(f"{c}__a").cast("string").alias("after")) for c in cols])
    return j.select(*as_list(key), F.inline(F.filter(cells, lambda s: ~s["before"].eqNullSafe(s["after"])))).withColumn("reason", F.lit(reason))


def check_labels(labels: DataFrame, tips: DataFrame, id_col: str, label: str, valid: Sequence[str]) -> DataFrame:
    """Invalid labels, duplicate ids, ids missing on either side, and counts per label, as (check, item, n)."""
    counted = labels.groupBy(F.col(label).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    per_label = counted.select(F.when(F.col("item").isin(*valid), F.lit("label")).otherwise(F.lit("invalid_label")).alias("check"), "item", "n")
    dup = labels.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
    no_tip = labels.select(id_col).distinct().join(tips.select(id_col), id_col, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    no_label = tips.select(id_col).distinct().join(labels.select(id_col), id_col, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    totals = union_all(*[d.select(F.lit(name).alias("check"), F.lit("").alias("item"), F.col("n").cast("bigint").alias("n"))
                         for name, d in (("duplicate_ids", dup), ("label_without_tip", no_tip), ("tip_without_label", no_label))])
    return union_all(per_label, totals)


def trend_rates(df: DataFrame, keys, pairs: dict[str, tuple[Column, Column]], clamp_hi: bool = False) -> DataFrame:
    """``metric_pct``, ``metric_lo``, ``metric_hi`` columns for several numerator / denominator pairs."""
    cols = []
    for name, (x, n) in pairs.items():
        cols += [v.alias(f"{name}_{k}") for k, v in stats.rate_ci(x, n, clamp_hi).items()]
    return df.select(*as_list(keys), *cols)
