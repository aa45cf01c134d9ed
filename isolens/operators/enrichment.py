"""Feature presence by group: counts, exact tests, multiple testing, definers and summaries.

Shape of the work: presence rows (sample, feature) are joined to the sample labels and reduced to
counts per feature and group with map-side combining.  From there on everything is count-table
sized.  Tests run once per distinct table of counts, not once per feature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from ..functions.dates import assign_bin
from ..functions.formatting import format_cell
from ..session import by_size, cut_lineage, saved, spread
from .ranking import level_index
from .relations import as_list, null_safe_join
from .reports import complete, counts, one_value
from .reshape import with_runs

# Thresholds of the reports.
FDR_ALPHA = 0.05
MIN_TOTAL = 10
DEFINER_IN, DEFINER_OUT = 40.0, 1.0
GENE_IN, GENE_OUT = 90.0, 5.0
COVERAGE_EDGES = (40.0, 60.0, 80.0, 90.0)
COVERAGE_BINS = ("40-<60%", "60-<80%", "80-<90%", ">=90%")
MIN_COVERAGE, MIN_IDENTITY = 80.0, 90.0


def presence_filter(hits: DataFrame, coverage: str | None, identity: str | None, cov: float = MIN_COVERAGE,
                    ident: float = MIN_IDENTITY) -> DataFrame:
    """Hits above both thresholds; a value that is not a number fails, an absent column is skipped."""
    if coverage:
        hits = hits.where(F.col(coverage).try_cast("double") >= cov)
    if identity:
        hits = hits.where(F.col(identity).try_cast("double") >= ident)
    return hits


# --- counts ----------------------------------------------------------------------------------


def sample_labels(groups: DataFrame, sample: str, group: str, run=()) -> DataFrame:
    """One label per sample (and run): null samples and labels are left out, repeated rows count once.

    A sample with several labels gets the smallest, so it is in one group only.
    """
    keys = [*as_list(run), sample]
    known = groups.where(F.col(group).isNotNull() & F.col(sample).isNotNull()).select(*keys, group)
    return by_size(known, *keys).groupBy(*keys).agg(F.min(group).alias(group))


def feature_counts(presence: DataFrame, groups: DataFrame, sample: str, feature, group: str, run=()) -> DataFrame:
    """Samples per feature and group (each sample once), with the total over groups.

    ``groups`` may carry run columns (scheme, mode); they become part of the key and all runs are
    counted in one job.
    """
    feature, run = as_list(feature), as_list(run)
    in_presence, in_groups = [c for c in run if c in presence.columns], [c for c in run if c in groups.columns]
    labelled = sample_labels(groups, sample, group, in_groups)
    shared = [c for c in in_presence if c in in_groups]
    once = by_size(presence.select(sample, *feature, *in_presence).join(labelled, [sample, *shared]), sample, *feature).distinct()
    c = once.groupBy(*run, *feature, group).agg(F.count(F.lit(1)).alias("k"))
    return c.withColumn("k_all", F.sum("k").over(W.partitionBy(*run, *feature)))


def scenario_counts(presence: DataFrame, groups: DataFrame, sample: str, feature, group: str, flag: str,
                    names=("all_snps", "vertical_only")) -> DataFrame:
    """Feature counts of both scenarios (all rows, unflagged rows) from one pass over the calls."""
    feature = as_list(feature)
    labelled = by_size(presence.join(sample_labels(groups, sample, group), sample), sample, *feature)
    once = labelled.groupBy(sample, *feature, group).agg(F.min(F.col(flag).cast("int")).alias("__f"))
    c = once.groupBy(*feature, group).agg(
        F.count(F.lit(1)).alias("a"), F.count_if(F.col("__f") == 0).alias("v"))
    rows = F.array(F.struct(F.lit(names[0]).alias("scenario"), F.col("a").alias("k")), F.struct(F.lit(names[1]).alias("scenario"), F.col("v").alias("k")))
    return c.select(*feature, group, F.inline(rows)).where("k > 0")


def roll_runs(counted: DataFrame, group: str, keys, value: str = "k") -> DataFrame:
    """Counts per label to counts per scheme × mode run.

    Runs only merge or drop labels, so they are derived from the count table and the calls are
    never multiplied by the number of runs.
    """
    keys = as_list(keys)
    return with_runs(counted, group).groupBy("scheme", "mode", *keys, group).agg(F.sum(value).alias(value))


def with_feature_total(fc: DataFrame, keys) -> DataFrame:
    return fc.withColumn("k_all", F.sum("k").over(W.partitionBy(*as_list(keys))))


def group_totals(groups: DataFrame, group: str, run=(), sample: str = "sample") -> DataFrame:
    """Group size n and run size M, over the same labels as the counts."""
    run = as_list(run)
    g = sample_labels(groups, sample, group, run).groupBy(*run, group).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("n_all", F.sum("n").over(W.partitionBy(*run)))


def feature_grid(fc: DataFrame, totals: DataFrame, feature, group: str, run=()) -> DataFrame:
    """Every feature against every group of its run, absent counts as zero.

    The (few) groups of a run are packed into one row, so the grid is an explode and not a product.
    The grid is materialised: it is count-table sized, several tests read it, and the calls behind
    it are then scanned once.
    """
    feature, run = as_list(feature), as_list(run)
    packed = totals.groupBy(*run).agg(F.collect_list(F.struct(group, "n", "n_all")).alias("__g"))
    per = fc.groupBy(*run, *feature).agg(F.first("k_all").alias("k_all"), F.map_from_entries(F.collect_list(F.struct(group, "k"))).alias("__k"))
    joined = per.join(packed, run) if run else per.withColumn("__g", one_value(totals, F.collect_list(F.struct(group, "n", "n_all"))))
    d = joined.withColumn("__x", F.explode("__g"))
    return cut_lineage(d.select(
        *run, *feature, F.col("__x")[group].alias(group), F.coalesce(F.try_element_at("__k", F.col("__x")[group]), F.lit(0)).alias("k"),
        "k_all", F.col("__x")["n"].alias("n"), F.col("__x")["n_all"].alias("n_all")))


# --- multiple testing ------------------------------------------------------------------------


def _p_bucket(p: Column, log: bool) -> Column:
    """Buckets that rise with p (or ln p): a logarithmic scale below 1/4096, 4096 equal steps from there on."""
    plain = F.exp(p) if log else p
    octaves = F.greatest(p, F.lit(-1e15)) / math.log(2) if log else F.log2(F.greatest(p, F.lit(5e-324)))
    return F.when(plain >= 2.0**-12, F.floor(plain * 4096)).otherwise(F.floor(octaves * 16) + 192).cast("bigint")


def _bh_of_table(ps: DataFrame, by: list[str], log: bool = False) -> DataFrame:
    """FDR of a table of distinct p-values (by, __p, __c = number of tests); with ``log``, both are natural logarithms.

    Bucket sizes give each bucket the rank it starts at, and bucket minima what larger p-values
    contribute, so only the p-values of one bucket of one scope are ordered together.
    """
    ps = ps.withColumn("__b", _p_bucket(F.col("__p"), log))
    small_first = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    sizes = ps.groupBy(*by, "__b").agg(F.sum("__c").alias("__n"))
    sizes = sizes.select(*by, "__b", (F.sum("__n").over(small_first) - F.col("__n")).alias("__off"),
                         F.sum("__n").over(W.partitionBy(*by)).alias("__m"))
    inner = W.partitionBy(*by, "__b")
    q = null_safe_join(ps, sizes, [*by, "__b"], "inner")
    q = q.withColumn("__rank", F.sum("__c").over(inner.orderBy("__p").rowsBetween(W.unboundedPreceding, 0)) + F.col("__off"))
    q = q.withColumn("__q", F.col("__p") + F.ln("__m") - F.ln("__rank") if log else F.col("__p") * F.col("__m") / F.col("__rank"))
    q = q.withColumn("__in", F.min("__q").over(inner.orderBy(F.desc("__p")).rowsBetween(W.unboundedPreceding, 0)))
    later = q.groupBy(*by, "__b").agg(F.min("__q").alias("__bq"))
    later = later.select(*by, "__b", F.min("__bq").over(
        W.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)).alias("__after"))
    q = null_safe_join(q, later, [*by, "__b"], "inner")
    return q.select(*by, "__p", F.least(F.lit(0.0 if log else 1.0), F.col("__in"), F.col("__after")).alias("__fdr"))


def bh(df: DataFrame, p: str = "p", by=(), out: str = "fdr", log: bool = False) -> DataFrame:
    """Benjamini-Hochberg over the rows of each scope that have a p-value (with ``log``, its natural logarithm, and so the result).

    Ranks are taken over distinct p-values with their multiplicities.  That table is materialised
    once, as it is read several times.
    """
    by = as_list(by)
    ps = cut_lineage(df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__c")))
    q = _bh_of_table(ps, by, log).withColumnsRenamed({"__p": p, "__fdr": out})
    return null_safe_join(df, q, [*by, p], "left")


def test_once(df: DataFrame, cells: Sequence[str], log_value: Column, scope=(), out: str = "fdr") -> DataFrame:
    """p-value of a test on a few counts, and its FDR inside ``scope``; null cells are not tested.

    ``log_value`` is the natural logarithm of p. Ranks and FDR stay logarithms, so p-values below the
    smallest double keep their order; added are log_p, p, log_<out> and <out>. The test runs once per
    distinct table of counts and scope.  Those tables are few next to the features, are materialised
    once, and carry all numbers back in a single join.
    """
    scope, cells = as_list(scope), list(cells)
    keys = [*scope, *[c for c in cells if c not in scope]]
    t = df.where(" AND ".join(f"{c} IS NOT NULL" for c in cells)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    t = cut_lineage(spread(t, *keys).withColumn("__p", log_value))
    ps = t.groupBy(*scope, "__p").agg(F.sum("__c").alias("__c"))
    fdr = _bh_of_table(ps, scope, log=True)
    t = null_safe_join(t.drop("__c"), fdr, [*scope, "__p"], "inner").withColumnsRenamed({"__p": "log_p", "__fdr": f"log_{out}"})
    return df.join(t, keys, "left").select(*df.columns, "log_p", F.exp("log_p").alias("p"), f"log_{out}", F.exp(f"log_{out}").alias(out))


def holm(df: DataFrame, p: str = "p", by=(), order: Sequence[str] = (), out: str = "p_holm", log: bool = False) -> DataFrame:
    """Holm step-down inside a scope of few tests (the pairs of one element); with ``log``, on natural logarithms."""
    by = as_list(by)
    scope = W.partitionBy(*by)
    ordered = scope.orderBy(F.asc_nulls_last(p), *order)
    d = df.withColumn("__r", F.row_number().over(ordered)).withColumn("__m", F.count(p).over(scope))
    left = F.col("__m") - F.col("__r") + 1
    step = F.when(F.col(p).isNotNull(), F.col(p) + F.ln(left) if log else F.col(p) * left)
    run = F.max(step).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(0.0 if log else 1.0), run))).drop("__r", "__m")


def adjust_p(df: DataFrame, method: str, p: str = "p", by=(), out: str = "p_adj") -> DataFrame:
    return bh(df, p, by, out) if method == "bh" else holm(df, p, by, out=out)


def once_per_table(df: DataFrame, cells: Sequence[str], value: Column, out: str) -> DataFrame:
    """Evaluate an expensive function of a few counts once per distinct combination."""
    table = spread(df.select(*cells).where(" AND ".join(f"{c} IS NOT NULL" for c in cells)).distinct(), *cells).withColumn(out, value)
    return df.join(table, list(cells), "left")


# --- variants --------------------------------------------------------------------------------


def hypergeom_enrichment(grid: DataFrame, scope, min_total: int | None = MIN_TOTAL) -> DataFrame:
    """Upper-tail test, BH inside ``scope``, percent in and out.  Needs columns k, k_all, n, n_all.

    Only ``min_total <= k_all < n_all`` is tested; ``min_total=None`` tests every row.
    """
    ok = F.lit(True) if min_total is None else (F.col("k_all") >= min_total) & (F.col("k_all") < F.col("n_all"))
    d = grid.withColumn("eligible", ok).withColumn("__k", F.when(F.col("eligible"), F.col("k")))
    d = test_once(d, ["__k", "k_all", "n", "n_all"], stats.hypergeom_log_sf("__k", "n_all", "k_all", "n"), scope)
    rest = F.col("n_all") - F.col("n")
    return d.select(*grid.columns, "eligible", "log_p", "p", "log_fdr", "fdr",
                    F.when(F.col("n") > 0, F.col("k") / F.col("n") * 100.0).otherwise(F.lit(0.0)).alias("percent_in"),
                    F.when(rest > 0, (F.col("k_all") - F.col("k")) / rest * 100.0).otherwise(F.lit(0.0)).alias("percent_out"))


def coverage_bin(c: Column | str = "percent_in") -> Column:
    return assign_bin(c, COVERAGE_EDGES, COVERAGE_BINS)


def definers(df: DataFrame, in_pct: float = DEFINER_IN, out_pct: float = DEFINER_OUT, alpha: float = FDR_ALPHA) -> DataFrame:
    return df.where((F.col("fdr") <= alpha) & (F.col("percent_in") >= in_pct) & (F.col("percent_out") <= out_pct))


def first_annotation(rows: DataFrame, feature, cols: Sequence[str]) -> DataFrame:
    """One annotation per feature: the smallest, since file order does not exist here."""
    feature = as_list(feature)
    # distinct rows are few, and unlike a minimum of records they are reduced without a sort of all rows (the filter keeps the two steps apart)
    few = rows.groupBy(*feature, *cols).agg(F.count(F.lit(1)).alias("__n")).where("__n > 0")
    g = few.groupBy(*feature).agg(F.min(F.struct(*cols)).alias("__a"))
    return g.select(*feature, *[F.col(f"__a.{c}").alias(c) for c in cols])


def feature_report(tested: DataFrame, annotation: DataFrame, feature, scope, totals: DataFrame,
                   effects: Sequence[str], gene: str = "gene", effect: str = "effect") -> DataFrame:
    """Per group: significant and defining features, intergenic/coding split, genes and effects."""
    scope = as_list(scope)
    d = tested.where(F.col("fdr") <= FDR_ALPHA).join(annotation, as_list(feature), "left")
    strict = (F.col("percent_in") >= DEFINER_IN) & (F.col("percent_out") <= DEFINER_OUT)
    g = F.trim(F.col(gene))
    # Gene names that are not genes.
    named = g.isNotNull() & ~F.lower(g).isin("intergenic", "nan", "", "none", ".", "-", "hypothetical protein")
    inter = F.coalesce(F.lower(g), F.lit("")) == "intergenic"
    agg = d.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("significant"), F.count_if(strict).alias("strict_definers"),
        F.count_if(strict & inter).alias("definer_intergenic"), F.count_if(strict & ~inter).alias("definer_coding"),
        F.count_distinct(F.when(strict & named, g)).alias("genes_strict"), F.count_distinct(F.when(named, g)).alias("genes_significant"),
        *[F.count_if(strict & (F.col(effect) == e)).alias(f"definer_{e}") for e in effects])
    out = totals.select(*scope, "n").join(agg, scope, "left")
    return out.fillna(0)


def definer_bins(tested: DataFrame, scope, totals: DataFrame) -> DataFrame:
    """Defining features per group and coverage bin, all bins present, with both totals."""
    scope = as_list(scope)
    sig = tested.where(F.col("fdr") <= FDR_ALPHA)
    strict = (F.col("percent_in") >= DEFINER_IN) & (F.col("percent_out") <= DEFINER_OUT)
    per = sig.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("significant"), F.count_if(strict).alias("strict_definers"),
        *[F.count_if(strict & (coverage_bin() == b)).alias(b) for b in COVERAGE_BINS])
    full = totals.select(*scope, "n").join(per, scope, "left").fillna(0)
    return full.select(*scope, "n", "significant", "strict_definers", F.inline(F.array(*[
        F.struct(F.lit(b).alias("coverage_bin"), F.col(f"`{b}`").alias("definers")) for b in COVERAGE_BINS])))


def overall_bins(long: DataFrame, group: str) -> DataFrame:
    """Definers per group and bin summed over all runs."""
    return long.groupBy(group, "coverage_bin").agg(F.sum("definers").alias("definers"), F.count(F.lit(1)).alias("runs"))


def gene_list(df: DataFrame, gene: str = "gene") -> DataFrame:
    g = F.trim(F.col(gene))
    return (df.select(g.alias(gene)).where(F.col(gene).isNotNull() & ~F.lower(gene).isin(
        "intergenic", "nan", "", "none", ".", "-", "hypothetical protein")).distinct().orderBy(gene))


# --- presence / absence ----------------------------------------------------------------------


def presence_absence(hits: DataFrame, samples: DataFrame, sample: str, feature: str) -> DataFrame:
    """Long presence rows; samples without any hit stay, with a null feature."""
    return samples.select(sample).distinct().join(hits.select(sample, feature).distinct(), sample, "left")


def presence_matrix(long: DataFrame, sample: str, feature: str, features: Sequence[str]) -> DataFrame:
    """Wide 0/1 export for a named list of features."""
    hit = [F.max(F.when(F.col(feature) == f, 1).otherwise(0)).alias(f) for f in features]
    return long.groupBy(sample).agg(*hit)


def modal_catalog(hits: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Most frequent annotation per key; ties go to the smaller annotation."""
    c = hits.groupBy(key, *cols).agg(F.count(F.lit(1)).alias("__n"))
    m = c.groupBy(key).agg(F.min(F.struct((-F.col("__n")).alias("o"), *cols)).alias("__m"))
    return m.select(key, *[F.col(f"__m.{x}").alias(x) for x in cols])


# --- omnibus and pairwise --------------------------------------------------------------------


def eligible_groups(grid: DataFrame, feature, group: str, order: Sequence[str], run=(), min_total: int | None = MIN_TOTAL) -> DataFrame:
    """One row per feature with its variable groups (0 < k < n) in order and the reason if untestable."""
    feature, run = as_list(feature), as_list(run)
    variable = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    entry = F.struct(level_index(group, order).alias("o"), F.col(group).alias("g"), F.col("k").alias("k"), F.col("n").alias("n"))
    d = grid.groupBy(*run, *feature).agg(F.first("k_all").alias("k_all"), F.array_sort(F.collect_list(F.when(variable, entry))).alias("tested"))
    rare = F.lit(False) if min_total is None else F.col("k_all") < min_total
    return d.withColumn("reason", F.when(rare, F.lit(f"rare (<{min_total} total present)"))
                        .when(F.size("tested") < 2, F.lit("insufficient variable groups after zero/full exclusion"))
                        .otherwise(F.lit("")))


def chi2_statistic(entries: Column) -> tuple[Column, Column]:
    """Chi-square of the R x 2 table in ``entries`` and the smallest expected count."""
    k = F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + e["k"])
    n = F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    share = k.cast("double") / n
    chi2 = F.aggregate(entries, F.lit(0.0), lambda a, e: a + (e["k"] - e["n"] * share) * (e["k"] - e["n"] * share)
                       / (e["n"] * share * (1.0 - share)))
    low = F.array_min(F.transform(entries, lambda e: e["n"] * F.least(share, 1.0 - share)))
    return chi2, low


def chi2_omnibus(eligible: DataFrame, key, n_tables: int = 5000, seed: int = 12345, monte_carlo: bool = True) -> DataFrame:
    """Chi-square per feature; tables with an expected count below 5 are resampled instead.

    Materialised, so follow-up tests do not run the tail function or the resampling again.
    """
    chi2, low = chi2_statistic(F.col("tested"))
    ok = F.col("reason") == ""
    d = spread(eligible, *as_list(key)).withColumn("chi2", F.when(ok, chi2)).withColumn("min_expected", F.when(ok, low))
    sparse = F.col("min_expected") < 5 if monte_carlo else F.lit(False)
    d = d.withColumn("method", F.when(~ok, F.lit("")).when(sparse, F.lit(f"chi-square (montecarlo, {n_tables} resamples, seed={seed})"))
                     .otherwise(F.lit("chi-square")))
    d = d.withColumn("dof", F.when(ok & ~sparse, F.size("tested") - 1))
    # Python evaluates every argument row, so rows of the other kind get null input
    p = stats.chi2_sf(F.when(F.col("dof").isNotNull(), F.col("chi2")), F.col("dof"))
    d = d.withColumn("p", F.when(F.col("dof").isNotNull(), p))
    if monte_carlo:
        run = stats.monte_carlo_chi2(n_tables, seed)
        none = F.array().cast("array<bigint>")
        mc = run(F.when(ok & sparse, F.transform("tested", lambda e: e["k"])).otherwise(none),
                 F.when(ok & sparse, F.transform("tested", lambda e: e["n"])).otherwise(none), F.xxhash64(*as_list(key)))
        d = d.withColumn("p_mc", mc).withColumn("p", F.when(ok & sparse, F.col("p_mc")).otherwise(F.col("p"))).drop("p_mc")
    return cut_lineage(d)


def group_pair_tables(eligible: DataFrame, keep: Sequence[str]) -> DataFrame:
    """All unordered pairs of the (few) tested groups of each feature, in group order."""
    d = eligible.select(*keep, "tested", F.posexplode("tested").alias("__i", "x"))
    d = d.select(*keep, "x", F.explode(F.slice("tested", F.col("__i") + 2, F.size("tested"))).alias("y"))
    return d.select(*keep, F.col("x.g").alias("group1"), F.col("y.g").alias("group2"),
                    F.col("x.k").alias("a"), (F.col("x.n") - F.col("x.k")).alias("b"),
                    F.col("y.k").alias("c"), (F.col("y.n") - F.col("y.k")).alias("d"))


def fisher_tables(df: DataFrame) -> DataFrame:
    """Two-sided Fisher p, its natural logarithm, and +0.5 odds ratio of the columns a, b, c, d."""
    out = once_per_table(df, ["a", "b", "c", "d"], stats.fisher_log_p("a", "b", "c", "d"), "log_p")
    return out.withColumns({"p": F.exp("log_p"), "odds_ratio": stats.odds_ratio("a", "b", "c", "d")}).select(*df.columns, "log_p", "p", "odds_ratio")


def holm_pairs(tables: DataFrame, key) -> DataFrame:
    """Fisher pairs with Holm inside each key, on logarithms: log_p, p, log_p_holm and p_holm."""
    d = holm(fisher_tables(tables), "log_p", key, order=["group1", "group2"], out="log_p_holm", log=True)
    return d.withColumn("p_holm", F.exp("log_p_holm"))


def fisher_vs_rest(grid: DataFrame, scope) -> DataFrame:
    """Each group against all others, BH inside ``scope``."""
    t = grid.where((F.col("n") > 0) & (F.col("n_all") > F.col("n"))).select(
        "*", F.col("k").alias("a"), (F.col("n") - F.col("k")).alias("b"), (F.col("k_all") - F.col("k")).alias("c"),
        (F.col("n_all") - F.col("n") - F.col("k_all") + F.col("k")).alias("d"))
    t = test_once(t, ["a", "b", "c", "d"], stats.fisher_log_p("a", "b", "c", "d"), scope)
    t = t.withColumn("odds_ratio", stats.odds_ratio("a", "b", "c", "d"))
    return t.withColumn("percent_in", 100.0 * F.col("a") / F.col("n")).withColumn("percent_out", 100.0 * F.col("c") / (F.col("n_all") - F.col("n")))


def fisher_pairwise(grid: DataFrame, feature, group: str, order: Sequence[str], run=()) -> DataFrame:
    """Every pair of groups for every feature, BH inside a pair."""
    feature, run = as_list(feature), as_list(run)
    entry = F.struct(level_index(group, order).alias("o"), F.col(group).alias("g"), F.col("k").alias("k"), F.col("n").alias("n"))
    packed = grid.where(F.col("n") > 0).groupBy(*run, *feature).agg(F.array_sort(F.collect_list(entry)).alias("tested"))
    pairs = group_pair_tables(packed, [*run, *feature])
    t = test_once(pairs, ["a", "b", "c", "d"], stats.fisher_log_p("a", "b", "c", "d"), [*run, "group1", "group2"])
    return t.withColumn("odds_ratio", stats.odds_ratio("a", "b", "c", "d"))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _letters(groups: pd.Series, pairs: pd.Series, alpha: pd.Series) -> pd.Series:
    out = []
    for gs, ps, level in zip(groups, pairs, alpha):
        differ = {frozenset((p["group1"], p["group2"])) for p in ps if p["p"] is not None and p["p"] <= level}
        left, given, letter = list(gs), {}, ord("a")
        while left:
            block: list[str] = []
            for g in left:
                if all(frozenset((g, h)) not in differ for h in block):
                    block.append(g)
            for g in block:
                given[g] = chr(letter)
            left, letter = [g for g in left if g not in block], letter + 1
        out.append(given)
    return pd.Series(out)


def cld(pairs: DataFrame, key, order: Sequence[str], p: str = "p_holm", alpha: float = FDR_ALPHA) -> DataFrame:
    """Compact letters per group from adjusted pairwise p-values: greedy blocks in group order (then by name)."""
    key = as_list(key)

    def place(c: str) -> Column:
        return F.coalesce(level_index(c, order), F.lit(len(order) + 1)) if order else F.lit(0)

    both = F.array(*[F.struct(place(c).alias("o"), F.col(c).alias("g")) for c in ("group1", "group2")])
    d = pairs.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(both)))).alias("gs"),
        F.collect_list(F.struct("group1", "group2", F.col(p).alias("p"))).alias("ps"))
    m = d.select(*key, _letters(F.transform("gs", lambda s: s["g"]), "ps", F.lit(alpha)).alias("m"))
    return m.select(*key, F.explode("m").alias("group", "letters"))


def pairwise_posthoc(omnibus: DataFrame, key, alpha: float = FDR_ALPHA, fdr: str | None = "fdr") -> DataFrame:
    """Fisher pairs with Holm inside each feature, for features significant in the omnibus test."""
    key = as_list(key)
    sig = omnibus.where(F.col(fdr) <= alpha) if fdr else omnibus.where(F.col("reason") == "")
    return holm_pairs(group_pair_tables(sig, key), key)


def element_summary(grid: DataFrame, omnibus: DataFrame, letters: DataFrame, catalog: DataFrame, feature: str,
                    group: str, order: Sequence[str]) -> DataFrame:
    """One row per element: annotation, total, one formatted cell per group, p and FDR."""
    cells = grid.join(letters.withColumnRenamed("group", group), [feature, group], "left")
    cells = cells.withColumn("cell", format_cell("k", "n", F.col("letters")))
    wide = cells.groupBy(feature).pivot(group, list(order)).agg(F.first("cell"))
    total = grid.groupBy(feature).agg(F.first("k_all").alias("total"))
    return (catalog.join(total, feature).join(wide, feature)
            .join(omnibus.select(feature, "p", "fdr"), feature, "left"))


def sort_summary(df: DataFrame, tested: str = "p", keys: Sequence[str] = ("type", "symbol"), total: str = "total") -> DataFrame:
    """Tested elements first, then larger totals, then the names."""
    return df.orderBy(F.col(tested).isNull(), F.desc(total), *keys)


def attribute_enrichment(df: DataFrame, group: str, attr: str, groups: Sequence[str], order: Sequence[str] | None = None,
                         monte_carlo: bool = True) -> dict[str, DataFrame]:
    """Per group: table of categories with letters, omnibus test over eligible categories, and Holm pairs.

    A category is eligible if some but not all of its rows are in the group. Table: counts, percent of the
    group, share of the category, letters of the pairs ('' where untested). Omnibus: sizes, test, and the
    range of both percents over eligible categories. Pairs: counts, shares, percents and their
    differences, p, Holm p, odds ratio and direction. Categories are ordered by ``order``, then by name.
    """
    d = df.where(F.col(attr).isNotNull())
    cats = counts(d, attr, "n_total")
    c = complete(counts(d.where(F.col(group).isin(*groups)), [group, attr]), {group: groups, attr: None}, {"n": 0})
    c = c.join(cats, attr).withColumn("within_pct", 100.0 * F.try_divide(
        F.col("n"), F.sum("n").over(W.partitionBy(group)))).withColumn("share_pct", 100.0 * F.try_divide("n", "n_total"))
    c = saved(c, "categories")
    usable = (F.col("n") > 0) & (F.col("n") < F.col("n_total"))
    rank = F.lit(0) if order is None else F.coalesce(level_index(attr, order), F.lit(len(order) + 1))
    entry = F.struct(rank.alias("o"), F.col(attr).alias("g"), F.col("n").alias("k"), F.col("n_total").alias("n"))
    ranges = [f(F.when(usable, F.col(x))).alias(f"{x}_{n}") for x in ("within_pct", "share_pct") for n, f in (("min", F.min), ("max", F.max))]
    e = c.groupBy(group).agg(F.array_sort(F.collect_list(F.when(usable, entry))).alias("tested"), F.count(F.lit(1)).alias("n_categories"),
                             F.count_if(usable).alias("n_tested"), F.sum("n").alias("n_in_group"), F.sum("n_total").alias("n_all"), *ranges)
    # Fixed value: the text of an untested group.
    e = e.withColumn("reason", F.when(F.size("tested") < 2, F.lit("Fewer than 2 eligible categories for testing.")).otherwise(F.lit("")))
    omnibus = chi2_omnibus(e, group, monte_carlo=monte_carlo)
    pairs = holm_pairs(group_pair_tables(e.where("reason = ''"), [group, "n_in_group"]), group)
    pairs = pairs.withColumn("direction", F.when(F.col("odds_ratio") > 1, F.lit("Cat1>Cat2")).when(F.col("odds_ratio") < 1, F.lit("Cat2>Cat1"))
                             .otherwise(F.lit("Equal")))
    for i, (hit, miss) in enumerate((("a", "b"), ("c", "d")), 1):
        pairs = pairs.withColumns({f"share{i}_pct": 100.0 * F.col(hit) / (F.col(hit) + F.col(miss)), f"within{i}_pct": 100.0 * F.try_divide(hit, "n_in_group")})
    pairs = saved(pairs.withColumns({"diff_share_pp": F.col("share1_pct") - F.col("share2_pct"), "diff_within_pp": F.col("within1_pct") - F.col("within2_pct")}).drop("n_in_group"), "pairs")
    letters = cld(pairs, group, order or ()).withColumnsRenamed({"group": attr})
    table = c.join(letters, [group, attr], "left").withColumns({"letters": F.coalesce("letters", F.lit("")), "tested": F.when(usable, F.lit("YES")).otherwise(F.lit(""))})
    return {"table": table, "omnibus": omnibus, "pairs": pairs}
