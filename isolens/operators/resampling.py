"""Bootstrap, permutation and stratified selection.

Resampling works on pattern counts: isolates with the same indicator pattern are one row with a
count, so a replicate costs the number of patterns and not the number of isolates.  Replicates are
rows, spread over the cluster, and every draw is seeded by its replicate number, so results do not
depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import draw_seed
from ..session import cut_lineage, saved, spread
from .enrichment import bh
from .ranking import hash_order, sample_up_to
from .relations import exclude, union_all
from .reports import hill_numbers, normalise, one_value


def _hill(weights: np.ndarray) -> np.ndarray:
    """q0, q1, q2 of each row of category weights."""
    total = weights.sum(axis=-1, keepdims=True)
    p = np.divide(weights, total, out=np.zeros_like(weights, dtype=float), where=total > 0)
    plogp = np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0)
    some = total[..., 0] > 0
    sq = (p * p).sum(axis=-1)
    return np.stack([(p > 0).sum(axis=-1).astype(float), np.where(some, np.exp(-plogp.sum(axis=-1)), 0.0),
                     np.divide(1.0, sq, out=np.zeros_like(sq), where=sq > 0)], axis=-1)


BLOCK = 250  # replicates drawn together by one row


def pattern_counts(df: DataFrame, group: str, categories: Sequence[str]) -> DataFrame:
    """Isolates per group and 0/1 pattern, the pattern as an array.  Small, and read many times: materialised."""
    pattern = F.array(*[F.col(f"`{c}`").cast("double") for c in categories])
    return cut_lineage(df.groupBy(group, pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("c")))


def _packed(patterns: DataFrame, group: str) -> DataFrame:
    return patterns.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pattern", "c"))).alias("pats"))


def _blocks(n: int) -> Column:
    """Block numbers of n replicates, with the size of each block."""
    starts = F.sequence(F.lit(0), F.lit(n - 1), F.lit(BLOCK))
    return F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(BLOCK), F.lit(n) - s).alias("size"))))


def _counts(pats: str) -> Column:
    return F.transform(pats, lambda s: s["c"])


def _patterns(pats: str) -> Column:
    return F.transform(pats, lambda s: s["pattern"])


def bootstrap_hill(patterns: DataFrame, group: str, b: int = 1000, seed: int = 1) -> DataFrame:
    """95 % percentile interval of the Hill numbers per group."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def draw(counts: pd.Series, patterns: pd.Series, start: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        out = []
        for c, pats, r, n, k in zip(counts, patterns, start, size, key):
            c, m = np.asarray(c, dtype=np.int64), np.array([list(p) for p in pats], dtype=float)
            take = draw_seed(seed, int(r), int(k)).multinomial(c.sum(), c / c.sum(), size=int(n))
            out.append(_hill(take @ m).tolist())
        return pd.Series(out)

    d = spread(_packed(patterns, group).select(group, "pats", _blocks(b).alias("blk")))
    h = d.select(group, F.explode(draw(_counts("pats"), _patterns("pats"), "blk.start", "blk.size", F.xxhash64(group))).alias("h"))
    ci = [F.percentile(F.col("h")[i], F.lit(p)).alias(f"q{i}_{side}") for i in range(3) for side, p in (("lo", 0.025), ("hi", 0.975))]
    return h.groupBy(group).agg(*ci)


def _permute(seed: int, which: int, stat):
    """UDF: block of replicates → statistics after dealing the pooled patterns out to groups of fixed size."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(pool: pd.Series, patterns: pd.Series, sizes: pd.Series, start: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for c, pats, ns, r, reps in zip(pool, patterns, sizes, start, size):
            m, rng = np.array([list(p) for p in pats], dtype=float), draw_seed(seed, int(r))
            left = np.repeat(np.asarray(c, dtype=np.int64)[None, :], int(reps), axis=0)
            values = []
            for n in ns:
                take, room, rest = np.zeros_like(left), np.full(int(reps), int(n)), left.sum(axis=1)
                for j in range(left.shape[1]):
                    rest = rest - left[:, j]
                    take[:, j] = rng.hypergeometric(left[:, j], rest, room)
                    room = room - take[:, j]
                left = left - take
                values.append(_hill(take @ m / n)[:, which])
            out.append(stat(np.array(values)).tolist())
        return pd.Series(out)

    return run


def observed_hill(patterns: DataFrame, group: str) -> DataFrame:
    """q0, q1 and q2 of each group from its pattern counts."""
    weights = patterns.select(group, "c", F.posexplode("pattern").alias("category", "on")).groupBy(group, "category").agg(F.sum(F.col("c") * F.col("on")).alias("weight"))
    return hill_numbers(normalise(weights, group, "weight"), group)


def _reaches(drawn: str, observed: str) -> Column:
    """Drawn statistic as large as the observed one; the two are summed in different orders, so ties allow for rounding."""
    return F.col(drawn) >= F.col(observed) - 1e-9 * F.greatest(F.lit(1.0), F.abs(observed))


def permutation_hill(patterns: DataFrame, group: str, q: int = 1, n_perm: int = 2000, seed: int = 101) -> DataFrame:
    """Global test: range of the Hill number over groups against permuted group labels (one row)."""
    obs = observed_hill(patterns, group).agg((F.max(f"q{q}") - F.min(f"q{q}")).cast("double"))
    pool = patterns.groupBy("pattern").agg(F.sum("c").alias("c")).agg(F.array_sort(F.collect_list(F.struct("pattern", "c"))).alias("pats"))
    sizes = patterns.groupBy(group).agg(F.sum("c").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct(group, "n"))), lambda s: s["n"]))
    run = _permute(seed, q, lambda v: v.max(axis=0) - v.min(axis=0))
    d = spread(pool.withColumn("ns", sizes.scalar()).select("pats", "ns", _blocks(n_perm).alias("blk")))
    s = d.select(F.explode(run(_counts("pats"), _patterns("pats"), "ns", "blk.start", "blk.size")).alias("s")).withColumn("obs_stat", obs.scalar())
    return s.groupBy("obs_stat").agg(F.avg(_reaches("s", "obs_stat").cast("double")).alias("p")).select(F.lit(f"q{q}").alias("metric"), "obs_stat", "p")


def permutation_hill_pairs(patterns: DataFrame, group: str, q: int = 1, n_perm: int = 2000, seed: int = 201) -> DataFrame:
    """Every pair of groups: absolute difference against permuted labels, BH over pairs."""
    observed = observed_hill(patterns, group).select(group, F.col(f"q{q}").cast("double").alias("q"))
    packed = _packed(patterns, group).join(observed, group)
    groups = packed.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "pats", "q"))).alias("gs"))
    pairs = groups.select("gs", F.posexplode("gs").alias("i", "x")).select("x", F.explode(F.slice("gs", F.col("i") + 2, F.size("gs"))).alias("y"))
    pairs = pairs.select(F.col("x.g").alias("group1"), F.col("y.g").alias("group2"), F.abs(F.col("x.q") - F.col("y.q")).alias("obs_diff"),
                         F.concat("x.pats", "y.pats").alias("pats"),
                         F.array(*[F.aggregate(f"{s}.pats", F.lit(0).cast("bigint"), lambda a, e: a + e["c"]) for s in ("x", "y")]).alias("ns"))
    run = _permute(seed, q, lambda v: np.abs(v[0] - v[1]))
    d = spread(pairs.select("*", _blocks(n_perm).alias("blk")))
    s = d.select("group1", "group2", "obs_diff", F.explode(run(_counts("pats"), _patterns("pats"), "ns", "blk.start", "blk.size")).alias("s"))
    out = s.groupBy("group1", "group2", "obs_diff").agg(F.avg(_reaches("s", "obs_diff").cast("double")).alias("p"))
    return bh(out.withColumn("metric", F.lit(f"q{q}")), "p", (), "p_bh")


# --- selection -------------------------------------------------------------------------------


def stratified_selection(df: DataFrame, plan: dict, id_col: str = "id", seed: int = 1) -> DataFrame:
    """Selection by blocks: forced stratum, early block with refill, late sections by year and pattern.

    ``df`` needs id, year, source, positive (boolean), pattern and forced (boolean).  ``plan`` holds
    ``total``, ``early`` = {before, total, targets{source: n}} and ``late`` =
    [{name, lo, hi, targets{source: n}}], ``positive_share``.  Every draw is a seeded hash order.
    """
    df = saved(df, "pool")  # read by every step below
    spark_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    forced = df.where("forced").withColumn("section", F.lit("forced"))
    pool = df.where("NOT forced")

    early = plan["early"]
    block = pool.where(F.col("year") < early["before"])
    have = block.where("positive").groupBy("source").agg(F.count(F.lit(1)).alias("np"))
    need = block.where("NOT positive").join(have, "source", "left").withColumn(
        "take", F.greatest(F.coalesce(F.try_element_at(spark_map(early["targets"]), F.col("source")), F.lit(0)) - F.coalesce("np", F.lit(0)), F.lit(0)))
    picked = saved(block.where("positive").unionByName(sample_up_to(need, "take", "source", id_col, seed).drop("np", "take")), "picked")
    short = F.greatest(F.lit(early["total"]) - one_value(picked, F.count(F.lit(1))), F.lit(0))
    refill = sample_up_to(exclude(block, picked, id_col).withColumn("take", short), "take", (), id_col, seed + 1).drop("take")
    first = union_all(picked, refill).withColumn("section", F.lit("early"))

    parts = []
    for s in plan["late"]:
        sec = pool.where(F.col("year").between(s["lo"], s["hi"])).withColumn("target", F.try_element_at(spark_map(s["targets"]), F.col("source")))
        parts.append(sec.where(F.col("target") > 0).withColumn("section", F.lit(s["name"])))
    late = union_all(*parts)
    goal = F.bround(F.col("target") * plan["positive_share"], 0).cast("int")
    late = late.withColumn("need", F.when(F.col("positive"), goal).otherwise(F.col("target") - goal))
    key = ["section", "source", "positive", "year"]
    sizes = late.groupBy(*key, "pattern", "need").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy(*key).agg(F.sum("n").alias("n_all"))
    sizes = sizes.join(totals, key).select(*key, "pattern", F.bround(F.col("n") / F.col("n_all") * F.col("need"), 0).cast("int").alias("take"))
    late = sample_up_to(late.join(sizes, [*key, "pattern"]), "take", [*key, "pattern"], id_col, seed + 2)
    # arrival order of the section: positives first, then years, patterns and hash; cut at the target
    # (a section holds at most years x target rows here, so the ordered pass is bounded by the plan)
    order = W.partitionBy("section", "source").orderBy(F.desc("positive"), "year", "pattern", hash_order(id_col, seed + 2), id_col)
    late = saved(late, "late")
    late = late.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("target")).drop("__r", "target", "need", "take")

    rest = saved(union_all(first, late), "rest")
    room = F.lit(plan["total"]) - one_value(forced, F.count(F.lit(1)))
    fits = F.when(room >= 0, room).otherwise(F.raise_error(F.lit("the forced stratum is larger than the whole selection")))
    forced = forced.where(fits >= 0)
    rest = sample_up_to(rest.withColumn("take", fits), "take", (), id_col, seed + 3).drop("take")
    return union_all(forced, rest)


def allocate_quotas(strata: DataFrame, stratum: str, share: float) -> DataFrame:
    """Positives per stratum (``quota``) from ``target``, ``pos`` and ``neg`` available.

    A stratum first gets its proportional number within what exists.  The difference to the pooled
    share is then levelled: room is taken from the strata with most room down to a common level,
    which follows from cumulative sums over the strata ordered by room.  What the level leaves over
    in whole genomes falls on the last names.  The job fails if a stratum has fewer genomes than its
    target, or the pooled share cannot be met.
    """
    low, high = F.greatest(F.lit(0), F.col("target") - F.col("neg")), F.least("target", "pos")
    own = F.least(F.greatest(F.bround(F.col("target") * share, 0).cast("bigint"), low), high)
    own = F.when(low <= high, own).otherwise(F.raise_error(F.lit("a stratum has fewer genomes than its target")))
    d = strata.withColumn("start", own)
    every = W.partitionBy()
    d = d.withColumn("gap", F.bround(F.sum("target").over(every) * share, 0).cast("bigint") - F.sum("start").over(every))
    d = d.withColumn("room", F.when(F.col("gap") >= 0, high - F.col("start")).otherwise(F.col("start") - low))
    by_room = W.orderBy(F.desc("room"), stratum).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({"i": F.count(F.lit(1)).over(by_room), "left": F.sum("room").over(by_room) - F.abs("gap")})
    # the strata above the common level are the longest head in which each has more room than the level
    d = d.withColumn("head", F.max(F.when(F.col("room") * F.col("i") > F.col("left"), F.struct("i", "left"))).over(every))
    each, over = F.floor(F.col("head.left") / F.col("head.i")), F.pmod("head.left", "head.i")
    in_head = F.col("i") <= F.col("head.i")
    name_rank = F.row_number().over(W.partitionBy("in_head").orderBy(stratum))
    d = d.withColumn("in_head", F.coalesce(in_head, F.lit(False))).withColumn("keeps", name_rank <= over)
    after = F.when(F.col("in_head") & (F.col("gap") != 0), each + F.col("keeps").cast("int")).otherwise(F.col("room"))
    after = F.when(F.sum("room").over(every) >= F.abs("gap"), after).otherwise(F.raise_error(F.lit("the pooled share cannot be met with the available genomes")))
    return d.select(stratum, "target", (F.col("start") + F.signum("gap").cast("bigint") * (F.col("room") - after)).alias("quota"))


def quota_selection(df: DataFrame, targets: DataFrame, stratum: str, positive: str, share: float = 0.8, id_col: str = "id", seed: int = 1) -> DataFrame:
    """Sample each stratum to its target with a pooled share of positives."""
    avail = df.join(targets, stratum).groupBy(stratum).agg(
        F.first("target").alias("target"), F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    quota = allocate_quotas(avail, stratum, share)
    rows = F.array(F.struct(F.lit(True).alias(positive), F.col("quota").alias("take")), F.struct(F.lit(False).alias(positive), (F.col("target") - F.col("quota")).alias("take")))
    plan = quota.select(stratum, F.inline(rows))
    return sample_up_to(df.join(plan, [stratum, positive]), "take", [stratum, positive], id_col, seed).drop("take")
