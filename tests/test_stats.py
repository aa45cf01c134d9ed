import math
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from isolens.functions import formatting, stats
from isolens.operators import enrichment, resampling


def sf(k, m, s, n):
    return float(Fraction(sum(comb(s, i) * comb(m - s, n - i) for i in range(max(k, n + s - m, 0), min(s, n) + 1)), comb(m, n)))


def fisher(a, b, c, d):
    s, n, m = a + c, a + b, a + b + c + d
    pmf = {i: Fraction(comb(s, i) * comb(m - s, n - i), comb(m, n)) for i in range(max(0, n + s - m), min(s, n) + 1)}
    return float(sum(p for p in pmf.values() if p <= pmf[a] * (1 + Fraction(1, 10**7))))


def test_hypergeom_tail(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        m = int(rng.integers(2, 900))
        s, n = int(rng.integers(0, m + 1)), int(rng.integers(0, m + 1))
        rows.append((int(rng.integers(max(0, n + s - m), min(s, n) + 1)), m, s, n))
    df = spark.createDataFrame(rows, "k long, m long, s long, n long").withColumn("p", stats.hypergeom_sf("k", "m", "s", "n"))
    for r in df.collect():
        assert r.p == pytest.approx(sf(r.k, r.m, r.s, r.n), rel=1e-8, abs=1e-13)


def test_fisher(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(int(x) for x in rng.integers(0, 60, 4)) for _ in range(200)] + [(0, 0, 3, 4), (3, 1, 1, 3), (400, 20, 30, 500), (1, 0, 0, 1)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long").withColumn("p", stats.fisher_two_sided("a", "b", "c", "d"))
    for r in df.collect():
        assert r.p == pytest.approx(fisher(r.a, r.b, r.c, r.d), rel=1e-7, abs=1e-300)


def log_comb_sum(terms):
    return math.log(sum(terms))


def test_far_tails_keep_their_order(spark):
    """p-values down to 1e-2000 and below, against whole-number arithmetic, through test, FDR and Holm."""
    m, s, n = 9000, 3000, 3000
    ks = [2990, 2700, 2699, 2400, 1100, 1000]
    whole = math.log(comb(m, n))
    want = {k: log_comb_sum([comb(s, i) * comb(m - s, n - i) for i in range(k, s + 1)]) - whole for k in ks}
    assert want[2990] < -2000 * math.log(10)
    df = spark.createDataFrame([(k, m, s, n) for k in ks], "k long, m long, s long, n long")
    got = {r.k: r for r in enrichment.test_once(df, ["k", "m", "s", "n"], stats.hypergeom_log_sf("k", "m", "s", "n")).collect()}
    fdr = dict(zip(ks, np.minimum.accumulate([want[k] + math.log(len(ks) / (i + 1)) for i, k in enumerate(ks)][::-1])[::-1]))
    for k in ks:
        assert got[k].log_p == pytest.approx(want[k], rel=1e-9, abs=1e-9)
        assert got[k].log_fdr == pytest.approx(min(0.0, fdr[k]), rel=1e-9, abs=1e-9)
    assert got[2700].log_p < got[2699].log_p and got[2990].p == 0.0
    a, b, c, d = 2990, 10, 10, 5990
    pmf = {i: comb(a + c, i) * comb(b + d, a + b - i) for i in range(a, a + 11)}
    tables = spark.createDataFrame([("e", "x", "y", a, b, c, d), ("e", "x", "z", 2700, 300, 300, 5700), ("e", "y", "z", 1, 1, 1, 1)],
                                   "e string, group1 string, group2 string, a long, b long, c long, d long")
    rows = {r.group1 + r.group2: r for r in enrichment.holm_pairs(tables, "e").collect()}
    exact = log_comb_sum(pmf.values()) - math.log(comb(a + b + c + d, a + b))
    assert rows["xy"].log_p == pytest.approx(exact, rel=1e-9) and rows["xy"].log_p_holm == pytest.approx(exact + math.log(3), rel=1e-9)
    assert rows["xz"].log_p_holm == pytest.approx(rows["xz"].log_p + math.log(2), rel=1e-9) and rows["xz"].log_p > exact
    assert rows["yz"].p_holm == pytest.approx(1.0)


def test_chi2_published_quantiles(spark):
    # published upper 5 % and 1 % points
    rows = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (6.634897, 1, 0.01), (15.086272, 5, 0.01), (23.209251, 10, 0.01)]
    for r in spark.createDataFrame(rows, "x double, k int, want double").withColumn("p", stats.chi2_sf("x", "k")).collect():
        assert r.p == pytest.approx(r.want, rel=1e-5)


def bh_numpy(p):
    o = np.argsort(-p)
    q = np.minimum(1, np.minimum.accumulate(p[o] * len(p) / np.arange(len(p), 0, -1)))
    out = np.empty(len(p))
    out[o] = q
    return out


def test_bh(spark):
    rng = np.random.default_rng(3)
    rows = [(i, g, float(p)) for g in ("a", "b") for i, p in enumerate(np.round(rng.uniform(0, 1, 400) ** 6, 4))]
    rows += [(1000, "a", None), (1001, "c", 0.2)]
    got = enrichment.bh(spark.createDataFrame(rows, "i int, g string, p double"), "p", "g").toPandas()
    assert got[got.i == 1000].fdr.isna().all()
    assert got[got.g == "c"].fdr.iloc[0] == 0.2
    for g in ("a", "b"):
        part = got[(got.g == g) & got.p.notna()]
        assert np.allclose(part.fdr, bh_numpy(part.p.to_numpy()))


def test_holm(spark):
    df = spark.createDataFrame([("e", "x", 0.01), ("e", "y", 0.04), ("e", "z", 0.03), ("s", "x", 0.2)], "k string, g string, p double")
    got = {(r.k, r.g): r.p_holm for r in enrichment.holm(df, "p", "k", ["g"]).collect()}
    assert got == {("e", "x"): pytest.approx(0.03), ("e", "z"): pytest.approx(0.06), ("e", "y"): pytest.approx(0.06), ("s", "x"): 0.2}


def test_attribute_letters_and_ranges(spark):
    rows = [(c, g) for c, (inside, outside) in {"x": (90, 10), "y": (85, 15), "z": (5, 95), "all": (7, 0), "none": (0, 7)}.items() for g, n in (("in", inside), ("out", outside)) for _ in range(n)]
    out = enrichment.attribute_enrichment(spark.createDataFrame(rows, "cat string, grp string"), "grp", "cat", ["in", "out"], monte_carlo=False)
    table = {(r.grp, r.cat): r for r in out["table"].collect()}
    assert {c: table["in", c].letters for c in ("x", "y", "z", "all", "none")} == {"x": "a", "y": "a", "z": "b", "all": "", "none": ""}
    assert {c: table["in", c].tested for c in ("x", "all", "none")} == {"x": "YES", "all": "", "none": ""}
    pair = {(r.grp, r.group1, r.group2): r for r in out["pairs"].collect()}["in", "x", "z"]
    assert (pair.share1_pct, pair.share2_pct, pair.diff_share_pp) == pytest.approx((90, 5, 85))
    assert (pair.within1_pct, pair.diff_within_pp) == pytest.approx((100 * 90 / 187, 100 * 85 / 187)) and pair.direction == "Cat1>Cat2"
    omnibus = {r.grp: r for r in out["omnibus"].collect()}["in"]
    assert (omnibus.n_categories, omnibus.n_tested, omnibus.n_in_group, omnibus.n_all) == (5, 3, 187, 314)
    assert (omnibus.share_pct_min, omnibus.share_pct_max, omnibus.within_pct_max) == pytest.approx((5, 90, 100 * 90 / 187))


def test_compact_letters(spark):
    pairs = [("e", "A", "B", 0.01), ("e", "A", "C", 0.5), ("e", "B", "C", 0.5), ("f", "A", "B", 0.9)]
    df = spark.createDataFrame(pairs, "k string, group1 string, group2 string, p_holm double")
    got = {(r.k, r.group): r.letters for r in enrichment.cld(df, "k", ["A", "B", "C"]).collect()}
    assert got == {("e", "A"): "a", ("e", "B"): "b", ("e", "C"): "a", ("f", "A"): "a", ("f", "B"): "a"}


def test_monte_carlo_is_repeatable_and_close(spark):
    df = spark.createDataFrame([([3, 9, 6], [10, 12, 14], 5), ([1, 1], [2, 3], 6)], "k array<long>, n array<long>, key long")
    run = stats.monte_carlo_chi2(5000, 1)
    p = sorted(r.p for r in df.select(run("k", "n", "key").alias("p")).collect())
    assert p == sorted(r.p for r in df.repartition(2).select(run("k", "n", "key").alias("p")).collect())
    assert 0 < min(p) <= max(p) <= 1


def test_rate_ci_zero_denominator(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "x int, n int")
    rows = df.select(*[v.alias(k) for k, v in stats.rate_ci("x", "n").items()]).collect()
    assert rows[0].pct is None and rows[0].lo is None and rows[0].hi is None
    assert rows[1].pct == 50.0 and rows[2].hi == 100.0


def test_fixed_decimals_match_binary_rounding(spark):
    values = [0.15, 0.25, 0.35, 0.45, 16.25, 16.35, 99.95, 99.949999, 12.345, 2.675, 0.05, 33.333333, 100.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", formatting.fixed("v", 1).alias("a"), formatting.fixed("v", 2).alias("b")).collect():
        assert r.a == f"{r.v:.1f}" and r.b == f"{r.v:.2f}"


def test_bootstrap_and_permutation(spark):
    rows = [("a", 1, 0)] * 40 + [("a", 0, 1)] * 10 + [("b", 1, 0)] * 5 + [("b", 0, 1)] * 45
    pats = resampling.pattern_counts(spark.createDataFrame(rows, "g string, x int, y int"), "g", ["x", "y"])
    ci = {r.g: r for r in resampling.bootstrap_hill(pats, "g", 400).collect()}
    q1 = math.exp(-(0.8 * math.log(0.8) + 0.2 * math.log(0.2)))
    assert ci["a"].q1_lo <= q1 <= ci["a"].q1_hi and ci["a"].q0_hi == 2.0
    p = resampling.permutation_hill(pats, "g", 1, 400).collect()[0]
    assert 0 <= p.p <= 1 and p.obs_stat > 0
    assert resampling.permutation_hill(pats, "g", 1, 400).collect()[0].p == p.p
    pair = resampling.permutation_hill_pairs(pats, "g", 2, 400).collect()
    assert len(pair) == 1 and pair[0].p_bh == pair[0].p


def test_allocate_quotas(spark):
    def quotas(rows, share):
        d = spark.createDataFrame(rows, "s string, target long, pos long, neg long")
        return {r.s: r.quota for r in resampling.allocate_quotas(d, "s", share).collect()}

    assert quotas([("a", 100, 70, 100), ("b", 50, 50, 50), ("c", 10, 10, 2)], 0.8) == {"a": 70, "b": 49, "c": 9}
    assert quotas([("a", 100, 90, 90), ("b", 50, 50, 50)], 0.8) == {"a": 80, "b": 40}
    # too few positives in one stratum: those with most room are levelled
    got = quotas([("a", 100, 40, 100), ("b", 100, 95, 90), ("c", 60, 60, 60), ("d", 30, 25, 30)], 0.7)
    assert sum(got.values()) == 203 and got["a"] == 40 and got["b"] <= 95 and got["d"] <= 25
    with pytest.raises(Exception, match="pooled share"):
        quotas([("a", 100, 60, 100), ("b", 50, 50, 50)], 0.8)
    with pytest.raises(Exception, match="fewer genomes"):
        quotas([("a", 10, 2, 3)], 0.5)


def test_forced_stratum_must_fit(spark):
    pool = spark.range(40).selectExpr("id", "1998 AS year", "'x' AS source", "id % 2 = 0 AS positive", "'p' AS pattern", "id < 30 AS forced")
    plan = {"total": 20, "positive_share": 0.5, "early": {"before": 1997, "total": 2, "targets": {"x": 2}}, "late": [{"name": "l", "lo": 1997, "hi": 1999, "targets": {"x": 5}}]}
    with pytest.raises(Exception, match="forced stratum"):
        resampling.stratified_selection(pool, plan).collect()


def test_definer_gate(spark):
    grid = spark.createDataFrame([("f", "x", 9, 9, 10, 30), ("g", "x", 9, 10, 10, 30), ("h", "x", 10, 30, 10, 30)], "f string, g string, k long, k_all long, n long, n_all long")
    got = {r.f: r.p for r in enrichment.hypergeom_enrichment(grid, "g").collect()}
    assert got["f"] is None and got["h"] is None and got["g"] == pytest.approx(sf(9, 30, 10, 10))
    assert enrichment.definers(enrichment.hypergeom_enrichment(grid, "g"), 40, 10).select(F.col("f")).collect()[0].f == "g"


def test_montecarlo_covers_all_present_hits(spark):
    """Every feature that passes the presence rule (80, 90) has a row, none below 80 or 90 has one."""
    from isolens.plans import registry

    registry.load()
    sf_dir = "/root/testdata/sf0.001"
    present = registry.Entities(spark, sf_dir)("hits").where("coverage >= 80 AND identity >= 90")
    want = {r[0] for r in present.select(F.concat_ws(":", "symbol", "name")).distinct().collect()}
    got = [r[0] for r in registry.QUERIES["chi2_montecarlo"](spark, sf_dir).select("symbol").collect()]
    assert len(got) == len(want) and set(got) == want
