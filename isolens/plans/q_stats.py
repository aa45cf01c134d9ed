"""Queries over exact tests, multiple testing, enrichment tables and resampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import enrichment, pangenome, ranking, relations, reports, resampling, reshape
from .q_clean import RUNS_SQL
from .q_reports import _COMP_SQL as COMP_SQL
from .q_reports import CATS, LINEAGES, marker_indicators
from .registry import query, rounded

FEATURE = ["pos", "ref", "alt"]


def neglog(c: str):
    """-log10 of a p-value, given as its natural logarithm log_<c>, to six places; the added zero removes a negative zero."""
    return (F.round(-F.col(f"log_{c}") / F.lit(math.log(10)), 6) + 0.0).alias(c)


NL = "round(-log_{0} / ln(10), 6) + 0.0"

_GRID = """fc AS (SELECT pos, ref, alt, lineage, count(DISTINCT sample) AS k FROM {variants} JOIN {groups} USING (sample) GROUP BY ALL),
gt AS (SELECT lineage, count(*) AS n, (SELECT count(*) FROM {groups}) AS n_all FROM {groups} GROUP BY 1), ft AS (SELECT pos, ref, alt, CAST(sum(k) AS BIGINT) AS k_all FROM fc GROUP BY ALL),
grid AS (SELECT ft.pos, ft.ref, ft.alt, gt.lineage, coalesce(fc.k, 0) AS k, k_all, n, n_all FROM ft CROSS JOIN gt LEFT JOIN fc ON fc.pos = ft.pos AND fc.ref = ft.ref AND fc.alt = ft.alt AND fc.lineage = gt.lineage)"""

# logarithm of the exact upper tail by log-gamma terms, once per distinct table
_HYPER = """hp AS (SELECT k, k_all, n, n_all, least(0, max(mx) + ln(sum(exp(t - mx)))) AS log_p FROM (SELECT *, max(t) OVER (PARTITION BY k, k_all, n, n_all) AS mx FROM (
 SELECT *, lgamma(k_all + 1) - lgamma(i + 1) - lgamma(k_all - i + 1) + lgamma(n_all - k_all + 1) - lgamma(n - i + 1) - lgamma(n_all - k_all - n + i + 1) - lgamma(n_all + 1) + lgamma(n + 1) + lgamma(n_all - n + 1) AS t
 FROM (SELECT *, unnest(generate_series(greatest(k, n + k_all - n_all, 0), least(k_all, n))) AS i FROM (SELECT DISTINCT k, k_all, n, n_all FROM grid WHERE GATE)))) GROUP BY ALL)"""
_TESTED = """tp AS (SELECT grid.*, GATE AS eligible, log_p FROM grid LEFT JOIN hp ON grid.k = hp.k AND grid.k_all = hp.k_all AND grid.n = hp.n AND grid.n_all = hp.n_all AND (GATEG)),
dp AS (SELECT SCOPE, log_p, count(*) AS c FROM tp WHERE log_p IS NOT NULL GROUP BY ALL),
rk AS (SELECT *, sum(c) OVER (PARTITION BY SCOPE ORDER BY log_p) AS r, sum(c) OVER (PARTITION BY SCOPE) AS m FROM dp),
bh AS (SELECT * EXCLUDE (c, r, m), least(0, min(log_p + ln(m) - ln(r)) OVER (PARTITION BY SCOPE ORDER BY log_p DESC)) AS log_fdr FROM rk),
tested AS (SELECT tp.*, bh.log_fdr, exp(bh.log_fdr) AS fdr, 100.0 * tp.k / tp.n AS percent_in, CASE WHEN tp.n_all > tp.n THEN 100.0 * (tp.k_all - tp.k) / (tp.n_all - tp.n) ELSE 0 END AS percent_out FROM tp LEFT JOIN bh USING (SCOPE, log_p))"""


def tested_sql(gate: str, scope: str, grid: str = _GRID) -> str:
    gateg = gate.replace("k_all", "grid.k_all").replace("n_all", "grid.n_all")
    body = (_HYPER.replace("GATE", gate) + ",\n" + _TESTED.replace("GATEG", gateg).replace("GATE", gateg).replace("SCOPE", scope))
    return f"WITH {grid},\n{body}\n"


_VAR = tested_sql("k_all >= 10 AND k_all < n_all", "lineage")


def _grid(q):
    g = q("groups")
    fc = enrichment.feature_counts(q("variants"), g, "sample", FEATURE, "lineage")
    totals = enrichment.group_totals(g, "lineage")
    return enrichment.feature_grid(fc, totals, FEATURE, "lineage"), totals


def _tested(q):
    grid, totals = _grid(q)
    return enrichment.hypergeom_enrichment(grid, "lineage"), totals


@query("hypergeom_enrichment", "T1", _VAR + f"SELECT pos, ref, alt, lineage, k, k_all, n, n_all, eligible, {NL.format('p')} AS p, {NL.format('fdr')} AS fdr, round(percent_in, 6) AS percent_in, round(percent_out, 6) AS percent_out FROM tested")
def _(q):
    t, _ = _tested(q)
    return rounded(t.withColumns({"p": neglog("p"), "fdr": neglog("fdr")}).drop("log_p", "log_fdr"), "percent_in", "percent_out")


_SRC_GRID = """fc AS (SELECT lineage, pos, ref, alt, source, count(DISTINCT sample) AS k FROM {variants} JOIN {groups} USING (sample) GROUP BY ALL),
gt AS (SELECT lineage, source, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY lineage) AS BIGINT) AS n_all FROM {groups} GROUP BY lineage, source), ft AS (SELECT lineage, pos, ref, alt, CAST(sum(k) AS BIGINT) AS k_all FROM fc GROUP BY ALL),
grid AS (SELECT ft.lineage, ft.pos, ft.ref, ft.alt, gt.source, coalesce(fc.k, 0) AS k, k_all, n, n_all FROM ft JOIN gt USING (lineage) LEFT JOIN fc ON fc.lineage = ft.lineage AND fc.pos = ft.pos AND fc.ref = ft.ref AND fc.alt = ft.alt AND fc.source = gt.source)"""


@query("hypergeom_by_source", "T1", tested_sql("k_all >= 0", "lineage, source", _SRC_GRID)
       + f"SELECT lineage, source, pos, ref, alt, k, {NL.format('p')} AS p, {NL.format('fdr')} AS fdr, round(percent_in, 6) AS percent_in, round(percent_out, 6) AS percent_out FROM tested")
def _(q):
    g = q("groups")
    fc = enrichment.feature_counts(q("variants"), g, "sample", FEATURE, "source", ["lineage"])
    grid = enrichment.feature_grid(fc, enrichment.group_totals(g, "source", ["lineage"]), FEATURE, "source", ["lineage"])
    t = enrichment.hypergeom_enrichment(grid, ["lineage", "source"], min_total=None)
    return rounded(t.select("lineage", "source", *FEATURE, "k", neglog("p"), neglog("fdr"), "percent_in", "percent_out"), "percent_in", "percent_out")


_BIN = "CASE WHEN percent_in < 60 THEN '40-<60%' WHEN percent_in < 80 THEN '60-<80%' WHEN percent_in < 90 THEN '80-<90%' ELSE '>=90%' END"


@query("definers", "T2", _VAR + f"SELECT pos, ref, alt, lineage, round(percent_in, 6) AS percent_in, {_BIN} AS coverage_bin FROM tested WHERE fdr <= 0.05 AND percent_in >= 40 AND percent_out <= 1")
def _(q):
    d = enrichment.definers(_tested(q)[0]).withColumn("coverage_bin", enrichment.coverage_bin())
    return rounded(d.select(*FEATURE, "lineage", "percent_in", "coverage_bin"), "percent_in")


_ANN = "an AS (SELECT pos, ref, alt, min(struct_pack(g := gene, e := effect)) AS a FROM {variants} GROUP BY ALL)"


@query("feature_report", "G32", _VAR + f""", {_ANN}, s AS (SELECT t.*, a.g AS gene, a.e AS effect, percent_in >= 40 AND percent_out <= 1 AS strict FROM tested t JOIN an USING (pos, ref, alt) WHERE fdr <= 0.05)
SELECT gt.lineage, gt.n, count(s.pos) AS significant, count(*) FILTER (strict) AS strict_definers, count(*) FILTER (strict AND gene = 'intergenic') AS definer_intergenic, count(*) FILTER (strict AND gene <> 'intergenic') AS definer_coding,
 count(DISTINCT CASE WHEN strict AND gene NOT IN ('intergenic', 'hypothetical protein') THEN gene END) AS genes_strict, count(DISTINCT CASE WHEN gene NOT IN ('intergenic', 'hypothetical protein') THEN gene END) AS genes_significant,
 count(*) FILTER (strict AND effect = 'missense_variant') AS definer_missense_variant, count(*) FILTER (strict AND effect = 'stop_gained') AS definer_stop_gained FROM gt LEFT JOIN s USING (lineage) GROUP BY ALL""")
def _(q):
    t, totals = _tested(q)
    ann = enrichment.first_annotation(q("variants"), FEATURE, ["gene", "effect"])
    return enrichment.feature_report(t, ann, FEATURE, "lineage", totals, ["missense_variant", "stop_gained"])


_BINS_SQL = """SELECT gt.lineage, gt.n, coalesce(sig, 0) AS significant, coalesce(strict, 0) AS strict_definers, b.bin AS coverage_bin, coalesce(c, 0) AS definers FROM gt CROSS JOIN (VALUES ('40-<60%'), ('60-<80%'), ('80-<90%'), ('>=90%')) b(bin)
LEFT JOIN (SELECT lineage, count(*) AS sig, count(*) FILTER (percent_in >= 40 AND percent_out <= 1) AS strict FROM tested WHERE fdr <= 0.05 GROUP BY 1) s USING (lineage)
LEFT JOIN (SELECT lineage, BIN AS bin, count(*) AS c FROM tested WHERE fdr <= 0.05 AND percent_in >= 40 AND percent_out <= 1 GROUP BY ALL) x ON x.lineage = gt.lineage AND x.bin = b.bin""".replace("BIN AS", _BIN + " AS")


@query("definer_bins", "G33", _VAR + _BINS_SQL)
def _(q):
    t, totals = _tested(q)
    return enrichment.definer_bins(t, "lineage", totals)


_WIDE = ", ".join(f"CAST(max(CASE coverage_bin WHEN '{b}' THEN definers END) AS BIGINT) AS \"{b}\"" for b in enrichment.COVERAGE_BINS)


@query("definer_bins_wide", "G33", _VAR + f"SELECT lineage, {_WIDE} FROM ({_BINS_SQL}) GROUP BY 1")
def _(q):
    t, totals = _tested(q)
    long = enrichment.definer_bins(t, "lineage", totals)
    return reshape.coverage_wide(long, "lineage", list(enrichment.COVERAGE_BINS), value="definers")


_RUN_GRID = RUNS_SQL + """, v AS (SELECT sample, pos, ref, alt, bool_and(EXISTS (SELECT 1 FROM {intervals} i WHERE i.sample = x.sample AND x.pos BETWEEN i.start_pos AND i.end_pos)) AS masked FROM {variants} x GROUP BY ALL),
vs AS (SELECT 'all_snps' AS scenario, * FROM v UNION ALL SELECT 'vertical_only', * FROM v WHERE NOT masked),
fc AS (SELECT scheme, mode, scenario, pos, ref, alt, lineage, count(*) AS k FROM vs JOIN runs USING (sample) GROUP BY ALL),
gt AS (SELECT scheme, mode, lineage, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY scheme, mode) AS BIGINT) AS n_all FROM runs GROUP BY scheme, mode, lineage),
ft AS (SELECT scheme, mode, scenario, pos, ref, alt, CAST(sum(k) AS BIGINT) AS k_all FROM fc GROUP BY ALL),
grid AS (SELECT ft.scheme, ft.mode, ft.scenario, ft.pos, ft.ref, ft.alt, gt.lineage, coalesce(fc.k, 0) AS k, k_all, n, n_all FROM ft JOIN gt USING (scheme, mode)
 LEFT JOIN fc ON fc.scheme = ft.scheme AND fc.mode = ft.mode AND fc.scenario = ft.scenario AND fc.pos = ft.pos AND fc.ref = ft.ref AND fc.alt = ft.alt AND fc.lineage = gt.lineage)"""


def _run_bins(q):
    g = q("groups")
    v = relations.flag_in_interval(q("variants").select("sample", *FEATURE), q("intervals"), "sample", "pos", "start_pos", "end_pos")
    counted = enrichment.scenario_counts(v, g, "sample", FEATURE, "lineage", "masked")
    run = ["scheme", "mode", "scenario"]
    fc = enrichment.with_feature_total(enrichment.roll_runs(counted, "lineage", ["scenario", *FEATURE]), [*run, *FEATURE])
    totals = enrichment.roll_runs(reports.counts(g, "lineage", "n"), "lineage", [], "n")
    sizes = totals.groupBy("scheme", "mode").agg(F.sum("n").alias("n_all"))
    totals = totals.join(sizes, ["scheme", "mode"]).withColumn("scenario", F.explode(F.array(F.lit("all_snps"), F.lit("vertical_only"))))
    t = enrichment.hypergeom_enrichment(enrichment.feature_grid(fc, totals, FEATURE, "lineage", run), [*run, "lineage"])
    return enrichment.definer_bins(t, [*run, "lineage"], totals)


@query("definer_bins_all_runs", "G33", tested_sql("k_all >= 10 AND k_all < n_all", "scheme, mode, scenario, lineage", _RUN_GRID) + f"""
, d AS (SELECT scheme, mode, scenario, lineage, {_BIN} AS bin, count(*) AS c FROM tested WHERE fdr <= 0.05 AND percent_in >= 40 AND percent_out <= 1 GROUP BY ALL),
s AS (SELECT scheme, mode, scenario, lineage, count(*) AS sig, count(*) FILTER (percent_in >= 40 AND percent_out <= 1) AS strict FROM tested WHERE fdr <= 0.05 GROUP BY ALL)
SELECT g.scheme, g.mode, sc.scenario, g.lineage, g.n, coalesce(sig, 0) AS significant, coalesce(strict, 0) AS strict_definers, b.bin AS coverage_bin, coalesce(c, 0) AS definers FROM gt g CROSS JOIN (VALUES ('all_snps'), ('vertical_only')) sc(scenario)
CROSS JOIN (VALUES ('40-<60%'), ('60-<80%'), ('80-<90%'), ('>=90%')) b(bin) LEFT JOIN s ON s.scheme = g.scheme AND s.mode = g.mode AND s.scenario = sc.scenario AND s.lineage = g.lineage
LEFT JOIN d ON d.scheme = g.scheme AND d.mode = g.mode AND d.scenario = sc.scenario AND d.lineage = g.lineage AND d.bin = b.bin""")
def _(q):
    return _run_bins(q)


@query("overall_bins", "G33", tested_sql("k_all >= 10 AND k_all < n_all", "scheme, mode, scenario, lineage", _RUN_GRID) + f"""
, d AS (SELECT lineage, {_BIN} AS bin, count(*) AS c FROM tested WHERE fdr <= 0.05 AND percent_in >= 40 AND percent_out <= 1 GROUP BY ALL)
SELECT g.lineage, b.bin AS coverage_bin, coalesce(min(c), 0) AS definers, count(*) AS runs FROM gt g CROSS JOIN (VALUES (1), (2)) sc(x) CROSS JOIN (VALUES ('40-<60%'), ('60-<80%'), ('80-<90%'), ('>=90%')) b(bin) LEFT JOIN d ON d.lineage = g.lineage AND d.bin = b.bin GROUP BY ALL""")
def _(q):
    return enrichment.overall_bins(_run_bins(q), "lineage")


# --- genes: Fisher ---------------------------------------------------------------------------

_FISHER = """fs AS (SELECT a, b, c, d, least(0, max(lo) + ln(sum(CASE WHEN lp <= lo + 1e-7 THEN exp(lp - lo) ELSE 0 END))) AS log_p FROM (
 SELECT a, b, c, d, lgamma(a + c + 1) - lgamma(i + 1) - lgamma(a + c - i + 1) + lgamma(b + d + 1) - lgamma(a + b - i + 1) - lgamma(d - a + i + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1) AS lp,
  lgamma(a + c + 1) - lgamma(a + 1) - lgamma(c + 1) + lgamma(b + d + 1) - lgamma(b + 1) - lgamma(d + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1) AS lo
 FROM (SELECT *, unnest(generate_series(greatest(a - d, 0), least(a + c, a + b))) AS i FROM (SELECT DISTINCT a, b, c, d FROM tables))) GROUP BY ALL)"""
_OR = "round((a + 0.5::DOUBLE) / (b + 0.5::DOUBLE) / ((c + 0.5::DOUBLE) / (d + 0.5::DOUBLE)), 6)"
_GENE_GRID = """acc AS (SELECT gene FROM {presence} JOIN {groups} USING (sample) GROUP BY 1 HAVING count(DISTINCT sample) >= 10 AND count(DISTINCT sample) / (SELECT count(*) FROM {groups}) BETWEEN 0.01 AND 0.99),
fc AS (SELECT gene, lineage, count(DISTINCT sample) AS k FROM {presence} JOIN {groups} USING (sample) WHERE gene IN (FROM acc) GROUP BY ALL), gt AS (SELECT lineage, count(*) AS n, (SELECT count(*) FROM {groups}) AS n_all FROM {groups} GROUP BY 1),
ft AS (SELECT gene, CAST(sum(k) AS BIGINT) AS k_all FROM fc GROUP BY ALL), grid AS (SELECT ft.gene, gt.lineage, coalesce(k, 0) AS k, k_all, n, n_all FROM ft CROSS JOIN gt LEFT JOIN fc ON fc.gene = ft.gene AND fc.lineage = gt.lineage)"""


def _gene_grid(q):
    g = q("groups")
    fc = enrichment.feature_counts(q("presence"), g, "sample", "gene", "lineage")
    return pangenome.accessory_rows(enrichment.feature_grid(fc, enrichment.group_totals(g, "lineage"), "gene", "lineage"))


def _bh_sql(scope):
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {scope} ORDER BY p) + count(*) OVER (PARTITION BY {scope}, p) - 1 AS r, count(*) OVER (PARTITION BY {scope}) AS m FROM tp),
bh AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY {scope} ORDER BY p DESC)) AS fdr FROM rk)"""


def _log_bh_sql(scope):
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {scope} ORDER BY log_p) + count(*) OVER (PARTITION BY {scope}, log_p) - 1 AS r, count(*) OVER (PARTITION BY {scope}) AS m FROM tp),
bh AS (SELECT *, least(0, min(log_p + ln(m) - ln(r)) OVER (PARTITION BY {scope} ORDER BY log_p DESC)) AS log_fdr FROM rk)"""


@query("fisher_vs_rest", "T3", f"""
WITH {_GENE_GRID}, tables AS (SELECT gene, lineage, k AS a, n - k AS b, k_all - k AS c, n_all - n - k_all + k AS d, n, n_all FROM grid), {_FISHER}, tp AS (SELECT tables.*, log_p FROM tables JOIN fs USING (a, b, c, d)), {_log_bh_sql('lineage')}
SELECT gene, lineage, a, b, c, d, {NL.format('p')} AS p, {NL.format('fdr')} AS fdr, {_OR} AS odds_ratio, round(100.0 * a / n, 6) AS percent_in, round(100.0 * c / (n_all - n), 6) AS percent_out FROM bh""")
def _(q):
    t = enrichment.fisher_vs_rest(_gene_grid(q), "lineage")
    t = t.select("gene", "lineage", "a", "b", "c", "d", neglog("p"), neglog("fdr"), "odds_ratio", "percent_in", "percent_out")
    return rounded(t, "odds_ratio", "percent_in", "percent_out")


@query("gene_definers", "T2", f"""
WITH {_GENE_GRID}, tables AS (SELECT gene, lineage, k AS a, n - k AS b, k_all - k AS c, n_all - n - k_all + k AS d, n, n_all FROM grid), {_FISHER}, tp AS (SELECT tables.*, log_p FROM tables JOIN fs USING (a, b, c, d)), {_log_bh_sql('lineage')}
SELECT gene, lineage FROM bh WHERE exp(log_fdr) <= 0.05 AND 100.0 * a / n >= 90 AND 100.0 * c / (n_all - n) <= 5""")
def _(q):
    return enrichment.definers(enrichment.fisher_vs_rest(_gene_grid(q), "lineage"), enrichment.GENE_IN, enrichment.GENE_OUT).select("gene", "lineage")


_PAIRS = "tables AS (SELECT x.gene, x.lineage AS group1, y.lineage AS group2, x.k AS a, x.n - x.k AS b, y.k AS c, y.n - y.k AS d FROM grid x JOIN grid y ON x.gene = y.gene AND x.lineage < y.lineage)"


@query("fisher_pairwise", "T4", f"""
WITH {_GENE_GRID}, {_PAIRS}, {_FISHER}, tp AS (SELECT tables.*, log_p FROM tables JOIN fs USING (a, b, c, d)), {_log_bh_sql('group1, group2')}
SELECT gene, group1, group2, a, b, c, d, {NL.format('p')} AS p, {NL.format('fdr')} AS fdr, {_OR} AS odds_ratio FROM bh""")
def _(q):
    t = enrichment.fisher_pairwise(_gene_grid(q), "gene", "lineage", LINEAGES)
    return rounded(t.select("gene", "group1", "group2", "a", "b", "c", "d", neglog("p"), neglog("fdr"), "odds_ratio"), "odds_ratio")


@query("odds_ratio", "T5", f"WITH t AS (SELECT p_brand, count(*) FILTER (p_size > 25 AND p_type = 'PROMO') AS a, count(*) FILTER (p_size > 25 AND p_type <> 'PROMO') AS b, count(*) FILTER (p_size <= 25 AND p_type = 'PROMO') AS c, count(*) FILTER (p_size <= 25 AND p_type <> 'PROMO') AS d FROM {{part}} GROUP BY 1) SELECT p_brand, {_OR} AS odds_ratio FROM t")
def _(q):
    big, promo = F.col("p_size") > 25, F.col("p_type") == "PROMO"
    t = q("part").groupBy("p_brand").agg(F.count_if(big & promo).alias("a"), F.count_if(big & ~promo).alias("b"), F.count_if(~big & promo).alias("c"), F.count_if(~big & ~promo).alias("d"))
    return rounded(t.select("p_brand", stats.odds_ratio("a", "b", "c", "d").alias("odds_ratio")), "odds_ratio")


# --- elements: chi-square --------------------------------------------------------------------

_EL_GRID = """fc AS (SELECT symbol, lineage, count(DISTINCT sample) AS k FROM {hits} JOIN {groups} USING (sample) WHERE coverage >= 80 AND identity >= 90 GROUP BY ALL), gt AS (SELECT lineage, count(*) AS n, (SELECT count(*) FROM {groups}) AS n_all FROM {groups} GROUP BY 1),
ft AS (SELECT symbol, CAST(sum(k) AS BIGINT) AS k_all FROM fc GROUP BY 1), grid AS (SELECT ft.symbol, gt.lineage, coalesce(k, 0) AS k, k_all, n FROM ft CROSS JOIN gt LEFT JOIN fc ON fc.symbol = ft.symbol AND fc.lineage = gt.lineage),
el AS (SELECT symbol, min(k_all) AS k_all, count(*) FILTER (k > 0 AND k < n) AS groups_tested, string_agg(CASE WHEN k > 0 AND k < n THEN lineage END, ',' ORDER BY lineage) AS tested FROM grid GROUP BY 1),
rs AS (SELECT *, CASE WHEN k_all < 10 THEN 'rare (<10 total present)' WHEN groups_tested < 2 THEN 'insufficient variable groups after zero/full exclusion' ELSE '' END AS reason FROM el),
ok AS (SELECT g.*, sum(g.k) OVER w / sum(g.n) OVER w AS sh FROM grid g JOIN rs USING (symbol) WHERE reason = '' AND g.k > 0 AND g.k < g.n WINDOW w AS (PARTITION BY symbol)),
ch AS (SELECT symbol, sum((k - n * sh) * (k - n * sh) / (n * sh * (1 - sh))) AS chi2, min(n * least(sh, 1 - sh)) AS low, count(*) - 1 AS dof FROM ok GROUP BY 1)"""


def _el_grid(q):
    g = q("groups")
    hits = enrichment.presence_filter(q("hits"), "coverage", "identity")
    return enrichment.feature_grid(enrichment.feature_counts(hits, g, "sample", "symbol", "lineage"), enrichment.group_totals(g, "lineage"), "symbol", "lineage")


def _eligible(q):
    return enrichment.eligible_groups(_el_grid(q), "symbol", "lineage", LINEAGES)


@query("eligible_groups", "T8", f"WITH {_EL_GRID} SELECT symbol, k_all, coalesce(tested, '') AS tested, reason FROM rs")
def _(q):
    return _eligible(q).select("symbol", "k_all", F.array_join(F.transform("tested", lambda e: e["g"]), ",").alias("tested"), "reason")


# upper tail from the series of the lower one; its terms peak at chi2 / 2, so their number follows chi2
_CHI_TAIL = "CASE WHEN chi2 IS NOT NULL THEN greatest(0, 1 - (SELECT sum(exp((dof / 2 + i) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2 + i + 1))) FROM (SELECT unnest(generate_series(0, CAST(chi2 AS BIGINT) + 400)) AS i))) END"
_CHI_P = f"round({_CHI_TAIL}, 6)"


@query("chi2_omnibus", "T6", f"WITH {_EL_GRID} SELECT symbol, reason, round(chi2, 6) AS chi2, round(low, 6) AS min_expected, CAST(dof AS INT) AS dof, {_CHI_P} AS p FROM rs LEFT JOIN ch USING (symbol)")
def _(q):
    d = enrichment.chi2_omnibus(_eligible(q), "symbol", monte_carlo=False)
    return rounded(d.select("symbol", "reason", "chi2", "min_expected", "dof", "p"), "chi2", "min_expected", "p")


@query("chi2_montecarlo", "T7")
def _(q):
    """Finer features (element × status of the order) leave many sparse tables to resample."""
    g = q("groups")
    hits = enrichment.presence_filter(q("hits"), "coverage", "identity").withColumn("symbol", F.concat_ws(":", "symbol", "name"))
    grid = enrichment.feature_grid(enrichment.feature_counts(hits, g, "sample", "symbol", "lineage"), enrichment.group_totals(g, "lineage"), "symbol", "lineage")
    return enrichment.chi2_omnibus(enrichment.eligible_groups(grid, "symbol", "lineage", LINEAGES), "symbol").select("symbol", "method", "chi2", "dof", "p", "reason")


def _omnibus(q):
    return enrichment.bh(enrichment.chi2_omnibus(_eligible(q), "symbol", monte_carlo=False), "p", ())


_OMNIBUS_BH = f"tp AS (SELECT symbol, {_CHI_TAIL} AS p FROM ch), " + _bh_sql("1").replace("PARTITION BY 1, p", "PARTITION BY p").replace("PARTITION BY 1 ", "").replace("PARTITION BY 1", "")


@query("bh", "T9", f"""
WITH {_EL_GRID}, {_OMNIBUS_BH} SELECT symbol, CASE WHEN fdr IS NOT NULL THEN round(greatest(fdr, 0), 6) END AS fdr FROM rs LEFT JOIN bh USING (symbol)""")
def _(q):
    return rounded(_omnibus(q).select("symbol", "fdr"), "fdr")


_EL_PAIRS = _OMNIBUS_BH + """, sg AS (SELECT symbol FROM bh WHERE fdr <= 0.05), tables AS (SELECT x.symbol, x.lineage AS group1, y.lineage AS group2, x.k AS a, x.n - x.k AS b, y.k AS c, y.n - y.k AS d FROM ok x JOIN ok y ON x.symbol = y.symbol AND x.lineage < y.lineage WHERE x.symbol IN (FROM sg))"""
_HOLM = """ho AS (SELECT *, least(0, max(log_p + ln(m - r + 1)) OVER (PARTITION BY symbol ORDER BY r)) AS log_p_holm, exp(log_p_holm) AS p_holm FROM (SELECT tables.*, log_p, row_number() OVER (PARTITION BY symbol ORDER BY log_p, group1, group2) AS r, count(*) OVER (PARTITION BY symbol) AS m FROM tables JOIN fs USING (a, b, c, d)))"""


def _posthoc(q):
    return enrichment.pairwise_posthoc(_omnibus(q), "symbol")


@query("holm", "T10", f"WITH {_EL_GRID}, {_EL_PAIRS}, {_FISHER}, {_HOLM} SELECT symbol, group1, group2, {NL.format('p')} AS p, {NL.format('p_holm')} AS p_holm, {_OR} AS odds_ratio FROM ho")
def _(q):
    return rounded(_posthoc(q).select("symbol", "group1", "group2", neglog("p"), neglog("p_holm"), "odds_ratio"), "odds_ratio")


@query("adjust_p", "W4", """
WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice / 500000 AS p FROM {orders}), r AS (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY p) AS rk, count(*) OVER (PARTITION BY o_custkey) AS m FROM t)
SELECT o_orderkey, round(least(1, min(p * m / rk) OVER (PARTITION BY o_custkey ORDER BY p DESC)), 12) AS p_bh, round(least(1, max(p * (m - rk + 1)) OVER (PARTITION BY o_custkey ORDER BY p)), 12) AS p_holm FROM r""")
def _(q):
    t = q("orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 500000).alias("p"))
    t = enrichment.adjust_p(enrichment.adjust_p(t, "bh", "p", "o_custkey", "p_bh"), "holm", "p", "o_custkey", "p_holm")
    return rounded(t.select("o_orderkey", "p_bh", "p_holm"), "p_bh", "p_holm", digits=12)


_LETTERS = f"""{_EL_GRID}, {_EL_PAIRS}, {_FISHER}, {_HOLM}, nd AS (SELECT DISTINCT symbol, lineage, CAST(list_position(['Clade 1A','Clade 1B','Clade 2','Clade 3','Unassigned'], lineage) AS INT) AS o FROM ok WHERE symbol IN (FROM sg)),
df AS (SELECT symbol, group1 AS x, group2 AS y FROM ho WHERE p_holm <= 0.05 UNION ALL SELECT symbol, group2, group1 FROM ho WHERE p_holm <= 0.05),
st AS (SELECT symbol, 1 AS step, CAST([] AS STRUCT(g VARCHAR, l INT)[]) AS given FROM sg UNION ALL SELECT s.symbol, step + 1, CASE WHEN NOT free THEN given ELSE list_append(given, struct_pack(g := lineage, l := lvl)) END FROM (
 SELECT s.*, ((step - 1) // 5) + 1 AS lvl, nd.lineage, nd.lineage IS NOT NULL AND len(list_filter(given, lambda e: e.g = nd.lineage)) = 0 AND len(list_filter(given, lambda e: e.l = ((step - 1) // 5) + 1 AND list_contains(coalesce(dd.ys, []), e.g))) = 0 AS free
 FROM st s LEFT JOIN nd ON nd.symbol = s.symbol AND nd.o = ((step - 1) % 5) + 1 LEFT JOIN (SELECT symbol, x, list(y) AS ys FROM df GROUP BY ALL) dd ON dd.symbol = s.symbol AND dd.x = nd.lineage WHERE step <= 25) s),
le AS (SELECT symbol, e.g AS lineage, chr(96 + e.l) AS letters FROM (SELECT symbol, unnest(given) AS e FROM st WHERE step = 26))"""


@query("cld", "T11", f"WITH RECURSIVE CTES {_LETTERS} SELECT symbol, lineage AS \"group\", letters FROM le")
def _(q):
    return enrichment.cld(_posthoc(q), "symbol", LINEAGES)


_FMT = "CASE WHEN k = 0 THEN '0 (0%)' ELSE CAST(k AS VARCHAR) || ' (' || CASE WHEN CAST(100 AS DOUBLE) * k / n < 0.1 THEN '<0.1%' WHEN CAST(100 AS DOUBLE) * k / n = round(CAST(100 AS DOUBLE) * k / n) THEN CAST(CAST(round(CAST(100 AS DOUBLE) * k / n) AS INT) AS VARCHAR) || '%' ELSE printf('%.1f%%', CAST(100 AS DOUBLE) * k / n) END || ')' END"


@query("element_summary", "G27", f"""
WITH {_EL_GRID}, c AS (SELECT symbol, lineage, {_FMT} AS cell FROM grid), m AS (SELECT symbol, type, name FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, type, name) AS r FROM (SELECT symbol, type, name, count(*) AS n FROM {{hits}} WHERE coverage >= 80 AND identity >= 90 GROUP BY ALL)) WHERE r = 1)
SELECT symbol, type, name, k_all AS total, max(CASE lineage WHEN 'Clade 1A' THEN cell END) AS "Clade 1A", max(CASE lineage WHEN 'Clade 1B' THEN cell END) AS "Clade 1B", max(CASE lineage WHEN 'Clade 2' THEN cell END) AS "Clade 2", max(CASE lineage WHEN 'Clade 3' THEN cell END) AS "Clade 3", max(CASE lineage WHEN 'Unassigned' THEN cell END) AS "Unassigned"
FROM c JOIN m USING (symbol) JOIN ft USING (symbol) GROUP BY ALL""")
def _(q):
    grid, om = _el_grid(q), _omnibus(q)
    catalog = enrichment.modal_catalog(enrichment.presence_filter(q("hits"), "coverage", "identity"), "symbol", ["type", "name"])
    none = grid.where("k < 0").select("symbol", F.col("lineage").alias("group"), F.lit("").alias("letters"))
    return enrichment.element_summary(grid, om, none, catalog, "symbol", "lineage", LINEAGES).drop("p", "fdr")


_WITH_LETTERS = ", ".join(f"max(CASE lineage WHEN '{x}' THEN cell END) AS \"{x}\"" for x in LINEAGES)


@query("element_summary_with_letters", "G27", f"""
WITH RECURSIVE CTES {_LETTERS}, ce AS (SELECT symbol, lineage, {_FMT} || translate(coalesce(letters, ''), 'abcde', 'ᵃᵇᶜᵈᵉ') AS cell FROM grid LEFT JOIN le USING (symbol, lineage)),
m AS (SELECT symbol, type, name FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, type, name) AS r FROM (SELECT symbol, type, name, count(*) AS n FROM {{hits}} WHERE coverage >= 80 AND identity >= 90 GROUP BY ALL)) WHERE r = 1),
w AS (SELECT symbol, {_WITH_LETTERS} FROM ce GROUP BY 1)
SELECT symbol, type, name, k_all AS total, w.* EXCLUDE (symbol), CASE WHEN p IS NOT NULL THEN round(greatest(p, 0), 6) END AS p, CASE WHEN fdr IS NOT NULL THEN round(greatest(fdr, 0), 6) END AS fdr FROM w JOIN m USING (symbol) JOIN ft USING (symbol) LEFT JOIN bh USING (symbol)""")
def _(q):
    grid, om = _el_grid(q), _omnibus(q)
    catalog = enrichment.modal_catalog(enrichment.presence_filter(q("hits"), "coverage", "identity"), "symbol", ["type", "name"])
    letters = enrichment.cld(enrichment.pairwise_posthoc(om, "symbol"), "symbol", LINEAGES)
    return rounded(enrichment.sort_summary(enrichment.element_summary(grid, om, letters, catalog, "symbol", "lineage", LINEAGES)), "p", "fdr")


@query("sort_summary", "O3", f"""
WITH {_EL_GRID}, m AS (SELECT symbol, min(type) AS type FROM {{hits}} WHERE coverage >= 80 AND identity >= 90 GROUP BY 1), t AS (SELECT symbol, type, rs.k_all AS total, {_CHI_P} AS p FROM rs JOIN m USING (symbol) LEFT JOIN ch USING (symbol))
SELECT *, row_number() OVER (ORDER BY p IS NULL, total DESC, type, symbol) - 1 AS position FROM t""")
def _(q):
    """Elements with the p-value of their omnibus test, in the order of the report; position is the row's place in it."""
    types = enrichment.presence_filter(q("hits"), "coverage", "identity").groupBy("symbol").agg(F.min("type").alias("type"))
    d = enrichment.chi2_omnibus(_eligible(q), "symbol", monte_carlo=False).select("symbol", F.col("k_all").alias("total"), "p")
    ordered = enrichment.sort_summary(rounded(d.join(types, "symbol"), "p")).coalesce(1)  # one row per element
    return ordered.withColumn("position", F.monotonically_increasing_id()).select("symbol", "type", "total", "p", "position")


# --- attributes ------------------------------------------------------------------------------

_ATT = """ct AS (SELECT source, count(*) AS n_total FROM {groups} GROUP BY 1), c AS (SELECT l.lineage, ct.source, count(g.sample) AS n, n_total FROM (SELECT DISTINCT lineage FROM {groups}) l CROSS JOIN ct LEFT JOIN {groups} g ON g.lineage = l.lineage AND g.source = ct.source GROUP BY ALL)"""


_ATT_PAIRS = f"""{_ATT}, pc AS (SELECT *, sum(n) OVER (PARTITION BY lineage) AS n_in, 100.0 * n / sum(n) OVER (PARTITION BY lineage) AS within_pct, 100.0 * n / n_total AS share_pct, n > 0 AND n < n_total AS usable FROM c),
tables AS (SELECT x.lineage AS symbol, x.source AS group1, y.source AS group2, x.n AS a, x.n_total - x.n AS b, y.n AS c, y.n_total - y.n AS d, x.n_in FROM pc x JOIN pc y ON x.lineage = y.lineage AND x.source < y.source WHERE x.usable AND y.usable), {_FISHER}, {_HOLM}"""


@query("attribute_enrichment_table", "T12", f"""
WITH RECURSIVE CTES {_ATT_PAIRS}, nd AS (SELECT lineage AS symbol, source AS cat, row_number() OVER (PARTITION BY lineage ORDER BY source) AS o, count(*) OVER (PARTITION BY lineage) AS m FROM pc WHERE usable),
df AS (SELECT symbol, x, list(y) AS ys FROM (SELECT symbol, group1 AS x, group2 AS y FROM ho WHERE p_holm <= 0.05 UNION ALL SELECT symbol, group2, group1 FROM ho WHERE p_holm <= 0.05) GROUP BY ALL),
st AS (SELECT DISTINCT symbol, 0 AS step, m, CAST([] AS STRUCT(g VARCHAR, l INT)[]) AS given FROM nd UNION ALL
 SELECT s.symbol, step + 1, s.m, CASE WHEN len(list_filter(given, lambda e: e.g = nd.cat)) = 0 AND len(list_filter(given, lambda e: e.l = step // s.m + 1 AND list_contains(coalesce(df.ys, []), e.g))) = 0
  THEN list_append(given, struct_pack(g := nd.cat, l := CAST(step // s.m + 1 AS INT))) ELSE given END
 FROM st s JOIN nd ON nd.symbol = s.symbol AND nd.o = step % s.m + 1 LEFT JOIN df ON df.symbol = s.symbol AND df.x = nd.cat WHERE step < s.m * s.m),
le AS (SELECT symbol AS lineage, e.g AS source, chr(96 + e.l) AS letters FROM (SELECT symbol, unnest(given) AS e FROM st WHERE step = m * m AND m >= 2))
SELECT lineage, source, n, n_total, round(within_pct, 6) AS within_pct, round(share_pct, 6) AS share_pct, coalesce(letters, '') AS letters, CASE WHEN usable THEN 'YES' ELSE '' END AS tested FROM pc LEFT JOIN le USING (lineage, source)""")
def _(q):
    return rounded(enrichment.attribute_enrichment(q("groups"), "lineage", "source", LINEAGES)["table"], "within_pct", "share_pct")


@query("attribute_enrichment_pairs", "T12", f"""
WITH {_ATT_PAIRS}, s AS (SELECT *, 100.0 * a / (a + b) AS s1, 100.0 * c / (c + d) AS s2, 100.0 * a / n_in AS w1, 100.0 * c / n_in AS w2 FROM ho)
SELECT symbol AS lineage, group1, group2, a, b, c, d, {NL.format('p')} AS p, {NL.format('p_holm')} AS p_holm, {_OR} AS odds_ratio, CASE WHEN {_OR} > 1 THEN 'Cat1>Cat2' WHEN {_OR} < 1 THEN 'Cat2>Cat1' ELSE 'Equal' END AS direction,
 round(s1, 6) AS share1_pct, round(s2, 6) AS share2_pct, round(s1 - s2, 6) AS diff_share_pp, round(w1, 6) AS within1_pct, round(w2, 6) AS within2_pct, round(w1 - w2, 6) AS diff_within_pp FROM s""")
def _(q):
    d = enrichment.attribute_enrichment(q("groups"), "lineage", "source", LINEAGES)["pairs"]
    more = ["share1_pct", "share2_pct", "diff_share_pp", "within1_pct", "within2_pct", "diff_within_pp"]
    return rounded(d.select("lineage", "group1", "group2", "a", "b", "c", "d", neglog("p"), neglog("p_holm"), "odds_ratio", "direction", *more), "odds_ratio", *more)


_CHI_P_401 = "round(1 - (SELECT sum(exp((dof / 2 + i) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2 + i + 1))) FROM (SELECT unnest(generate_series(0, 400)) AS i)), 6)"


@query("attribute_enrichment_omnibus", "T12", f"""
WITH {_ATT_PAIRS}, u AS (SELECT *, sum(n) OVER w / sum(n_total) OVER w AS sh FROM c WHERE n > 0 AND n < n_total WINDOW w AS (PARTITION BY lineage)), ch AS (SELECT lineage, sum((n - n_total * sh) * (n - n_total * sh) / (n_total * sh * (1 - sh))) AS chi2, count(*) - 1 AS dof FROM u GROUP BY 1),
r AS (SELECT lineage, count(*) AS n_categories, count(*) FILTER (usable) AS n_tested, CAST(sum(n) AS BIGINT) AS n_in_group, CAST(sum(n_total) AS BIGINT) AS n_all, round(min(within_pct) FILTER (usable), 6) AS within_pct_min, round(max(within_pct) FILTER (usable), 6) AS within_pct_max,
 round(min(share_pct) FILTER (usable), 6) AS share_pct_min, round(max(share_pct) FILTER (usable), 6) AS share_pct_max FROM pc GROUP BY 1)
SELECT r.*, round(chi2, 6) AS chi2, CAST(dof AS INT) AS dof, {_CHI_P_401} AS p FROM ch JOIN r USING (lineage)""")
def _(q):
    d = enrichment.attribute_enrichment(q("groups"), "lineage", "source", LINEAGES, monte_carlo=False)["omnibus"]
    ranges = ["within_pct_min", "within_pct_max", "share_pct_min", "share_pct_max"]
    return rounded(d.select("lineage", "n_categories", "n_tested", "n_in_group", "n_all", *ranges, "chi2", "dof", "p"), *ranges, "chi2", "p")


# --- resampling ------------------------------------------------------------------------------


@query("bootstrap_hill", "T13")
def _(q):
    return resampling.bootstrap_hill(resampling.pattern_counts(marker_indicators(q), "segment", CATS), "segment", b=1000)


@query("permutation_hill", "T14")
def _(q):
    return resampling.permutation_hill(resampling.pattern_counts(marker_indicators(q), "segment", CATS), "segment", q=1, n_perm=2000)


@query("permutation_hill_pairs", "T14")
def _(q):
    return resampling.permutation_hill_pairs(resampling.pattern_counts(marker_indicators(q), "segment", CATS), "segment", q=2, n_perm=2000)


_HILL = f"hi AS (SELECT segment, count(*) AS q0, exp(-sum(p * ln(p))) AS q1, 1 / sum(p * p) AS q2 FROM comp GROUP BY 1)"


@query("permutation_observed", "T14", f"WITH {COMP_SQL}, {_HILL} SELECT 'q1' AS metric, round(max(q1) - min(q1), 6) AS obs_stat FROM hi")
def _(q):
    """The observed range that the global permutation test compares with."""
    patterns = resampling.pattern_counts(marker_indicators(q), "segment", CATS)
    return rounded(resampling.permutation_hill(patterns, "segment", q=1, n_perm=50).select("metric", "obs_stat"), "obs_stat")


@query("permutation_observed_pairs", "T14", f"WITH {COMP_SQL}, {_HILL} SELECT x.segment AS group1, y.segment AS group2, round(abs(x.q2 - y.q2), 6) AS obs_diff FROM hi x JOIN hi y ON x.segment < y.segment")
def _(q):
    """The observed differences that the pairwise permutation tests compare with."""
    patterns = resampling.pattern_counts(marker_indicators(q), "segment", CATS)
    return rounded(resampling.permutation_hill_pairs(patterns, "segment", q=2, n_perm=50).select("group1", "group2", "obs_diff"), "obs_diff")


@query("levels_of_groups", "O1", "SELECT lineage, CAST(list_position(['Unassigned','Clade 3','Clade 2','Clade 1B','Clade 1A'], lineage) AS INT) AS position, count(*) AS n FROM {groups} GROUP BY ALL")
def _(q):
    order = list(reversed(LINEAGES))
    c = reports.counts(q("groups"), "lineage").withColumn("position", ranking.level_index("lineage", order))
    return ranking.order_by_levels(c, "lineage", order)
