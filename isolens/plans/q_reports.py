"""Queries over count, prevalence, weight, diversity, quality and functional reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, dates, markers
from ..operators import enrichment, functional, pangenome, quality, relations, reports, reshape
from .q_clean import ANIMAL_SQL, BUCKET_SQL, GROUP_SQL, MAJOR_SQL, PERIOD_SQL, PERIODS, QC_SQL, SOURCE_SQL, _gene_rows, _source, qc_table
from .registry import query, rounded



def sel():
    return F.col("selected")


def ana():
    return F.col("analyzed")


def status():
    return F.when(F.size("markers") > 0, F.lit("positive")).otherwise(F.lit("negative"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATUS_SQL = "CASE WHEN n_markers > 0 THEN 'positive' ELSE 'negative' END"
CI = "round(100.0 * x / n_total, 6) AS pct, round(greatest(0, 100 * (x / n_total - 1.96 * sqrt(x / n_total * (1 - x / n_total) / n_total))), 6) AS lo, round(least(100, 100 * (x / n_total + 1.96 * sqrt(x / n_total * (1 - x / n_total) / n_total))), 6) AS hi"


@query("counts", "G1", "SELECT segment, year, count(*) AS n FROM {isolates} GROUP BY ALL")
def _(q):
    return reports.counts(q("isolates"), ["segment", "year"])


@query("rate_ci", "G2", f"""
SELECT segment, x_n AS n, n_total, {CI} FROM (SELECT segment, count(*) FILTER (n_markers > 0) AS x_n, CAST(count(*) FILTER (n_markers > 0) AS DOUBLE) AS x, count(*) AS n_total FROM {{o_packed}} GROUP BY 1)""")
def _(q):
    from ..functions.stats import rate_ci

    g = q.cohort.groupBy("segment").agg(F.count_if(F.size("markers") > 0).alias("n"), F.count(F.lit(1)).alias("n_total"))
    return rounded(g.select("*", *[v.alias(k) for k, v in rate_ci("n", "n_total").items()]), "pct", "lo", "hi")


@query("marker_prevalence_by_source_year", "G2", f"""
SELECT segment, year, marker, x_n AS n, n_total, {CI} FROM (
 SELECT m.segment, m.year, m.marker, m.n AS x_n, CAST(m.n AS DOUBLE) AS x, d.n_total FROM (SELECT segment, year, marker, count(*) AS n FROM {{o_markers}} WHERE year IS NOT NULL GROUP BY ALL) m
 JOIN (SELECT segment, year, count(*) AS n_total FROM {{isolates}} GROUP BY ALL) d ON m.segment = d.segment AND m.year = d.year)""")
def _(q):
    from ..functions.stats import rate_ci

    d = reports.marker_counts(q.cohort.where("year IS NOT NULL"), ["segment", "year"], "markers")
    return rounded(d.select("*", *[v.alias(k) for k, v in rate_ci("n", "n_total").items()]), "pct", "lo", "hi")


@query("pct_within", "G3", f"""
SELECT segment, year, qr_status, n, CAST(sum(n) OVER (PARTITION BY segment, year) AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (PARTITION BY segment, year), 6) AS pct
FROM (SELECT segment, year, {STATUS_SQL} AS qr_status, count(*) AS n FROM {{o_packed}} GROUP BY ALL)""")
def _(q):
    d = q.cohort.withColumn("qr_status", status())
    return rounded(reports.pct_within(d, ["segment", "year", "qr_status"], ["segment", "year"]), "pct")


@query("marker_frequency", "G4", f"""
SELECT marker, type, n_isolates, n_total, {CI} FROM (SELECT *, CAST(n_isolates AS DOUBLE) AS x, (SELECT count(*) FROM {{isolates}}) AS n_total FROM (
 SELECT marker, 'QR/FQR marker' AS type, count(*) AS n_isolates FROM {{o_markers}} GROUP BY 1 UNION ALL SELECT 'Q/FQ-susceptible', 'Q/FQ-susceptible', count(*) FROM {{o_packed}} WHERE n_markers = 0))""")
def _(q):
    return rounded(reports.marker_frequency(q.cohort, "run", "markers"), "pct", "lo", "hi")


@query("marker_burden", "G5", "SELECT run, CAST(n_markers AS INT) AS n_markers, packed AS markers FROM {o_packed} WHERE n_markers > 0")
def _(q):
    return reports.marker_burden(q.cohort, "run", "markers")


@query("burden_bins", "G6", """
SELECT bin, n_isolates, round(100.0 * n_isolates / sum(n_isolates) OVER (), 6) AS pct_isolates FROM (
 SELECT CASE n_markers WHEN 1 THEN '1 marker' WHEN 2 THEN '2 markers' ELSE '>2 markers' END AS bin, count(*) AS n_isolates FROM {o_packed} WHERE n_markers > 0 GROUP BY 1)""")
def _(q):
    return rounded(reports.burden_bins(reports.marker_burden(q.cohort, "run", "markers")), "pct_isolates")


def _combo_sql(cond):
    return f"SELECT CAST(n_markers AS INT) AS n_markers, markers, n_isolates, round(100.0 * n_isolates / sum(n_isolates) OVER (), 6) AS pct FROM (SELECT n_markers, packed AS markers, count(*) AS n_isolates FROM {{o_packed}} WHERE {cond} GROUP BY ALL)"


@query("marker_combinations", "G7", _combo_sql("n_markers = 2"))
def _(q):
    return rounded(reports.marker_combinations(reports.marker_burden(q.cohort, "run", "markers"), 2, 2), "pct")


@query("marker_combinations_above_two", "G7", _combo_sql("n_markers > 2"))
def _(q):
    return rounded(reports.marker_combinations(reports.marker_burden(q.cohort, "run", "markers"), 3), "pct")


@query("genotype_signatures", "G8", """
SELECT year, CASE WHEN n_markers = 0 THEN 'QS/FQS (no marker)' ELSE replace(packed, ';', ' + ') END AS signature, count(*) AS n_available, count(*) FILTER (selected) AS n_selected, count(*) FILTER (analyzed) AS n_analyzed
FROM {o_packed} GROUP BY ALL""")
def _(q):
    return reports.genotype_signatures(q.cohort, "year", "markers", {"n_selected": sel(), "n_analyzed": ana()})


@query("source_audit", "G9", """
SELECT segment, count(*) AS n_available, count(*) FILTER (year IS NULL) AS n_missing_year, count(*) FILTER (year NOT BETWEEN 1996 AND 2000) AS n_outside, count(*) FILTER (year BETWEEN 1996 AND 2000) AS n_temporal,
 count(*) FILTER (selected) AS n_selected, count(*) FILTER (analyzed) AS n_analyzed FROM {o_flags} GROUP BY 1""")
def _(q):
    return reports.source_audit(q.flagged, "segment", "year", 1996, 2000, sel(), ana())


_W = """count(*) AS n_available, count(*) FILTER (selected) AS n_selected, count(*) FILTER (analyzed) AS n_analyzed"""
_WP = """n_available, n_selected, n_analyzed, round(100.0 * n_selected / nullif(n_available, 0), 6) AS pct_selected, round(100.0 * n_analyzed / nullif(n_available, 0), 6) AS pct_analyzed, round(n_available / nullif(n_analyzed, 0), 6) AS weight"""


@query("sampling_weights", "G10", f"SELECT segment, year, qr_status, {_WP} FROM (SELECT segment, year, {STATUS_SQL} AS qr_status, {_W} FROM {{o_packed}} GROUP BY ALL)")
def _(q):
    d = reports.sampling_weights(q.cohort.withColumn("qr_status", status()), ["segment", "year", "qr_status"], sel(), ana())
    return rounded(d, "pct_selected", "pct_analyzed", "weight")


@query("complete", "G11", """
WITH c AS (SELECT isolation_source, year, count(*) AS n FROM {isolates} GROUP BY ALL)
SELECT i.s AS isolation_source, y.year, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT isolation_source AS s FROM c) i, (SELECT CAST(unnest(generate_series(1994, 2002)) AS INT) AS year UNION ALL SELECT NULL) y
LEFT JOIN c ON c.isolation_source = i.s AND c.year IS NOT DISTINCT FROM y.year""")
def _(q):
    c = reports.counts(q("isolates"), ["isolation_source", "year"])
    return reports.complete(c, {"isolation_source": None, "year": [*range(1994, 2003), None]}, {"n": 0})


@query("complete_seen", "G11", """
WITH c AS (SELECT segment, host, year, count(*) AS n FROM {isolates} GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT segment FROM c) a, (SELECT DISTINCT host FROM c) b, (SELECT DISTINCT year FROM c) d)
SELECT g.segment, g.host, g.year, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON c.segment IS NOT DISTINCT FROM g.segment AND c.host IS NOT DISTINCT FROM g.host AND c.year IS NOT DISTINCT FROM g.year""")
def _(q):
    """Three dimensions with the values that occur, null among them."""
    return reports.complete(reports.counts(q("isolates"), ["segment", "host", "year"]), {"segment": None, "host": None, "year": None}, {"n": 0})


@query("sampling_weights_by_period", "G12", f"""
WITH w AS (SELECT period, segment, qr_status, {_W} FROM (SELECT *, {PERIOD_SQL} AS period, {STATUS_SQL} AS qr_status FROM {{o_packed}}) GROUP BY ALL),
g AS (SELECT * FROM (VALUES ('Early'), ('1997-1999'), ('Late'), ('Missing year')) p(period), (SELECT DISTINCT segment FROM {{isolates}}) s, (VALUES ('positive'), ('negative')) t(qr_status))
SELECT period, segment, qr_status, {_WP} FROM (SELECT g.*, coalesce(n_available, 0) AS n_available, coalesce(n_selected, 0) AS n_selected, coalesce(n_analyzed, 0) AS n_analyzed FROM g LEFT JOIN w USING (period, segment, qr_status))""")
def _(q):
    d = q.cohort.withColumn("qr_status", status()).withColumn("period", dates.period("year", PERIODS, "Missing year"))
    w = reports.sampling_weights(d, ["period", "segment", "qr_status"], sel(), ana(),
                                 {"period": ["Early", "1997-1999", "Late", "Missing year"], "segment": SEGMENTS, "qr_status": ["positive", "negative"]})
    return rounded(w, "pct_selected", "pct_analyzed", "weight")


@query("genotype_year_table", "G13", f"""
WITH m AS ({MAJOR_SQL}), w AS (SELECT year, {GROUP_SQL} AS grp, {_W} FROM m WHERE year BETWEEN 1997 AND 2000 GROUP BY ALL)
SELECT y.year, l.grp, coalesce(n_available, 0) AS n_available, coalesce(n_selected, 0) AS n_selected, coalesce(n_analyzed, 0) AS n_analyzed
FROM (SELECT CAST(unnest(generate_series(1997, 2000)) AS INT) AS year) y, (VALUES ('gyrA_D87Y'), ('gyrA_D87N'), ('gyrA_S83Y'), ('gyrA_D87G'), ('qnrB19'), ('Multiple major QR/FQR markers'), ('Other QR/FQR marker(s)'), ('QS/FQS (no marker)')) l(grp)
LEFT JOIN w ON w.year = y.year AND w.grp = l.grp""")
def _(q):
    d = q.cohort.where("year BETWEEN 1997 AND 2000").withColumn("grp", markers.exclusive_group("raw_markers"))
    levels = [*markers.MAJOR_MARKERS, "Multiple major QR/FQR markers", "Other QR/FQR marker(s)", "QS/FQS (no marker)"]
    w = reports.sampling_weights(d, ["year", "grp"], sel(), ana(), {"year": list(range(1997, 2001)), "grp": levels})
    return w.drop("pct_selected", "pct_analyzed", "weight")


@query("topk_prevalence", "G14", """
WITH top AS (SELECT marker, count(*) AS n FROM {o_markers} GROUP BY 1 ORDER BY n DESC, marker LIMIT 5), g AS (SELECT DISTINCT run, segment, year, CASE WHEN marker IN (SELECT marker FROM top) THEN marker ELSE 'others' END AS marker_group FROM {o_markers}),
d AS (SELECT segment, year, count(*) AS n_total FROM {isolates} GROUP BY ALL)
SELECT g.segment, g.year, marker_group, count(*) AS n, min(n_total) AS n_total, round(100.0 * count(*) / min(n_total), 6) AS pct FROM g JOIN d ON g.segment = d.segment AND g.year IS NOT DISTINCT FROM d.year GROUP BY ALL""")
def _(q):
    return rounded(reports.topk_prevalence(q.cohort, "run", "markers", ["segment", "year"], 5), "pct")


@query("family_counts", "G15", """
SELECT family, count(*) AS n FROM (SELECT CASE WHEN t LIKE 'gyra%' THEN 'gyra_others' WHEN t LIKE 'parc%' THEN 'parc_all' WHEN t LIKE 'qnr%' THEN 'qnr_all' WHEN t LIKE 'aac%' THEN t WHEN t = 'oqxa' THEN t
 WHEN t LIKE 'acrb%' THEN 'acrb_all' ELSE 'soxs_all' END AS family FROM (SELECT replace(lower(marker), '_ib', '-ib') AS t FROM {o_markers})) GROUP BY 1""")
def _(q):
    t = q.cohort.select(F.explode(F.array_distinct(F.transform("raw_markers", lambda x: F.lower(x)))).alias("t"))
    return reports.counts(t.select(markers.marker_family("t").alias("family")), "family")


BUCKETS = ["QS/FQS", *markers.MAJOR_MARKERS, "Others"]


def _stack(q, sel: bool):
    d = q.cohort.withColumn("period", dates.period("year", PERIODS)).withColumn("bucket", markers.priority_bucket("raw_markers"))
    d = d.where("selected") if sel else d
    return reports.bucket_stack(d, "Selected" if sel else "Total", "period", "bucket", ["Early", "1997-1999", "Late"], BUCKETS)


_STACK_SQL = f"""b AS (SELECT *, CASE WHEN year <= 1996 THEN 'Early' WHEN year <= 1999 THEN '1997-1999' ELSE 'Late' END AS period, {BUCKET_SQL} AS bucket FROM ({MAJOR_SQL}) WHERE year IS NOT NULL),
c AS (SELECT 'Total' AS cohort, period, bucket, count(*) AS count FROM b GROUP BY ALL UNION ALL SELECT 'Selected', period, bucket, count(*) FROM b WHERE selected GROUP BY ALL)"""


@query("bucket_stack", "G16", f"""
WITH {_STACK_SQL}, g AS (SELECT * FROM (VALUES ('Total'), ('Selected')) x(cohort), (VALUES ('Early'), ('1997-1999'), ('Late')) p(period), (VALUES ('QS/FQS'), ('gyrA_D87Y'), ('gyrA_D87N'), ('gyrA_S83Y'), ('gyrA_D87G'), ('qnrB19'), ('Others')) l(bucket))
SELECT cohort, period, bucket, coalesce(count, 0) AS count, CAST(sum(coalesce(count, 0)) OVER w AS BIGINT) AS total_n, round(100.0 * coalesce(count, 0) / sum(coalesce(count, 0)) OVER w, 6) AS percent FROM g LEFT JOIN c USING (cohort, period, bucket) WINDOW w AS (PARTITION BY cohort, period)""")
def _(q):
    return rounded(relations.union_all(_stack(q, False), _stack(q, True)), "percent")


@query("stack_check", "G17", "SELECT CASE WHEN year <= 1996 THEN 'Early' WHEN year <= 1999 THEN '1997-1999' ELSE 'Late' END AS period, count(*) AS plotted_count, count(*) AS total_n, CAST(0 AS BIGINT) AS difference FROM {isolates} WHERE year IS NOT NULL GROUP BY 1")
def _(q):
    den = reports.counts(q("isolates").where("year IS NOT NULL").select(dates.period("year", PERIODS).alias("period")), "period", "total_n")
    return reports.stack_check(_stack(q, False).drop("total_n"), den, "period")


@query("sampling_summary", "G18", f"""
SELECT dataset, period, qr_status, n, CAST(sum(n) OVER (PARTITION BY dataset, period) AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (PARTITION BY dataset, period), 6) AS pct FROM (
 SELECT 'Total' AS dataset, {PERIOD_SQL} AS period, {STATUS_SQL} AS qr_status, count(*) AS n FROM {{o_packed}} GROUP BY ALL UNION ALL SELECT 'Selected', {PERIOD_SQL}, {STATUS_SQL}, count(*) FROM {{o_packed}} WHERE selected GROUP BY ALL)""")
def _(q):
    d = q.cohort.withColumn("period", dates.period("year", PERIODS, "Missing year")).withColumn("qr_status", status())
    return rounded(reports.sampling_summary(d, d.where("selected"), ["period", "qr_status"], "period"), "pct")


_LAB = "lab AS (SELECT CASE WHEN event_type <> 'view' THEN event_type || '-' || CAST(user_id AS VARCHAR) END AS label, CAST(month(ts) AS INT) AS year, event_type AS source, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS status FROM {events})"


def _labelled(q):
    return q("events").select(F.when(F.col("event_type") != "view", F.concat_ws("-", "event_type", "user_id")).alias("label"), F.month("ts").alias("year"),
                              F.col("event_type").alias("source"), F.when(F.col("value") > 50, F.lit("high")).otherwise(F.lit("low")).alias("status"))


@query("label_audit", "G19", f"""
WITH {_LAB}, m AS (SELECT * FROM lab WHERE label IS NOT NULL)
SELECT 'per_year' AS view, CAST(year AS VARCHAR) AS year, NULL AS label, NULL AS source, NULL AS status, count(*) AS n FROM m GROUP BY year
UNION ALL SELECT 'per_label', NULL, label, NULL, NULL, count(*) FROM m GROUP BY label UNION ALL SELECT 'per_year_label', CAST(year AS VARCHAR), label, NULL, NULL, count(*) FROM m GROUP BY year, label
UNION ALL SELECT 'repeated_label', CAST(year AS VARCHAR), label, NULL, NULL, count(*) FROM m GROUP BY year, label HAVING count(*) > 1
UNION ALL SELECT 'per_year_source', CAST(year AS VARCHAR), NULL, source, NULL, count(*) FROM m GROUP BY year, source UNION ALL SELECT 'per_year_status', CAST(year AS VARCHAR), NULL, NULL, status, count(*) FROM m GROUP BY year, status
UNION ALL SELECT 'labelled', NULL, NULL, NULL, NULL, count(*) FROM m UNION ALL SELECT 'total', NULL, NULL, NULL, NULL, count(*) FROM lab""")
def _(q):
    return reports.label_audit(_labelled(q), "label", "year", "source", "status")


@query("one_per_year_test", "G19", f"WITH {_LAB} SELECT max(n) AS max_per_year, CASE WHEN max(n) <= 1 THEN 'PASS' ELSE 'FAIL' END AS result FROM (SELECT count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY year)")
def _(q):
    return reports.one_per_year_test(_labelled(q), "label", "year")


CATS = [*markers.MAJOR_MARKERS, "others"]


def marker_indicators(q):
    """Marker-positive isolates with one 0/1 column per category."""
    c = q.cohort.where(F.size("markers") > 0)
    majors = F.array(*[F.lit(m) for m in markers.MAJOR_MARKERS])
    return c.select("run", "segment", *[F.array_contains("markers", m).cast("int").alias(m) for m in markers.MAJOR_MARKERS],
                    (F.size(F.array_except("markers", majors)) > 0).cast("int").alias("others"))


_COMP_SQL = """m AS (SELECT DISTINCT run, segment, CASE WHEN marker IN ('gyrA_D87Y','gyrA_D87N','gyrA_S83Y','gyrA_D87G','qnrB19') THEN marker ELSE 'others' END AS category FROM {o_markers}),
d AS (SELECT segment, count(DISTINCT run) AS nr FROM m GROUP BY 1), p AS (SELECT segment, category, count(*) / min(nr) AS prevalence FROM m JOIN d USING (segment) GROUP BY ALL), comp AS (SELECT *, prevalence / sum(prevalence) OVER (PARTITION BY segment) AS p FROM p)"""


@query("composition", "G20", f"WITH {_COMP_SQL} SELECT segment, category, round(prevalence, 9) AS prevalence, round(p, 9) AS p FROM comp")
def _(q):
    return rounded(reports.composition(marker_indicators(q), "segment", CATS), "prevalence", "p", digits=9)


@query("hill_numbers", "G21", f"WITH {_COMP_SQL} SELECT segment, count(*) AS q0, round(exp(-sum(p * ln(p))), 6) AS q1, round(1 / sum(p * p), 6) AS q2 FROM comp GROUP BY 1")
def _(q):
    return rounded(reports.hill_numbers(reports.composition(marker_indicators(q), "segment", CATS), "segment"), "q1", "q2")


LINEAGES = ["Clade 1A", "Clade 1B", "Clade 2", "Clade 3", "Unassigned"]


@query("composition_table", "G22", """
WITH g AS (SELECT * FROM (SELECT DISTINCT lineage FROM {groups}), (SELECT DISTINCT source FROM {groups})), c AS (SELECT lineage, source, count(*) AS n FROM {groups} GROUP BY ALL), f AS (SELECT lineage, source, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (lineage, source))
SELECT lineage, source, n, CAST(sum(n) OVER l AS BIGINT) AS group_n, round(100.0 * n / sum(n) OVER l, 6) AS within_pct, CAST(sum(n) OVER s AS BIGINT) AS category_n, round(100.0 * n / sum(n) OVER s, 6) AS share_pct FROM f WINDOW l AS (PARTITION BY lineage), s AS (PARTITION BY source)""")
def _(q):
    return rounded(reports.composition_table(q("groups"), "lineage", "source", LINEAGES), "within_pct", "share_pct")


@query("group_sizes", "G23", """
SELECT l.lineage, coalesce(n, 0) AS n, l.position FROM (VALUES ('Clade 9', 1), ('Clade 1A', 2), ('Clade 2', 3)) l(lineage, position) LEFT JOIN (SELECT lineage, count(*) AS n FROM {groups} GROUP BY 1) USING (lineage)""")
def _(q):
    return reports.group_sizes(q("groups"), "lineage", ["Clade 9", "Clade 1A", "Clade 2"])


@query("feature_counts", "G24", """
SELECT pos, ref, alt, lineage, k, CAST(sum(k) OVER (PARTITION BY pos, ref, alt) AS BIGINT) AS k_all FROM (SELECT pos, ref, alt, lineage, count(DISTINCT sample) AS k FROM {variants} JOIN {groups} USING (sample) GROUP BY ALL)""")
def _(q):
    return enrichment.feature_counts(q("variants"), q("groups"), "sample", ["pos", "ref", "alt"], "lineage")


@query("presence_absence", "G25", """
SELECT s.sample, h.symbol FROM (SELECT DISTINCT sample FROM {groups}) s LEFT JOIN (SELECT DISTINCT sample, symbol FROM {hits} WHERE coverage >= 80 AND identity >= 90) h USING (sample)""")
def _(q):
    return enrichment.presence_absence(enrichment.presence_filter(q("hits"), "coverage", "identity"), q("groups"), "sample", "symbol")


@query("presence_matrix", "G25", """
SELECT sample, CAST(coalesce(max(CAST(symbol = 'el1F' AS INT)), 0) AS INT) AS "el1F", CAST(coalesce(max(CAST(symbol = 'blue ring' AS INT)), 0) AS INT) AS "blue ring" FROM (SELECT DISTINCT sample FROM {groups}) LEFT JOIN (SELECT * FROM {hits} WHERE coverage >= 80 AND identity >= 90) USING (sample) GROUP BY 1""")
def _(q):
    long = enrichment.presence_absence(enrichment.presence_filter(q("hits"), "coverage", "identity"), q("groups"), "sample", "symbol")
    return enrichment.presence_matrix(long, "sample", "symbol", ["el1F", "blue ring"])


@query("modal_catalog", "G26", """
SELECT symbol, type, name FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, type, name) AS r FROM (SELECT symbol, type, name, count(*) AS n FROM {hits} GROUP BY ALL)) WHERE r = 1""")
def _(q):
    return enrichment.modal_catalog(q("hits"), "symbol", ["type", "name"])


_PAN = """pc AS (SELECT lineage, gene, count(DISTINCT sample) AS k FROM {presence} JOIN {groups} USING (sample) GROUP BY ALL), gn AS (SELECT lineage, count(*) AS n FROM {groups} GROUP BY 1)"""


@query("pangenome_summary", "G28", f"""
WITH {_PAN}, j AS (SELECT lineage, gene, n, 100.0 * k / n AS pct FROM pc JOIN gn USING (lineage))
SELECT lineage, min(n) AS genomes, count(*) AS total_genes, count(*) FILTER (pct >= 95) AS core, count(*) FILTER (pct >= 15 AND pct < 95) AS shell, (SELECT count(DISTINCT gene) FROM {{presence}}) - count(*) FILTER (pct >= 15) AS cloud FROM j GROUP BY 1""")
def _(q):
    return pangenome.pangenome_summary(q("presence"), q("groups"), "sample", "gene", "lineage")


@query("accessory_genes", "G29", """
SELECT gene, n_present, round(f, 9) AS frequency FROM (SELECT gene, count(DISTINCT sample) AS n_present, count(DISTINCT sample) / (SELECT count(*) FROM {groups}) AS f FROM {presence} GROUP BY 1) WHERE f BETWEEN 0.01 AND 0.99 AND n_present >= 10""")
def _(q):
    return rounded(pangenome.accessory_genes(q("presence"), q("groups"), "sample", "gene"), "frequency", digits=9)


_ACC = f"""{_PAN}, h AS (SELECT lineage, n, k AS c, count(*) AS genes FROM pc JOIN gn USING (lineage) GROUP BY ALL), x AS (SELECT *, unnest(generate_series(1, n)) AS k FROM h),
cv AS (SELECT lineage, k, sum(genes * (1 - CASE WHEN n - c >= k THEN exp(lgamma(n - c + 1) - lgamma(n - c - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) ELSE 0 END)) AS total_genes,
 sum(genes * CASE WHEN c >= k THEN exp(lgamma(c + 1) - lgamma(c - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) ELSE 0 END) AS core_genes FROM x GROUP BY ALL)"""


@query("accumulation_curve", "G30", f"WITH {_ACC} SELECT lineage, k, round(total_genes, 4) AS total_genes, round(core_genes, 4) AS core_genes FROM cv")
def _(q):
    return rounded(pangenome.accumulation_curve(q("presence"), q("groups"), "sample", "gene", "lineage"), "total_genes", "core_genes", digits=4)


@query("accumulation_draws", "G30")
def _(q):
    return pangenome.accumulation_draws(q("presence"), q("groups"), "sample", "gene", "lineage")


@query("heaps_fit", "G31", f"WITH {_ACC} SELECT lineage, round(regr_slope(log10(total_genes), log10(k)), 6) AS alpha, round(regr_intercept(log10(total_genes), log10(k)), 6) AS intercept FROM cv WHERE k > 1 GROUP BY 1")
def _(q):
    return rounded(pangenome.heaps_fit(pangenome.accumulation_curve(q("presence"), q("groups"), "sample", "gene", "lineage"), "lineage"), "alpha", "intercept")


@query("gene_list", "G34", "SELECT DISTINCT gene FROM {variants} WHERE gene NOT IN ('intergenic', 'hypothetical protein')")
def _(q):
    return enrichment.gene_list(q("variants"))


# --- functional roll-ups ---------------------------------------------------------------------


def _variant_rows(q):
    """Line items as defining variants of the gene given by part name, with percents."""
    j = q("lineitem").join(q("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(q("part"), F.col("l_partkey") == F.col("p_partkey"))  # texts come last
    return j.select(F.col("o_orderstatus").alias("clade"), F.concat_ws("|", "p_name", "p_type").alias("gene"), F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("variant"),
                    F.when(F.col("l_returnflag") == "R", F.lit("stop_gained")).when(F.col("l_returnflag") == "A", F.lit("missense_variant")).otherwise(F.lit("")).alias("effect"),
                    enrichment.coverage_bin(F.col("l_quantity") * 2).alias("bin"), F.col("l_quantity").alias("pin"), F.col("l_discount").alias("pout"),
                    F.upper(F.regexp_replace("p_name", " ", "")).alias("cog"), (F.col("p_size") > 10).alias("has_protein"))


_VR = """vr AS (SELECT o_orderstatus AS clade, p_name || '|' || p_type AS gene, CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) AS variant,
 CASE l_returnflag WHEN 'R' THEN 'stop_gained' WHEN 'A' THEN 'missense_variant' ELSE '' END AS effect, CASE WHEN l_quantity < 20 THEN NULL WHEN l_quantity < 30 THEN '40-<60%' WHEN l_quantity < 40 THEN '60-<80%' WHEN l_quantity < 45 THEN '80-<90%' ELSE '>=90%' END AS bin,
 l_quantity AS pin, l_discount AS pout, upper(replace(p_name, ' ', '')) AS cog, p_size > 10 AS has_protein FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey)"""
_LET = "lt AS (SELECT *, unnest(list_distinct(string_split(cog, ''))) AS letter, CASE effect WHEN 'stop_gained' THEN 'High' WHEN 'missense_variant' THEN 'Moderate' ELSE 'Low' END AS impact FROM vr)"


@query("gene_rollup", "G35", f"""
WITH {_VR}, w AS (SELECT clade, gene, count(*) AS n_variants, coalesce(string_agg(DISTINCT nullif(effect, ''), ';' ORDER BY nullif(effect, '')), '') AS effects,
 coalesce(string_agg(DISTINCT bin, ';' ORDER BY bin), '') AS bins, min(pin) AS min_in, max(pin) AS max_in, min(pout) AS min_out, max(pout) AS max_out FROM vr GROUP BY ALL),
r AS (SELECT clade, gene, variant, (row_number() OVER (PARTITION BY clade, gene ORDER BY variant) - 1) // {functional.CHUNK} AS chunk FROM vr)
SELECT clade, gene, n_variants, string_agg(variant, ';' ORDER BY variant) AS variant_ids, effects, bins, min_in, max_in, min_out, max_out FROM r JOIN w USING (clade, gene) GROUP BY clade, gene, n_variants, effects, bins, min_in, max_in, min_out, max_out, chunk""")
def _(q):
    """A gene of more than ``functional.CHUNK`` variants has a row for each so many of them, in the order of their ids."""
    g = functional.gene_rollup(_variant_rows(q), ["clade", "gene"], "variant", "effect", "bin", "pin", "pout")
    return g.select("clade", "gene", "n_variants", "variant_ids", "effects", "bins", "min_in", "max_in", "min_out", "max_out")


@query("collapse_cog", "G36", """
WITH l AS (SELECT l_orderkey AS gene, l_linenumber AS o, l_returnflag || l_linestatus AS cog, l_partkey, l_suppkey FROM {lineitem}), x AS (SELECT gene, o, unnest([1, 2]) AS p, unnest(string_split(cog, '')) AS c FROM l WHERE o <> 4),
f AS (SELECT gene, c, min(o * 10 + p) AS first FROM x GROUP BY ALL)
SELECT g.gene, string_agg(c, '' ORDER BY first, c) AS cog FROM (SELECT DISTINCT gene FROM l) g LEFT JOIN f USING (gene) GROUP BY 1""")
def _(q):
    d = q("lineitem").select(F.col("l_orderkey").alias("gene"), "l_linenumber", F.when(F.col("l_linenumber") == 4, F.lit("-")).otherwise(F.concat("l_returnflag", "l_linestatus")).alias("cog"))
    return functional.collapse_cog(d, "gene", "cog", F.col("l_linenumber"))


def _with_impact(q):
    return _variant_rows(q).withColumn("impact", classify.impact_class("effect"))


@query("functional_summary", "G37", f"""
WITH {_VR}, {_LET}, b AS (SELECT clade, bin, impact, count(DISTINCT variant) AS unique_variants, count(DISTINCT gene) AS unique_genes, count(*) AS assignments FROM lt GROUP BY ALL),
p AS (SELECT clade, bin, impact, letter, count(*) AS letter_n, count(DISTINCT variant) AS variants_in_letter, count(DISTINCT gene) AS genes_in_letter FROM lt GROUP BY ALL)
SELECT p.clade, p.bin, p.impact, letter, letter_n, variants_in_letter, genes_in_letter, unique_variants, unique_genes, assignments FROM p JOIN b ON p.clade = b.clade AND p.bin IS NOT DISTINCT FROM b.bin AND p.impact = b.impact""")
def _(q):
    return functional.functional_summary(_with_impact(q), ["clade", "bin", "impact"], "cog", "variant", "gene")


@query("clade_overview", "G38", f"""
WITH {_VR}, {_LET} SELECT clade, count(DISTINCT variant) AS unique_variants, count(DISTINCT gene) AS unique_genes, count(*) AS assignments, count(DISTINCT CASE impact WHEN 'High' THEN variant END) AS high,
 count(DISTINCT CASE impact WHEN 'Moderate' THEN variant END) AS moderate, count(DISTINCT CASE impact WHEN 'Low' THEN variant END) AS low FROM lt GROUP BY 1""")
def _(q):
    return functional.clade_overview(_with_impact(q), "clade", "cog", "variant", "gene", "impact")


@query("cog_summary", "G39", r"""
WITH g AS (SELECT DISTINCT p_type AS clade, p_name AS gene, p_brand < 'Brand#2' AS has_protein, CASE WHEN p_size <= 10 THEN 'NO_PROTEIN' WHEN p_size <= 30 THEN upper(substr(p_name, 1, 1)) ELSE upper(substr(p_name, 1, 2)) END AS c FROM {part}),
s AS (SELECT clade, count(DISTINCT gene) AS n_genes, count(*) FILTER (has_protein) AS n_proteins, CAST(len(list_distinct(flatten(list(CASE WHEN c <> 'NO_PROTEIN' THEN string_split(c, '') END)))) AS INT) AS n_letters FROM g GROUP BY 1),
m AS (SELECT clade, count(*) AS n, string_agg(gene || ' (2 COG)', '; ' ORDER BY gene || ' (2 COG)') AS t FROM g WHERE c <> 'NO_PROTEIN' AND length(c) = 2 GROUP BY 1)
SELECT clade, n_genes, n_proteins, n_letters, coalesce(CAST(m.n AS VARCHAR) || ' proteins (2 COG): ' || t, 'None') AS multi FROM s LEFT JOIN m USING (clade)""")
def _(q):
    cog = F.when(F.col("p_size") <= 5, F.lit("-")).when(F.col("p_size") <= 10, F.lit(None)).when(F.col("p_size") <= 30, F.upper(F.substring("p_name", 1, 1))).otherwise(F.upper(F.substring("p_name", 1, 2)))
    d = q("part").select(F.col("p_type").alias("clade"), F.col("p_name").alias("gene"), cog.alias("cog"), (F.col("p_brand") < "Brand#2").alias("has_protein"))
    return functional.cog_summary(d, "clade", "gene", "cog", "has_protein").drop("chunk")


@query("gene_rollup_chunks", "G35", f"""
WITH {_VR}, r AS (SELECT clade, variant, row_number() OVER (PARTITION BY clade ORDER BY variant) AS r FROM vr)
SELECT clade, CAST((r - 1) // 500 AS BIGINT) AS chunk, CAST(count(*) AS INT) AS n, string_agg(variant, ';' ORDER BY variant) AS variant_ids, max(t.n) AS n_variants FROM r JOIN (SELECT clade, count(*) AS n FROM vr GROUP BY 1) t USING (clade) GROUP BY ALL""")
def _(q):
    """All variants of a clade as one large gene, in rows of 500."""
    g = functional.gene_rollup(_variant_rows(q), "clade", "variant", "effect", "bin", "pin", "pout", size=500)
    return g.select("clade", "chunk", F.size("variants").alias("n"), "variant_ids", "n_variants")


@query("cog_summary_chunks", "G39", r"""
WITH g AS (SELECT DISTINCT p_name AS gene, p_partkey, upper(substr(p_name, 1, 2)) AS c FROM {part}), r AS (SELECT gene || '#' || CAST(p_partkey AS VARCHAR) || ' (2 COG)' AS t FROM g),
n AS (SELECT t, (row_number() OVER (ORDER BY t) - 1) // 300 AS chunk, count(*) OVER () AS m FROM r)
SELECT CAST(chunk AS BIGINT) AS chunk, CAST(max(m) AS VARCHAR) || ' proteins (2 COG): ' || string_agg(t, '; ' ORDER BY t) AS multi FROM n GROUP BY chunk""")
def _(q):
    """One group with every part as a protein of two letters, in rows of 300."""
    d = q("part").select(F.lit("all").alias("clade"), F.concat_ws("#", "p_name", "p_partkey").alias("gene"), F.upper(F.substring("p_name", 1, 2)).alias("cog"), F.lit(True).alias("has_protein"))
    return functional.cog_summary(d, "clade", "gene", "cog", "has_protein", size=300).select("chunk", "multi")


@query("row_accounting", "G40", """
WITH l AS (SELECT l_orderkey AS gene, count(*) AS n, max(l_returnflag) AS f FROM {lineitem} GROUP BY 1), c AS (SELECT f AS run, n, CASE f WHEN 'R' THEN 2 ELSE 1 END AS letters FROM l)
SELECT run, count(*) AS gene_rows, count(*) AS unique_genes, CAST(sum(n) AS BIGINT) AS expected_variants, CAST(sum(letters) AS BIGINT) AS gene_cog_rows, CAST(sum(n) AS BIGINT) AS recovered_variants, CAST(sum(n * letters) AS BIGINT) AS variant_cog_rows,
 CAST(sum(letters) AS BIGINT) - count(*) AS extra_gene_rows, CAST(sum(n * letters) - sum(n) AS BIGINT) AS extra_variant_rows, true AS balanced FROM c GROUP BY 1""")
def _(q):
    f = F.when(F.col("effects") == "stop_gained", F.lit("R")).when(F.col("effects") == "missense_variant", F.lit("N")).otherwise(F.lit("A"))
    genes = _gene_rows(q).withColumn("run", f).withColumn("cog", F.when(F.col("run") == "R", F.lit("KLK")).when(F.col("run") == "N", F.lit("S")).otherwise(F.lit("-")))
    return functional.row_accounting(genes, reshape.unpack_gene_rows(genes), "run", "n_variants", "gene", "cog")


# --- contracts and quality -------------------------------------------------------------------


@query("check_counts", "G41", """
WITH e(lineage, expected) AS (VALUES ('Clade 1A', 300), ('Clade 2', 1), ('Clade 9', 5)) SELECT e.lineage, e.expected, coalesce(o.n, 0) AS observed, coalesce(o.n, 0) - expected AS difference, coalesce(o.n, 0) = expected AS ok
FROM e LEFT JOIN (SELECT lineage, count(*) AS n FROM {groups} GROUP BY 1) o USING (lineage)""")
def _(q):
    expected = q.spark.createDataFrame([("Clade 1A", 300), ("Clade 2", 1), ("Clade 9", 5)], "lineage string, n int")
    return quality.check_counts(reports.counts(q("groups"), "lineage"), expected, "lineage")


@query("qc_dashboard", "G42", f"""
WITH {QC_SQL} SELECT 'final' AS section, final AS item, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM fin), 6) AS pct FROM fin GROUP BY 2
UNION ALL SELECT 'fold_coverage', CASE WHEN fold_coverage >= 30 THEN '>=30x' WHEN fold_coverage >= 25 THEN '25-29x' WHEN fold_coverage >= 20 THEN '20-24x' ELSE '<20x' END, count(*), round(100.0 * count(*) / (SELECT count(*) FROM fin), 6) FROM fin GROUP BY 2""")
def _(q):
    d = quality.qc_dashboard(qc_table(q), "final", ["fold_coverage"])
    return rounded(d.withColumn("section", F.when(F.col("section") == "status", F.lit("final")).otherwise(F.col("section"))), "pct")


@query("read_depth", "G43", """
SELECT conv_id, count(*) AS reads, CAST(coalesce(floor(avg(CASE WHEN role = 'user' AND turn < 6 THEN length(text) END)), 0) AS BIGINT) AS mean_length, count(*) * CAST(coalesce(floor(avg(CASE WHEN role = 'user' AND turn < 6 THEN length(text) END)), 0) AS BIGINT) AS bases,
 round(count(*) * CAST(coalesce(floor(avg(CASE WHEN role = 'user' AND turn < 6 THEN length(text) END)), 0) AS BIGINT) / 1000, 6) AS fold_coverage FROM {conversations} GROUP BY 1""")
def _(q):
    r = q("conversations").select("conv_id", (F.col("turn") + 1).alias("read_no"), F.length("text").alias("len"), F.when(F.col("role") == "user", 1).otherwise(2).alias("mate"))
    return rounded(quality.read_depth(r, "conv_id", "read_no", "len", "mate", 1000, head=6), "fold_coverage")


@query("depth_loss", "G43", """
SELECT user_id, round(b, 2) AS initial_depth, round(coalesce(a, 0), 2) AS final_depth, round(round(b, 2) - round(coalesce(a, 0), 2), 2) AS depth_loss FROM (SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) / 4800 AS b, sum(CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) END) / 4800 AS a FROM {events} GROUP BY 1)""")
def _(q):
    e = q("events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("bases"))
    return quality.depth_loss(e, e.where("event_type = 'click'"), "user_id", "bases", 4800)


@query("resolve_duplicates", "G44", """
SELECT user_id, count(*) AS n_rows, count(DISTINCT t) AS n_calls, max(value) AS max_value, count(DISTINCT t) > 1 AS conflict, CASE WHEN count(DISTINCT t) <= 1 THEN max(t) END AS call
FROM (SELECT user_id, value, CASE WHEN user_id > 75 THEN event_type WHEN event_type <> 'view' THEN 'same' END AS t FROM {events}) GROUP BY 1""")
def _(q):
    t = F.when(F.col("user_id") > 75, F.col("event_type")).when(F.col("event_type") != "view", F.lit("same"))
    return relations.resolve_duplicates(q("events").select("user_id", "value", t.alias("call")), "user_id", "call", "value")


@query("metrics", "G46", """
SELECT 'selected_rows' AS metric, count(*) AS value FROM {o_flags} WHERE selected UNION ALL SELECT 'unique_runs', count(DISTINCT run) FROM {isolates} UNION ALL SELECT 'missing_year', count(*) FROM {isolates} WHERE year IS NULL""")
def _(q):
    return reports.metrics(q.flagged, {"selected_rows": F.count_if(sel()), "unique_runs": F.count_distinct("run"), "missing_year": F.count_if(F.col("year").isNull())})


@query("subset_breakdowns", "G47", """
SELECT field, value, n, CAST(sum(n) OVER (PARTITION BY field) AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (PARTITION BY field), 6) AS pct FROM (
 SELECT 'food_origin' AS field, coalesce(nullif(trim(food_origin), ''), '[Missing]') AS value, count(*) AS n FROM {isolates} WHERE status = 'F' GROUP BY 2 UNION ALL SELECT 'host', coalesce(host, '[Missing]'), count(*) FROM {isolates} WHERE status = 'F' GROUP BY 2
 UNION ALL SELECT 'isolation_source', isolation_source, count(*) FROM {isolates} WHERE status = 'F' GROUP BY 2)""")
def _(q):
    return rounded(reports.subset_breakdowns(q("isolates").where("status = 'F'"), ["food_origin", "host", "isolation_source"]), "pct")


@query("source_decomposition", "G48", f"""
SELECT segment, animal, n, CAST(sum(n) OVER (PARTITION BY segment) AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (PARTITION BY segment), 6) AS pct FROM (SELECT segment, {ANIMAL_SQL} AS animal, count(*) AS n FROM (SELECT segment, lower(isolation_source) AS x FROM {{isolates}}) GROUP BY ALL)""")
def _(q):
    d = q("isolates").withColumn("animal", classify.classify_animal("isolation_source"))
    return rounded(reports.source_decomposition(d, "segment", "animal"), "pct")


@query("source_decomposition_by_status", "G48", f"""
SELECT segment, animal, qr_status, n, CAST(sum(n) OVER w AS BIGINT) AS total, round(100.0 * n / sum(n) OVER w, 6) AS pct FROM (SELECT segment, {ANIMAL_SQL} AS animal, {STATUS_SQL} AS qr_status, count(*) AS n FROM (SELECT *, lower(isolation_source) AS x FROM {{o_packed}}) GROUP BY ALL) WINDOW w AS (PARTITION BY segment, animal)""")
def _(q):
    d = q.cohort.withColumn("animal", classify.classify_animal("isolation_source")).withColumn("qr_status", status())
    return rounded(reports.source_decomposition(d, "segment", "animal", "qr_status"), "pct")


@query("marker_multiplicity", "G49", """
SELECT marker_class, n, CAST(sum(n) OVER () AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT CASE n_markers WHEN 0 THEN '0 markers detected' WHEN 1 THEN '1 marker' ELSE '>1 marker' END AS marker_class, count(*) AS n FROM {o_packed} WHERE contains(lower(amr), 'gyra') OR contains(amr, 'tolC') GROUP BY 1)""")
def _(q):
    flag = F.coalesce(F.lower("amr").contains("gyra") | F.col("amr").contains("tolC"), F.lit(False))
    return rounded(reports.marker_multiplicity(q.cohort, flag, "markers"), "pct")


def _two_versions(q):
    a = q("isolates").select("run", "status", "year", "food_origin")
    b = q("isolates").select("run", F.when(F.col("price") > 400000, F.lit("X")).otherwise(F.col("status")).alias("status"), F.when(F.col("price") < 50000, F.lit(None)).otherwise(F.col("year")).alias("year"), "food_origin")
    return a, b


@query("mismatch_report", "G50", """
SELECT run, status AS status_a, year AS year_a, CASE WHEN price > 400000 THEN 'X' ELSE status END AS status_b, CASE WHEN price >= 50000 THEN year END AS year_b, price > 400000 AS status_mismatch, price < 50000 AND year IS NOT NULL AS year_mismatch
FROM {isolates} WHERE price > 400000 OR (price < 50000 AND year IS NOT NULL)""")
def _(q):
    a, b = _two_versions(q)
    return quality.mismatch_report(a, b, "run", ["status", "year"])


@query("assert_unchanged", "G51", "SELECT run, status FROM {isolates} WHERE price > 400000")
def _(q):
    a, b = _two_versions(q)
    return quality.changed_rows(a, b, ["run", "status"])


@query("year_counts", "G52", """
SELECT y.year, s.segment, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(1993, 2000)) AS INT) AS year) y, (SELECT DISTINCT segment FROM {isolates}) s LEFT JOIN (SELECT year, segment, count(*) AS n FROM {isolates} GROUP BY ALL) c ON c.year = y.year AND c.segment = s.segment""")
def _(q):
    return reports.year_counts(q("isolates"), "year", 1993, 2000, {"segment": SEGMENTS})


@query("check_labels", "G54", """
WITH l AS (SELECT sample, CASE WHEN source = 'BUILDING' THEN 'odd' ELSE lineage END AS lineage FROM {groups} UNION ALL SELECT sample, lineage FROM {groups} WHERE source = 'FURNITURE' UNION ALL SELECT 'ghost', 'Clade 2'), t AS (SELECT DISTINCT 'SRR' || CAST(o_custkey AS VARCHAR) AS sample FROM {orders} WHERE o_orderstatus = 'F' UNION SELECT 'tip')
SELECT CASE WHEN lineage = 'odd' THEN 'invalid_label' ELSE 'label' END AS "check", lineage AS item, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'duplicate_ids', '', count(*) FROM (SELECT sample FROM l GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'label_without_tip', '', count(*) FROM (SELECT DISTINCT sample FROM l WHERE sample NOT IN (FROM t)) UNION ALL SELECT 'tip_without_label', '', count(*) FROM t WHERE sample NOT IN (SELECT sample FROM l)""")
def _(q):
    g = q("groups").select("sample", "lineage", "source")
    ghost = q.spark.createDataFrame([("ghost", "Clade 2")], "sample string, lineage string")
    labels = relations.union_all(g.select("sample", F.when(F.col("source") == "BUILDING", F.lit("odd")).otherwise(F.col("lineage")).alias("lineage")),
                                 g.where("source = 'FURNITURE'").select("sample", "lineage"), ghost)
    tips = q("orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("SRR"), F.col("o_custkey").cast("string")).alias("sample"))
    tips = tips.unionByName(q.spark.createDataFrame([("tip",)], "sample string"))
    return quality.check_labels(labels, tips, "sample", "lineage", LINEAGES)


@query("multi_stack", "G55", """
WITH top AS (SELECT marker, count(*) AS n FROM {o_markers} GROUP BY 1 ORDER BY n DESC, marker LIMIT 5), g AS (SELECT DISTINCT run, segment, CASE WHEN marker IN (SELECT marker FROM top) THEN marker ELSE 'others' END AS marker_group FROM {o_markers}
 UNION ALL SELECT run, segment, 'QS/FQS' FROM {o_packed} WHERE n_markers = 0), d AS (SELECT segment, count(*) AS n_total FROM {isolates} GROUP BY 1)
SELECT segment, marker_group, count(*) AS n, min(n_total) AS n_total, round(100.0 * count(*) / min(n_total), 6) AS pct FROM g JOIN d USING (segment) GROUP BY ALL""")
def _(q):
    from ..operators.ranking import top_k

    top = top_k(q.cohort.select(F.explode("markers").alias("marker")), "marker", 5)
    return rounded(reports.multi_stack(q.cohort, "segment", "markers", top), "pct")


@query("source_counts_classified", "G1", f"SELECT source, count(*) AS n FROM (SELECT {SOURCE_SQL} AS source FROM {{isolates}}) GROUP BY 1")
def _(q):
    return reports.counts(q("isolates").select(_source().alias("source")), "source")
