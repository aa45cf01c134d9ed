"""Queries over cleaning, classification and reshaping functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, dates, formatting, markers, text
from ..operators import quality, relations, reports, reshape
from .registry import CALL, PRETTY, query, rounded

_SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def sq(expr: str) -> str:
    return _SQ.format(expr)


@query("clean_text", "P1", f"SELECT run, coalesce({sq('isolation_source')}, '') AS a, coalesce({sq('food_origin')}, '') AS b FROM {{isolates}}")
def _(q):
    return q("isolates").select("run", text.clean_text("isolation_source").alias("a"), text.clean_text("food_origin").alias("b"))


@query("clean_na", "P2", """
SELECT run, CASE WHEN food_origin IS NULL OR trim(food_origin) = '' THEN NULL ELSE 'x' END AS a, CASE status WHEN 'P' THEN NULL ELSE status END AS b FROM {isolates}""")
def _(q):
    raw = F.when(F.col("status") == "P", F.when(F.col("priority") == "5-LOW", F.lit(" N/A ")).otherwise(F.lit("None"))).otherwise(F.col("status"))
    return q("isolates").select("run", F.when(text.clean_na("food_origin").isNotNull(), F.lit("x")).alias("a"), text.clean_na(raw).alias("b"))


@query("normalize_id", "P3", "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE 'SRR' || CAST(c_custkey AS VARCHAR) END AS id FROM {customer}")
def _(q):
    k = F.col("c_custkey").cast("string")
    raw = (F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("/a/b/_"), "c_name", F.lit("_trimmed.TSV")))
           .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("dir/xSRR"), k, F.lit("_pure.gff"))).otherwise(F.concat(F.lit(" SRR"), k, F.lit("_1 "))))
    return q("customer").select(text.normalize_id(raw).alias("id"))


@query("derive_year", "P4", "SELECT run, year FROM {isolates}")
def _(q):
    return q("isolates").select("run", dates.derive_year("collection_date").alias("year"))


@query("year_bin", "P5", """
SELECT CASE WHEN year IS NULL THEN 'Unknown' WHEN year <= 2000 THEN '<=2000' ELSE '2001-2005' END AS bin, count(*) AS n FROM {isolates} GROUP BY 1""")
def _(q):
    return q("isolates").groupBy(dates.year_bin("year").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


PERIODS = (("Early", None, 1996), ("1997-1999", 1997, 1999), ("Late", 2000, 2005))
PERIOD_SQL = "CASE WHEN year IS NULL THEN 'Missing year' WHEN year <= 1996 THEN 'Early' WHEN year <= 1999 THEN '1997-1999' ELSE 'Late' END"


@query("period", "P6", f"SELECT {PERIOD_SQL} AS period, count(*) AS n FROM {{isolates}} GROUP BY 1")
def _(q):
    return q("isolates").groupBy(dates.period("year", PERIODS, "Missing year").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("year_group", "P7", """
WITH y AS (SELECT run, year, min(year) OVER () AS y0 FROM {isolates})
SELECT run, CAST(year - (year - y0) % 3 AS VARCHAR) || '-' || CAST(year - (year - y0) % 3 + 2 AS VARCHAR) AS year_group FROM y""")
def _(q):
    return reports.year_group(q("isolates"), "year", 3).select("run", "year_group")


_NORM = r"regexp_replace(lower(coalesce(isolation_source, '')), '[^a-z]+', ' ', 'g')"
_WORDS = (r"replace(replace(replace(regexp_replace(" + _NORM + r", 'chicken([a-z])', 'chicken \1', 'g'), 'chicekn', 'chicken'), 'chikcen', 'chicken'), 'chcken', 'chicken')")
_POULTRY = r"\b(chicken|chick|poultry|hen|broiler|layer|gallus|egg|eggs|yolk|yolks|hatchery|hatching|hatcher|liner|liners)\b|\bdrag\s*swabs?\b|\bbox\s*liners?\b|\begg\s*product\b|\begg\s*yolks?\b"
SOURCE_SQL = rf"""CASE WHEN regexp_matches(lower(source_type), '\bhuman\b') THEN 'Human'
  WHEN regexp_matches({_WORDS}, '{_POULTRY}') THEN 'Chicken'
  WHEN contains(lower(coalesce(host, '')), 'chicken') OR contains(lower(coalesce(ifsac_category, '')), 'chicken') THEN 'Chicken'
  WHEN contains(lower(collected_by), 'cdc') THEN 'Human' ELSE 'Other' END"""


def _source():
    return classify.classify_source("source_type", "isolation_source", "host", "ifsac_category", "collected_by")


@query("classify_source", "P8", f"SELECT run, {SOURCE_SQL} AS source FROM {{isolates}}")
def _(q):
    return q("isolates").select("run", _source().alias("source"))


ORIGIN_SQL = rf"""CASE WHEN NOT (starts_with(lower(strain), 'fda') OR regexp_matches(lower(coalesce(isolate_identifiers, '')), '\b(cfsan|fda)\b')) THEN 'US'
  WHEN coalesce(trim(food_origin), '') = '' THEN 'US' WHEN regexp_matches(lower(food_origin), '\busa\b|united\s+states|\bus\b') THEN 'US' ELSE 'Non-US' END"""


@query("derive_origin", "P9", f"""
WITH s AS (SELECT run, {SOURCE_SQL} AS source, {ORIGIN_SQL} AS origin_group FROM {{isolates}})
SELECT run, origin_group, CASE source WHEN 'Human' THEN 'Human' ELSE source || '-' || origin_group END AS source_group,
       CASE WHEN source <> 'Human' AND origin_group = 'Non-US' THEN 'International' WHEN source = 'Human' THEN 'Human' ELSE source || '-US' END AS final_source FROM s""")
def _(q):
    d = q("isolates").withColumn("source", _source())
    return d.select("run", *[v.alias(k) for k, v in classify.derive_origin("source", "strain", "isolate_identifiers", "food_origin").items()])


ANIMAL_SQL = r"""CASE WHEN regexp_matches(x, '\b(chicken|broiler|hen)\b') THEN 'Chicken' WHEN regexp_matches(x, '\bturkey\b') THEN 'Turkey'
  WHEN regexp_matches(x, '\b(cattle|bovine|beef|steer|calf|veal|bos taurus)\b') THEN 'Cattle' WHEN regexp_matches(x, '\b(sheep|lamb|ovine|goat|caprine)\b') THEN 'Sheep/goat'
  WHEN regexp_matches(x, '\b(swine|sow|pork|porcine)\b') THEN 'Swine' ELSE 'Others' END"""


@query("classify_animal", "P10", f"SELECT run, {ANIMAL_SQL} AS animal FROM (SELECT run, lower(isolation_source) AS x FROM {{isolates}})")
def _(q):
    return q("isolates").select("run", classify.classify_animal("isolation_source").alias("animal"))


@query("classify_commodity", "P11", r"""
SELECT run, CASE WHEN status = 'O' AND segment = 'AUTOMOBILE' THEN 'Chicken-containing pet treats'
  WHEN regexp_matches(x, 'rabbit') THEN 'Rabbit meat/products'
  WHEN regexp_matches(x, '\b(shrimp|crab|lobster)\b') AND NOT regexp_matches(x, 'imitation\s+crab') THEN 'Crustaceans'
  WHEN regexp_matches(x, '\b(squid|cuttlefish|snail|mussel|clam)\b') THEN 'Mollusks'
  WHEN regexp_matches(x, 'imitation\s+crab') THEN 'Processed/imitated seafood'
  WHEN regexp_matches(x, '\b(guinea\s+pig|quail)\b') THEN 'Other terrestrial animals'
  WHEN regexp_matches(x, '\b(cake|biscuit)\b') THEN 'Bakery/confectionery' WHEN regexp_matches(x, '\bcheese\b') THEN 'Dairy/cheese'
  ELSE 'Unclassified — review literal source' END AS commodity FROM (SELECT *, lower(isolation_source) AS x FROM {isolates})""")
def _(q):
    group = F.when((F.col("status") == "O") & (F.col("segment") == "AUTOMOBILE"), F.lit("Chicken-Non-US")).otherwise(F.lit("Other-Non-US"))
    return q("isolates").select("run", classify.classify_commodity("isolation_source", group).alias("commodity"))


@query("assign_pattern", "P12", """
SELECT run, CASE WHEN regexp_matches(a, 'gyra[_-]?d87y') THEN 'gyrA_D87Y' WHEN regexp_matches(a, 'gyra[_-]?d87n') THEN 'gyrA_D87N' WHEN regexp_matches(a, 'gyra[_-]?s83y') THEN 'gyrA_S83Y'
 WHEN regexp_matches(a, 'gyra[_-]?d87g') THEN 'gyrA_D87G' WHEN contains(a, 'qnrb19') THEN 'qnrB19' ELSE 'others' END AS pattern FROM (SELECT run, lower(coalesce(amr, '')) AS a FROM {cohort})""")
def _(q):
    return q("cohort").select("run", markers.assign_pattern("amr").alias("pattern"))


FAMILY_SQL = """CASE WHEN tok IN ('gyra_d87y', 'gyra_d87n') THEN tok WHEN tok LIKE 'gyra!_%' ESCAPE '!' THEN 'gyra_others' WHEN tok LIKE 'parc!_%' ESCAPE '!' THEN 'parc_all'
 WHEN tok LIKE 'qnr%' THEN 'qnr_all' WHEN tok = 'aac(6'')-ib-cr' THEN tok WHEN tok = 'oqxa' THEN tok WHEN tok LIKE 'acrb!_%' ESCAPE '!' THEN 'acrb_all'
 WHEN tok LIKE 'soxs!_%' ESCAPE '!' THEN 'soxs_all' ELSE 'other_qr' END"""


@query("marker_family", "P13", f"""
SELECT run, tok AS token, {FAMILY_SQL} AS family FROM (SELECT run, lower(tok) AS tok FROM {{o_tokens}} WHERE regexp_matches(lower(tok), '{CALL}'))""")
def _(q):
    t = q.cohort.select("run", F.explode("raw_markers").alias("t")).select("run", F.lower("t").alias("token"))
    return t.withColumn("family", markers.marker_family("token", ["gyra_d87y", "gyra_d87n"]))


_MAJOR_COUNT = "SELECT f.run, f.year, f.status, count(m.marker) AS n, count(*) FILTER (m.marker IN ('gyrA_D87Y','gyrA_D87N','gyrA_S83Y','gyrA_D87G','qnrB19')) AS k, " \
    "min(CASE m.marker WHEN 'gyrA_D87Y' THEN 1 WHEN 'gyrA_D87N' THEN 2 WHEN 'gyrA_S83Y' THEN 3 WHEN 'gyrA_D87G' THEN 4 WHEN 'qnrB19' THEN 5 END) AS first, " \
    "min(f.selected) AS selected, min(f.analyzed) AS analyzed FROM {o_flags} f LEFT JOIN {o_markers} m USING (run) GROUP BY f.run, f.year, f.status"
_MAJOR_NAME = "list_extract(['gyrA_D87Y','gyrA_D87N','gyrA_S83Y','gyrA_D87G','qnrB19'], first)"
GROUP_SQL = f"CASE WHEN n = 0 THEN 'QS/FQS (no marker)' WHEN k > 1 THEN 'Multiple major QR/FQR markers' WHEN k = 1 THEN {_MAJOR_NAME} ELSE 'Other QR/FQR marker(s)' END"
BUCKET_SQL = f"CASE WHEN n = 0 THEN 'QS/FQS' WHEN k >= 1 THEN {_MAJOR_NAME} ELSE 'Others' END"
MAJOR_SQL = _MAJOR_COUNT


@query("exclusive_group", "P14", f"SELECT run, {GROUP_SQL} AS grp FROM ({_MAJOR_COUNT})")
def _(q):
    return q.cohort.select("run", markers.exclusive_group("raw_markers").alias("grp"))


@query("priority_bucket", "P15", f"SELECT run, {BUCKET_SQL} AS bucket FROM ({_MAJOR_COUNT})")
def _(q):
    return q.cohort.select("run", markers.priority_bucket("raw_markers").alias("bucket"))


REPORT_SQL = r"""
WITH u AS (SELECT run, upper(coalesce(amr, '')) AS t, cust IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0) AS skip FROM {cohort}),
l AS (SELECT run, skip, list_filter([
  CASE WHEN regexp_matches(t, '\bGYRA_S83Y\b') THEN 'S83Y' END, CASE WHEN regexp_matches(t, '\bGYRA_D87Y\b') THEN 'D87Y' END,
  CASE WHEN regexp_matches(t, '\bGYRA_D87N\b') THEN 'D87N' END, CASE WHEN regexp_matches(t, '\bGYRA_D87G\b') THEN 'D87G' END,
  CASE WHEN regexp_matches(t, '\bQNRB19\b') THEN 'qnrB19' END,
  CASE WHEN len(list_filter(regexp_extract_all(t, '\b(?:GYRA|GYRB|PARC|PARE)_[A-Z][0-9]+[A-Z]\b|\bQNR[A-Z0-9]+\b'),
     lambda x: x NOT IN ('GYRA_S83Y','GYRA_D87Y','GYRA_D87N','GYRA_D87G','QNRB19'))) > 0 THEN 'Others' END], lambda x: x IS NOT NULL) AS ls FROM u)
SELECT run, CASE WHEN skip OR len(ls) = 0 THEN 'QS/FQS' ELSE ls[1] END AS primary_marker, CASE WHEN skip OR len(ls) = 0 THEN 'QS/FQS' ELSE array_to_string(ls, ';') END AS markers,
       CAST(CASE WHEN skip THEN 0 ELSE len(ls) END AS INT) AS n FROM l"""


@query("derive_markers", "P16", REPORT_SQL)
def _(q):
    over = q("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("cust"))
    d = relations.flag_members(q("cohort"), over, "cust", "override").withColumn("ls", markers.report_markers("amr", F.col("override")))
    none = F.size("ls") == 0
    return d.select("run", F.when(none, F.lit("QS/FQS")).otherwise(F.try_element_at("ls", F.lit(1))).alias("primary_marker"),
                    F.when(none, F.lit("QS/FQS")).otherwise(F.array_join("ls", ";")).alias("markers"), F.size("ls").alias("n"))


@query("indicator_columns", "P17", """
SELECT run, CAST(list_contains(string_split(packed, ';'), 'gyrA_D87Y') AS INT) AS "has_gyrA_D87Y", CAST(list_contains(string_split(packed, ';'), 'qnrB19') AS INT) AS "has_qnrB19" FROM {o_packed}""")
def _(q):
    d = q.cohort.select("run", F.array_join("markers", ";").alias("packed"))
    return d.select("run", *markers.indicator_columns("packed", ["gyrA_D87Y", "qnrB19"]))


@query("clean_source", "P18", """
SELECT run, CASE WHEN region = 'ASIA' THEN 'International' WHEN region = 'AFRICA' THEN 'Unknown' ELSE region END AS source FROM {isolates}""")
def _(q):
    raw = F.when(F.col("region") == "ASIA", F.lit(" Other-Non-US")).when(F.col("region") == "AFRICA", F.lit("  ")).otherwise(F.concat(F.lit(" "), "region"))
    return q("isolates").select("run", text.clean_source(raw).alias("source"))


@query("recode_groups", "P19", """
SELECT sample, CASE WHEN lineage IN ('Clade 1A', 'Clade 1B') THEN 'Clade 1' WHEN source = 'HOUSEHOLD' THEN 'Unassigned' ELSE lineage END AS lineage FROM {groups} WHERE source <> 'BUILDING'""")
def _(q):
    odd = F.when(F.col("source") == "BUILDING", F.lit("Reference")).when((F.col("source") == "HOUSEHOLD") & ~F.col("lineage").startswith("Clade 1"), F.lit("??")).otherwise(F.col("lineage"))
    valid = ["Clade 1A", "Clade 1B", "Clade 2", "Clade 3", "Unassigned"]
    return reshape.recode_groups(q("groups").withColumn("lineage", odd), "lineage", "Combined_Clade1", valid).select("sample", "lineage")


@query("lump_rare", "P20", """
WITH c AS (SELECT p_brand, count(*) AS n FROM {part} GROUP BY 1) SELECT CASE WHEN c.n < 80 THEN 'Other' ELSE p_brand END AS brand, count(*) AS n FROM {part} JOIN c USING (p_brand) GROUP BY 1""")
def _(q):
    return reports.lump_rare(q("part"), "p_brand", 80).groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("gene_class", "P21", """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'Blank_or_missing' WHEN p_size <= 20 THEN 'Intergenic' WHEN p_size <= 30 THEN 'Hypothetical_protein' WHEN p_size <= 40 THEN 'Locus_tag_like' ELSE 'Named_gene' END AS cls FROM {part}""")
def _(q):
    s = F.col("p_size")
    name = (F.when(s <= 5, F.lit(" N/A ")).when(s <= 10, F.lit(None)).when(s <= 20, F.lit("Intergenic")).when(s <= 30, F.lit("hypothetical  protein"))
            .when(s <= 40, F.concat(F.lit("SEN_RS"), "p_partkey")).otherwise(F.col("p_name")))
    return q("part").select("p_partkey", text.gene_class(name).alias("cls"))


@query("impact_class", "P22", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'High' WHEN p_size > 20 THEN 'Moderate' ELSE 'Low' END AS impact FROM {part}""")
def _(q):
    s = F.col("p_size")
    eff = F.when(s > 40, F.lit("missense_variant; stop_gained")).when(s > 20, F.lit("synonymous_variant;missense_variant")).when(s > 10, F.lit("synonymous_variant"))
    return q("part").select("p_partkey", classify.impact_class(eff).alias("impact"))


@query("assign_bin", "P23", """
SELECT l_linenumber, CASE WHEN v < 40 THEN NULL WHEN v < 60 THEN '40-<60%' WHEN v < 80 THEN '60-<80%' WHEN v < 90 THEN '80-<90%' ELSE '>=90%' END AS bin,
       CASE WHEN v <= 0 THEN '0' WHEN v <= 5 THEN '1-5' WHEN v <= 10 THEN '6-10' WHEN v <= 20 THEN '10-20' WHEN v <= 40 THEN '20-40' WHEN v <= 50 THEN '40-50' WHEN v <= 60 THEN '50-60' WHEN v <= 80 THEN '60-80' ELSE '80+' END AS prevalence,
       count(*) AS n FROM (SELECT l_linenumber, l_quantity * 2 AS v FROM {lineitem}) GROUP BY ALL""")
def _(q):
    v = F.col("l_quantity") * 2
    # Prevalence bins, right-closed.
    wide = dates.assign_bin(v, (0, 5, 10, 20, 40, 50, 60, 80), ("0", "1-5", "6-10", "10-20", "20-40", "40-50", "50-60", "60-80", "80+"), right=True)
    half = dates.assign_bin(v, (40, 60, 80, 90), ("40-<60%", "60-<80%", "80-<90%", ">=90%"))
    return q("lineitem").groupBy("l_linenumber", half.alias("bin"), wide.alias("prevalence")).agg(F.count(F.lit(1)).alias("n"))


@query("eligible", "P24", """
SELECT segment, count(*) FILTER (year BETWEEN 1996 AND 2000) AS strict, count(*) FILTER (year IS NULL OR year BETWEEN 1996 AND 2000) AS with_missing FROM {isolates} GROUP BY 1""")
def _(q):
    return q("isolates").groupBy("segment").agg(F.count_if(dates.eligible("year", 1996, 2000)).alias("strict"),
                                                F.count_if(dates.eligible("year", 1996, 2000, True)).alias("with_missing"))


@query("presence_filter", "P25", "SELECT sample, symbol, count(*) AS n FROM {hits} WHERE coverage >= 80 AND identity >= 90 AND type <> 'PROMO' GROUP BY ALL")
def _(q):
    from ..operators.enrichment import presence_filter

    raw = F.when(F.col("type") == "PROMO", F.lit("not a number")).otherwise(F.col("coverage").cast("string"))
    return presence_filter(q("hits").withColumn("coverage", raw), "coverage", "identity").groupBy("sample", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("qc_status", "P26", """
SELECT run, CASE WHEN t = '' THEN 'PASS' ELSE t END AS qc FROM (SELECT run, concat_ws('|', CASE WHEN price < 100000 THEN 'Low_Purity' END, CASE WHEN year < 1997 THEN 'Low_Depth' END, CASE WHEN status = 'P' THEN 'Short_Reads' END) AS t FROM {isolates})""")
def _(q):
    rules = [(F.col("price") < 100000, "Low_Purity"), (F.col("year") < 1997, "Low_Depth"), (F.col("status") == "P", "Short_Reads")]
    return q("isolates").select("run", quality.qc_status(rules).alias("qc"))


QC_SQL = """
qc AS (SELECT i.run, i.status, c.fold_coverage, a.call_a, b.call_b,
  CASE WHEN c.fold_coverage IS NULL THEN 'MISSING' WHEN c.fold_coverage >= 30 THEN 'PASS' ELSE 'FAIL' END AS cov,
  CASE WHEN a.call_a IS NULL THEN 'MISSING' WHEN a.call_a = 'Enteritidis' THEN 'PASS' ELSE 'FAIL' END AS sa,
  CASE WHEN b.call_b IS NULL THEN 'MISSING' WHEN contains(b.call_b, 'Enteritidis') THEN 'PASS' ELSE 'FAIL' END AS sb
  FROM {isolates} i LEFT JOIN {coverage_report} c USING (run) LEFT JOIN {typing_a} a USING (run) LEFT JOIN {typing_b} b USING (run)),
fin AS (SELECT *, CASE WHEN cov = 'MISSING' OR sa = 'MISSING' OR sb = 'MISSING' THEN 'MISSING_' || concat_ws('_', CASE cov WHEN 'MISSING' THEN 'COVERAGE' END, CASE sa WHEN 'MISSING' THEN 'SISTR' END, CASE sb WHEN 'MISSING' THEN 'SEQSERO' END)
  WHEN cov = 'PASS' AND sa = 'PASS' AND sb = 'PASS' THEN 'PASS_ALL_THREE' WHEN cov = 'FAIL' AND sa = 'FAIL' AND sb = 'FAIL' THEN 'FAIL_ALL_THREE'
  ELSE 'FAIL_' || concat_ws('_', CASE cov WHEN 'FAIL' THEN 'COVERAGE' END, CASE sa WHEN 'FAIL' THEN 'SISTR' END, CASE sb WHEN 'FAIL' THEN 'SEQSERO' END)
  || CASE WHEN CAST(cov = 'FAIL' AS INT) + CAST(sa = 'FAIL' AS INT) + CAST(sb = 'FAIL' AS INT) = 1 THEN '_ONLY' ELSE '' END END AS final FROM qc)"""


def qc_table(q):
    d = (q("isolates").select("run", "status").join(q("coverage_report"), "run", "left").join(q("typing_a"), "run", "left").join(q("typing_b"), "run", "left"))
    d = d.withColumns({"cov": quality.criterion_status(F.col("fold_coverage") >= 30), "sa": quality.criterion_status(F.col("call_a") == "Enteritidis"),
                       "sb": quality.criterion_status(F.col("call_b").contains("Enteritidis"))})
    return d.withColumn("final", quality.compose_status({"COVERAGE": F.col("cov"), "SISTR": F.col("sa"), "SEQSERO": F.col("sb")}))


@query("compose_status", "P27", f"WITH {QC_SQL} SELECT run, cov, sa, sb, final FROM fin")
def _(q):
    return qc_table(q).select("run", "cov", "sa", "sb", "final")


REASON_SQL = """concat_ws(' | ', CASE cov WHEN 'FAIL' THEN printf('Low Coverage (%.2fX < 30X)', fold_coverage) WHEN 'MISSING' THEN 'Missing Coverage Data' END,
  CASE sa WHEN 'FAIL' THEN 'SISTR Not Enteritidis (' || call_a || ')' WHEN 'MISSING' THEN 'Missing SISTR Data' END,
  CASE sb WHEN 'FAIL' THEN 'SeqSero2 Not Enteritidis (' || call_b || ')' WHEN 'MISSING' THEN 'Missing SeqSero2 Data' END)"""


def _reasons():
    return quality.failure_reasons("fold_coverage", "cov", [("SISTR", "sa", "call_a"), ("SeqSero2", "sb", "call_b")], "Enteritidis", 30)


@query("failure_reasons", "P28", f"WITH {QC_SQL} SELECT run, {REASON_SQL} AS reasons FROM fin")
def _(q):
    return qc_table(q).select("run", _reasons().alias("reasons"))


@query("audit_label", "P29", f"""
WITH {QC_SQL}, r AS (SELECT *, {REASON_SQL} AS reasons, status <> 'P' AS in_tree FROM fin)
SELECT run, CASE WHEN in_tree AND final = 'PASS_ALL_THREE' THEN 'PASS'
 WHEN in_tree AND sa = 'PASS' AND sb = 'PASS' AND cov = 'FAIL' THEN printf('PASS: Historical coverage exception; confirmed Enteritidis by both typing tools; coverage %.2fX (<30X); retained in final tree', fold_coverage)
 WHEN in_tree THEN 'PASS: Present in historical final tree despite retrospective QC flag [' || reasons || ']'
 WHEN final = 'PASS_ALL_THREE' THEN 'FAIL: Excluded during initial composition/phylogenetic screening' || CASE WHEN contains(call_b, ' or ') THEN '; ambiguous call (' || call_b || ')' ELSE '' END
 ELSE 'FAIL: ' || reasons END AS audit FROM r""")
def _(q):
    d = qc_table(q).withColumn("reasons", _reasons())
    label = quality.audit_label("final", F.col("status") != "P", F.col("final").isNotNull(), F.col("reasons"), "fold_coverage", "cov", ["sa", "sb"],
                                "call_b", "Enteritidis", 30, "PASS_ALL_THREE")
    return d.select("run", label.alias("audit"))


@query("format_cell", "P30", """
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY ALL), t AS (SELECT p_brand, sum(n) AS d FROM c GROUP BY 1)
SELECT p_brand, p_type, CAST(n AS VARCHAR) || ' (' || CASE WHEN 100.0 * n / d = round(100.0 * n / d) THEN CAST(CAST(round(100.0 * n / d) AS INT) AS VARCHAR) || '%' ELSE printf('%.1f%%', CAST(100 AS DOUBLE) * n / d) END || ')ᵃᵇ' AS cell
FROM c JOIN t USING (p_brand)""")
def _(q):
    c = reports.with_share(reports.counts(q("part"), ["p_brand", "p_type"]), "p_brand")
    return c.select("p_brand", "p_type", formatting.format_cell("n", "total", F.lit("ab")).alias("cell"))


@query("complete_schema", "P31", """
SELECT run, status AS status, coalesce(host, isolation_source) AS source_raw, food_origin AS location_clean, CAST(NULL AS VARCHAR) AS outbreak_clean FROM {isolates}""")
def _(q):
    d = q("isolates").select("run", "status", "host", "isolation_source", "food_origin")
    out = reshape.complete_schema(d, {"status": [F.lit("never")], "source_raw": ["absent", "host", "isolation_source"], "location_clean": ["food_origin"],
                                      "outbreak_clean": ["Outbreak", "Rmd_Outbreak"]}, keep=["status"])
    return out.select("run", "status", "source_raw", "location_clean", "outbreak_clean")


@query("prefix_columns", "P32", """SELECT run, status AS "QC_status", region AS "QC_region" FROM {isolates}""")
def _(q):
    return reshape.prefix_columns(q("isolates").select("run", "status", "region"), "run", "QC_")


@query("expect", "P33", "SELECT year, source, cip_tested AS tested FROM {phenotype}")
def _(q):
    d = relations.expect(q("phenotype"), F.col("cip_tested") == F.col("dsc_tested"), "denominators differ")
    d = relations.expect(d, F.col("cip_resistant") + F.col("dsc_resistant") <= F.col("cip_tested"), "resistant exceeds tested")
    return d.select("year", "source", F.col("cip_tested").alias("tested"))


@query("audit_formats", "P34", r"""
SELECT 'run' AS field, true AS checked, count(*) AS nonmissing, CAST(0 AS BIGINT) AS invalid FROM {isolates}
UNION ALL SELECT 'food_origin', true, count(*) FILTER (trim(food_origin) <> ''), count(*) FILTER (trim(food_origin) <> '' AND NOT regexp_matches(food_origin, '^[A-Z]+$')) FROM {isolates}
UNION ALL SELECT 'bioproject', false, NULL, NULL""")
def _(q):
    return quality.audit_formats(q("isolates"), {"run": r"^SRR[0-9]+$", "food_origin": r"^[A-Z]+$", "bioproject": r"^PRJ"})


# --- scalar functions ------------------------------------------------------------------------


@query("string_functions", "X1", """
SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS cased, printf('%03d|%s', p_size, p_brand) AS packed, split_part(p_name, ' ', 2) AS last_word FROM {part}""")
def _(q):
    return q("part").select("p_partkey", F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.expr("substring(p_name, 2)"))).alias("cased"),
                            F.format_string("%03d|%s", "p_size", "p_brand").alias("packed"), F.element_at(F.split("p_name", " "), -1).alias("last_word"))


@query("pretty_token", "X2", f"SELECT DISTINCT tok AS token, {PRETTY} AS pretty FROM {{o_tokens}} WHERE regexp_matches(lower(tok), '{CALL}')")
def _(q):
    return q.cohort.select(F.explode("raw_markers").alias("token")).distinct().withColumn("pretty", markers.pretty_token("token"))


@query("filter_tokens", "X3", f"""
SELECT run, count(*) FILTER (regexp_matches(lower(tok), '{CALL}')) AS narrow,
       count(*) FILTER (regexp_matches(lower(tok), '^(gyr|par|qnr|aac|oqx|acr|tolc|sox)')) AS broad FROM {{o_tokens}} GROUP BY run""")
def _(q):
    d = q("cohort").withColumn("t", markers.extract_tokens("amr")).where(F.size("t") > 0)
    return d.select("run", F.size(markers.filter_tokens("t")).cast("bigint").alias("narrow"),
                    F.size(markers.filter_tokens("t", markers.BROAD_PATTERN)).cast("bigint").alias("broad"))


@query("canonical_list", "X4", """
SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ';' ORDER BY l_returnflag || l_linestatus) AS packed FROM {lineitem} GROUP BY 1""")
def _(q):
    packed = F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus")), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), " ; ")
    return q("lineitem").groupBy("l_orderkey").agg(packed.alias("raw")).select("l_orderkey", text.canonical_list("raw").alias("packed"))


@query("bracket_category", "X5", """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'Uncategorized' ELSE p_type END AS category FROM {part}""")
def _(q):
    product = F.when(F.col("p_size") <= 5, F.lit(None)).when(F.col("p_size") <= 10, F.col("p_name")).otherwise(
        F.concat("p_name", F.lit(" [ "), "p_type", F.lit(" ] [Salmonella]")))
    return q("part").select("p_partkey", text.bracket_category(product).alias("category"))


@query("parse_date", "X7", """
SELECT run, CASE priority WHEN '1-URGENT' THEN CAST(o_orderdate AS DATE) WHEN '3-MEDIUM' THEN CAST(o_orderdate AS DATE) WHEN '2-HIGH' THEN make_date(CAST(year(o_orderdate) AS BIGINT), 1, 1) END AS parsed
FROM {isolates} JOIN {orders} ON order_id = o_orderkey""")
def _(q):
    return q("isolates").select("run", dates.parse_date("collection_date").alias("parsed"))


@query("math_functions", "X8", """
SELECT l_linenumber, round(exp(avg(ln(l_quantity))), 6) AS geo, round(quantile_cont(l_extendedprice, 0.975), 6) AS q975, round(sqrt(avg(l_quantity)), 6) AS root,
       sum(CAST(round_even(l_quantity / 2, 0) AS BIGINT))::BIGINT AS half_even, max(greatest(l_discount, l_tax)) AS hi, min(least(l_discount, l_tax)) AS lo FROM {lineitem} GROUP BY 1""")
def _(q):
    d = q("lineitem").groupBy("l_linenumber").agg(
        F.exp(F.avg(F.ln("l_quantity"))).alias("geo"), F.percentile("l_extendedprice", F.lit(0.975)).alias("q975"), F.sqrt(F.avg("l_quantity")).alias("root"),
        F.sum(F.bround(F.col("l_quantity") / 2, 0).cast("bigint")).alias("half_even"), F.max(F.greatest("l_discount", "l_tax")).alias("hi"), F.min(F.least("l_discount", "l_tax")).alias("lo"))
    return rounded(d, "geo", "q975", "root")


@query("extract_markers", "X9", f"""
SELECT run, CAST(count(DISTINCT tok) AS INT) AS n, string_agg(DISTINCT tok, ',' ORDER BY tok) AS tokens FROM {{o_tokens}} WHERE regexp_matches(lower(tok), '{CALL}') GROUP BY run""")
def _(q):
    d = q("cohort").withColumn("m", markers.extract_markers("amr")).where(F.size("m") > 0)
    return d.select("run", F.size("m").alias("n"), F.array_join(F.array_sort("m"), ",").alias("tokens"))


@query("null_safe_compare", "X11", "SELECT run, food_origin IS NOT DISTINCT FROM host AS same, (food_origin IS NULL) <> (host IS NULL) AS one_missing FROM {isolates}")
def _(q):
    return q("isolates").select("run", F.col("food_origin").eqNullSafe(F.col("host")).alias("same"),
                                (F.col("food_origin").isNull() != F.col("host").isNull()).alias("one_missing"))


# --- reshape ---------------------------------------------------------------------------------


@query("pivot_metrics", "R1", """
SELECT year, source, metric, round(pct, 6) AS pct, round(greatest(0, lo), 6) AS lo, round(hi, 6) AS hi FROM (
 SELECT year, source, metric, 100 * x / n AS pct, 100 * (x / n - 1.96 * sqrt((x / n) * (1 - x / n) / n)) AS lo, 100 * (x / n + 1.96 * sqrt((x / n) * (1 - x / n) / n)) AS hi FROM (
  SELECT year, source, 'cip' AS metric, CAST(cip_resistant AS DOUBLE) AS x, cip_tested AS n FROM {phenotype} UNION ALL SELECT year, source, 'dsc', dsc_resistant, dsc_tested FROM {phenotype}
  UNION ALL SELECT year, source, 'both', cip_resistant + dsc_resistant, cip_tested FROM {phenotype}))""")
def _(q):
    wide = quality.trend_rates(q("phenotype"), ["year", "source"], {
        "cip": (F.col("cip_resistant"), F.col("cip_tested")), "dsc": (F.col("dsc_resistant"), F.col("dsc_tested")),
        "both": (F.col("cip_resistant") + F.col("dsc_resistant"), F.greatest("cip_tested", "dsc_tested"))})
    return rounded(reshape.pivot_metrics(wide, ["year", "source"], r"^(cip|dsc|both)_(pct|lo|hi)$"), "pct", "lo", "hi")


@query("to_long", "R2", """
SELECT year, source, 'cip_resistant' AS name, CAST(cip_resistant AS BIGINT) AS value FROM {phenotype} UNION ALL SELECT year, source, 'dsc_resistant', CAST(dsc_resistant AS BIGINT) FROM {phenotype}""")
def _(q):
    return reshape.to_long(q("phenotype"), ["year", "source"], ["cip_resistant", "dsc_resistant"])


@query("to_wide", "R2", """
SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY') AS "ECONOMY", count(*) FILTER (p_type = 'PROMO') AS "PROMO", CAST(0 AS BIGINT) AS "NONE" FROM {part} GROUP BY 1""")
def _(q):
    return reshape.to_wide(reports.counts(q("part"), ["p_brand", "p_type"]), "p_brand", "p_type", "n", ["ECONOMY", "PROMO", "NONE"])


@query("explode_tokens", "R3", "SELECT run, tok AS marker FROM {o_tokens}")
def _(q):
    return reports.explode_tokens(q("cohort").select("run", markers.extract_tokens("amr").alias("t")), "t")


def _gene_rows(q):
    """Orders as gene rows with packed lists: one id per line, one effect for all, one bin for all or none."""
    g = q("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey"))), "; ").alias("variant_ids"),
                                                F.count(F.lit(1)).alias("n_variants"), F.max("l_returnflag").alias("f"))
    return g.select(F.col("l_orderkey").alias("gene"), "variant_ids", "n_variants",
                    F.when(F.col("f") == "R", F.lit("stop_gained")).when(F.col("f") == "N", F.lit("missense_variant")).otherwise(F.lit("")).alias("effects"),
                    F.when(F.col("f") == "R", F.lit(">=90%")).alias("bins"))


@query("unpack_rows", "R4", """
WITH l AS (SELECT l_orderkey AS gene, CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) AS id, max(l_returnflag) OVER (PARTITION BY l_orderkey) AS f FROM {lineitem})
SELECT gene, id AS variant_id, CASE f WHEN 'R' THEN 'stop_gained' WHEN 'N' THEN 'missense_variant' END AS effect, CASE f WHEN 'R' THEN '>=90%' END AS coverage_bin,
       CASE f WHEN 'R' THEN 'High' WHEN 'N' THEN 'Moderate' ELSE 'Low' END AS impact_class, CAST(row_number() OVER (PARTITION BY gene ORDER BY id) AS INT) AS item_index FROM l""")
def _(q):
    return reshape.unpack_gene_rows(_gene_rows(q)).select("gene", "variant_id", "effect", "coverage_bin", "impact_class", "item_index")


@query("explode_letters", "R5", """
SELECT p_partkey, unnest(list_distinct(string_split(upper(replace(p_name, ' ', '')), ''))) AS letter FROM {part} WHERE p_size > 5
UNION ALL SELECT p_partkey, 'NO_PROTEIN' FROM {part} WHERE p_size <= 5""")
def _(q):
    cog = F.when(F.col("p_size") <= 2, F.lit("-")).when(F.col("p_size") <= 5, F.lit(None)).otherwise(F.upper(F.regexp_replace("p_name", " ", "")))
    return reshape.explode_letters(q("part").select("p_partkey", cog.alias("cog")), "cog").select("p_partkey", "letter")


RUNS_SQL = """
runs AS (SELECT sample, scheme, mode, CASE WHEN scheme = 'Combined_Clade1' AND lineage IN ('Clade 1A', 'Clade 1B') THEN 'Clade 1' ELSE lineage END AS lineage
  FROM {groups}, (VALUES ('Combined_Clade1'), ('Split_Clade1A1B')) s(scheme), (VALUES ('with_unassigned'), ('without_unassigned')) m(mode) WHERE mode = 'with_unassigned' OR lineage <> 'Unassigned')"""


@query("with_runs", "R6", f"WITH {RUNS_SQL} SELECT scheme, mode, lineage, count(*) AS n FROM runs GROUP BY ALL")
def _(q):
    return reports.counts(reshape.with_runs(q("groups"), "lineage"), ["scheme", "mode", "lineage"])


@query("canonical_slice", "R7", f"""
WITH {RUNS_SQL} SELECT scheme, lineage, count(*) AS n FROM runs WHERE mode = 'with_unassigned' AND ((scheme = 'Combined_Clade1' AND lineage = 'Clade 1') OR (scheme = 'Split_Clade1A1B')) GROUP BY ALL""")
def _(q):
    c = reports.counts(reshape.with_runs(q("groups"), "lineage"), ["scheme", "mode", "lineage"])
    return reshape.canonical_slice(c, [
        {"scheme": "Combined_Clade1", "mode": "with_unassigned", "lineage": "Clade 1"},
        {"scheme": "Split_Clade1A1B", "mode": "with_unassigned", "lineage": ["Clade 1A", "Clade 1B", "Clade 2", "Clade 3", "Unassigned"]}]).drop("mode")
