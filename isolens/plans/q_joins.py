"""Queries over joins, set operations, windows, ordering and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality, ranking, relations, reports, resampling, tree
from .q_clean import QC_SQL, qc_table
from .registry import CALL, query, rounded


def _sel(q):
    return q.flagged.where("selected")


@query("select_cohort", "J1", "SELECT run, strain, food_origin FROM {o_flags} WHERE (strain, coalesce(food_origin, '~')) IN (SELECT strain, coalesce(food_origin, '~') FROM {o_flags} WHERE analyzed)")
def _(q):
    keys = q.flagged.where("analyzed").select("strain", "food_origin")
    return relations.select_cohort(q("isolates").select("run", "strain", "food_origin"), keys, ["strain", "food_origin"])


@query("exclude", "J2", "SELECT run, food_origin FROM {isolates} WHERE coalesce(food_origin, '~') NOT IN (SELECT coalesce(food_origin, '~') FROM {isolates} WHERE region IN ('ASIA', 'MIDDLE EAST'))")
def _(q):
    gone = q("isolates").where(F.col("region").isin("ASIA", "MIDDLE EAST")).select("food_origin")
    return relations.exclude(q("isolates").select("run", "food_origin"), gone, "food_origin")


@query("filter_by_ids", "J3", "SELECT run, false AS dropped FROM {isolates} WHERE run IN (SELECT run FROM {typing_a} WHERE call_a = 'Enteritidis') UNION ALL SELECT run, true FROM {isolates} WHERE run NOT IN (SELECT run FROM {typing_a} WHERE call_a = 'Enteritidis')")
def _(q):
    ids = q("typing_a").where("call_a = 'Enteritidis'")
    d = q("isolates").select("run")
    return relations.union_all(relations.filter_by_ids(d, ids, "run").withColumn("dropped", F.lit(False)),
                               relations.filter_by_ids(d, ids, "run", keep=False).withColumn("dropped", F.lit(True)))


@query("left_join_1to1", "J4", "SELECT run, round(fold_coverage, 6) AS fold_coverage FROM {isolates} LEFT JOIN {coverage_report} USING (run)")
def _(q):
    return rounded(relations.left_join_1to1(q("isolates").select("run"), q("coverage_report"), "run"), "fold_coverage")


@query("compare_on_key", "J5", "SELECT a.run, a.run AS run_check, call_a, call_b FROM {typing_a} a JOIN {typing_b} b ON a.run = b.run")
def _(q):
    d = relations.compare_on_key(q("typing_a").withColumnRenamed("call_a", "call"), q("typing_b").withColumnRenamed("call_b", "call"), "run")
    return d.select("run", F.col("run").alias("run_check"), "call_a", "call_b")


@query("compare_counts", "J6", """
WITH a AS (SELECT isolation_source AS k, count(*) AS n FROM {isolates} WHERE status <> 'P' GROUP BY 1), b AS (SELECT isolation_source AS k, count(*) AS n FROM {isolates} WHERE status <> 'F' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS isolation_source, coalesce(a.n, 0) AS old_n, coalesce(b.n, 0) AS new_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS difference FROM a FULL JOIN b ON a.k = b.k""")
def _(q):
    i = q("isolates")
    return relations.compare_counts(reports.counts(i.where("status <> 'P'"), "isolation_source"), reports.counts(i.where("status <> 'F'"), "isolation_source"), "isolation_source")


@query("merge_audited", "J7", """
SELECT i.run, i.isolate, i.status, CASE WHEN i.status = 'F' THEN 'Included' ELSE 'Excluded' END AS final_phylogeny, CASE WHEN i.status = 'F' THEN g.lineage END AS clade
FROM {isolates} i JOIN {groups} g ON 'SRR' || CAST(i.cust AS VARCHAR) = g.sample""")
def _(q):
    meta = q("isolates").select("run", "isolate", "status", F.concat(F.lit("SRR"), F.col("cust").cast("string")).alias("sample"))
    audit = q("isolates").select("run", "isolate", F.when(F.col("status") == "F", F.lit("Included")).otherwise(F.lit("Excluded")).alias("final_phylogeny"))
    labels = q("groups").select("sample", "lineage")
    rules = [(F.col("final_phylogeny").isin("Included", "Excluded"), "unknown phylogeny state"),
             ((F.col("final_phylogeny") == "Included") == (F.col("status") == "F"), "state and call disagree"), (F.col("lineage").isNotNull(), "sample without label")]
    d = relations.merge_audited(meta, audit, labels, ["run", "isolate"], rules, "sample", ["final_phylogeny", "lineage"])
    return d.select("run", "isolate", "status", "final_phylogeny", F.when(F.col("final_phylogeny") == "Included", F.col("lineage")).alias("clade"))


@query("flag_in_interval", "J8", """
SELECT v.sample, v.pos, v.ref, v.alt, v.gene, count(*) AS copies, bool_or(EXISTS (SELECT 1 FROM {intervals} i WHERE i.sample = v.sample AND v.pos BETWEEN i.start_pos AND i.end_pos)) AS masked
FROM {variants} v GROUP BY ALL""")
def _(q):
    v = q("variants").select("sample", "pos", "ref", "alt", "gene")
    d = relations.flag_in_interval(v, q("intervals"), "sample", "pos", "start_pos", "end_pos")
    return d.groupBy("sample", "pos", "ref", "alt", "gene", "masked").agg(F.count(F.lit(1)).alias("copies"))


@query("flag_members", "J9", "SELECT run, run IN (SELECT run FROM {o_flags} WHERE analyzed) AS in_tree FROM {isolates}")
def _(q):
    return relations.flag_members(q("isolates").select("run"), q.flagged.where("analyzed"), "run", "in_tree")


@query("lookup_priority", "J10", """
WITH k AS (SELECT 1 AS prio, lower(p_brand) AS k, p_partkey, p_name, p_brand, p_type FROM {part} UNION ALL SELECT 2, lower(p_name), p_partkey, p_name, p_brand, p_type FROM {part} UNION ALL SELECT 3, lower(p_type), p_partkey, p_name, p_brand, p_type FROM {part}),
qs AS (SELECT DISTINCT gene AS query FROM {variants} UNION SELECT DISTINCT symbol FROM {hits} UNION SELECT DISTINCT upper(type) FROM {hits}),
h AS (SELECT query, prio, p_partkey, p_name, row_number() OVER (PARTITION BY query ORDER BY prio, p_partkey) AS r FROM qs JOIN k ON lower(query) = k.k),
d AS (SELECT query, prio, p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY query) AS u FROM h WHERE r = 1)
SELECT CAST(p_partkey AS VARCHAR) AS resolved_id, query, CAST(prio AS INT) AS match_rank FROM d WHERE u = 1""")
def _(q):
    ref = q("part").select("p_partkey", "p_name", "p_brand", "p_type")
    qs = relations.union_all(q("variants").select(F.col("gene").alias("query")), q("hits").select(F.col("symbol").alias("query")), q("hits").select(F.upper("type").alias("query")))
    return relations.lookup_priority(qs, ref, "query", ["p_brand", "p_name", "p_type"], ["p_partkey"]).select("resolved_id", "query", "match_rank")


@query("pick_first_source", "J11", """
SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'N/A' WHEN p_brand < 'Brand#2' THEN 'reference' WHEN p_type <> 'PROMO' THEN 'rescued' ELSE 'N/A' END AS value_source,
 CASE WHEN p_size <= 5 THEN 'blank' WHEN p_brand < 'Brand#2' THEN 'matched_reference' WHEN p_type <> 'PROMO' THEN 'rescued_representative' ELSE 'not_found' END AS value_status,
 CASE WHEN p_size <= 5 THEN 'N/A' WHEN p_brand < 'Brand#2' THEN 'ref ' || p_name WHEN p_type <> 'PROMO' THEN 'alt ' || p_name ELSE 'N/A' END AS value FROM {part}""")
def _(q):
    p = q("part")
    ref = p.where("p_brand < 'Brand#2'").select("p_partkey", F.concat(F.lit("ref "), "p_name").alias("v"))
    alt = p.where("p_type <> 'PROMO'").select("p_partkey", F.concat(F.lit("alt "), "p_name").alias("v"))
    d = relations.pick_first_source(p.select("p_partkey", "p_size"), ref, alt, "p_partkey", "v", blank=F.col("p_size") <= 5)
    return d.drop("p_size")


@query("enrich", "J12", """
SELECT l_orderkey, l_linenumber, p_brand AS description FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""")
def _(q):
    info = q("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("description"))
    return relations.enrich(q("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), relations.union_all(info, info), "l_partkey").drop("l_partkey")


@query("group_pairs", "J13", "SELECT DISTINCT a.lineage AS group1, b.lineage AS group2 FROM {groups} a, (SELECT DISTINCT lineage FROM {groups}) b WHERE a.lineage < b.lineage")
def _(q):
    return relations.group_pairs(q("groups"), "lineage")


_DIST = """
d AS (SELECT a.c_custkey AS x, b.c_custkey AS y, CASE WHEN a.c_custkey = b.c_custkey THEN 0
  WHEN a.c_nationkey = b.c_nationkey THEN floor(abs(a.c_acctbal) / 100) + floor(abs(b.c_acctbal) / 100)
  WHEN na.n_regionkey = nb.n_regionkey THEN floor(abs(a.c_acctbal) / 100) + floor(abs(b.c_acctbal) / 100) + na.n_nationkey + nb.n_nationkey + 4
  ELSE floor(abs(a.c_acctbal) / 100) + floor(abs(b.c_acctbal) / 100) + na.n_nationkey + nb.n_nationkey + 4 + na.n_regionkey + nb.n_regionkey + 2 END AS dist, na.n_regionkey AS rx
 FROM PAIRS JOIN {nation} na ON a.c_nationkey = na.n_nationkey JOIN {nation} nb ON b.c_nationkey = nb.n_nationkey)"""


@query("pairwise_tree_distance", "J14", "WITH " + _DIST.replace("PAIRS", "{orders} JOIN {customer} a ON a.c_custkey = o_custkey JOIN (SELECT c_custkey + 1 AS k, * FROM {customer}) b ON a.c_custkey = b.k")
       + " SELECT DISTINCT 'SRR' || CAST(x AS VARCHAR) AS a, 'SRR' || CAST(y AS VARCHAR) AS b, CAST(dist AS DOUBLE) AS distance FROM d")
def _(q):
    paths = tree.tree_index(q("tree_edges"))
    pairs = q("orders").select(F.concat(F.lit("SRR"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("SRR"), (F.col("o_custkey") - 1).cast("string")).alias("b")).where("a <> 'SRR0'")
    return tree.pairwise_tree_distance(paths, pairs)


@query("distance_summary", "G45", "WITH " + _DIST.replace("PAIRS", "{customer} a JOIN {customer} b ON a.c_custkey < b.c_custkey")
       + """, m AS (SELECT sample, lineage FROM {groups}), w AS (SELECT ma.lineage, dist FROM d JOIN m ma ON ma.sample = 'SRR' || CAST(x AS VARCHAR) JOIN m mb ON mb.sample = 'SRR' || CAST(y AS VARCHAR) WHERE ma.lineage = mb.lineage)
SELECT lineage, (SELECT count(*) FROM m WHERE m.lineage = w.lineage) AS n_tips, count(*) AS n_pairs, CAST(min(dist) AS BIGINT) AS min_distance, median(dist) AS median_distance, CAST(max(dist) AS BIGINT) AS max_distance FROM w GROUP BY lineage""")
def _(q):
    paths = tree.ancestor_paths(q("tree_edges"))
    return tree.distance_summary(paths, q("groups").select(F.col("sample").alias("tip"), "lineage"), "lineage")


_REAL = _DIST.replace("floor(abs(a.c_acctbal) / 100)", "abs(a.c_acctbal) / 97").replace("floor(abs(b.c_acctbal) / 100)", "abs(b.c_acctbal) / 97")


@query("distance_order_summary", "G45", "WITH " + _REAL.replace("PAIRS", "{customer} a JOIN {customer} b ON a.c_custkey < b.c_custkey")
       + """, m AS (SELECT sample, lineage FROM {groups}), w AS (SELECT ma.lineage, dist FROM d JOIN m ma ON ma.sample = 'SRR' || CAST(x AS VARCHAR) JOIN m mb ON mb.sample = 'SRR' || CAST(y AS VARCHAR) WHERE ma.lineage = mb.lineage)
SELECT lineage, (SELECT count(*) FROM m WHERE m.lineage = w.lineage) AS n_tips, count(*) AS n_pairs, round(min(dist), 6) AS min_distance, round(median(dist), 6) AS median_distance, round(max(dist), 6) AS max_distance FROM w GROUP BY lineage""")
def _(q):
    """The tree of the samples with real branch lengths."""
    c = q("customer").select(F.concat(F.lit("SRR"), F.col("c_custkey").cast("string")).alias("child"), (F.abs("c_acctbal") / 97).alias("real"))
    edges = q("tree_edges").join(c, "child", "left").select("child", "parent", F.coalesce("real", F.col("length").cast("double")).alias("length"))
    found = tree.distance_order_summary(tree.tree_index(edges), q("groups").select(F.col("sample").alias("tip"), "lineage"), "lineage")
    return rounded(found, "min_distance", "median_distance", "max_distance")


@query("with_denominator", "J15", """
SELECT m.segment, m.marker, m.n, d.n_total, round(100.0 * m.n / d.n_total, 6) AS pct FROM (SELECT segment, marker, count(*) AS n FROM {o_markers} GROUP BY ALL) m JOIN (SELECT segment, count(*) AS n_total FROM {isolates} GROUP BY 1) d USING (segment)""")
def _(q):
    c = reports.counts(q.cohort.select("segment", F.explode("markers").alias("marker")), ["segment", "marker"])
    return rounded(relations.with_denominator(c, q("isolates"), "segment"), "pct")


# --- set operations --------------------------------------------------------------------------


@query("union_all", "U1", "SELECT run, call_a, NULL::VARCHAR AS call_b FROM {typing_a} UNION ALL SELECT run, NULL, call_b FROM {typing_b}")
def _(q):
    return relations.union_all(q("typing_a"), q("typing_b"))


@query("distinct_by", "U2", "SELECT o_custkey, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM {orders} GROUP BY 1")
def _(q):
    return relations.distinct_by(q("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate"])


@query("compare_sets", "U3", """
WITH a AS (SELECT DISTINCT run FROM {typing_a}), b AS (SELECT DISTINCT run FROM {typing_b})
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a WHERE run IN (FROM b)) AS n_both, (SELECT count(*) FROM a WHERE run NOT IN (FROM b)) AS only_a,
 (SELECT count(*) FROM b WHERE run NOT IN (FROM a)) AS only_b, false AS equal, false AS a_in_b""")
def _(q):
    return relations.compare_sets(q("typing_a"), q("typing_b"), "run")


@query("label_by_precedence", "U4", """
SELECT sample, CASE WHEN source = 'BUILDING' AND lineage IN ('Clade 1A', 'Clade 1B') THEN 'Sub B' WHEN lineage IN ('Clade 1A', 'Clade 1B') THEN 'Sub A' WHEN lineage = 'Clade 2' OR source = 'BUILDING' THEN 'Two' ELSE 'Unassigned' END AS label FROM {groups}""")
def _(q):
    g = q("groups")
    one = g.where(F.col("lineage").isin("Clade 1A", "Clade 1B"))
    sub = one.where("source = 'BUILDING'")
    sets = [("Sub B", sub), ("Sub A", relations.exclude(one, sub, "sample")), ("Two", g.where("lineage = 'Clade 2' OR source = 'BUILDING'"))]
    return relations.label_by_precedence(g.select("sample"), sets, "sample", "Unassigned")


# --- windows ---------------------------------------------------------------------------------


@query("with_share", "W1", "SELECT p_brand, p_type, n, CAST(sum(n) OVER (PARTITION BY p_brand) AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (PARTITION BY p_brand), 6) AS pct FROM (SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY ALL)")
def _(q):
    return rounded(reports.with_share(reports.counts(q("part"), ["p_brand", "p_type"]), "p_brand"), "pct")


@query("best_per_key", "W2", """
SELECT sample, symbol, coverage, identity, name FROM (SELECT *, row_number() OVER (PARTITION BY sample, symbol ORDER BY coverage DESC, identity DESC, name) AS r FROM {hits}) WHERE r = 1""")
def _(q):
    h = q("hits").select("sample", "symbol", "coverage", "identity", "name")
    return ranking.best_per_key(h, ["sample", "symbol"], [("coverage", False), ("identity", False)], ["name"])


@query("with_row_id", "W3", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS in_status FROM {orders}")
def _(q):
    o = q("orders").select("o_orderkey", "o_orderstatus")
    slot = F.floor(F.col("o_orderkey") / 65536)
    d = ranking.with_row_id(o, "o_orderkey", slot)
    return ranking.with_row_id(d, "o_orderkey", slot, "o_orderstatus", "in_status").drop("o_orderstatus")


@query("normalise", "W5", """
SELECT segment, marker, round(n / sum(n) OVER (PARTITION BY segment), 9) AS p FROM (SELECT segment, marker, count(*) AS n FROM {o_markers} GROUP BY ALL)""")
def _(q):
    c = reports.counts(q.cohort.select("segment", F.explode("markers").alias("marker")), ["segment", "marker"])
    return rounded(reports.normalise(c, "segment", "n"), "p", digits=9).select("segment", "marker", "p")


@query("find_duplicates", "W6", "SELECT o_orderkey, o_custkey, o_orderpriority FROM {orders} JOIN (SELECT o_custkey, o_orderpriority FROM {orders} GROUP BY ALL HAVING count(*) > 1) USING (o_custkey, o_orderpriority)")
def _(q):
    return relations.find_duplicates(q("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"])


# --- ordering and top-k ----------------------------------------------------------------------


@query("order_by_levels", "O1", "SELECT source, lineage, count(*) AS n, CAST(list_position(['HOUSEHOLD','BUILDING','FURNITURE'], source) AS INT) AS position FROM {groups} GROUP BY ALL")
def _(q):
    levels = ["HOUSEHOLD", "BUILDING", "FURNITURE"]
    c = reports.counts(q("groups"), ["source", "lineage"]).withColumn("position", ranking.level_index("source", levels))
    return ranking.order_by_levels(c, "source", levels, "lineage")


@query("top_k", "O2", "SELECT marker, count(*) AS n FROM {o_markers} GROUP BY 1 ORDER BY n DESC, marker LIMIT 5")
def _(q):
    return ranking.top_k(q.cohort.select(F.explode("markers").alias("marker")), "marker", 5)


@query("top_k_token_basis", "O2", f"SELECT tok AS token, count(*) AS n FROM {{o_tokens}} WHERE regexp_matches(lower(tok), '{CALL}') GROUP BY 1 ORDER BY n DESC, tok LIMIT 5")
def _(q):
    return ranking.top_k(q.cohort.select(F.explode("raw_markers").alias("token")), "token", 5)


@query("truncate", "O4", """
SELECT run, segment, status FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY status = 'F' DESC, price, run) AS r FROM {isolates}) WHERE r <= 40""")
def _(q):
    slot = F.when(F.col("status") == "F", 0).otherwise(1000) + F.floor(F.col("price") / 10000)
    order = [F.desc(F.col("status") == "F"), F.asc("price"), F.asc("run")]
    return ranking.truncate(q("isolates").select("run", "segment", "status", "price"), "segment", order, slot, 40).drop("price")


# --- samples and selections (hash order, so the check is on sizes) ----------------------------


@query("safe_sample", "T15", "SELECT segment, least(count(*), 400) AS n FROM {isolates} GROUP BY 1")
def _(q):
    return reports.counts(ranking.sample_up_to(q("isolates").select("run", "segment"), 400, "segment", "run", 7), "segment")


def _selection_input(q):
    c = q.cohort
    return c.where("year IS NOT NULL").select(F.col("run").alias("id"), "year", F.col("region").alias("source"), (F.size("markers") > 0).alias("positive"),
                    F.col("status").alias("pattern"), (F.col("segment") == "FURNITURE").alias("forced"))


def _plan(pool: int) -> dict:
    """Sizes of the plan in parts of the pool."""
    part = lambda x: max(1, pool * x // 1000)
    return {"total": part(400), "positive_share": 0.7, "early": {"before": 1997, "total": part(70), "targets": {"ASIA": part(35), "AFRICA": part(20), "EUROPE": part(15)}},
            "late": [{"name": "1997-1998", "lo": 1997, "hi": 1998, "targets": {"ASIA": part(14), "AFRICA": part(10)}},
                     {"name": "1999-2001", "lo": 1999, "hi": 2001, "targets": {"ASIA": part(20), "EUROPE": part(7)}}]}


@query("stratified_selection", "T16")
def _(q):
    pool = _selection_input(q)
    return resampling.stratified_selection(pool, _plan(pool.count())).select("id", "section", "year", "source", "positive")


# The units of room a stratum gives up or takes, one a step, always from the stratum with most room: all units by height.
@query("quota_selection", "T17", """
WITH s AS (SELECT region || ':' || status AS stratum, count(*) // 10 AS target, count(*) FILTER (n_markers > 0) AS pos, count(*) FILTER (n_markers = 0) AS neg FROM {o_packed} GROUP BY 1),
b AS (SELECT *, greatest(0, target - neg) AS low, least(target, pos) AS high, CAST(greatest(greatest(0, target - neg), least(least(target, pos), round_even(target * 0.8, 0))) AS BIGINT) AS own FROM s),
g AS (SELECT *, CAST(round_even(sum(target) OVER () * 0.8, 0) AS BIGINT) - CAST(sum(own) OVER () AS BIGINT) AS gap FROM b),
r AS (SELECT *, CASE WHEN gap >= 0 THEN high - own ELSE own - low END AS room FROM g),
u AS (SELECT stratum, abs(gap) AS steps, row_number() OVER (ORDER BY level DESC, stratum DESC) AS k FROM (SELECT stratum, gap, unnest(generate_series(1, room)) AS level FROM r)),
m AS (SELECT stratum, count(*) FILTER (k <= steps) AS moved FROM u GROUP BY 1)
SELECT stratum, target AS n, own + sign(gap) * coalesce(moved, 0) AS n_positive, CAST((SELECT sum(target) FROM r) AS BIGINT) AS n_all FROM r LEFT JOIN m USING (stratum)""")
def _(q):
    d = q.cohort.select(F.col("run").alias("id"), F.concat_ws(":", "region", "status").alias("stratum"), (F.size("markers") > 0).alias("positive"))
    targets = d.groupBy("stratum").agg(F.floor(F.count(F.lit(1)) / 10).alias("target"))
    picked = resampling.quota_selection(d, targets, "stratum", "positive").dropDuplicates(["id"])
    rows = picked.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("n_positive"))
    return rows.withColumn("n_all", F.sum("n").over(Window.partitionBy()))  # one row per stratum


# --- quality ---------------------------------------------------------------------------------


@query("status_lists", "G53", f"WITH {QC_SQL}" + """
SELECT 'cov_fail' AS list, run FROM fin WHERE cov = 'FAIL' UNION ALL SELECT 'cov_sa_fail', run FROM fin WHERE cov = 'FAIL' AND sa = 'FAIL' UNION ALL SELECT 'all_pass', run FROM fin WHERE cov = 'PASS' AND sa = 'PASS' AND sb = 'PASS'
UNION ALL SELECT 'any_missing', run FROM fin WHERE cov = 'MISSING' OR sa = 'MISSING' OR sb = 'MISSING' UNION ALL SELECT 'all_fail', run FROM fin WHERE cov = 'FAIL' AND sa = 'FAIL' AND sb = 'FAIL' UNION ALL SELECT 'sa_missing', run FROM fin WHERE sa = 'MISSING'""")
def _(q):
    lists = quality.standard_status_lists({k: F.col(k) for k in ("cov", "sa", "sb")})
    wanted = ("cov_fail", "cov_sa_fail", "all_pass", "any_missing", "all_fail", "sa_missing")
    return quality.status_lists(qc_table(q), "run", {k: lists[k] for k in wanted})
