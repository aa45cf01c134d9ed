"""How the entities of a surveillance cohort are derived from the supplied star-schema tables.

Each binding is one ANSI-SQL text that Spark and the SQL checker both accept, so a query and its
check start from the same rows while the operator logic is written twice, independently.
``{name}`` refers to a supplied table or to another binding.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

BINDINGS: dict[str, str] = {}

# Marker token reported for a line item, by part type and return flag (open lines only).
BINDINGS["marker_hits"] = """
SELECT DISTINCT l.l_orderkey AS order_id,
       CASE WHEN l.l_linestatus = 'F' THEN 'mdsA' ELSE m.tok END AS tok,
       CASE WHEN l.l_linestatus = 'F' THEN 'COMPLETE' ELSE m.kind END AS kind
FROM {lineitem} l
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN (VALUES
  ('ECONOMY','R','gyrA_D87Y','POINT'), ('ECONOMY','A','gyrA_D87N','POINT'), ('ECONOMY','N','blaTEM-1','COMPLETE'),
  ('MEDIUM','R','gyrA_S83Y','POINT'), ('MEDIUM','A','qnrB19','COMPLETE'), ('MEDIUM','N','tet(A)','COMPLETE'),
  ('LARGE','R','gyrA_D87G','POINT'), ('LARGE','A','parC_S80I','POINT'), ('LARGE','N','sul1','COMPLETE'),
  ('PROMO','R','aac(6'')-Ib-cr','COMPLETE'), ('PROMO','A','oqxA','COMPLETE'), ('PROMO','N','floR','COMPLETE'),
  ('SMALL','R','acrB_R717L','POINT'), ('SMALL','A','qnrS1','COMPLETE'), ('SMALL','N','GyrA_D87Y','POINT'),
  ('STANDARD','R','soxS_E52K','POINT'), ('STANDARD','A','tolC','COMPLETE'), ('STANDARD','N','mdsB','COMPLETE')
) AS m(ptype, flag, tok, kind) ON p.p_type = m.ptype AND l.l_returnflag = m.flag
"""

# One row per isolate (= order) with the free-text fields the classifiers read.
BINDINGS["isolates"] = """
SELECT 'SRR' || CAST(o.o_orderkey AS STRING) AS run,
       'PDT' || CAST(o.o_orderkey AS STRING) AS isolate,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'FDA' ELSE 'CDC' END || CAST(o.o_custkey AS STRING) AS strain,
       CASE WHEN o.o_orderpriority = '2-HIGH' THEN 'CFSAN ' || CAST(o.o_orderkey AS STRING)
            WHEN o.o_orderpriority = '3-MEDIUM' THEN 'fda-' || CAST(o.o_orderkey AS STRING) ELSE NULL END AS isolate_identifiers,
       CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL
            WHEN o.o_orderpriority = '1-URGENT' THEN CAST(year(o.o_orderdate) AS STRING) || '_' || lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0') || '_' || lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0')
            WHEN o.o_orderpriority = '2-HIGH' THEN CAST(year(o.o_orderdate) AS STRING)
            WHEN o.o_orderpriority = '3-MEDIUM' THEN CAST(month(o.o_orderdate) AS STRING) || '/' || CAST(day(o.o_orderdate) AS STRING) || '/' || CAST(year(o.o_orderdate) AS STRING)
            ELSE 'about  ' || CAST(year(o.o_orderdate) AS STRING) || ' autumn' END AS collection_date,
       CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE CAST(year(o.o_orderdate) AS INT) END AS year,
       CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Human' WHEN c.c_mktsegment = 'BUILDING' THEN 'clinical (human)'
            ELSE 'environmental/other' END AS source_type,
       t.txt AS isolation_source,
       CASE WHEN c.c_mktsegment = 'MACHINERY' AND o.o_orderstatus = 'P' THEN 'Gallus chicken' ELSE NULL END AS host,
       CASE WHEN c.c_mktsegment = 'FURNITURE' AND o.o_orderstatus = 'P' THEN 'Chicken' ELSE NULL END AS ifsac_category,
       CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'CDC lab' ELSE 'FDA' END AS collected_by,
       CASE WHEN r.r_name = 'AMERICA' THEN 'United  States' WHEN r.r_name = 'ASIA' THEN 'Viet Nam'
            WHEN r.r_name = 'EUROPE' THEN 'USA' WHEN r.r_name = 'AFRICA' THEN '' ELSE NULL END AS food_origin,
       c.c_mktsegment AS segment, r.r_name AS region,
       o.o_orderstatus AS status, o.o_orderpriority AS priority, o.o_totalprice AS price,
       o.o_custkey AS cust, o.o_orderkey AS order_id
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (VALUES
  ('AUTOMOBILE','F','Chicken  breast'), ('AUTOMOBILE','O','chickenthigh, raw'), ('AUTOMOBILE','P','chcken product'),
  ('BUILDING','F','stool'), ('BUILDING','O','blood'), ('BUILDING','P','urine'),
  ('FURNITURE','F','raw shrimp, frozen'), ('FURNITURE','O','imitation crab meat'), ('FURNITURE','P','Bovine ground beef'),
  ('HOUSEHOLD','F','clinical'), ('HOUSEHOLD','O','egg yolks'), ('HOUSEHOLD','P','hatchery drag swab'),
  ('MACHINERY','F','guinea pig'), ('MACHINERY','O','Cheese roll cake'), ('MACHINERY','P','pork chop')
) AS t(seg, st, txt) ON c.c_mktsegment = t.seg AND o.o_orderstatus = t.st
"""

# Group labels per sample (= customer).
BINDINGS["groups"] = """
SELECT 'SRR' || CAST(c.c_custkey AS STRING) AS sample,
       CASE r.r_name WHEN 'AFRICA' THEN 'Clade 1A' WHEN 'AMERICA' THEN 'Clade 1B' WHEN 'ASIA' THEN 'Clade 2'
            WHEN 'EUROPE' THEN 'Clade 3' ELSE 'Unassigned' END AS lineage,
       c.c_mktsegment AS source
FROM {customer} c
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

# Variant calls: one family from line items, one tied to the customer's region.
BINDINGS["variants"] = """
SELECT 'SRR' || CAST(o.o_custkey AS STRING) AS sample,
       CAST(substr(p.p_brand, 7) AS INT) * 100 + p.p_size AS pos,
       l.l_returnflag AS ref, l.l_linestatus AS alt,
       CASE WHEN p.p_size <= 10 THEN 'intergenic' WHEN p.p_size <= 20 THEN 'hypothetical protein'
            ELSE lower(p.p_brand) END AS gene,
       CASE WHEN p.p_size <= 10 THEN 'intergenic_region' WHEN p.p_size <= 25 THEN 'synonymous_variant'
            WHEN p.p_size <= 45 THEN 'missense_variant' ELSE 'stop_gained' END AS effect
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {part} p ON l.l_partkey = p.p_partkey
UNION ALL
SELECT 'SRR' || CAST(o.o_custkey AS STRING) AS sample,
       10000 + n.n_regionkey * 100 + CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS pos,
       v.ref, v.alt,
       'gene' || substr(o.o_orderpriority, 1, 1) || lower(v.ref) AS gene,
       CASE WHEN v.ref = 'T' THEN 'missense_variant' WHEN o.o_orderstatus = 'F' THEN 'stop_gained'
            WHEN o.o_orderstatus = 'O' THEN 'missense_variant' ELSE 'synonymous_variant' END AS effect
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN (VALUES ('F','F','G'), ('O','O','G'), ('P','P','G'), ('F','T','A'), ('O','T','A'), ('P','T','A')) AS v(st, ref, alt)
  ON o.o_orderstatus = v.st
"""

# Masked intervals per sample.
BINDINGS["intervals"] = """
SELECT 'SRR' || CAST(o_custkey AS STRING) AS sample,
       CAST(floor(o_totalprice / 200) AS INT) AS start_pos,
       CAST(floor(o_totalprice / 200) AS INT) + 40 AS end_pos
FROM {orders} WHERE o_orderstatus = 'P'
"""

# Screening hits with coverage and identity; the second family depends on the region.
BINDINGS["hits"] = """
SELECT 'SRR' || CAST(o.o_custkey AS STRING) AS sample, p.p_name AS symbol, p.p_type AS type, p.p_brand AS name,
       50.0 + l.l_quantity AS coverage, 100.0 - l.l_discount * 200 AS identity
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {part} p ON l.l_partkey = p.p_partkey
UNION ALL
SELECT 'SRR' || CAST(o.o_custkey AS STRING) AS sample, 'el' || substr(o.o_orderpriority, 1, 1) || o.o_orderstatus AS symbol,
       'STRESS' AS type, 'element ' || o.o_orderstatus AS name,
       CAST(65 + 5 * n.n_regionkey AS DOUBLE) + o.o_totalprice / 25000 AS coverage, CAST(95 AS DOUBLE) AS identity
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

# Gene presence, long form (one row per gene and sample).
BINDINGS["presence"] = """
SELECT DISTINCT 'SRR' || CAST(o.o_custkey AS STRING) AS sample, p.p_brand || '_' || p.p_type AS gene
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {part} p ON l.l_partkey = p.p_partkey
UNION
SELECT DISTINCT 'SRR' || CAST(o.o_custkey AS STRING) AS sample, 'status_' || o.o_orderstatus AS gene FROM {orders} o
UNION
SELECT DISTINCT 'SRR' || CAST(o.o_custkey AS STRING) AS sample,
       'reg' || CAST(n.n_regionkey AS STRING) || '_' || substr(o.o_orderpriority, 1, 1) AS gene
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

# Three quality criteria per run; each report misses some runs.
BINDINGS["coverage_report"] = """
SELECT 'SRR' || CAST(o_orderkey AS STRING) AS run, o_totalprice / 10000 AS fold_coverage
FROM {orders} WHERE o_orderpriority <> '5-LOW'
"""
BINDINGS["typing_a"] = """
SELECT 'SRR' || CAST(o_orderkey AS STRING) AS run,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Typhimurium' ELSE 'Enteritidis' END AS call_a
FROM {orders} WHERE o_orderstatus <> 'P'
"""
BINDINGS["typing_b"] = """
SELECT 'SRR' || CAST(o.o_orderkey AS STRING) AS run,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Dublin' WHEN 'MACHINERY' THEN 'Gallinarum or Enteritidis'
            ELSE 'Enteritidis' END AS call_b
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus <> 'O'
"""

# Tree: root -> region -> nation -> customer -> order, integer edge lengths.
BINDINGS["tree_edges"] = """
SELECT 'reg' || CAST(r_regionkey AS STRING) AS child, 'root' AS parent, CAST(r_regionkey + 1 AS BIGINT) AS length FROM {region}
UNION ALL
SELECT 'nat' || CAST(n_nationkey AS STRING), 'reg' || CAST(n_regionkey AS STRING), CAST(n_nationkey + 2 AS BIGINT) FROM {nation}
UNION ALL
SELECT 'SRR' || CAST(c_custkey AS STRING), 'nat' || CAST(c_nationkey AS STRING),
       CAST(floor(abs(c_acctbal) / 100) AS BIGINT) FROM {customer}
"""

# Counts of tested and resistant units by year and source.
BINDINGS["phenotype"] = """
SELECT CAST(year(l_shipdate) AS INT) AS year, l_linestatus AS source,
       sum(CASE WHEN l_returnflag = 'R' AND l_quantity <= 20 THEN 1 ELSE 0 END) AS cip_resistant,
       count(*) AS cip_tested,
       sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 20 THEN 1 ELSE 0 END) AS dsc_resistant,
       count(*) AS dsc_tested
FROM {lineitem} GROUP BY year(l_shipdate), l_linestatus
"""

_REF = re.compile(r"\{([a-z_]\w*)\}")

# Rendered per dialect: the marker list packed into one text field per isolate.
_PACKED = {
    "spark": "array_join(array_sort(collect_set(tok || '=' || kind)), ',')",
    "duck": "string_agg(DISTINCT tok || '=' || kind, ',' ORDER BY tok || '=' || kind)",
}
_PACKED_ISOLATES = """
SELECT i.*, a.amr FROM {isolates} i LEFT JOIN
(SELECT order_id AS oid, PACKED AS amr FROM {marker_hits} GROUP BY order_id) a ON i.order_id = a.oid
"""
BINDINGS["cohort"] = _PACKED_ISOLATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The DataFrame of a binding (or of a supplied table)."""
    if name not in BINDINGS:
        return table(spark, sf_dir, name)
    text = BINDINGS[name].replace("PACKED", _PACKED["spark"])
    refs = dict.fromkeys(_REF.findall(text))
    return spark.sql(text, **{ref: bind(spark, sf_dir, ref) for ref in refs})


def oracle(text: str) -> str:
    """Render a check query: prepend the bindings it refers to as common table expressions."""
    needed: dict[str, str] = {}

    def visit(body: str) -> None:
        for ref in dict.fromkeys(_REF.findall(body)):
            if ref in BINDINGS and ref not in needed:
                visit(BINDINGS[ref])
                needed[ref] = _REF.sub(r"\1", BINDINGS[ref].replace("PACKED", _PACKED["duck"]))

    visit(text)
    body = _REF.sub(r"\1", text).strip()
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in needed.items())
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE CTES"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE CTES'):]}"
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
