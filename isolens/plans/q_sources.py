"""Queries over sources and sinks.  Text files are derived from the tables, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence
from ..operators import quality, relations
from ..session import scratch_folder
from ..sources import formats, sinks, tables
from .registry import query


def _folder(q, name: str) -> str:
    return scratch_folder(q.spark, name)


def _files(q, lines, head=(), by: str = "part", rows: int = 20_000) -> str:
    """Path of files made of ``lines`` (value, line_no): each file has ``head`` as its first lines and some ``rows`` numbers of those that follow, in order."""
    path = _folder(q, "files")
    d = lines.select("value", "line_no", F.lpad(F.floor(F.col("line_no") / rows).cast("string"), 12, "0").alias("part"))
    top = d.select("part").distinct().select(F.posexplode(F.array(*[F.lit(h) for h in head])).alias("line_no", "value"), "part") if head else None
    if top is not None:
        d = d.unionByName(top.select("value", (F.col("line_no") - F.lit(1 << 40)).alias("line_no"), "part"))
    d.repartition("part").sortWithinPartitions("part", "line_no").select("value", F.col("part").alias(by)).write.partitionBy(by).text(path)
    return f"{path}/*/*.txt"


@query("read_master", "S1", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', "' || c_mktsegment || '"' AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM {customer}""")
def _(q):
    c = q("customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("c_name"), "c_nationkey", "c_mktsegment")
    path = _folder(q, "master")
    c.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return tables.read_master(q.spark, path, q("customer").count(), 4, ["c_custkey"])


_REPAIRS = ((',""Brand', ',"Brand'),)


def _dirty_lines(q):
    """Names with an escaped comma, and a doubled quote where the size is small; every tenth line repeats the header."""
    p = q("part")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("\\, "))
    quote = F.when(F.col("p_size") <= 5, F.lit('""')).otherwise(F.lit('"'))
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), name, F.lit('",'), quote, "p_brand", F.lit('"'))
    return p.select(F.when(F.col("p_partkey") % 10 == 3, F.lit(_DIRTY_HEAD)).otherwise(line).alias("value"), F.col("p_partkey").alias("line_no"))


_DIRTY_HEAD = "id,name,brand"


@query("read_repaired_csv", "S2", """
SELECT CAST(p_partkey AS VARCHAR) AS id, replace(p_name, ' ', ', ') AS name, p_brand AS brand,
       CAST(length(p_name) - length(replace(p_name, ' ', '')) AS INT) AS n_escaped, CASE WHEN p_size <= 5 THEN 1 ELSE 0 END AS n_repaired
FROM {part} WHERE p_partkey % 10 <> 3
UNION ALL SELECT 'id', 'name', 'brand', 0, 0 FROM {part} WHERE p_partkey % 10 = 3""")
def _(q):
    return tables.read_repaired_csv(q.spark, _files(q, _dirty_lines(q), [_DIRTY_HEAD]), _REPAIRS)


@query("repair_delta", "S3", r"""
SELECT p_partkey, 'p_name' AS field, replace(p_name, ' ', '\, ') AS before, replace(p_name, ' ', ', ') AS after,
       'field_value_changed_by_normalization' AS reason FROM {part} WHERE strpos(p_name, ' ') > 0
UNION ALL
SELECT p_partkey, 'p_brand', '"' || p_brand, p_brand, 'field_value_changed_by_normalization' FROM {part} WHERE p_size <= 5""")
def _(q):
    p = q("part")
    raw = p.select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit("\\, ")).alias("p_name"),
                   F.when(F.col("p_size") <= 5, F.concat(F.lit('"'), "p_brand")).otherwise(F.col("p_brand")).alias("p_brand"))
    fixed = p.select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")).alias("p_name"), "p_brand")
    return quality.repair_delta(raw, fixed, "p_partkey", ["p_name", "p_brand"])


@query("read_table", "S4", "SELECT s_suppkey, s_name, s_acctbal FROM {supplier}")
def _(q):
    lines = q("supplier").select(F.concat_ws("\t", "s_suppkey", "s_name", "s_acctbal").alias("value"))
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_acctbal", T.DoubleType())])
    return tables.parse_lines(lines, schema, sep="\t", placeholder=None)


def _ragged(q):
    """Rows of three fields, of four where the size is large, and copies of the header."""
    extra = F.when(F.col("p_size") > 45, F.lit("x"))
    line = F.when(F.col("p_partkey") % 10 == 3, F.lit("id\tname\ttype")).otherwise(F.concat_ws("\t", "p_partkey", "p_name", "p_type", extra))
    lines = q("part").select(line.alias("value"), F.col("p_partkey").alias("line_no"))
    return tables.read_tsv_tolerant(q.spark, _files(q, lines, ["id\tname\ttype"]))


@query("read_tsv_tolerant", "S5", """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS type FROM {part} WHERE p_size <= 45 AND p_partkey % 10 <> 3
UNION ALL SELECT 'id', 'name', 'type' FROM {part} WHERE p_partkey % 10 = 3""")
def _(q):
    return _ragged(q)[0]


@query("ragged_bad_lines", "S5", """
SELECT CAST(p_partkey AS VARCHAR) || chr(9) || p_name || chr(9) || p_type || chr(9) || 'x' AS value,
       row_number() OVER (PARTITION BY p_partkey // 20000 ORDER BY p_partkey) AS line_no, 4 AS fields, 3 AS expected
FROM {part} QUALIFY p_size > 45 AND p_partkey % 10 <> 3""")
def _(q):
    return _ragged(q)[1].drop("path")


@query("drop_noise_rows", "S6", "SELECT s_name AS name FROM {supplier} WHERE s_nationkey > 8")
def _(q):
    name = F.when(F.col("s_nationkey") <= 4, F.concat(F.lit("==> "), "s_name", F.lit(" <=="))).when(
        F.col("s_nationkey") <= 8, F.concat(F.lit("_SMOKE_"), "s_name")).otherwise(F.col("s_name"))
    return tables.drop_noise_rows(q("supplier").select(name.alias("name")), "name")


@query("read_reports", "S7", """
SELECT 'SRR' || CAST(c_nationkey AS VARCHAR) AS sample, CAST(c_custkey AS VARCHAR) AS gene, c_mktsegment AS product FROM {customer}""")
def _(q):
    """One report folder for each nation, each with its own headers; the manifest lists all nations that have a customer."""
    c = q("customer")
    name = F.concat(F.lit("SRR"), F.col("c_nationkey").cast("string"))
    path = _folder(q, "reports")
    rows = c.select(F.concat(name, F.lit("_vfdb")).alias("report"), F.col("c_custkey").alias("gene"), F.col("c_mktsegment").alias("product"))
    rows.hint("rebalance", "report").write.partitionBy("report").option("header", True).option("sep", "\t").csv(path)
    return tables.read_reports(q.spark, f"{path}/*/*.csv", c.select(name.alias("sample")).distinct(), level=-2)


@query("missing_reports", "S7", """
SELECT 'SRR' || CAST(c_custkey AS VARCHAR) AS sample FROM {customer}
WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT')""")
def _(q):
    manifest = q("customer").select(F.concat(F.lit("SRR"), F.col("c_custkey").cast("string")).alias("sample"))
    have = q("orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("SRR"), F.col("o_custkey").cast("string")).alias("sample"))
    return tables.missing_reports(have, manifest)


def _vcf_lines(q):
    """Variant lines: annotated, without annotation, comment and short lines, by line number."""
    j = q("lineitem").join(q("part"), F.col("l_partkey") == F.col("p_partkey"))
    ann = F.concat(F.lit("DP=10;ANN="), "l_returnflag", F.lit("|"), F.when(F.col("p_size") > 25, F.lit("missense_variant")).otherwise(F.lit("stop_gained")),
                   F.lit("|MODERATE|"), F.when(F.col("p_size") <= 20, F.lower("p_type")).otherwise(F.lit("")), F.lit("|"),
                   F.when(F.col("p_size") <= 35, F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))).otherwise(F.lit("")),
                   F.lit("|t|x|y|1/1|c.1A>G|"), F.when(F.col("l_linestatus") == "O", F.lit("p.Asp87Tyr")).otherwise(F.lit("")),
                   F.lit("|1,T|other|HIGH|zzz|q;END=1"))
    info = F.when(F.col("l_linenumber") == 1, F.lit("DP=3")).otherwise(ann)
    line = F.concat_ws("\t", F.lit("chr1"), F.col("p_size") * 10, F.lit("."), "l_returnflag", "l_linestatus", F.lit("50"), F.lit("PASS"), info, F.lit("GT"))
    line = F.when(F.col("l_linenumber") == 2, F.concat(F.lit("##"), line)).when(F.col("l_linenumber") == 3, F.lit("chr1\t5\t.\tA")).otherwise(line)
    path = F.concat(F.lit("/data/SRR"), F.col("l_orderkey").cast("string"), F.lit("/snps.annotated.vcf"))
    return j.select(line.alias("value"), formats.parent_folder(path).alias("sample"))


@query("read_vcf", "S8", """
SELECT 'SRR' || CAST(l_suppkey % 40 AS VARCHAR) AS sample, CAST(l_partkey % 5000 AS INT) AS pos, l_returnflag AS ref, l_linestatus AS alt, 'DP=' || CAST(l_linenumber AS VARCHAR) AS info
FROM {lineitem} WHERE l_linenumber NOT IN (2, 3)""")
def _(q):
    """One folder of variant files for each of 40 samples, with comment lines and short lines."""
    line = F.concat_ws("\t", F.lit("chr1"), F.col("l_partkey") % 5000, F.lit("."), "l_returnflag", "l_linestatus", F.lit("50"), F.lit("PASS"), F.concat(F.lit("DP="), "l_linenumber"), F.lit("GT"))
    line = F.when(F.col("l_linenumber") == 2, F.concat(F.lit("##"), line)).when(F.col("l_linenumber") == 3, F.lit("chr1\t5\t.\tA")).otherwise(line)
    path = _folder(q, "variants")
    rows = q("lineitem").select(line.alias("value"), F.concat(F.lit("SRR"), (F.col("l_suppkey") % 40).cast("string")).alias("sample"))
    rows.hint("rebalance", "sample").write.partitionBy("sample").text(path)
    return formats.read_vcf(q.spark, f"{path}/*/*.txt")


@query("parse_ann", "S9", """
SELECT 'SRR' || CAST(l_orderkey AS VARCHAR) AS sample, CAST(p_size * 10 AS INT) AS pos,
       CASE WHEN l_linenumber = 1 THEN 'unannotated' WHEN p_size <= 20 THEN lower(p_type)
            WHEN p_size <= 35 THEN lower(replace(p_brand, '#', '_')) ELSE 'intergenic' END AS gene,
       CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN p_size > 25 THEN 'missense_variant' ELSE 'stop_gained' END AS effect,
       CASE WHEN l_linenumber <> 1 AND l_linestatus = 'O' THEN 'p.Asp87Tyr' ELSE '.' END AS aa_change
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_linenumber NOT IN (2, 3)""")
def _(q):
    return formats.parse_ann(formats.parse_vcf(_vcf_lines(q), ["sample"])).select("sample", "pos", "gene", "effect", "aa_change")


@query("read_intervals", "S10", """
SELECT 'SRR' || CAST(o_custkey AS VARCHAR) AS sample, CAST(floor(o_totalprice / 200) AS INT) AS start_pos, CAST(floor(o_totalprice / 200) AS INT) + 40 AS end_pos
FROM {orders} WHERE o_orderpriority <> '5-LOW'
UNION ALL
SELECT 'SRR' || CAST(o_orderkey AS VARCHAR), CAST(floor(o_totalprice / 200) AS INT), CAST(floor(o_totalprice / 200) AS INT) + 40
FROM {orders} WHERE o_orderpriority <> '5-LOW'""")
def _(q):
    start = F.floor(F.col("o_totalprice") / 200).cast("int")
    taxa = F.concat(F.lit('node="x";taxa=" SRR'), F.col("o_custkey").cast("string"), F.lit("_pure;SRR"), F.col("o_orderkey").cast("string"), F.lit('"'))
    line = F.concat_ws("\t", F.lit("SEQ"), F.lit("G"), F.lit("CDS"), start, start + 40, F.lit("0"), F.lit("."), F.lit("0"), taxa)
    low = F.col("o_orderpriority") == "5-LOW"
    line = F.when(low & (F.col("o_orderstatus") == "F"), F.concat(F.lit("##"), line)).when(low, F.lit("too\tshort")).otherwise(line)
    return formats.read_intervals(q.spark, _files(q, q("orders").select(line.alias("value"), F.col("o_orderkey").alias("line_no")), ["##gff-version 3"]))


@query("read_hash_header_tsv", "S11", """
SELECT CASE WHEN p_size = 48 THEN 'query' ELSE 'gene' || CAST(p_partkey AS VARCHAR) END AS query, p_type AS "COG_category", p_name AS "Description" FROM {part} WHERE p_size <= 48""")
def _(q):
    """Comments stand among the rows; later header-like comments name other columns."""
    gene = F.when(F.col("p_size") == 48, F.lit("query")).otherwise(F.concat(F.lit("gene"), F.col("p_partkey").cast("string")))
    line = F.concat_ws("\t", gene, "p_type", "p_name")
    line = F.when(F.col("p_size") == 49, F.lit("## run info")).when(F.col("p_size") == 50, F.lit("#query\ta later\tcomment")).otherwise(line)
    lines = q("part").select(line.alias("value"), F.col("p_partkey").alias("line_no"))
    return formats.read_hash_header_tsv(q.spark, _files(q, lines, ["## run info", "#query\tCOG_category\tDescription"]))


_STRIP_HEAD = ["DATASET_COLORSTRIP", "SEPARATOR COMMA", "DATASET_LABEL,Source", "COLOR,#000000", "SRR1,#ffffff,before the data", "DATA", ""]


@query("read_colorstrip", "S12", """
SELECT 'SRR' || CAST(o_custkey AS VARCHAR) AS sample, arg_min(o_orderstatus, o_orderkey) AS color, arg_min(o_orderpriority, o_orderkey) AS label
FROM {orders} GROUP BY o_custkey""")
def _(q):
    line = F.concat_ws(" , ", F.concat(F.lit("SRR"), F.col("o_custkey").cast("string")), "o_orderstatus", "o_orderpriority")
    lines = q("orders").select(line.alias("value"), F.col("o_orderkey").alias("line_no"))
    return formats.read_colorstrip(q.spark, _files(q, lines, _STRIP_HEAD))


@query("write_colorstrip", "S12", "SELECT sample, '#000000' AS color, min(source) AS label FROM {groups} GROUP BY sample")
def _(q):
    path = _folder(q, "strip")
    formats.write_colorstrip(q("groups"), path, "sample", "source", "Source")
    return formats.read_colorstrip(q.spark, f"{path}/*/*.txt")


@query("extract_ids", "S13", r"""
SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/[A-Za-z]+"', 0)) AS id FROM {pages}""")
def _(q):
    return formats.extract_ids(q("pages"), "html", r'href="/[A-Za-z]+"')


@query("tree_tips", "S14", """
SELECT DISTINCT 'SRR' || CAST(c_custkey AS VARCHAR) AS id FROM {customer} UNION SELECT 'Reference'""")
def _(q):
    text = F.concat(F.lit("(SRR"), F.col("c_custkey").cast("string"), F.lit(":0.1,"),
                    F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Reference")).otherwise(F.lit("Reference_2")), F.lit(":0.2);"))
    return formats.tree_tips(q("customer").select(text.alias("value")), reference="Reference")


@query("resolve_column", "S15", "SELECT c_mktsegment AS value, count(*) AS n FROM {customer} GROUP BY 1")
def _(q):
    c = q("customer")
    name = tables.resolve_column(c, ["segment", " C_MktSegment "], "segment")
    return c.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_projection", "S16", "SELECT l_orderkey, l_quantity FROM {lineitem}")
def _(q):
    return q("lineitem").select("l_orderkey", "l_quantity")


@query("write_both", "S17", "SELECT 'SRR' || CAST(o_orderkey AS VARCHAR) AS run, CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE o_orderstatus END AS status, 2 AS copies FROM {orders}")
def _(q):
    df = q("orders").select(F.concat(F.lit("SRR"), F.col("o_orderkey").cast("string")).alias("run"),
                            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("status"))
    base = _folder(q, "twin")
    sinks.write_both(df, base)
    both = relations.union_all(*[tables.read_table(q.spark, f"{base}_{ext}", sep, tables.text_schema(["run", "status"])) for ext, sep in (("csv", ","), ("tsv", "\t"))])
    return both.groupBy("run", "status").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query("write_partitioned", "S18", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def _(q):
    df = q("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    path = _folder(q, "runs")
    sinks.write_partitioned(df, path, ["status", "priority"])
    back = q.spark.read.parquet(path).where("status = 'F'")
    return back.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("file_checksums", "S19")
def _(q):
    return sinks.file_checksums(q.spark, f"{q.sf_dir}/*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "length", "md5")


@query("to_fasta", "S20", r"""
SELECT '>doc_id=' || CAST(doc_id AS VARCHAR) || CASE WHEN lang <> 'en' THEN ' | language=' || lang ELSE '' END || chr(10) ||
       rtrim(regexp_replace(seq, '(.{80})', '\1' || chr(10), 'g'), chr(10)) AS value
FROM (SELECT doc_id, lang, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM {documents}) WHERE seq <> ''""")
def _(q):
    d = q("documents").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("language"),
                              F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    return formats.to_fasta(d, ["doc_id", "language"], "seq")


@query("fasta_filter", "S21", r"""
SELECT CAST(doc_id AS VARCHAR) AS id, seq FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM {documents})
WHERE doc_id NOT IN (SELECT doc_id FROM {labels} WHERE toxic = 1)""")
def _(q):
    seq = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    body = F.regexp_replace(seq, "(.{60})", "$1\n")
    rec = q("documents").select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" x\n"), body).alias("value"))
    drop = q("labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return formats.fasta_filter(formats.parse_fasta(rec).select("id", "seq"), drop)


# --- sequences (X6) --------------------------------------------------------------------------

_DNA = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"


@query("revcomp", "X6", f"SELECT doc_id, reverse(translate({_DNA}, 'ACGT', 'TGCA')) AS rc FROM {{documents}}")
def _(q):
    return q("documents").select("doc_id", sequence.revcomp(F.regexp_replace(F.upper("text"), "[^ACGT]", "")).alias("rc"))


_CODON_ROWS = ", ".join(f"('{k}','{v}')" for k, v in sequence.CODONS.items())


@query("translate", "X6", f"""
WITH d AS (SELECT doc_id, {_DNA} AS s FROM {{documents}}),
p AS (SELECT doc_id, i, substr(s, CAST(i * 3 + 1 AS BIGINT), 3) AS codon FROM d, unnest(generate_series(0, CAST(length(s) // 3 AS BIGINT) - 1)) AS g(i))
SELECT d.doc_id, coalesce(t.aa, '') AS aa FROM d LEFT JOIN
(SELECT doc_id, string_agg(m.a, '' ORDER BY i) AS aa FROM p JOIN (VALUES {_CODON_ROWS}) AS m(c, a) ON p.codon = m.c GROUP BY doc_id) t USING (doc_id)""")
def _(q):
    return q("documents").select("doc_id", sequence.translate(F.regexp_replace(F.upper("text"), "[^ACGT]", "")).alias("aa"))


# One regular expression per frame gives the same runs: codon-aligned text with stops marked.
_ORF = f"""
WITH d AS (SELECT doc_id, {_DNA} AS s FROM {{documents}}),
f AS (SELECT doc_id, fr, substr(s, fr + 1) AS s FROM d, (VALUES (0), (1), (2)) v(fr)),
c AS (SELECT doc_id, fr, i, substr(s, CAST(i * 3 + 1 AS BIGINT), 3) AS codon FROM f, unnest(generate_series(0, CAST(length(s) // 3 AS BIGINT) - 1)) AS g(i)),
b AS (SELECT *, coalesce(sum(CASE WHEN codon IN ('TAA','TAG','TGA') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, fr ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM c),
o AS (SELECT doc_id, fr, seg, min(CASE WHEN codon = 'ATG' THEN i END) AS a, max(CASE WHEN codon IN ('TAA','TAG','TGA') THEN i END) AS z FROM b GROUP BY ALL)
SELECT d.doc_id, coalesce(max((z - a + 1) * 3), 0) AS nt_length FROM d LEFT JOIN (SELECT * FROM o WHERE a IS NOT NULL AND z IS NOT NULL) o USING (doc_id) GROUP BY d.doc_id"""


@query("longest_orf", "X6", _ORF)
def _(q):
    orf = sequence.longest_orf(F.regexp_replace(F.upper("text"), "[^ACGT]", ""))
    return q("documents").select("doc_id", F.length(orf["nt"]).cast("bigint").alias("nt_length"))


@query("hit_flags", "X6", f"""
SELECT b.doc_id, length(b.s) < greatest(length(r.s), 1) AS partial_hit FROM (SELECT doc_id, lang, {_DNA} AS s FROM {{documents}}) b
JOIN (SELECT lang, min({_DNA}) AS s FROM {{documents}} GROUP BY lang) r ON b.lang = r.lang""")
def _(q):
    d = q("documents").select("doc_id", "lang", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))
    ref = d.groupBy("lang").agg(F.min("s").alias("ref"))
    j = d.join(ref, "lang").withColumn("orf", sequence.longest_orf("s")["nt"])
    flags = sequence.hit_flags("s", "ref", "orf")
    return j.select("doc_id", *[v.alias(k) for k, v in flags.items() if k == "partial_hit"])


@query("hit_flags_full", "X6", f"""
WITH b AS (SELECT doc_id, lang, {_DNA} AS s FROM {{documents}}), r AS (SELECT lang, min(s) AS ref FROM b GROUP BY lang), n AS ({_ORF})
SELECT b.doc_id, length(s) < greatest(length(ref), 1) AS partial_hit, nt_length > 0 AS orf_found, false AS internal_stop, nt_length = 0 OR nt_length < 0.8 * length(ref) AS frame_disruption
FROM b JOIN r USING (lang) JOIN n USING (doc_id)""")
def _(q):
    d = q("documents").select("doc_id", "lang", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))
    ref = d.groupBy("lang").agg(F.min("s").alias("ref"))
    j = d.join(ref, "lang").withColumn("orf", sequence.longest_orf("s")["nt"])
    return j.select("doc_id", *[v.alias(k) for k, v in sequence.hit_flags("s", "ref", "orf").items()])


@query("metrics_json", "X10", """
SELECT '{"n_orders":' || CAST(count(*) AS VARCHAR) || ',"n_open":' || CAST(count(*) FILTER (o_orderstatus = 'O') AS VARCHAR) || '}' AS metrics FROM {orders}""")
def _(q):
    from ..operators.reports import metrics_json

    return metrics_json(q("orders"), {"n_orders": F.count(F.lit(1)), "n_open": F.count_if(F.col("o_orderstatus") == "O")})


