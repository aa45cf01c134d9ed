"""SQL checks on values and sizes that the supplied tables reach only as larger copies."""

import os

import duckdb
from compare import compare, connect
from pyspark.sql import functions as F

from isolens import session
from isolens.functions import stats
from isolens.operators import enrichment, pangenome, relations
from isolens.plans import q_stats, registry
from isolens.plans.bindings import TABLES

registry.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def folder(path, **changed):
    """The supplied tables under ``path``, some of them replaced by the rows of a query over them (``{t}``)."""
    for t in TABLES:
        source = f"{SF}/{t}.parquet"
        if t in changed:
            rows = changed[t].replace("{t}", f"read_parquet('{source}')")
            duckdb.sql(f"COPY ({rows}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(source, f"{path}/{t}.parquet")
    return str(path)


def test_chi2_tail_of_large_statistics(spark):
    rows = [(0.5, 1), (9.488, 4), (1002.293126, 4), (60137.5, 3), (None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (chi2 DOUBLE, dof INT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = con.execute(f"SELECT chi2, {q_stats._CHI_P} AS p FROM t ORDER BY chi2").fetchall()
    d = spark.createDataFrame(rows, "x double, dof int")
    got = d.select("x", F.when(d.x.isNotNull(), F.round(stats.chi2_sf("x", "dof"), 6)).alias("p")).orderBy(F.asc_nulls_last("x")).collect()
    assert [tuple(r) for r in got] == want


def test_gene_rollup_of_a_large_gene(spark, tmp_path):
    sf = folder(tmp_path, lineitem="SELECT t.* REPLACE ((l_linenumber + 10 * i)::INT AS l_linenumber) FROM (FROM {t} ORDER BY ALL LIMIT 120) t, range(600) r(i)",
                part="SELECT * REPLACE ('one' AS p_name, 'type' AS p_type) FROM {t}")
    con = connect(sf)
    assert con.execute("SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus ORDER BY 1").fetchall()[-1][0] > 20_000
    ok, note, _ = compare(spark, con, sf, "gene_rollup")
    assert ok, note


def test_accumulation_curve_has_every_k(spark):
    n = 5000
    groups = spark.range(n).select(F.col("id").cast("string").alias("sample"), F.lit("a").alias("grp"))
    presence = groups.where("sample < '3'").select("sample", F.lit("g").alias("gene"))
    c = presence.count()
    got = pangenome.accumulation_curve(presence, groups, "sample", "gene", "grp").orderBy("k").collect()
    assert [r.k for r in got] == list(range(1, n + 1))
    missed = 1.0
    for r in got:
        missed *= max(n - c - r.k + 1, 0) / (n - r.k + 1)
        assert abs(r.total_genes - (1 - missed)) < 1e-9
    some = pangenome.accumulation_curve(presence, groups, "sample", "gene", "grp", points=[1, 1024, 1025, n, n + 1]).collect()
    assert sorted(r.k for r in some) == [1, 1024, 1025, n]


def test_parts_follow_the_input(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "odd name %20")
    spark.range(20_000).selectExpr("concat('s', id % 700) AS sample", "id % 37 AS pos").write.parquet(path)
    calls = spark.read.parquet(path)
    labels = spark.range(700).selectExpr("concat('s', id) AS sample", "if(id % 2 = 0, 'a', 'b') AS grp")
    intervals = spark.createDataFrame([("s0", 5, 20)], "sample string, s int, e int")

    def results():
        fc = enrichment.feature_counts(calls, labels, "sample", "pos", "grp")
        flagged = relations.flag_in_interval(calls, intervals, "sample", "pos", "s", "e")
        return fc, sorted(map(tuple, fc.collect())), sorted(map(tuple, flagged.collect()))

    _, *want = results()
    monkeypatch.setattr(session, "PART_BYTES", 1 << 10)
    n = -(-session.input_bytes(calls) // 1024)
    assert n > 16 and session.by_size(calls, "sample").rdd.getNumPartitions() == n
    fc, *got = results()
    assert got == want
    assert f", {n}), REPARTITION_BY_NUM" in fc._jdf.queryExecution().executedPlan().toString()
