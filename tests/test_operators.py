import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolens.functions import classify, dates, markers, sequence, text
from isolens.operators import enrichment, functional, pangenome, quality, ranking, relations, reports, reshape, resampling, tree


def test_null_keys_match(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([("x",), (None,)], "k string")
    assert {r.v for r in relations.select_cohort(a, b, "k").collect()} == {1, 2}
    assert [r.v for r in relations.exclude(a, b, "k").collect()] == [3]


def test_prefix_ids_do_not_match(spark):
    a = spark.createDataFrame([("SRR1",), ("SRR12",)], "id string")
    assert [r.id for r in relations.filter_by_ids(a, spark.createDataFrame([("SRR1",)], "id string"), "id").collect()] == ["SRR1"]


def test_guards_fail(spark):
    twice = spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int")
    for bad in (relations.left_join_1to1(twice.select("k"), twice, "k"), relations.expect(twice, F.col("v") < 2, "too large"),
                reshape.unpack_rows(spark.createDataFrame([("a;b;c", 2)], "ids string, n int"), {"ids": "id"}, "n")):
        with pytest.raises(Exception):
            bad.collect()


def test_interval_bounds(spark):
    v = spark.createDataFrame([("s", p) for p in (9, 10, 5000, 5001)] + [("t", 10), ("s", None)], "s string, p int")
    iv = spark.createDataFrame([("s", 10, 5000), ("s", 10, 12)], "s string, a int, b int")
    got = [(r.s, r.p, r.masked) for r in relations.flag_in_interval(v, iv, "s", "p", "a", "b", bucket=16).collect()]
    assert sorted(got, key=str) == sorted([("s", 9, False), ("s", 10, True), ("s", 5000, True), ("s", 5001, False), ("t", 10, False), ("s", None, False)], key=str)


def test_exact_rank_equals_row_number(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("g")).alias("g"), ranking.hash_order("id", 5).alias("h"))
    got = ranking.exact_rank(df, "g", [F.col("h"), F.col("id")], ranking.hash_bucket(F.col("h"), 64), "r")
    want = df.withColumn("w", F.row_number().over(W.partitionBy("g").orderBy("h", "id")))
    assert got.join(want, "id").where("r <> w").count() == 0


def test_sample_paths_agree(spark):
    df = spark.range(4000).select("id", (F.col("id") % 3).alias("g"))
    short = {r.id for r in ranking.sample_up_to(df, 50, "g", "id", 3).collect()}
    long = {r.id for r in ranking.sample_up_to(df.repartition(5), F.lit(50), "g", "id", 3).collect()}
    assert short == long and len(short) == 150


def test_best_per_key_sorts_nulls_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2.0, 2), ("a", 3.0, 3), ("b", None, 4)], "k string, x double, v int")
    assert {(r.k, r.v) for r in ranking.best_per_key(df, "k", [("x", False)]).collect()} == {("a", 3), ("b", 4)}
    assert {(r.k, r.v) for r in ranking.best_per_key(df, "k", [("x", True)]).collect()} == {("a", 2), ("b", 4)}


def test_distances_against_brute_force(spark):
    rng = random.Random(4)
    parent, edges = {}, []
    for i in range(1, 60):
        parent[f"n{i}"] = ("n0" if i < 3 else f"n{rng.randrange(i)}", rng.randrange(0, 9))
        edges.append((f"n{i}", *parent[f"n{i}"]))
    tips = [n for n in parent if n not in {p for p, _ in parent.values()}]

    def up(n):
        out, d = {n: 0}, 0
        while n in parent:
            d += parent[n][1]
            n = parent[n][0]
            out[n] = d
        return out

    ups = {t: up(t) for t in tips}
    dist = {(a, b): min(ups[a][x] + ups[b][x] for x in ups[a] if x in ups[b]) for a, b in itertools.combinations(tips, 2)}
    groups = {t: "g" if i % 3 else "h" for i, t in enumerate(tips)}
    paths = tree.ancestor_paths(spark.createDataFrame(edges, "child string, parent string, length long"))
    got = {r.grp: r for r in tree.distance_summary(paths, spark.createDataFrame([(t, g) for t, g in groups.items()], "tip string, grp string"), "grp").collect()}
    for g in ("g", "h"):
        vals = [d for (a, b), d in dist.items() if groups[a] == groups[b] == g]
        assert (got[g].n_pairs, got[g].min_distance, got[g].max_distance, got[g].median_distance) == (len(vals), min(vals), max(vals), statistics.median(vals))
    pairs = list(dist)[:50]
    index = tree.tree_index(spark.createDataFrame(edges, "child string, parent string, length long"))
    out = tree.pairwise_tree_distance(index, spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {(r.a, r.b): r.distance for r in out} == {p: dist[p] for p in pairs}


@pytest.mark.parametrize("listed, drawn", [(200_000, 512), (15, 40)])
def test_real_distances_without_pairs(spark, monkeypatch, listed, drawn):
    """A tree of chains, stars and ties in real lengths: median, extremes and counts against all pairs."""
    monkeypatch.setattr(tree, "LISTED", listed)
    monkeypatch.setattr(tree, "DRAWN", drawn)
    rng = random.Random(listed)
    parent = {}
    for i in range(1, 61):
        up = i - 1 if i < 25 else 3 if i < 40 else rng.randrange(i)
        parent[f"n{i}"] = (f"n{up}", rng.choice([0.0, 0.5, rng.random(), 3 * rng.random()]))
    tips = [n for n in parent if rng.random() < 0.7]  # inner nodes too

    def ups(n):
        out, d = {n: 0.0}, 0.0
        while n in parent:
            d += parent[n][1]
            n = parent[n][0]
            out[n] = d
        return out

    of = {t: ups(t) for t in tips}
    groups = {t: "ghk"[min(i % 5, 2)] for i, t in enumerate(tips)} | {"n60": "alone"}
    index = tree.tree_index(spark.createDataFrame([(c, p, x) for c, (p, x) in parent.items()], "child string, parent string, length double"))
    got = {r.grp: r for r in tree.distance_order_summary(index, spark.createDataFrame(list(groups.items()), "tip string, grp string"), "grp").collect()}
    assert set(got) == {"g", "h", "k"}
    of["n60"] = ups("n60")
    for g, r in got.items():
        own = [t for t in groups if groups[t] == g]
        d = [min(of[a][x] + of[b][x] for x in of[a] if x in of[b]) for a, b in itertools.combinations(own, 2)]
        assert (r.n_tips, r.n_pairs) == (len(own), len(d))
        assert (r.min_distance, r.median_distance, r.max_distance) == pytest.approx((min(d), statistics.median(d), max(d)), abs=1e-9)


def test_jump_table_of_a_deep_chain(spark):
    n = 10_000
    edges = spark.range(1, n + 1).selectExpr("id AS child", "id - 1 AS parent", "id % 7 AS length")
    index = tree.tree_index(edges)
    assert len(index.levels) == 14 and sum(x.count() for x in index.levels) < n * 14
    at = [0]
    for i in range(1, n + 1):
        at.append(at[-1] + i % 7)
    pairs = [(0, n), (5, 9999), (77, 77), (9000, 4097), (1, 2)]
    got = tree.pairwise_tree_distance(index, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.a, r.b): r.distance for r in got} == {(a, b): abs(at[a] - at[b]) for a, b in pairs}


@pytest.mark.parametrize("block", [2, 64])
def test_accumulation_draws_against_brute_force(spark, block):
    rng = random.Random(9)
    share = [1.0, 0.97, 0.9, 0.9, 0.5, 0.2, 0.05, 0.02]
    rows = [(f"s{i}", f"g{j}") for i in range(43) for j, p in enumerate(share) if rng.random() < p] + [("s1", "g1"), ("other", "g0"), ("s2", "solo")]
    grp = [(f"s{i}", "A" if i < 30 else "B") for i in range(43)]
    pres, groups = spark.createDataFrame(rows, "sample string, gene string"), spark.createDataFrame(grp, "sample string, grp string")
    got = {(r.grp, r.k): r for r in pangenome.accumulation_draws(pres, groups, "sample", "gene", "grp", reps=7, seed=3, block=block).collect()}
    order = {}
    for r in pangenome.draw_orders(groups, "sample", "grp", 7, 3).collect():
        order.setdefault((r.grp, r.rep), {})[r.pos] = r["sample"]
    own = {}
    for x, g in rows:
        own.setdefault(x, set()).add(g)
    for g, n in (("A", 30), ("B", 13)):
        for k in (1, 2, 3, 5, 8, n):
            taken = [[own.get(order[g, rep][p], set()) for p in range(1, k + 1)] for rep in range(1, 8)]
            total, core = [len(set().union(*t)) for t in taken], [len(set.intersection(*t)) for t in taken]
            r = got[g, k]
            assert (r.total_mean, r.total_sd, r.core_mean, r.core_sd) == pytest.approx((np.mean(total), np.std(total), np.mean(core), np.std(core)))
        assert got[g, n].total_sd == 0 and got[g, n].core_sd == 0


def test_accumulation_draws_order_first_positions_only(spark, monkeypatch):
    groups = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("sample"), F.when(F.col("id") < 2900, "A").when(F.col("id") < 2990, "B").alias("grp"))
    members = groups.where("grp IS NOT NULL").withColumn("n", F.when(F.col("grp") == "A", 2900).otherwise(90).cast("long"))
    whole = {tuple(r) for r in pangenome.draw_orders(members, "sample", "grp", 4, 9).select("sample", "grp", "rep", "pos").collect()}
    for upto in (1, 2, 64, 100, 5000):
        got = pangenome.first_positions(members, "sample", "grp", 4, 9, upto).select("sample", "grp", "rep", "pos").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == {r for r in whole if r[3] <= upto}
    ordered, plain = [], pangenome.saved

    def saved(df, name):
        out = plain(df, name)
        ordered.extend([out.count()] if name == "orders" else [])
        return out

    monkeypatch.setattr(pangenome, "saved", saved)
    presence = groups.select("sample", F.explode(F.array(F.lit("all"), F.concat(F.lit("g"), F.abs(F.xxhash64("sample")) % 3))).alias("gene"))
    got = {(r.grp, r.k): r for r in pangenome.accumulation_draws(presence, groups, "sample", "gene", "grp", reps=4).collect()}
    assert len(got) == 3000 and got["A", 2900].total_mean == 4 and got["A", 2900].core_mean == 1 and got["A", 1].total_mean == 2
    assert 0 < sum(ordered) < 4 * 500  # of 4 draws of 2,990 labelled samples


def test_curve_points(spark):
    got = {r.n: r.k for r in spark.createDataFrame([(1,), (5000,), (1_000_000,)], "n long").select("n", pangenome.curve_points(F.col("n")).alias("k")).collect()}
    assert got[1] == [1] and got[5000][:4096] == list(range(1, 4097)) and got[5000][4096:4098] == [4112, 4128] and got[5000][-1] == 5000
    assert got[1_000_000] == sorted(set(got[1_000_000])) and got[1_000_000][-1] == 1_000_000 and len(got[1_000_000]) < 4096 + 256 * 9


def test_accumulation_draws_agree_with_expectation(spark):
    rows = [(f"s{i}", f"g{j}") for i in range(12) for j in range(20) if (i * 7 + j * 3) % 5 < 3 or j == 0]
    pres = spark.createDataFrame(rows, "sample string, gene string")
    grp = spark.createDataFrame([(f"s{i}", "A") for i in range(12)], "sample string, grp string")
    exact = {r.k: r for r in pangenome.accumulation_curve(pres, grp, "sample", "gene", "grp").collect()}
    drawn = {r.k: r for r in pangenome.accumulation_draws(pres, grp, "sample", "gene", "grp", reps=200).collect()}
    assert drawn[12].total_sd == 0 and drawn[12].total_mean == pytest.approx(exact[12].total_genes)
    for k in range(1, 13):
        assert drawn[k].total_mean == pytest.approx(exact[k].total_genes, abs=0.6)
        assert drawn[k].core_mean == pytest.approx(exact[k].core_genes, abs=0.6)


def test_selection_respects_plan(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), (2010 + F.pmod("id", F.lit(16))).cast("int").alias("year"),
                                  F.when(F.col("id") % 2 == 0, F.lit("H")).otherwise(F.lit("C")).alias("source"), (F.col("id") % 5 < 2).alias("positive"),
                                  F.lit("p").alias("pattern"), (F.col("id") < 30).alias("forced"))
    plan = {"total": 900, "positive_share": 0.7, "early": {"before": 2018, "total": 700, "targets": {"H": 100, "C": 100}},
            "late": [{"name": "late", "lo": 2018, "hi": 2025, "targets": {"H": 90, "C": 60}}]}
    got = resampling.stratified_selection(df, plan, "id").collect()
    assert len(got) == len({r.id for r in got}) <= 900
    assert sum(r.section == "forced" for r in got) == 30
    late = [r for r in got if r.section == "late"]
    assert sum(r.source == "H" for r in late) <= 90 and sum(r.source == "C" for r in late) <= 60
    assert {r.id for r in got} == {r.id for r in resampling.stratified_selection(df.repartition(7), plan, "id").collect()}


def test_dates(spark):
    cases = {"2019-03-04": 2019, "2019_3_4": 2019, "3.4.2019": 2019, "20190304": 2019, "Mar 2018": 2018, "5 March 2017": 2017, "2016": 2016,
             "25/12/2015": 2015, "spring of 2014": 2014, "unknown": None, None: None, "1850": 1850, "13-13-2012": 2012}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r.d: r.y for r in df.select("d", dates.derive_year("d").alias("y")).collect()} == cases


def test_markers(spark):
    df = spark.createDataFrame([("gyrA_D87Y=POINT, GYRA_d87y=POINT,tet(A)=COMPLETE,aac(6')-Ib-cr=COMPLETE,qnrVC1=X",), (None,), ("",), ("qnrB19=COMPLETE",)], "a string")
    rows = df.select(markers.pretty_markers("a").alias("m"), markers.exclusive_group(markers.extract_markers("a")).alias("g"), markers.priority_bucket(markers.extract_markers("a")).alias("b"),
                     markers.report_markers("a").alias("r")).collect()
    assert rows[0].m == ["aac(6')-Ib-cr", "gyrA_D87Y", "qnrVC1"] and rows[0].g == "gyrA_D87Y" and rows[0].r == ["D87Y", "Others"]
    assert rows[1].m == rows[2].m == [] and rows[1].b == "QS/FQS" and rows[3].r == ["qnrB19"]


def test_classification_edges(spark):
    df = spark.createDataFrame([("imitation  crab",), ("crab",), ("Guinea pig",), (None,)], "x string")
    got = [r.c for r in df.select(classify.classify_commodity("x", F.lit("Other-Non-US")).alias("c")).collect()]
    assert got == ["Processed/imitated seafood", "Crustaceans", "Other terrestrial animals", "Unclassified — review literal source"]
    glued = spark.createDataFrame([("chickenbreast",), ("CHCKEN",), ("penguin",)], "x string").select(classify.normalize_source_words("x").alias("w")).collect()
    assert [r.w for r in glued] == ["chicken breast", "chicken", "penguin"]
    assert spark.createDataFrame([("/a/_SRR9_trimmed.TSV",)], "x string").select(text.normalize_id("x").alias("i")).first().i == "SRR9"


def test_sequences(spark):
    df = spark.createDataFrame([("CCATGAAATAGATGCCCCCCTGA",), ("ATGAAA",), ("",), (None,)], "s string")
    rows = df.select(sequence.longest_orf("s")["nt"].alias("nt"), sequence.revcomp("s").alias("rc"), sequence.translate("s").alias("aa")).collect()
    assert rows[0].nt == "ATGCCCCCCTGA" and rows[1].nt == "" and rows[1].rc == "TTTCAT" and rows[1].aa == "MK" and rows[2].aa == ""


def test_status_and_complete(spark):
    df = spark.createDataFrame([("PASS", "PASS"), ("FAIL", "PASS"), ("FAIL", "FAIL"), ("MISSING", "FAIL")], "a string, b string")
    got = [r.s for r in df.select(quality.compose_status({"A": F.col("a"), "B": F.col("b")}).alias("s")).collect()]
    assert got == ["PASS_ALL_TWO", "FAIL_A_ONLY", "FAIL_ALL_TWO", "MISSING_A"]
    c = spark.createDataFrame([("x", None, 2)], "k string, y int, n int")
    assert sorted((r.k, r.y is None, r.n) for r in reports.complete(c, {"k": ["x", "z"], "y": None}, {"n": 0}).collect()) == [("x", True, 2), ("z", True, 0)]


def test_marker_frequency_without_susceptible(spark):
    df = spark.createDataFrame([("a", ["m"]), ("b", ["m", "k"])], "id string, m array<string>")
    got = {r.marker: (r.n_isolates, r.n_total) for r in reports.marker_frequency(df, "id", "m").collect()}
    assert got == {"m": (2, 2), "k": (1, 2), "Q/FQ-susceptible": (0, 2)}


def test_labels_are_clean(spark):
    """Null labels, repeated label rows and samples without hits: counts and totals agree."""
    groups = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", None), ("d", "y"), ("e", "z")], "sample string, lineage string")
    calls = spark.createDataFrame([("a", "g"), ("a", "g"), ("b", "g"), ("c", "g"), ("d", "h"), (None, "h"), ("q", "k")], "sample string, gene string")
    fc = {(r.gene, r.lineage): (r.k, r.k_all) for r in enrichment.feature_counts(calls, groups, "sample", "gene", "lineage").collect()}
    assert fc == {("g", "x"): (2, 2), ("h", "y"): (1, 1)}
    assert {r.lineage: (r.n, r.n_all) for r in enrichment.group_totals(groups, "lineage").collect()} == {"x": (2, 4), "y": (1, 4), "z": (1, 4)}
    pan = {r.lineage: (r.genomes, r.total_genes, r.core, r.cloud) for r in pangenome.pangenome_summary(calls, groups, "sample", "gene", "lineage").collect()}
    assert pan == {"x": (2, 1, 1, 2), "y": (1, 1, 1, 2), "z": (1, 0, 0, 3)}


def test_compare_counts_null_keys(spark):
    a = spark.createDataFrame([(None, 3), ("x", 1)], "k string, n long")
    b = spark.createDataFrame([(None, 5), ("y", 2)], "k string, n long")
    got = {r.k: (r.old_n, r.new_n, r.difference) for r in relations.compare_counts(a, b, "k").collect()}
    assert got == {None: (3, 5, 2), "x": (1, 0, -1), "y": (0, 2, 2)}


def test_functional_summary_deals_variants_out_before_they_are_grouped(spark):
    rows = [("a", "v1", "g1", "BA"), ("a", "v1", "g1", "CA"), ("a", "v2", "g1", None), ("a", None, "g2", "A"), ("a", "v3", None, "-"), (None, "v1", "g1", "é𐐀B"), (None, "v1", "g1", "é𐐀B")]
    df = spark.createDataFrame(rows, "k string, v string, g string, cog string")
    letters = [(k, v, g, c) for k, v, g, cog in rows for c in (["NO_PROTEIN"] if cog in (None, "-") else sorted(set(cog)))]
    want = set()
    for k, c in {(k, c) for k, _, _, c in letters}:
        key, one = [r for r in letters if r[0] == k], [r for r in letters if r[0] == k and r[3] == c]
        want.add((k, c, *[len({r[i] for r in x} - {None}) for x in (one, key) for i in (1, 2)], len(one), len(key)))
    found = functional.functional_summary(df, "k", "cog", "v", "g")
    got = [tuple(r) for r in found.select("k", "letter", "variants_in_letter", "genes_in_letter", "unique_variants", "unique_genes", "letter_n", "assignments").collect()]
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    # no letters as arrays in a shuffle of ids, and variants meet by the size of the input
    assert "__l" not in plan and "REPARTITION_BY_NUM" in plan


def test_gene_rollup_reads_its_input_once(spark, tmp_path):
    rng = random.Random(8)
    ids = [f"chr1:{rng.randrange(10**4)}" for _ in range(900)] + ["chr1:77"] * 60 + ["x", None]
    rows = [("c" if i % 3 else None, f"g{i % 2}", v, rng.choice(["a", "b", "", None]), rng.choice(["hi", "lo", None]), float(i % 9), i / 7) for i, v in enumerate(ids)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "clade string, gene string, id string, effect string, bin string, pin double, pout double").write.parquet(path)
    g = functional.gene_rollup(spark.read.parquet(path), ["clade", "gene"], "id", "effect", "bin", "pin", "pout", size=50)
    assert not [f for f in g.inputFiles() if str(tmp_path) in f]  # the joins behind it are not run again for each branch
    got = {(r.clade, r.gene, r.chunk): r for r in g.collect()}
    genes = {}
    for r in rows:
        genes.setdefault(r[:2], []).append(r)
    want = {(*k, c) for k, v in genes.items() for c in range(-(-len(v) // 50))}
    assert set(got) == want
    for (clade, gene), v in genes.items():
        order = sorted((r[2] for r in v), key=lambda x: (x is not None, x or ""))
        parts = [got[clade, gene, c] for c in range(-(-len(v) // 50))]
        for c, p in enumerate(parts):
            assert p.variant_ids == ";".join(x for x in order[50 * c:50 * (c + 1)] if x is not None)
            assert len(p.variants) == len(order[50 * c:50 * (c + 1)]) and p.n_variants == len(v)
            assert (p.min_in, p.max_in, p.min_out, p.max_out) == (min(r[5] for r in v), max(r[5] for r in v), min(r[6] for r in v), max(r[6] for r in v))
            assert p.effects == ";".join(sorted({r[3] for r in v if r[3]})) and p.bins == ";".join(sorted({r[4] for r in v if r[4]}))
        records = sorted(((x.id, x.effect, x.bin) for p in parts for x in p.variants), key=repr)
        assert records == sorted((r[2:5] for r in v), key=repr)
    empty = functional.gene_rollup(spark.read.parquet(path).where("false"), ["clade", "gene"], "id", "effect", "bin", "pin", "pout")
    assert empty.columns == g.columns and empty.collect() == []
