import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from isolens.sources import formats, sinks, tables


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_read_master(spark, tmp_path):
    good = put(tmp_path / "m.csv", 'Run,Isolate,Note\nSRR1,P1,"a, b"\nSRR2,P2,\n')
    df = tables.read_master(spark, good, 2, 3, ["Run"])
    assert [tuple(r) for r in df.orderBy("Run").collect()][0] == ("SRR1", "P1", "a, b")
    with pytest.raises(ValueError):
        tables.read_master(spark, good, 3)
    bad = put(tmp_path / "b.csv", "Run,Isolate\nSRR1,P1,extra,more\n")
    with pytest.raises(Exception):
        tables.read_master(spark, bad).collect()


def test_read_repaired_csv(spark, tmp_path):
    path = put(tmp_path / "d.csv", 'id,text,kind,end\n1,"raw\\, frozen","food",x\n2,""Exudate, Left Heel"","clinical",y\n')
    rows = tables.read_repaired_csv(spark, path, [(',""Exudate, Left Heel"","clinical",', ',"Exudate, Left Heel","clinical",')]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "raw, frozen", "food", "x", 1, 0), ("2", "Exudate, Left Heel", "clinical", "y", 0, 1)]
    with pytest.raises(Exception):
        tables.read_repaired_csv(spark, put(tmp_path / "e.csv", f"id,text\n1,{tables.PLACEHOLDER}\n")).collect()


def test_tolerant_and_reports(spark, tmp_path):
    good, bad = tables.read_tsv_tolerant(spark, put(tmp_path / "t.tsv", "a\tb\n1\t2\n3\n4\t5\t6\n7\t\n"))
    assert good.count() == 2 and {r.fields for r in bad.collect()} == {1, 3}
    for s in ("SRR1", "SRR2"):
        put(tmp_path / "rep" / f"{s}_vfdb.tsv", f"GENE\t%COVERAGE\nx{s}\t99\n")
    df = tables.read_reports(spark, str(tmp_path / "rep" / "*.tsv"))
    assert {(r["sample"], r["GENE"]) for r in df.collect()} == {("SRR1", "xSRR1"), ("SRR2", "xSRR2")}
    with pytest.raises(ValueError):
        tables.read_reports(spark, str(tmp_path / "rep" / "*.tsv"), spark.createDataFrame([("SRR3",)], "sample string"))
    assert tables.resolve_column(df, ["coverage", "%Coverage "]) == "%COVERAGE"
    with pytest.warns(UserWarning):
        assert tables.resolve_column(df, ["identity"], "identity") is None


def test_text_formats(spark, tmp_path):
    put(tmp_path / "v" / "SRR7" / "snps.vcf", "##x\nchr\t10\t.\tA\tG\t.\t.\tDP=1;ANN=G|missense_variant|M|gyrA|id|t|f|p|1|c|p.D87Y|z,other\nshort\nchr\t11\t.\tC\tT\t.\t.\tDP=1\n")
    v = formats.parse_ann(formats.read_vcf(spark, str(tmp_path / "v" / "*" / "*.vcf"))).orderBy("pos").collect()
    assert [tuple(r) for r in v] == [("SRR7", 10, "A", "G", "gyrA", "missense_variant", "p.D87Y"), ("SRR7", 11, "C", "T", "unannotated", "unknown", ".")]
    iv = formats.read_intervals(spark, put(tmp_path / "r.gff", '##g\nS\tG\tC\t5\t9\t.\t.\t0\tnode="a";taxa=" SRR1 SRR2;SRR3";x\nS\tG\n')).collect()
    assert {(r["sample"], r.start_pos, r.end_pos) for r in iv} == {("SRR1", 5, 9), ("SRR2", 5, 9), ("SRR3", 5, 9)}
    ann = formats.read_hash_header_tsv(spark, put(tmp_path / "e.tsv", "## c\n#query\tCOG\ng1\tKL\n## end\n"))
    assert [tuple(r) for r in ann.collect()] == [("g1", "KL")] and ann.columns == ["query", "COG"]
    df = spark.createDataFrame([("SRR1", "x"), ("SRR2", None)], "s string, l string")
    sinks.write_text(formats.colorstrip_lines(df, "s", "l", "T").orderBy("line_no").coalesce(1), str(tmp_path / "strip"))
    back = formats.parse_colorstrip(formats.read_lines(spark, str(tmp_path / "strip")), ["path"])
    assert {(r["sample"], r.label) for r in back.collect()} == {("SRR1", "x"), ("SRR2", "Unknown")}


def test_fasta_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g1", "A" * 165), ("g2", " "), ("g3", "MK")], "gene string, seq string")
    sinks.write_text(formats.to_fasta(df, ["gene"], "seq"), str(tmp_path / "fa"))
    recs = formats.read_fasta(spark, str(tmp_path / "fa"))
    assert {(r.id, len(r.seq)) for r in recs.collect()} == {("gene=g1", 165), ("gene=g3", 2)}
    keep = formats.fasta_filter(recs, spark.createDataFrame([("gene=g3",)], "id string"))
    assert [r.id for r in keep.collect()] == ["gene=g1"]
    sinks.write_partitioned(df, str(tmp_path / "p"), ["gene"])
    assert spark.read.parquet(str(tmp_path / "p")).where("gene = 'g3'").count() == 1
    sinks.write_both(df, str(tmp_path / "twin"))
    assert tables.read_table(spark, str(tmp_path / "twin_tsv"), "\t").select(F.col("gene")).count() == 3


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of 64 KB, also small ones."""
    names = {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_keep_their_place_over_splits(spark, tmp_path, small_splits):
    for name, n in (("a", 40_000), ("b", 3), ("c", 9_000)):
        put(tmp_path / "in" / f"{name}.txt", "".join(f"{name} {i}\n" for i in range(n)))
    d = formats.placed_lines(spark, str(tmp_path / "in"))
    assert d.select("path", "line_no").rdd.getNumPartitions() > 4
    rows = d.collect()
    assert len(rows) == 49_003 and all(r.value == f"{r.path[-5]} {r.line_no}" for r in rows)
    head = "id,name"
    put(tmp_path / "csv" / "x.csv", head + "\n" + "".join(f'{i},"n{i}"\n' if i % 7 else head + "\n" for i in range(20_000)))
    got = tables.read_repaired_csv(spark, str(tmp_path / "csv")).collect()
    assert len(got) == 20_000 and sum(r.id == "id" for r in got) == 2858
    good, bad = tables.read_tsv_tolerant(spark, put(tmp_path / "t" / "x.tsv", "a\tb\n" + "".join("a\tb\n" if i % 5 else "one\n" for i in range(30_000))))
    assert good.count() == 24_000 and {r.line_no for r in bad.collect()} == {i + 1 for i in range(0, 30_000, 5)}


def test_colorstrip_first_wins_over_splits(spark, tmp_path, small_splits):
    body = "".join(f"SRR{i % 5000},#{i:06d},l{i}\n" for i in range(20_000))
    put(tmp_path / "s" / "1.txt", "DATASET_COLORSTRIP\nSRR1,#x,too early\nDATA\n" + body)
    put(tmp_path / "s" / "2.txt", "SRR9,#y,later file\n\n data \nSRR9,#z,later\nSRR77777,#q,new\n")
    put(tmp_path / "s" / "3.txt", "SRR88888,#q,no data line\n")
    got = {r["sample"]: (r.color, r.label) for r in formats.read_colorstrip(spark, str(tmp_path / "s")).collect()}
    assert got == {f"SRR{i}": (f"#{i:06d}", f"l{i}") for i in range(5000)} | {"SRR77777": ("#q", "new")}
    df = spark.createDataFrame([(f"SRR{i % 900}", f"s{i}") for i in range(1000)], "s string, l string")
    formats.write_colorstrip(df, str(tmp_path / "w"), "s", "l", "T", per_file=100)
    files = list((tmp_path / "w").glob("file=*/*.txt"))
    assert len(files) >= 9 and all(f.read_text().split("\n")[:5] == ["DATASET_COLORSTRIP", "SEPARATOR COMMA", "DATASET_LABEL,T", "COLOR,#000000", "DATA"] for f in files)
    back = {r["sample"]: r.label for r in formats.read_colorstrip(spark, str(tmp_path / "w" / "*")).collect()}
    assert back == {f"SRR{i}": min(f"s{j}" for j in (i, i + 900) if j < 1000) for i in range(900)}


def test_checksums(spark, tmp_path, small_splits):
    rng = random.Random(1)
    contents = {
        "empty": b"", "feed": b"\n", "text": b"a\r\nb\n\nlast", "noise.parquet": rng.randbytes(700_000), "one line": b"x" * 300_000, "feeds": b"\n" * 70_000,
        "latin é.txt": "é\n".encode("latin-1") * 50_000, "packed.gz": gzip.compress(b"packed\n" * 5000)}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    for algorithm in ("md5", "sha256"):
        got = {r.path.rsplit("/", 1)[-1]: r for r in sinks.file_checksums(spark, str(tmp_path), algorithm, chunk=10_000).collect()}
        assert len(got) == len(contents)
        for name, raw in contents.items():
            r = got[name]
            assert (r.length, r[algorithm]) == (len(raw), hashlib.new(algorithm, raw).hexdigest()), name
