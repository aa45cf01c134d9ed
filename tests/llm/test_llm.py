"""Operators of the training-data pipeline: edge cases, brute force, SQL checks, and the pipeline."""

import collections
import os
import random

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from compare import canonical
from pyspark.sql import functions as F

from isolens.llm import common, decontaminate, exact_dedup, lm, line_dedup, mixing, pii, queries, shingle_dedup, simhash, toxicity, url_filter, warc
from isolens.session import ship

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, rank int, fp string, k int, doc string, line_no int"
WORDS = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu", "mel", "so", "ne", "vi") for b in ("ra", "nt", "lo", "ke", "sh", "um", "za", "po")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Null ids and texts, empty and long texts, exact and near copies, ties, repeated rows and lines."""
    rng = random.Random(7)
    out = [(None, None), (None, "x"), (None, "x"), (1, ""), (2, None), (3, " \t\n "), (3, "other"), (4, "Ünï ñ 世界 text\n\nend"), (5, "a" * 5000), (6, "1 " * 3000)]
    base = [prose(rng, 60) + "\n" + prose(rng, 12) + "\n" + prose(rng, 30) for _ in range(6)]
    for i in range(40):
        t = base[i % 6] if i < 18 else prose(rng, rng.randint(1, 80))
        if i % 3 == 1:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append((10 + i, t))
    out += [(10, out[10][1]), (500, prose(rng, 4000))]
    for i in range(6):
        mail = f"u{i % 2}@mail{i % 2}.example.com"
        out.append((600 + i, f"write to zorblat{i % 2} {mail} or call +1 (555) 010-99{i}0, card 4111 1111 1111 1111 at 10.0.0.{i} or 300.1.1.1"))
    return out


def frame(spark, rows):
    full = [(d, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 0.5, "z", 1, "q", 2, "w", 3) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship(spark)
    return frame(spark, rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, con, name):
    ship(spark)
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), columns)


def test_exact(docs, rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    want = []
    for d, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((d, keep, len(g), d == keep, brute.sha(t)))
    assert counted(exact_dedup.exact_dedup(docs, "largest", runs=8, fan_in=2).collect()) == counted(want)


def test_simhash(docs, rows):
    fps = [brute.simhash(t, 4) for _, t in rows]
    of = brute.classes(fps)
    low = {}
    for (d, _), c in zip(rows, of):
        low[c] = min((x for x in (d, low.get(c)) if x is not None), default=None)
    got = counted(simhash.near_duplicates(docs).collect())
    assert got == counted((d, format(f, "016x"), low[c]) for (d, _), f, c in zip(rows, fps, of))
    kept = simhash.keep_one(docs, ngram=5)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute.classes([brute.simhash(t, 5) for _, t in rows])))


def shingle_sets(rows):
    split = [(t or "").encode().lower().split() for _, t in rows]
    return [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


def jaccard_classes(sets, t=0.8):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= t * len(a | b) - 1e-9:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("crowd", [1, 8])
def test_near_dedup_stage(spark, docs, rows, crowd):
    """Near copies on both sides of a Jaccard similarity of 0.8 against brute force, also where SimHash is over four bits apart."""
    rng, near = random.Random(11), []
    shared = prose(rng, 40)
    for i in range(8):
        base = prose(rng, 100 if i % 2 else 400).split(" ") + shared.split(" ")
        for k in range(10):
            w = list(base)
            for at in rng.sample(range(len(w)), k * len(w) // 200):
                w[at] = "other"
            near.append((1000 + 10 * i + k, " ".join(w)))
    rows = rows + near
    sets = shingle_sets(rows)
    of = jaccard_classes(sets)
    fps = [brute.simhash(t, 5) for _, t in near]
    far = sum(len(a & b) >= 0.8 * len(a | b) and bin(fps[i] ^ fps[j]).count("1") > 4 for i, a in enumerate(sets[-80:]) for j, b in enumerate(sets[-80:][:i]))
    assert far > 20
    kept = shingle_dedup.keep_one(docs.unionByName(frame(spark, near)), crowd=crowd)
    assert kept.columns == docs.columns
    best = {}
    for (d, t), k in sorted(zip(rows, of), key=lambda x: brute.late(x[0][0])):
        best.setdefault(k, d)
    assert counted((r.doc_id,) for r in kept.select("doc_id").collect()) == counted((d,) for d in best.values())
    # the stage of the pipeline does the same
    stage = corpus_pipeline.near_dedup(spark, docs.unionByName(frame(spark, near)), SF)
    assert stage.count() == len(best) < len(set(brute.classes([brute.simhash(t, 5) for _, t in rows])))


def test_allocation_is_lossless():
    """Thresholds sum up as the general pigeonhole principle asks, for correlated bits too."""
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (400, 64))
    bits[:, 1] = bits[:, 0]
    both = bits.T @ bits
    for n in (10, 10**5, 10**8):
        plan = simhash.allocate(both * (n / 400), n, 4)
        dropped = 64 - sum(len(g) for g, _ in plan)
        assert dropped == 0 and sum(t + 1 for _, t in plan) == 5
    groups = simhash.group_bits(both, 400, 4)
    assert any({0, 1} <= set(g) for g in groups) and sorted(b for g in groups for b in g) == list(range(64))


def test_lines(docs, rows):
    want = brute.lines(rows)
    got = counted((r.doc_id, r.text, r.n_removed) for r in line_dedup.line_report(docs).collect())
    assert got == counted(want)
    after = line_dedup.dedup_lines(docs)
    assert after.columns == docs.columns and after.count() == len(rows)
    crowded = counted(tuple(r) for r in line_dedup.duplicate_lines(docs, crowd=1).collect())
    assert crowded == counted(tuple(r) for r in line_dedup.duplicate_lines(docs).collect())


def test_unlike_lines_are_not_read_again(spark, monkeypatch):
    """Lines that share a few tokens only, short or long, are no candidates; near copies of them are found."""
    rng = random.Random(11)
    lines = [" ".join(rng.sample([f"w{i}" for i in range(size * 10)], size)) for size in (12, 40, 300) for _ in range(60)]
    near = [" ".join([*line.split(" ")[1:], "other"]) for line in lines[::7]]
    rows = list(enumerate(lines + near))
    verified, plain = [], line_dedup._verify

    def verify(docs, classes, pairs, t):
        verified.append(pairs.count())
        return plain(docs, classes, pairs, t)

    monkeypatch.setattr(line_dedup, "_verify", verify)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = counted((r.doc_id, r.text, r.n_removed) for r in line_dedup.line_report(docs).collect())
    assert got == counted(brute.lines(rows))
    assert len(near) <= sum(verified) <= 2 * len(near)


def test_overlaps(spark, docs, rows):
    rng = random.Random(3)
    text = rows[12][1].replace("\n", " ").split(" ")
    changed = text[2:32]
    changed[9], changed[20] = "odd", "even"
    items = [(1, " ".join(text[5:40])), (2, " ".join(changed).upper()), (3, prose(rng, 30)), (4, None), (5, ""), (6, " ".join(text[3:10])), (1, " ".join(text[5:40]))]
    items.append((7, " ".join(w if i % 5 else "no" for i, w in enumerate(text[:30]))))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, size string")
    want = brute.overlaps(rows, items)
    assert {1, 2, 6} <= {i for _, i in want} and 7 not in {i for _, i in want}
    got = {(r.doc_id, r.item_id): r.matches for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert got == want
    shuffled = {(r.doc_id, r.item_id): r.matches for r in decontaminate.find_overlaps(docs, bench, broadcast_seeds=0).collect()}
    assert shuffled == want
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    hit = {d for d, _ in want}
    assert counted((r.doc_id, r.text) for r in left.select("doc_id", "text").collect()) == counted((d, t) for d, t in rows if d not in hit)


def test_pii(docs, rows):
    added = brute.pii_terms(rows)
    got = pii.find_pii(docs)
    listed = counted(tuple(r) for r in got.select("doc_id", pii.listed("base"), pii.listed("spans")).collect())
    want = []
    for d, t in rows:
        base = [(s, o, k, e) for s, o, k, e, _ in brute.pii(t)]
        more = [(a, o, k, b) for (a, b), (o, k) in added.get((d, t or ""), {}).items()]
        want.append((d, ",".join(f"{k}:{s}:{e}" for s, _, k, e in base), ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(base + more))))
    assert listed == counted(want)
    assert any("remove:" in w[2] or "generalise:" in w[2] for w in want)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, got).collect()}
    assert "[EMAIL]" in clean[600] and "@" not in clean[600] and "zorblat" not in clean[600] and clean[1] == ""


def test_lm(spark, docs, rows):
    ids = [(d, t) for d, t in rows if d is not None]
    want, n = brute.base_scores(list(dict(ids).items()))
    table = frame(spark, list(dict(ids).items()))
    learn = ~queries._held_out(7)
    words = lm.count_words(table, learn)
    model = lm.train(table, words, learn)
    got = lm.score(table, words, model).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9) and r.score < 0
    # the probabilities of all next words add up to one, unknown words included
    counts = {bytes(r.word): r.c for r in words.collect()}
    codes = lm._Codes(model.codes)
    context = [codes[w] for w in lm.tokens(rows[12][1])[:6]]
    total = 0.0
    for w in counts:
        c = np.array([*context, codes[w]])
        cls, seat = lm._lay_out(c)
        pa, pb, _ = lm._forward(model, lm._features(c, np.array([0])), cls)
        p = pa[-1, cls[-1]] * pb[-1, seat[-1]]
        total += p * (10 ** -model.other_log[cls[-1]] * (counts[w] + 1) if seat[-1] == lm.OTHER else 1)
    unknown = 0.0
    for k in range(lm.CLASSES):
        c = np.array([*context, -1 - k])
        cls, seat = lm._lay_out(c)
        pa, pb, _ = lm._forward(model, lm._features(c, np.array([0])), cls)
        unknown += pa[-1, k] * pb[-1, lm.OTHER] * 10 ** -model.other_log[k]
    assert total + unknown == pytest.approx(1, abs=1e-3)


def test_lm_learns(spark):
    ship(spark)
    d = queries.op6_lm_scoring(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert d.s > d.b


def test_mix(docs, rows):
    got = mixing.mix(docs, blocks=64, shard_bits=2).collect()
    assert len(got) == len(rows)
    taken, target, size = collections.Counter(), {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and len([s for s in r.shards.split(",") if s]) == -(-r.taken // r.size if r.size else 0)
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    total = sum(size.values())
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.5 and target[s] <= 2 * size[s]
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert counted(mixing.mix(docs.repartition(3), blocks=64, shard_bits=2).select("doc_id", "taken", "shards").collect()) == counted((r.doc_id, r.taken, r.shards) for r in got)


def test_write_shards(spark, docs, tmp_path):
    mixed = common.save(mixing.mix(docs, blocks=64, shard_bits=2), "mixed")
    mixing.write_shards(docs, mixed, str(tmp_path / "out"))
    copies = mixed.where("taken > 0").select(F.explode(F.split("shards", ",")).alias("s")).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == copies


def test_urls(spark):
    rules = [("com/", "com", "/", "allow"), ("x.com/a", "x.com", "/a", "block"), ("y.x.com/a", "y.x.com", "/a", "allow"), ("net/", "net", "/", "block"), ("net", "net", "", "allow")]
    urls = [(1, "http://x.com/abc?q=/a"), (2, "https://Y.X.com/a#f"), (3, "http://zx.com/a"), (4, None), (5, "x.com/a"), (6, "http://n.net"), (7, "http://n.net/é"), (None, "ftp://a.org/"), (1, "http://x.com/abc?q=/a"), (8, ""), (9, "http://")]
    pages = spark.createDataFrame([(i, u, "h", "c") for i, u in urls], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "rule string, host string, path string, verdict string")
    got = counted(url_filter.filter_urls(pages, table).collect())
    want = [(1, "x.com", "/abc", "x.com/a", "block")] * 2 + [
        (2, "y.x.com", "/a", "y.x.com/a", "allow"), (3, "zx.com", "/a", "com/", "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "n.net", "", "net", "allow"),
        (7, "n.net", "/é", "net/", "block"), (None, "a.org", "/", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow")]
    assert got == counted(want)
    assert url_filter.filter_urls(pages, table.limit(0), default="block").where("verdict = 'block'").count() == len(urls)


def test_warc_round_trip(spark, tmp_path):
    big = "<html>é" + "x" * 2000
    pages = [(1, "http://a", big), (2, "http://b", big), (2, "http://b", big), (None, None, None), (4, "u\r\nv", ""), (5, "http://c", "small"), (6, "http://d", "small"), (7, "http://e", "<p>\x00\n</p>")]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages], "page_id long, url string, html string, payload string, n int")
    warc.write_archive(df, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 4
    back = warc.parse_records(records).collect()
    assert all(r.verified for r in back) and len(back) == len(pages)
    assert counted((r.page_id, r.payload.decode()) for r in back) == counted((i, h or "") for i, _, h in pages)
    kinds = counted((r.page_id, r.record_type, r.refers_to) for r in back)
    assert kinds[2, "response", None] == 1 and kinds[2, "revisit", 2] == 1 and kinds[1, "revisit", 2] == 1 and kinds[5, "response", None] == kinds[6, "response", None] == 1
    for r in records.collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert block == block[:length] + b"\r\n\r\n" and (length == len(r.payload) or b"revisit" in head)


def test_toxicity(spark, docs, rows):
    rng = random.Random(5)
    made = [(i, prose(rng, rng.randint(5, 60)) + (f". you {rng.choice(('vilecur', 'vilecurs', 'snagtooth'))} {prose(rng, 4)}." if i % 6 == 0 else ".") + prose(rng, 20)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0), 1) for i, _ in made if i < 400] + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(frame(spark, made), labels)
    got = {r.doc_id: r for r in toxicity.classify(frame(spark, made), model).collect()}
    wrong = [i for i, _ in made if i >= 400 and got[i].predicted != int(i % 6 == 0)]
    assert len(wrong) <= 4
    hit = next(got[i] for i in range(402, 600, 6) if got[i].sentences)
    text = dict(made)[hit.doc_id]
    assert any(w in text[s.start:s.end] for s in hit.sentences for w in ("vilecur", "snagtooth"))
    odd = toxicity.classify(docs, model)
    assert odd.count() == len(rows) and odd.where("score is null or score < 0 or score > 1").count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.classify(docs, none).where("score is null").count() == 0


def test_empty_tables(spark, docs, tmp_path):
    empty, bench = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    learn = ~queries._held_out(7)
    words = lm.count_words(empty, learn)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert line_dedup.line_report(empty).count() == 0
    assert decontaminate.find_overlaps(empty, bench).count() == 0 and decontaminate.drop_contaminated(docs, bench).count() == docs.count()
    assert pii.find_pii(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert lm.score(empty, words, lm.train(empty, words, learn)).count() == 0
    assert lm.score(docs, words, lm.train(empty, words, learn)).count() == docs.count()
    assert toxicity.classify(empty, toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([("net/", "net", "/", "block")], "rule string, host string, path string, verdict string")
    assert url_filter.filter_urls(pages, rules).count() == 0
    warc.write_archive(pages, str(tmp_path / "archive"))
    assert warc.parse_records(warc.read_archive(spark, str(tmp_path / "archive"))).count() == 0
    assert shingle_dedup.keep_one(empty).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_documents(spark, docs, name, stage):
    ship(spark)
    out = stage(spark, docs.limit(0), SF)
    assert out.count() == 0 and (name == "mix" or out.columns == docs.columns)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 202), (201, 202)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}


def test_pipeline(spark, con):
    """All stages against brute force and SQL, each on what the stage before it kept."""
    ship(spark)
    got = corpus_pipeline.run(spark, SF)
    docs = common.table(spark, SF, "documents")
    first = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert first.columns == docs.columns
    rest = [tuple(r) for r in first.select("doc_id", "text", "source").collect()]
    assert 0.5 * docs.count() < len(rest) < docs.count()
    source = {d: s for d, _, s in rest}
    rest = [(d, t) for d, t, _ in brute.lines([(d, t) for d, t, _ in rest])]
    of = jaccard_classes(shingle_sets(rest))
    keep = {}
    for (d, t), c in sorted(zip(rest, of)):
        keep.setdefault(c, (d, t))
    rest = sorted(keep.values())
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    bad = {d for d, _ in brute.overlaps(rest, items)}
    rest = [(d, t, source[d]) for d, t in rest if d not in bad]
    con.execute("CREATE OR REPLACE TABLE rest (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO rest VALUES (?, ?, ?)", rest)
    want = con.execute(f"WITH {queries._mix_sql('rest')} SELECT doc_id, source, size, source_size, target, taken, shards FROM mixed").fetchall()
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "shards"]
    assert canonical([tuple(r) for r in got.select(columns).collect()], columns) == canonical(want, columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "lines", "near_dedup", "decontamination", "mix"]
