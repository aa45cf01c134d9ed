"""The near-dedup stage takes SimHash links as candidates, checks them, and completes them."""

import random

import corpus_pipeline
import pytest

from isolens.llm import shingle_dedup, simhash, toxicity


@pytest.mark.parametrize("size", [60, 600])
def test_stage_checks_simhash_candidates(spark, monkeypatch, size):
    rng = random.Random(size)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    close = [*base[:-1], "other"]  # one shingle differs
    apart = ["fresh" if i % 6 == 0 else w for i, w in enumerate(base)]  # no shingle in common
    rows = [(1, " ".join(base)), (2, " ".join(close)), (3, " ".join(apart)), (4, ""), (5, None)]
    linked, checked, links, verify = [], [], simhash.link, shingle_dedup._verify

    def link(fps, most):
        out = links(fps, most)
        linked.extend(r.node for r in out.collect())
        return out

    def check(docs, classes, pairs, ngram, t):
        checked.append(pairs.count())
        return verify(docs, classes, pairs, ngram, t)

    monkeypatch.setattr(simhash, "link", link)
    monkeypatch.setattr(shingle_dedup, "_verify", check)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    want = [simhash.fingerprint(t, 5) for _, t in rows[:2]]
    if bin((want[0] ^ want[1]) & (1 << 64) - 1).count("1") <= 4:
        assert set(want) <= set(linked) and checked[0] > 0
    assert linked or size == 60


@pytest.mark.parametrize("stage", ["toxicity", "near_dedup"])
def test_stages_send_small_batches_to_python(spark, stage):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, f"text number {i} of these") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    before = spark.conf.get(setting)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "table", lambda *_: labels)
        try:
            for given, most in ((10_000, 1000), (0, 1000), (300, 300)):
                spark.conf.set(setting, given)
                assert dict(corpus_pipeline.STAGES)[stage](spark, docs, "").count() <= 40
                rows = spark.range(2500).coalesce(1).mapInPandas(lambda frames: (f.head(1).assign(id=len(f)) for f in frames), "id long")
                assert max(r.id for r in rows.collect()) == most
        finally:
            spark.conf.set(setting, before)


def test_texts_that_meet_by_chance_are_not_joined(spark, monkeypatch):
    rng = random.Random(5)
    phrases = [" ".join(f"p{k}{i}" for i in range(5)) for k in range(8)]
    rows = []
    for i in range(80):  # two phrases that other texts have, too, among some 90 words of its own
        words = [f"w{rng.randrange(10**9)}" for _ in range(90)]
        rows.append((i, " ".join([*words[:30], phrases[i % 8], *words[30:60], phrases[(i + i // 8) % 8], *words[60:]])))
    rows += [(100 + i, text.rsplit(" ", 2 + i % 3)[0] + " end") for i, text in rows[:9]]  # these are near copies
    saved, save = {"shared": spark.range(99)}, shingle_dedup.save

    def record(df, name):
        out = save(df, name)
        saved[name] = out
        return out

    monkeypatch.setattr(shingle_dedup, "save", record)
    monkeypatch.setattr(shingle_dedup, "_simhash_pairs", lambda classes, most: spark.createDataFrame([], "a long, b long"))
    kept = shingle_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(80))
    assert 0 < saved["shared"].select("id").distinct().count() <= 18


def test_training_sends_weights_in_use_only(spark, monkeypatch):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, f"{rng.choice(['bad', 'worse']) if i % 2 else 'fine'} word {rng.randrange(50)}.") for i in range(400)], "doc_id long, text string")
    sent, collect = [], type(docs).collect

    def record(df):
        rows = collect(df)
        sent.extend(len(r.grad) for r in rows if "grad" in r)
        return rows

    monkeypatch.setattr(type(docs), "collect", record)
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic"))
    assert 0 < max(sent) < 10_000
    found = {r.doc_id: r.predicted for r in collect(toxicity.classify(docs, model))}
    assert found == {i: i % 2 for i in range(400)}


def test_simhash_chains_limit_no_pair(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(12):  # pairs on both sides of 0.8 and on it; what is like what is not told by the chain
        n = rng.choice([8, 22, 44, 104, 250])
        base = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        for k in range(5):
            cut = rng.choice([0, 1, (n - 4) // 5, (n - 4) // 5 + 1])
            words = [*base[cut:], *(f"e{rng.randrange(10**6)}" for _ in range(rng.choice([0, 0, 1])))]
            rows.append((10 * i + k, " ".join(words)))
    sets = [set(shingle_dedup.shingles(t, 5)) for _, t in rows]
    of = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if of[i] != of[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                of = [of[j] if x == of[i] else x for x in of]
    seen = []

    def one_chain(fps, most):
        out = fps.selectExpr("fp AS node", f"{-2**63} AS component")
        seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "link", one_chain)
    kept = shingle_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [min(d for (d, _), x in zip(rows, of) if x == k) for k in set(of)]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert seen[0] > len(want) > 12
