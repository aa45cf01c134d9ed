"""Packing, token alignment and the conversation trie: brute force, round trips, edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isolens.llm import alignment, packing, prefix_trie, vocab
from isolens.session import ship

BYTES, PIECES = vocab.public_path("byte_bpe_50k.json"), vocab.public_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, key string, ids string, tokens int, start int, groups string, pair int, row int"
TEXTS = [
    None, "", "", " ", "x", "x", "two words", " leading", "trailing \n\n ", "a<|endoftext|>b <s>[INST]</s> <unk>", "tab\tand\x00null\x0bchars", "Ünï ñ 世界 🙂🏽 ﬁ ½", "▁under ▁",
    "é vs é", "123456 7,8.9", "z" * 3000, "lorem ipsum dolor " * 900, " " * 300 + "end", "\r\n" * 40, "don't we'll I'M",
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rng = random.Random(11)
    words = ["ba", "kora", "tion", "schule", "été", "the", "of", "2024", "--", "zß"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    rows = [(None if i % 17 == 5 else i % 70, t, "k", "i", 1, 2, "g", 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3), [(r[0], r[1]) for r in rows]


def own_ids(text, plain):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(BYTES)
    t.encode_special_tokens = plain
    return t.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_files_own_library():
    encode, table = vocab.byte_table(BYTES)
    for text in [t for t in TEXTS if t] + [" " * 100_001 + "x", "a\n" * 60_000]:
        for special in (False, True):
            assert encode(text, special).tolist() == own_ids(text, not special)
        assert b"".join(table[i] for i in encode(text).tolist()) == text.encode()


def pieces_by_row(rows):
    rows_of = collections.defaultdict(list)
    for r in rows:
        rows_of[r.sequence_id].append(r)
    for seq in rows_of.values():
        seq.sort(key=lambda r: r.offset)
        at = 0
        for r in seq:
            assert r.offset == at and r.length > 0
            at += r.length
    return rows_of


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(128, 3), packing.Limits(64, 64, 40), packing.Limits(7, 2, 3)])
def test_documents_are_cut_into_full_rows(docs, limits):
    df, rows = docs
    got = packing.pack_documents(df, BYTES, limits).collect()
    for seq in pieces_by_row(got).values():
        n = sum(r.length for r in seq)
        assert n == limits.tokens or n & (n - 1) == 0 and n < limits.tokens
        assert len(seq) <= limits.segments
        assert sum(r.length - 1 for r in seq) <= (limits.tokens if limits.loss is None else limits.loss)
    parts = collections.defaultdict(list)
    for r in got:
        parts[r.doc_id, r.tokens].append((r.start, bytes(r.ids)))
    want = collections.defaultdict(list)
    for d, t in rows:
        ids = np.array((own_ids(t, False) if t else []) + [1], "<u4").tobytes()
        want[d, len(ids) // 4].append(ids)
    assert parts.keys() == want.keys()
    for k, copies in want.items():
        left = sorted(parts[k])
        assert sum(len(x) for _, x in left) == sum(map(len, copies))
        if len(copies) == 1:
            assert b"".join(x for _, x in left) == copies[0] and [s for s, _ in left] == list(np.cumsum([0] + [len(x) // 4 for _, x in left[:-1]]))


def best_fit(examples, limits):
    """Rows of whole examples by the definition, over a pool that holds them all."""
    cap = np.array([limits.tokens, limits.segments, limits.loss], float)
    left, rows = dict(enumerate(examples)), []
    while left:
        room, row = cap.copy(), []
        while True:
            fits = [(sum((np.array(d) / cap) * (room / cap)), -k) for k, d in left.items() if all(np.array(d) <= room)]
            if not fits:
                break
            k = -max(fits)[1]
            row.append(k)
            room -= left.pop(k)
        rows.append(row)
    return rows


def test_whole_examples_follow_the_dot_product(spark):
    ship(spark)
    rng = random.Random(3)
    sizes = [(rng.randint(1, 50), rng.random()) for _ in range(150)]
    rows = []
    for i, (n, share) in enumerate(sizes):
        rows.append((i, list(range(n)), [rng.random() < share for _ in range(n)]))
    limits = packing.Limits(64, 4, 24)
    fine = [(i, (len(m), 1, sum(m[1:]))) for i, _, m in rows if sum(m[1:]) <= limits.loss]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, mask array<boolean>").coalesce(1)
    got = packing.pack_examples(df, limits, loss="mask").collect()
    assert {r.doc_id for r in got if r.sequence_id is None} == {i for i, _, m in rows if sum(m[1:]) > limits.loss}
    have = [[r.doc_id for r in seq] for k, seq in sorted(pieces_by_row([r for r in got if r.sequence_id is not None]).items())]
    want = [[fine[k][0] for k in row] for row in best_fit([d for _, d in fine], limits)]
    assert sorted(map(sorted, have)) == sorted(map(sorted, want))
    for row in have:
        assert sum(sum(rows[i][2][1:]) for i in row) <= limits.loss and len(row) <= limits.segments
    cut = packing.pack_examples(df, limits, cut=True, loss="mask").collect()
    for seq in pieces_by_row(cut).values():
        assert sum(sum(rows[r.doc_id][2][r.start + 1:r.start + r.length]) for r in seq) <= limits.loss
    assert sum(r.length for r in cut) == sum(n for n, _ in sizes)
    odd = spark.createDataFrame([(1, None, None), (None, [], []), (2, [5, 6], None)], "doc_id long, ids array<int>, mask array<boolean>")
    got = {(r.doc_id, r.length, r.sequence_id is None) for r in packing.pack_examples(odd, limits, loss="mask").collect()}
    assert got == {(1, 0, True), (None, 0, True), (2, 2, False)}


def test_crc_of_pieces(docs):
    from pyspark.sql import functions as F

    for r in packing.pack_documents(docs[0], BYTES).withColumn("crc", F.crc32("ids")).collect():
        assert r.crc == zlib.crc32(bytes(r.ids))


ends = st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=5)


@settings(max_examples=150, deadline=None)
@given(ends, st.randoms())
def test_shared_cuts(texts, rng):
    a, b, starts, base = [], [], [], 0
    for lengths in texts:
        starts.append(len(a))
        own = np.cumsum(lengths)
        other = sorted({x for x in range(1, own[-1]) if rng.random() < 0.4} | {int(own[-1])})
        a += (own + base).tolist()
        b += [x + base for x in other]
        base += int(own[-1])
    in_a, in_b = alignment.shared_cuts(np.array(a), np.array(b), np.array(starts))
    assert [a[i] for i in in_a] == sorted(set(a) & set(b)) == [b[i] for i in in_b]


def brute_alignment(rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table_a, table_b = vocab.byte_table(BYTES)[1], vocab.piece_table(PIECES)[1]
    counts, each = collections.Counter(), []
    for d, t in rows:
        a, b = (own_ids(" " + t, True), model.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if b"".join(table_a[i] for i in a) != raw or b"".join(table_b[i] for i in b) != raw:
            each.append((d, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(table_a[i]) for i in a]).tolist(), np.cumsum([len(table_b[i]) for i in b]).tolist()
        links, groups, i, j = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            links.append((a[m - 1], b[n - 1]))
            i, j = m, n
        counts.update(links)
        each.append((d, len(a), len(b), links, ";".join(groups)))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(d, n_a, n_b, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), text) for d, n_a, n_b, x, text in each]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_alignment(docs, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    df, rows = docs
    want = brute_alignment(rows)
    assert sum(x[1] == 0 for x in want) >= 3 and sum(x[1] for x in want) > 3000
    got = alignment.link_support(df, BYTES, PIECES, digest=False).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    if broadcast:
        hashed = alignment.link_support(df, BYTES, PIECES).collect()
        sha = lambda t: t and hashlib.sha256(t.encode()).hexdigest()
        assert collections.Counter(map(tuple, hashed)) == collections.Counter((*x[:-1], sha(x[-1])) for x in want)


def late(v, low):
    return (v is not None, low if v is None else v)


def brute_trie(rows, every=100, heads=6):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((late(turn, 0), role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    members, stop = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % heads if heads else 0
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        path = tuple(convs.get(base, [])[:h] + convs[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        stop[path].append(c)
    below = collections.Counter()
    leaves, kids = collections.Counter(), collections.Counter(p[:-1] for p in members if p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            below[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += kids[p] == 0
    return {(m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], below[p], hashlib.sha256(",".join(map(str, stop[p])).encode()).hexdigest()) for p, m in members.items()}


TURNS = "conv_id long, turn long, role string, text string, t int, pos int, depth int, n_convs int, prior string"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "p") for r in rows], TURNS).repartition(4)


def found_trie(df, width=prefix_trie.WIDTH):
    nodes, ends = prefix_trie.prefix_trie(prefix_trie.grafted(prefix_trie.turn_ids(df)), width)
    rows = prefix_trie.with_end_digest(nodes, ends)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in rows.select(names).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("width", [1, 3, 4])
def test_trie(spark, monkeypatch, width):
    ship(spark)
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rng = random.Random(5)
    rows = [(None, 1, "user", "nobody"), (0, None, None, None), (0, 5, "user", "hi"), (0, 2, "", ""), (300, 1, "user", "hi"), (300, 1, "user", "hi"), (-7, 1, "a", "neg"), (-7, 2, "a", "é🙂"), (-107, 3, "a", "neg")]
    rows += [(500 + c, 1, "user", "short") for c in range(1, 40)]  # no conversation 500: many end before their own turns
    for c in range(1, 60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", rng.choice(["yes", "no", "maybe so"])))
    for c in (100, 101, 102, 103, 200):
        for t in range(37):
            rows.append((c, t, "user", f"turn {t}" if c < 103 or t < 20 else f"other {t}"))
    assert found_trie(turn_frame(spark, rows), width) == brute_trie(rows)


def test_trie_ties_and_empty(spark):
    ship(spark)
    tied = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 1, "user", "a"), (2, 1, "user", "b"), (2, 1, "user", "a")]
    rows = prefix_trie.turn_ids(turn_frame(spark, tied)).collect()
    assert sorted(r.pos for r in rows if r.conv_id == 1) == [1, 2, 3]
    assert [r.t for r in sorted(rows, key=lambda r: r.pos) if r.conv_id == 1] == [r.t for r in sorted(rows, key=lambda r: r.pos) if r.conv_id == 2]
    nodes, ends = prefix_trie.prefix_trie(prefix_trie.turn_ids(turn_frame(spark, tied)))
    assert nodes.count() == 4 and {(r.conv_id, r.node) for r in ends.collect()} == {(1, 1), (2, 1)}
    assert found_trie(turn_frame(spark, tied).limit(0)) == set()
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(empty, BYTES).count() == 0
    assert alignment.link_support(empty, BYTES, PIECES).count() == 0
