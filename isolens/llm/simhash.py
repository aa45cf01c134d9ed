"""SimHash near-duplicates by generalised pigeonhole search over fingerprints."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, save, text_of, text_key

BITS = 64


def shingle_hashes(text: str, ngram: int) -> np.ndarray:
    """XXH64 hashes of the shingles of a text, repeats included; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(min(ngram, len(words))))))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def majority(h: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashes: the bits set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[part:part + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprint(text: str, ngram: int) -> int:
    """Signed 64-bit SimHash over the shingles of a text, repeats included."""
    return majority(shingle_hashes(text, ngram))


def with_fingerprint(docs: DataFrame, ngram: int, name: str = "fp") -> DataFrame:
    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, ngram) for t in texts], dtype="int64")

    return docs.withColumn(name, fp(text_of()))


def _bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, over all of them, how often each pair of bits is set together."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for f in frames:
            bits = np.unpackbits(f["fp"].to_numpy(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += bits.T @ bits
            n += len(f)
        yield pd.DataFrame({"i": np.arange(BITS * BITS), "s": both.ravel(), "n": n})

    rows = fps.select("fp").mapInPandas(moments, "i int, s double, n long").groupBy("i").agg(F.sum("s"), F.sum("n")).collect()
    both, n = np.zeros(BITS * BITS), 0
    for i, s, count in rows:
        both[i], n = s, count
    return n, both.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Split the bits into parts of nearly equal width so that correlated bits share a part.

    Each part starts with the open bit that is most correlated with another one and takes the bits
    with the largest correlation with those it has.
    """
    p = np.diag(both) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev)
    np.fill_diagonal(corr, 0)
    open_bits, groups = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        seed = max(open_bits, key=lambda b: corr[b, open_bits].max())
        group = [seed]
        open_bits.remove(seed)
        while len(group) < width:
            best = max(open_bits, key=lambda b: corr[b, group].sum())
            group.append(best)
            open_bits.remove(best)
        groups.append(sorted(group))
    return groups


def _near(p: np.ndarray, most: int) -> list[float]:
    """Chance that two random fingerprints differ in at most 0, 1, ... ``most`` of the given bits."""
    dist = np.zeros(len(p) + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return list(np.cumsum(dist)[: most + 1])


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def allocate(both: np.ndarray, n: int, most: int, parts: range = range(1, 9), row_cost: float = 1.0, pair_cost: float = 0.1) -> list[tuple[list[int], int]]:
    """Parts of bits with their thresholds: thresholds sum up to ``most - parts + 1``.

    Two fingerprints within ``most`` bits are within the threshold in at least one part (general
    pigeonhole; -1 leaves a part out). For each number of parts, dynamic programming over the parts
    finds the thresholds with the least cost: signature rows that have to be made, and candidate
    pairs as estimated from the bit frequencies of all fingerprints. The cheapest number wins.
    """
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in parts:
        groups, total = group_bits(both, n, m), most - m + 1
        if total < -m:
            continue
        # state: sum of thresholds so far -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            near = _near(p[g], most)
            step: dict[int, tuple[float, list[int]]] = {}
            for so_far, (cost, chosen) in states.items():
                for t in range(-1, most + 1):
                    rows = 0 if t < 0 else n * (_ball(len(g), t - t // 2) + _ball(len(g), t // 2))
                    pairs = 0 if t < 0 else n * (n - 1) / 2 * near[min(t, len(near) - 1)]
                    c = cost + row_cost * rows + pair_cost * pairs
                    if so_far + t not in step or c < step[so_far + t][0]:
                        step[so_far + t] = (c, [*chosen, t])
            states = step
        cost, chosen = states[total]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _signatures(fps: DataFrame, plan: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """Rows ``(part, sig, fp)``: the values of a part within the radius of this side."""
    sides = []
    for k, (bits, t) in enumerate(plan):
        radius = t - t // 2 if probe else t // 2
        masks = [1 << (63 - b) for b in bits]
        whole = sum(masks)
        flips = [0]
        for r in range(1, radius + 1):
            flips += [sum(c) for c in itertools.combinations(masks, r)]
        signed = [f - (1 << 64) if f >> 63 else f for f in flips]
        keep = whole - (1 << 64) if whole >> 63 else whole
        value = F.col("fp").bitwiseAND(F.lit(keep))
        flipped = F.transform(F.array(*[F.lit(f) for f in signed]), lambda f: value.bitwiseXOR(f))
        sides.append(F.transform(flipped, lambda v: F.struct(F.lit(k).alias("part"), v.alias("sig"))))
    return fps.select(F.explode(F.concat(*sides)).alias("s"), "fp").select("s.part", "s.sig", "fp")


def link(fps: DataFrame, most: int) -> DataFrame:
    """Components of distinct fingerprints (``fp``) that are chained by links of at most ``most`` bits.

    Probe rows meet index rows with the same part and signature. In each such bucket everything is
    first compared with one centre only. What is linked to the centre is connected, so pairs inside
    that set are skipped; every other probe-index pair of the bucket is compared too, so no
    connection is lost, and a large group of near copies does not turn into all its pairs.

    Returns ``(node, component)`` for fingerprints with a link; component is the smallest fingerprint.
    """
    n, both = _bit_moments(fps)
    plan = allocate(both, n, most)
    probe = _signatures(fps, plan, True)
    index = _signatures(fps, plan, False)

    def bits(a: str, b: str):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))

    key = ["part", "sig"]
    centres = index.groupBy(*key).agg(F.min("fp").alias("centre"))
    star = save(probe.join(centres, key).where("fp != centre").select(*key, "fp", "centre", (bits("fp", "centre") <= most).alias("near")), "star")
    # index rows of buckets in which something besides the centre is probed; an index row is a probe row of its bucket too
    members = index.join(star.select(*key).distinct(), key, "left_semi")
    near = star.select(*key, "fp", "near")
    loose = near.where("not near")
    member_rows = members.join(near.withColumnRenamed("near", "m_near"), [*key, "fp"], "left").select(
        *key, F.col("fp").alias("member"), F.coalesce("m_near", F.lit(False)).alias("m_near"), F.col("m_near").isNull().alias("is_centre"))
    member_rows = save(member_rows.where("not is_centre"), "members")
    one = loose.join(member_rows.select(*key, "member"), key).where("fp != member")
    two = near.where("near").join(member_rows.where("not m_near").select(*key, "member"), key).where("fp != member")
    pairs = one.select("fp", "member").unionByName(two.select("fp", "member")).where(bits("fp", "member") <= most)
    edges = star.where("near").select("fp", F.col("centre").alias("member")).unionByName(pairs)
    return components(edges, "fp", "member")


def near_duplicates(docs: DataFrame, ngram: int = 4, most: int = 4) -> DataFrame:
    """Near-duplicate classes of documents whose SimHash differs in at most ``most`` bits, chained.

    Words are runs of anything but ASCII blanks, ASCII letters lower-cased; shingles of ``ngram``
    words with repeats (a shorter text is one shingle) are hashed by XXH64 with seed 42; a bit is set
    if it is set in over half of the hashes. Texts are fingerprinted once in Arrow batches; all that
    follows works on distinct fingerprints.

    Returns one row per input row: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the
    smallest doc_id of the class. Texts without words, null ones too, have fingerprint zero, which
    links like any other. A null doc_id names a class only if it has no other id. Repeated rows keep
    their own rows; an empty table gives an empty result; further columns are ignored.
    """
    rows = save(with_fingerprint(docs.select("doc_id", "text"), ngram).select("doc_id", "fp"), "fingerprints")
    of = save(link_classes(rows, most), "classes")
    return rows.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def link_classes(rows: DataFrame, most: int) -> DataFrame:
    """``(fp, class, component_id)`` for every fingerprint of ``rows`` (``doc_id, fp``); class is the smallest fingerprint."""
    fps = save(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    comp = link(fps.select("fp"), most)
    named = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    ids = named.groupBy("class").agg(F.min("low").alias("component_id"))
    return named.select("fp", "class").join(ids, "class").select("fp", "class", "component_id")


def keep_one(docs: DataFrame, ngram: int = 5, most: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, all columns kept.

    The row with the smallest doc_id stays (null last); rows that tie in doc_id are ordered by a hash
    of their text, and of rows that repeat both, one stays.
    """
    packed = with_fingerprint(docs.select(F.struct("*").alias("doc"), "doc_id", "text"), ngram)
    rows = packed.select("doc_id", text_key(text_of()).alias("tk"), "fp")
    rows = save(rows, "fingerprints")
    classes = save(link_classes(rows, most), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tk")
    best = rows.join(classes, "fp").groupBy("class").agg(F.min(order).alias("best")).select("best.doc_id", "best.tk")
    full = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("d"), text_key(text_of()).alias("k"))
    kept = full.join(best, full.d.eqNullSafe(best.doc_id) & (full.k == best.tk), "left_semi")
    return kept.groupBy("d", "k").agg(F.first("doc").alias("doc")).select("doc.*")
