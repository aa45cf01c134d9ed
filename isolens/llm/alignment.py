"""Aligning the tokens of two tokenizers over the same bytes, by divide and conquer at shared cuts.

A cut is a byte offset where tokens of both sides end. An interval between cuts is divided at the cut
nearest to the middle of its tokens: tokens' ends from the middle outwards are looked up in the other
side's sorted ends by bisection, and both halves are divided in turn. An interval without a cut inside
is a leaf: one group of tokens that belong together. All intervals of one depth, of all texts of a
batch, take their steps together as numpy arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import save

#: Pair counts are broadcast up to this many rows; beyond it they are shuffled.
BROADCAST_PAIRS = 1_000_000
#: Bytes of text that are aligned at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def shared_cuts(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and in ``b`` of the ends that both have, in order.

    ``a`` and ``b`` are strictly ascending ends of tokens of one or more texts laid end to end; the
    texts' first tokens are at ``starts`` of ``a``, and the last ends of each text agree.
    """
    last = np.append(starts[1:], len(a)) - 1
    cuts, lo, hi = [last], starts.astype(np.int64), last.astype(np.int64)  # ends lo .. hi - 1 are inside, hi is the interval's own
    while True:
        inside = hi > lo
        lo, hi = lo[inside], hi[inside]
        if not len(lo):
            break
        at = np.full(len(lo), -1)
        middle, step, left = (lo + hi) // 2, 0, np.arange(len(lo))
        while len(left):
            for probe in (middle[left] - step, middle[left] + step) if step else (middle[left],):
                valid = (probe >= lo[left]) & (probe < hi[left]) & (at[left] < 0)
                k, p = left[valid], probe[valid]
                ends = a[p]
                met = np.searchsorted(b, ends)
                hit = (met < len(b)) & (b[np.minimum(met, len(b) - 1)] == ends)
                at[k[hit]] = p[hit]
            step += 1
            left = left[(at[left] < 0) & ((middle[left] - step >= lo[left]) | (middle[left] + step < hi[left]))]
        cut = at >= 0  # the others are leaves
        lo, hi, at = lo[cut], hi[cut], at[cut]
        cuts.append(at)
        lo, hi = np.concatenate([lo, at + 1]), np.concatenate([at, hi])
    in_a = np.sort(np.concatenate(cuts))
    return in_a, np.searchsorted(b, a[in_a])


@dataclass(frozen=True)
class _Side:
    """Ids of a batch of texts laid end to end: number by text, and the ends in bytes."""

    ids: np.ndarray
    n: np.ndarray
    ends: np.ndarray


def _side(ids: list, lengths: np.ndarray) -> _Side:
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
    return _Side(flat, np.array([len(x) for x in ids], np.int64), np.cumsum(lengths[flat]))


def _groups(a: _Side, b: _Side, cut_a: np.ndarray, cut_b: np.ndarray, words: list[str], of_b: int) -> tuple[list[str], np.ndarray]:
    """Each text's groups as ``a1,a2|b1;a3|b2``, and the number of its groups. ``words``: an id and the sign after it, four for each id."""
    last_a, last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    last_a[cut_a], last_b[cut_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    upto_a, upto_b = cut_a + 1, np.concatenate([[0], cut_b[:-1] + 1])
    order = np.empty(len(a.ids) + len(b.ids), np.int64)
    order[np.arange(len(a.ids)) + upto_b[group_a]] = 2 * a.ids + last_a
    order[np.arange(len(b.ids)) + upto_a[group_b]] = 2 * of_b + 2 * b.ids + last_b
    parts = list(map(words.__getitem__, order.tolist()))
    ends = np.cumsum(a.n + b.n)
    texts = ["".join(parts[i:j])[:-1] for i, j in zip(ends - a.n - b.n, ends, strict=True)]
    n = np.diff(np.searchsorted(cut_a, np.concatenate([[0], np.cumsum(a.n)])))
    return texts, n


class Aligner:
    """The two tokenizers on an executor: a byte-level table, which reads a blank and the text, and a piece table, which adds the blank."""

    def __init__(self, byte_path: str, piece_path: str):
        self.encode_a, table_a = vocab.byte_table(byte_path)
        self.encode_b, table_b = vocab.piece_table(piece_path)
        self.table_a, self.table_b = table_a, table_b
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (table_a, table_b))
        self.words = [f"{i}{s}" for i in range(len(table_a)) for s in ",|"] + [f"{i}{s}" for i in range(len(table_b)) for s in ",;"]

    def tokens(self, texts: list[str | None]) -> tuple[list, list]:
        """Ids on both sides; none where the text is null or empty, or the bytes of a side differ from the text's."""
        a: list = [()] * len(texts)
        b: list = [()] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        for i, ids_b in zip(full, self.encode_b([texts[i] for i in full]), strict=True):
            raw, ids_a = b" " + texts[i].encode(), self.encode_a(" " + texts[i])
            if b"".join(map(self.table_b.__getitem__, ids_b)) == raw and b"".join(map(self.table_a.__getitem__, ids_a.tolist())) == raw:
                a[i], b[i] = ids_a, ids_b
        return a, b

    def align(self, texts: list[str | None]) -> list[tuple]:
        """For each text: n_a, n_b, n_groups, groups, and its linked id pairs (as a * size of b's table + b) with how often it links them."""
        both = self.tokens(texts)
        some = [i for i in range(len(texts)) if len(both[0][i])]
        out: list[tuple] = [(0, 0, 0, "", [], [])] * len(texts)
        if not some:
            return out
        a, b = _side([both[0][i] for i in some], self.length_a), _side([both[1][i] for i in some], self.length_b)
        cut_a, cut_b = shared_cuts(a.ends, b.ends, np.cumsum(a.n) - a.n)
        groups, n = _groups(a, b, cut_a, cut_b, self.words, len(self.table_a))
        size = len(self.table_b)
        pair, upto = a.ids[cut_a] * size + b.ids[cut_b], np.cumsum(n)
        for i, text, n_a, n_b, k, end in zip(some, groups, a.n.tolist(), b.n.tolist(), n.tolist(), upto.tolist(), strict=True):
            pairs, times = np.unique(pair[end - k:end], return_counts=True)
            out[i] = (n_a, n_b, k, text, pairs, times)
        return out


ALIGNED = "n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>"


def align(docs: DataFrame, byte_path: str, piece_path: str, digest: bool = False, key: str = "doc_id") -> DataFrame:
    """Groups of tokens of both tokenizers that cover the same bytes, for every row.

    Side a is the byte-level table on a blank and the text, side b the piece table on the text, to which
    it adds the blank; strings of special tokens are plain text. A text that is null or empty, or whose
    tokens' bytes on either side differ from the blank and the text, has no tokens.

    One row for each row of ``docs``: ``key``, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2`` in decimal ids; with
    ``digest`` its SHA-256, '' without tokens), pairs (id pairs whose tokens end together, as a * size of
    b's table + b, ascending) and times (how often the text links each). Other columns are left out.
    """
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["key", "n_a", "n_b", "n_groups", "groups", "pairs", "times"]
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        for batch in batches:
            keys, texts = batch[0].to_pylist(), batch[1].to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size < BATCH_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                rows = aligner.align(texts[begin:end])
                if digest:
                    rows = [r[:3] + (r[3] and hashlib.sha256(r[3].encode()).hexdigest(),) + r[4:] for r in rows]
                cols = [keys[begin:end], *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)
                begin = end

    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind.simpleString()}, {ALIGNED}").withColumnRenamed("key", key)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``(pair, a, b, links, best)``: links of each id pair over all texts, and whether no pair of its b id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links"))
    counts = counts.select("pair", F.floor(F.col("pair") / size_b).cast("long").alias("a"), (F.col("pair") % size_b).alias("b"), "links")
    counts = save(counts, "pairs")
    highest = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(highest, "b").select("pair", "a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def link_support(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", digest: bool = True) -> DataFrame:
    """``align`` with how well the corpus supports each text's links.

    Adds n_links, n_best (links of pairs that their b id has most often in the corpus, ties included) and
    count_sum (over the links, the corpus's links of the same pair). Texts are read and encoded once; what
    that gives is written to the shared folder. Repeated rows keep their own row; an empty table gives none.
    """
    size_b = len(vocab.piece_table(piece_path)[1])
    rows = align(docs, byte_path, piece_path, digest, key).withColumn("row", F.monotonically_increasing_id())
    rows = save(rows, "aligned")
    counts = save(pair_counts(rows, size_b).select("pair", "links", "best"), "counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts.hint("merge")
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = each.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    out = rows.select("row", key, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups").join(sums, "row", "left")
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")], "groups")
