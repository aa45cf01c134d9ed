"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_of

CLASSES = 16
SEATS = 32  # per class: frequent words with a seat of their own; the last seat stands for all others
FEATURES = 1 << 14
HEAVY = 1 << 16
OTHER = SEATS - 1
BATCH = 8192
END = b"\n"  # no word holds a blank


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() + [END]


def word_class(word: bytes) -> int:
    """Class of any word by its ending, so words never seen have one too."""
    return zlib.crc32(word.rstrip(b".,;:!?")[-2:]) % CLASSES


@dataclass
class Model:
    """Weights and the counts of frequent words; its size does not grow with the corpus."""

    codes: dict[bytes, int]  # heavy word -> class * SEATS + seat, shifted left, plus its rank
    log_count: np.ndarray  # by rank: log10(c + 1)
    other_log: np.ndarray  # by class: log10 of the smoothed mass of all words without a seat
    by_class: np.ndarray  # FEATURES x CLASSES
    by_seat: np.ndarray  # FEATURES x SEATS, rows hashed from feature and class
    class_bias: np.ndarray
    seat_bias: np.ndarray  # CLASSES x SEATS


class _Codes(dict):
    """Code of a heavy word; other words give -1 - class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word.rstrip(b".,;:!?")[-2:]) % CLASSES  # as word_class, without the call


def count_words(docs: DataFrame, train: Column) -> DataFrame:
    """``(word, c)`` over all training texts; each task counts its texts first, in bounded memory."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[bytes] = Counter()
        for f in frames:
            for t in f["text"]:
                c.update(tokens(t))
                if len(c) > 300_000:
                    yield pd.DataFrame({"word": list(c), "c": list(c.values())})
                    c.clear()
        yield pd.DataFrame({"word": list(c), "c": list(c.values())})

    texts = docs.where(train).select(text_of().alias("text"))
    return save(texts.mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def _start(words: DataFrame) -> Model:
    """Model that equals class-factored unigrams: seats, biases, and counts of the heavy words."""
    heavy = words.orderBy(F.col("c").desc(), "word").limit(HEAVY).toArrow()
    names, counts = heavy.column("word").to_pylist(), heavy.column("c").to_numpy()
    mass = _class_masses(words)
    taken = np.zeros(CLASSES, np.int64)
    codes, class_n, class_v = {}, mass[:, 0].astype(float), mass[:, 1].astype(float)
    seat_n = np.zeros((CLASSES, SEATS))
    for rank, w in enumerate(names):
        k = word_class(w)
        seat = OTHER
        if taken[k] < OTHER:
            seat = int(taken[k])
            taken[k] += 1
            seat_n[k, seat] = counts[rank]
            class_n[k] -= counts[rank]
            class_v[k] -= 1
        codes[w] = (k * SEATS + seat) << 20 | rank
    seat_n[:, OTHER] = class_n
    free = np.arange(SEATS) >= taken[:, None]
    free[:, OTHER] = False
    prior = mass[:, 0] + 1.0
    return Model(
        codes, np.log10(counts + 1.0), np.log10(class_n + class_v + 1), np.zeros((FEATURES, CLASSES), np.float32),
        np.zeros((FEATURES, SEATS), np.float32), np.log(prior / prior.sum()).astype(np.float32),
        np.where(free, -60, np.log((seat_n + 0.5) / ((seat_n + 0.5) * ~free).sum(axis=1, keepdims=True))).astype(np.float32))


def _class_masses(words: DataFrame) -> np.ndarray:
    """Tokens and distinct words of each class."""
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((CLASSES, 2), np.int64)
        for f in frames:
            k = np.fromiter(map(word_class, f["word"]), np.int64, len(f))
            out[:, 0] += np.bincount(k, f["c"].to_numpy(), CLASSES).astype(np.int64)
            out[:, 1] += np.bincount(k, minlength=CLASSES)
        yield pd.DataFrame({"k": np.arange(CLASSES), "n": out[:, 0], "v": out[:, 1]})

    out = np.zeros((CLASSES, 2), np.int64)
    for k, n, v in words.mapInPandas(sums, "k int, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():
        out[k] = n, v
    return out


def _lay_out(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and seat of each code."""
    known = codes >= 0
    cell = np.where(known, codes >> 20, 0)
    return np.where(known, cell // SEATS, -1 - codes), np.where(known, cell % SEATS, OTHER)


def _features(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashed features of each position: the words one, two and three back, and the last two together.

    A word without a code is seen by its class. Positions before the text's start share one value.
    """
    h = np.where(codes >= 0, codes & 0xFFFFF, (1 << 20) - codes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    back = []
    for k in range(1, 4):
        p = np.empty_like(h)
        p[:k], p[k:] = 0, h[:-k] if k < len(h) else h[:0]
        back.append(np.where(at >= k, p, np.uint64(77)))
    both = (back[0] * np.uint64(31) + back[1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    rows = [(x + np.uint64(i * 0x51ED27)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(50) for i, x in enumerate([*back, both])]
    return np.stack(rows).astype(np.int32)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Rows of logits as probabilities. One shift serves all rows, unless some row lies too far below the others for floats."""
    ones = np.ones(x.shape[1], np.float32)
    y = x - x.max() if len(x) else x
    np.exp(y, out=y)
    sums = y @ ones
    if len(x) and not sums.min() >= 1e-8:
        y = np.exp(x - x.max(axis=1, keepdims=True))
        sums = y @ ones
    y *= (1 / sums)[:, None]
    return y


def _forward(m: Model, feats: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class probabilities, seat probabilities in the true class, and the hashed rows of the seat weights."""
    a = m.by_class.take(feats[0], axis=0)
    a += m.class_bias
    for f in feats[1:]:
        a += m.by_class.take(f, axis=0)
    rows = (feats[:2] * 7 + cls * 461) & (FEATURES - 1)
    b = m.seat_bias.take(cls, axis=0)
    for r in rows:
        b += m.by_seat.take(r, axis=0)
    return _softmax(a), _softmax(b), rows


def _batches(texts: Iterator[str], table: _Codes) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray]]:
    """Texts in groups of some 100,000 tokens: the tokens of each, all codes, and where each text starts."""
    group, size = [], 0
    for t in texts:
        group.append(tokens(t))
        size += len(group[-1])
        if size >= 100_000:
            yield _coded(group, size, table)
            group, size = [], 0
    if group:
        yield _coded(group, size, table)


def _coded(group: list[list[bytes]], size: int, table: _Codes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    codes = np.fromiter(map(table.__getitem__, chain.from_iterable(group)), np.int64, size)
    return group, codes, np.cumsum([0] + [len(d) for d in group[:-1]])


def _step(weights: np.ndarray, square: np.ndarray, used: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """Adaptive step on the rows that occur, whose uses are counted: their gradients are put in order by one sort and summed.

    Most rows occur once to three times, and those are summed side by side; only the others are worth a reduction each.
    """
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # short keys are sorted by radix
    sorted_rows = rows[order]
    first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    times, ids = np.diff(first, append=len(rows)), sorted_rows[first]
    sums = grad.take(order[first], axis=0)
    two, three, many = np.flatnonzero(times == 2), np.flatnonzero(times == 3), times > 3
    sums[two] += grad.take(order[first[two] + 1], axis=0)
    sums[three] += grad.take(order[first[three] + 1], axis=0) + grad.take(order[first[three] + 2], axis=0)
    if many.any():
        n = times[many]
        sums[many] = np.add.reduceat(grad.take(order[np.repeat(many, times)], axis=0), np.cumsum(n) - n, axis=0)
    total = square.take(ids) + np.einsum("ij,ij->i", sums, sums) / np.float32(sums.shape[1])
    square[ids] = total
    used[ids] += times
    sums *= (np.float32(rate) / np.sqrt(total + np.float32(1)))[:, None]  # a row seen once moves little
    weights[ids] = weights.take(ids, axis=0) - sums


def _train_round(model: Model, texts: DataFrame, rate: float) -> Model:
    """One round: every task descends over its texts; weights are averaged by how often a row was used."""
    chunk = FEATURES // 16

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _Codes(model.codes)
        m = Model(**{**model.__dict__, "by_class": model.by_class.copy(), "by_seat": model.by_seat.copy()})
        squares = np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32)
        used = np.zeros(FEATURES), np.zeros(FEATURES)
        for f in frames:
            for _, codes, starts in _batches(iter(f["text"]), table):
                cls, seat = _lay_out(codes)
                feats = _features(codes, starts)
                for at in range(0, len(codes), BATCH):
                    part = slice(at, at + BATCH)
                    c, s, ft = cls[part], seat[part], feats[:, part]
                    pa, pb, rows = _forward(m, ft, c)
                    i = np.arange(len(c))
                    pa[i, c] -= 1
                    pb[i, s] -= 1
                    for r in ft:
                        _step(m.by_class, squares[0], used[0], r, pa, rate)
                    for r in rows:
                        _step(m.by_seat, squares[1], used[1], r, pb, rate)
        for k, (w, old, n) in enumerate(((m.by_class, model.by_class, used[0]), (m.by_seat, model.by_seat, used[1]))):
            for j in range(16):
                rows = slice(j * chunk, (j + 1) * chunk)
                if n[rows].any():
                    yield pd.DataFrame({"part": [k * 16 + j], "moved": [((w - old)[rows] * n[rows, None]).astype(np.float32).tobytes()], "n": [n[rows].astype(np.float64).tobytes()]})

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moved, n = 0, 0
        for f in frames:
            for a, b in zip(f["moved"], f["n"]):
                moved, n = moved + np.frombuffer(a, np.float32).astype(np.float64).reshape(chunk, -1), n + np.frombuffer(b, np.float64)
        mean = moved / np.maximum(n, 1)[:, None]
        yield pd.DataFrame({"part": [key[0]], "mean": [mean.astype(np.float32).tobytes()]})

    moves = texts.mapInPandas(local, "part int, moved binary, n binary").groupBy("part").applyInPandas(add, "part int, mean binary").collect()
    new = [model.by_class.copy(), model.by_seat.copy()]
    for r in moves:
        k, j = divmod(r.part, 16)
        new[k][j * chunk:(j + 1) * chunk] += np.frombuffer(r.mean, np.float32).reshape(chunk, -1)
    return Model(**{**model.__dict__, "by_class": new[0], "by_seat": new[1]})


def train(docs: DataFrame, words: DataFrame, train_on: Column, rounds: int = 2, rate: float = 0.3) -> Model:
    """Fit the model in one pass over all training texts, dealt to ``rounds`` rounds by a hash of the text.

    P(word | before) = P(class | before) * P(seat | class, before), and words without a seat share
    the last seat of their class by their smoothed counts. Both softmaxes are maximum-entropy models
    over hashed features: the words one to three back (skips) and the last pair. In a round, each
    task takes adaptive gradient steps over its own texts from the common weights; the moves are
    averaged row by row, weighted by use, and the next round starts from there.
    """
    model = _start(words)
    texts = docs.where(train_on).select(text_of().alias("text"))
    for k in range(rounds):
        model = _train_round(model, texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k), rate)
    return model


def score(docs: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) over the tokens, exact for all words:
    the counts of the most frequent words are part of the model (a fixed number of them), those of
    the others are joined to the texts' rare words. ``score`` is log10 of the model's probability of
    the text. An empty or null text is its end token alone; repeated rows and null ids keep their
    rows; an empty training set knows no word; further columns are ignored.
    """
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _Codes(model.codes)
        for f in frames:
            done = 0
            for group, codes, starts in _batches(iter(f["text"]), table):
                cls, seat = _lay_out(codes)
                feats, logs = _features(codes, starts), np.empty(len(codes))
                for at in range(0, len(codes), BATCH):
                    part = slice(at, at + BATCH)
                    pa, pb, _ = _forward(model, feats[:, part], cls[part])
                    i = np.arange(len(pa))
                    logs[part] = np.log10(np.maximum(pa[i, cls[part]], 1e-30)) + np.log10(np.maximum(pb[i, seat[part]], 1e-30))
                heavy = codes >= 0
                count_log = np.where(heavy, model.log_count[codes & 0xFFFFF * heavy], 0.0) if len(model.log_count) else np.zeros(len(codes))
                shared = seat == OTHER
                logs[shared] += count_log[shared] - model.other_log[cls[shared]]
                words_here, at_rare = list(chain.from_iterable(group)), np.flatnonzero(~heavy)
                ends = np.searchsorted(at_rare, np.append(starts, len(codes)))
                rare_words = [words_here[i] for i in at_rare.tolist()]
                rare = [Counter(rare_words[a:b]) for a, b in zip(ends, ends[1:])]
                out = pd.DataFrame({
                    "doc_id": f["doc_id"].iloc[done:done + len(group)].array, "n_tokens": [len(d) for d in group],
                    "heavy": np.add.reduceat(heavy.astype(np.int64), starts), "base": np.add.reduceat(count_log, starts),
                    "score": np.add.reduceat(logs, starts), "rare": [list(r) for r in rare], "times": [list(r.values()) for r in rare]})
                done += len(group)
                yield out

    kind = dict(docs.dtypes)["doc_id"]
    # ids travel as text, since a null would turn them into floats
    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).mapInPandas(
        run, "doc_id string, n_tokens long, heavy long, base double, score double, rare array<binary>, times array<int>")
    rows = save(made.withColumns({"rid": F.monotonically_increasing_id(), "doc_id": F.col("doc_id").cast(kind)}), "scored")
    each = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("rid", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    found = each.join(words, "word").groupBy("rid").agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("log"))
    both = rows.drop("rare", "times").join(found, "rid", "left")
    log = F.coalesce("log", F.lit(0.0))
    return both.select(
        "doc_id", "n_tokens", (F.col("heavy") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(float(np.log10(totals.n + totals.v + 1)))).alias("base_score"),
        (F.col("score") + log).alias("score"))
