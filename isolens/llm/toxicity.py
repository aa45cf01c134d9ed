"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, text_of

SLOTS = 1 << 18
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]|[^.!?\n]+")
TERM = re.compile(r"[^\W\d_]+")
CACHE = 1 << 18


@dataclass
class Model:
    """Weight of each hashed term, and the logit of a sentence without any."""

    weights: np.ndarray
    bias: float


#: A word counts as itself and, so that inflected and compound forms share evidence, by its beginnings.
STEMS = (4, 5, 6)


class _Slots(dict):
    """Slots of a word and its beginnings; words seen lately are remembered."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        terms = [word, *(f"{word[:k]}-" for k in STEMS if len(word) >= k)]
        slots = self[word] = tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % SLOTS for t in terms)
        return slots


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence; an empty text is one empty sentence."""
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, 0)]


def _instances(texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, the distinct slots of its sentences one after the other, and how many each sentence has."""
    slots = _Slots()
    for text in texts:
        low, ids, sizes = text.lower(), [], []
        for part in SENTENCE.findall(low) or [""]:
            own = set().union(*map(slots.__getitem__, TERM.findall(part)))
            ids.extend(own)
            sizes.append(len(own))
        yield np.array(ids, np.int32), np.array(sizes, np.int32)


def _sentence_logits(model: Model, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(model.weights[ids], dtype=np.float64)])
    upto = np.cumsum(sizes)
    return model.bias + ends[upto] - ends[upto - sizes]


def _log_clean(z: np.ndarray) -> np.ndarray:
    """Log of the chance that a sentence with logit z does not offend."""
    return -np.logaddexp(0, z)


def training_bags(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """Bags ``(y, ids, sizes)`` of at most ``max_docs`` labelled documents, chosen by a hash of doc_id.

    Labels are aggregated per doc_id (1 if any says so; nulls dropped). The chosen labels are a
    table of bounded size, so they are sent to the texts and the texts stay where they are.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = save(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs), "labels")
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, sizes = zip(*_instances(f["text"])) if len(f) else ((), ())
            yield pd.DataFrame({"y": f["y"], "ids": ids, "sizes": sizes})

    return save(rows.mapInPandas(encode, "y int, ids array<int>, sizes array<int>"), "bags")


def _gradient(model: Model, bags: DataFrame, slots: np.ndarray) -> tuple[np.ndarray, float, int, int]:
    """Gradient of the log-likelihood over all bags, for the terms of ``slots`` (zero elsewhere). Each part sends only
    these to the driver, so what meets there is as many values as terms with a weight, times the parts."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grad, bias, n, pos = np.zeros(SLOTS), 0.0, 0, 0
        for f in frames:
            for y, ids, sizes in zip(f["y"], f["ids"], f["sizes"]):
                z = _sentence_logits(model, ids, sizes)
                clean = _log_clean(z)
                p = np.exp(z + clean)
                total = clean.sum()
                scale = np.exp(total) / max(-np.expm1(total), 1e-9) if y else -1.0
                dz = scale * p
                np.add.at(grad, ids, np.repeat(dz, sizes))
                bias, n, pos = bias + dz.sum(), n + 1, pos + y
        yield pd.DataFrame({"grad": [grad[slots].astype(np.float32).tobytes()], "bias": [bias], "n": [n], "pos": [pos]})

    rows = bags.mapInPandas(part, "grad binary, bias double, n long, pos long").collect()
    grad = np.zeros(SLOTS)
    for r in rows:
        grad[slots] += np.frombuffer(r.grad, np.float32)
    return grad, sum(r.bias for r in rows), sum(r.n for r in rows), sum(r.pos for r in rows)


def _slot_counts(bags: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each slot in at least ``least`` bags (else zero): bags that have it, and toxic ones among them."""
    each = bags.select("y", F.explode(F.array_distinct("ids")).alias("slot"))
    rows = each.groupBy("slot").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).where(F.col("n") >= least).collect()
    n, pos = np.zeros(SLOTS), np.zeros(SLOTS)
    for slot, a, b in rows:
        n[slot], pos[slot] = a, b
    return n, pos


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 20000, min_share: float = 0.003, rounds: int = 30, rate: float = 0.6,
          penalty: float = 2.0) -> Model:
    """Fit the sentence model so that the noisy-or over a document's sentences explains its label.

    A document offends if at least one sentence does: P = 1 - prod(1 - p_s), and p_s is logistic in
    the terms of the sentence. Training uses at most ``max_docs`` labelled documents (the stated
    bound; whole texts), spread over the executors; each round sums the gradient of all of them and
    takes one adaptive step. The start is the odds of a toxic label given the term, where they are four
    to one or better and six standard deviations from chance. Weights are never negative, as no other words excuse an offence, and a
    linear penalty, worth ``penalty`` documents, keeps chance terms at zero; terms in less
    than ``min_share`` of the documents, or fewer than five, get no weight. Without any labelled row, or with one kind of label only, the model scores every
    sentence near the label's share.
    """
    bags = training_bags(docs.select("doc_id", "text"), labels, max_docs)
    stats = bags.agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum(F.size("sizes")).alias("parts")).first()
    n, pos = stats.n, stats.pos or 0
    share = (pos + 0.5) / (n + 1)
    per_part = max(1e-6, min(0.5, -np.log1p(-min(share, 0.999)) * max(n, 1) / max(stats.parts or 1, 1)))
    model = Model(np.zeros(SLOTS, np.float32), float(np.log(per_part / (1 - per_part))))
    if not pos or pos == n:
        return model
    seen, toxic = _slot_counts(bags, max(5, int(min_share * n)))
    support = seen > 0
    slots = np.flatnonzero(support)
    given = (toxic + share) / (seen + 1)
    unlikely = toxic - seen * share >= 6 * np.sqrt(seen * share * (1 - share))
    weights = np.where(support & unlikely & (given >= 0.8), np.log(given / (1 - given)) - model.bias, 0)
    model = Model(weights.astype(np.float32), model.bias)
    first, second, bias_first, bias_second = np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0
    for k in range(1, rounds + 1):
        grad, bias, _, _ = _gradient(model, bags, slots)
        grad, bias = np.where(support, (grad - penalty) / n, 0), bias / n
        first, second = 0.8 * first + 0.2 * grad, 0.99 * second + 0.01 * grad * grad
        bias_first, bias_second = 0.8 * bias_first + 0.2 * bias, 0.99 * bias_second + 0.01 * bias * bias
        near, far, step = 1 - 0.8**k, 1 - 0.99**k, rate / k**0.5
        # the floor keeps the steps of terms with hardly any gradient short
        weights = np.maximum(0, weights + step * first / near / (np.sqrt(second / far) + 1 / n))
        model = Model(weights.astype(np.float32), float(model.bias + 2 * step * (bias_first / near) / (np.sqrt(bias_second / far) + 1 / n)))
    return model


def score(model: Model, text: str | Column = "text") -> Column:
    """Chance that a text offends: noisy-or over all of its sentences."""

    @F.pandas_udf(T.DoubleType())
    def noisy_or(texts: pd.Series) -> pd.Series:
        return pd.Series([-np.expm1(_log_clean(_sentence_logits(model, *x)).sum()) for x in _instances(texts)], dtype="float64")

    return noisy_or(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def judge(model: Model, least: float) -> Column:
    """Score of a text and the sentences whose own chance reaches ``least``, from one reading of the text."""

    @F.pandas_udf("score double, sentences array<struct<start:int,end:int,p:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        scores, spans = [], []
        for t, x in zip(texts, _instances(texts)):
            z = _sentence_logits(model, *x)
            scores.append(-np.expm1(_log_clean(z).sum()))
            p = np.exp(_log_clean(-z))
            hits = np.nonzero(p >= least)[0]
            where = sentences(t) if len(hits) else []
            spans.append([{"start": where[i][0], "end": where[i][1], "p": float(p[i])} for i in hits])
        return pd.DataFrame({"score": np.array(scores, float), "sentences": pd.Series(spans, dtype=object)})

    return run(text_of())


def classify(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` and the ``sentences`` (start, end, p) that offend, one row per input row.

    A null or empty text is one empty sentence. Null ids and repeated rows keep their own rows, an
    empty table gives an empty result, further columns are ignored. Texts are read whole, in batches.
    """
    judged = docs.select("doc_id", judge(model, least).alias("j")).select("doc_id", "j.score", "j.sentences")
    return judged.withColumn("predicted", (F.col("score") >= least).cast("int"))
