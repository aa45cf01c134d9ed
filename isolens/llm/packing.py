"""Packing token sequences into training rows under several limits at once (vector bin packing).

An example has three demands: tokens, segments (1 for each piece) and loss-bearing tokens. Of the examples
at hand the open row takes the one whose demands point most in the direction of the room that is
left: the largest dot product of demands and room, both as shares of the limits, among those that fit.
Each partition is packed as it streams by, over a bounded pool of examples, so no row is shuffled and
none waits for another task. Row ids hold the partition's number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import text_of

#: Examples, and tokens of them, that a task holds while it packs.
POOL, POOL_TOKENS = 192, 1 << 22
#: Pieces, and tokens of them, handed over in one Arrow batch.
BATCH, BATCH_TOKENS = 4096, 1 << 20


@dataclass(frozen=True)
class Limits:
    """What a row may hold: ``loss`` is the number of tokens that bear loss (``None``: as many as tokens)."""

    tokens: int = 2048
    segments: int = 64
    loss: int | None = None

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.tokens if self.loss is None else self.loss], np.float64)


class _Example:
    """An example, and how far it has been placed. ``upto[i]``: loss-bearing tokens among the first i."""

    __slots__ = ("key", "ids", "start", "upto")

    def __init__(self, key, ids: np.ndarray, mask: np.ndarray | None):
        self.key, self.ids, self.start = key, ids, 0
        self.upto = None if mask is None else np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])

    def left(self) -> int:
        return len(self.ids) - self.start

    def loss(self, length: int) -> int:
        """Loss-bearing tokens of the next piece; its first token has nothing before it and bears none."""
        if self.upto is None:
            return max(0, length - 1)
        return int(self.upto[self.start + length] - self.upto[min(self.start + 1, self.start + length)])

    def most(self, tokens: int, loss: float) -> int:
        """Length of the longest next piece within both limits."""
        n = min(tokens, self.left())
        if self.loss(n) <= loss:
            return n
        if self.upto is None:
            return int(loss) + 1
        return int(np.searchsorted(self.upto[self.start + 1:], self.upto[self.start + 1] + loss, "right"))


class Packer:
    """Places examples in rows; ``rows`` gives each finished one as a list of (example, start, length)."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut, self.size = limits.vector, cut, limits.tokens
        self.pool: list[_Example | None] = [None] * POOL
        self.demand = np.full((POOL, 3), np.inf)
        self.free = list(range(POOL))[::-1]
        self.tokens = 0
        self._open()

    def _open(self) -> None:
        self.row: list[tuple[_Example, int, int]] = []
        self.room = self.limits.copy()

    def full(self) -> bool:
        return not self.free or self.tokens >= POOL_TOKENS

    def add(self, e: _Example) -> None:
        if not self.free:  # pieces that a row gave back
            self.pool.append(None)
            self.demand = np.vstack([self.demand, np.full((1, 3), np.inf)])
            self.free.append(len(self.pool) - 1)
        k = self.free.pop()
        self.pool[k] = e
        self._note(k)
        self.tokens += e.left()

    def _note(self, k: int) -> None:
        e = self.pool[k]
        self.demand[k] = (e.left(), 1, e.loss(e.left()))

    def _best(self) -> tuple[int, bool] | None:
        """The slot to place from next, and whether all of it fits."""
        held = np.isfinite(self.demand[:, 0])
        if not held.any() or (self.room < (1, 1, 0)).any():
            return None
        fits = held & (self.demand <= self.room).all(axis=1)
        among = fits if fits.any() else held if self.cut else None
        if self.cut and not self.row and (long := held & (self.demand[:, 0] >= self.size)).any():
            among = long  # a row of its own, without any room left
        if among is None:
            return None
        k = np.flatnonzero(among)
        use = np.minimum(self.demand[k], self.room) / self.limits
        best = k[np.argmax(use @ (self.room / self.limits))]
        return int(best), bool(fits[best])

    def _place(self, k: int, length: int) -> None:
        e = self.pool[k]
        self.room -= (length, 1, e.loss(length))
        self.row.append((e, e.start, length))
        e.start += length
        self.tokens -= length
        if e.left():
            self._note(k)
        else:
            self.pool[k] = None
            self.demand[k] = np.inf
            self.free.append(k)

    def _close(self) -> list[tuple[_Example, int, int]]:
        """The open row; if it may be cut and isn't full, no more of it than a power of two, and the rest goes back."""
        row, n = self.row, sum(x[2] for x in self.row)
        over = n - (1 << (n.bit_length() - 1)) if self.cut and n < self.size else 0
        while over:
            e, start, length = row.pop()
            back = min(over, length)
            over -= back
            if length > back:
                row.append((e, start, length - back))
            at = next((k for k, x in enumerate(self.pool) if x is e), None)
            e.start = start + length - back
            if at is None:
                self.add(e)
            else:
                self.tokens += back
                self._note(at)
        self._open()
        return row

    def rows(self, last: bool) -> Iterator[list[tuple[_Example, int, int]]]:
        """Finished rows, until the pool wants more examples or, if these were the last, is empty."""
        while True:
            best = self._best()
            if best is None and not self.row:
                return
            if best is None and not self.tokens and not last:
                return
            if best is None:
                yield self._close()
                continue
            k, whole = best
            e = self.pool[k]
            length = e.left() if whole else e.most(int(self.room[0]), self.room[2])
            if length:
                self._place(k, length)
            if not length or self.room[0] < 1:
                yield self._close()
            if not last and not self.full():
                return


PIECE = "start long, length long, tokens long, sequence_id long, offset long, ids binary"


def _batch(pieces: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*pieces, strict=True))
    kinds = [key, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["key", "start", "length", "tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _packed(examples: Iterator[tuple], limits: Limits, cut: bool, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Pieces of one partition's (key, ids, mask) triples."""
    packer, out, held = Packer(limits, cut), [], 0
    number = TaskContext.get().partitionId() << 36

    def drawn(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal out, held, number
        for row in packer.rows(last):
            offset = 0
            for e, start, length in row:
                out.append((e.key, start, length, len(e.ids), number, offset, e.ids[start:start + length].astype("<u4").tobytes()))
                offset += length
            held += offset
            number += 1
            if len(out) >= BATCH or held >= BATCH_TOKENS:
                yield _batch(out, key)
                out, held = [], 0

    for k, ids, mask in examples:
        e = _Example(k, ids, mask)
        if not cut and (e.left() > limits.vector[0] or e.loss(e.left()) > limits.vector[2]):
            out.append((k, 0, len(ids), len(ids), None, None, ids.astype("<u4").tobytes()))
            continue
        if not len(ids):
            out.append((k, 0, 0, 0, None, None, b""))
            continue
        packer.add(e)
        if packer.full():
            yield from drawn(False)
    yield from drawn(True)
    if out:
        yield _batch(out, key)


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end: int = 1, key: str = "doc_id") -> DataFrame:
    """All documents as token ids, cut into the pieces of training rows.

    A document is its ids by the byte-level table at ``path`` (strings of special tokens count as those
    tokens), then ``end``; a null or empty text is ``end`` alone. Documents may be cut anywhere, and each
    id is in one piece. A row ends at ``limits.tokens``, or at the highest power of two below it that
    its limits and the rest of the partition allow, so that rows need no padding; one partition ends in
    at most one row of each power. All but the first token of a piece bear loss.

    One row for each piece: ``key``, start (the document's ids before it), length, tokens (ids of the
    document), sequence_id, offset (ids before it in the row), ids (little-endian unsigned 32-bit).
    Repeated rows are packed each on its own; an empty table gives no piece; other columns are left out.
    """
    kind = docs.schema[key].dataType
    arrow = pa.schema([("k", _arrow_type(docs, key))]).field(0).type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = vocab.byte_table(path)
        last = np.array([end], np.uint32)
        examples = ((k, np.concatenate([encode(t, True), last]), None) for b in batches for k, t in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True))
        return _packed(examples, limits, True, arrow)

    rows = docs.select(F.col(key).alias("key"), text_of().alias("text"))
    return rows.mapInArrow(pack, f"key {kind.simpleString()}, {PIECE}").withColumnRenamed("key", key)


def pack_examples(examples: DataFrame, limits: Limits, cut: bool = False, key: str = "doc_id", ids: str = "ids", loss: str | None = None) -> DataFrame:
    """Examples given as arrays of token ids, with one boolean for each id that bears loss, in training rows.

    Without ``cut`` an example stays whole, and rows are to be padded; one that exceeds a limit alone
    is returned with a null sequence_id and offset. With ``cut`` it works as ``pack_documents`` does. The
    first token of a piece never bears loss; a null ``loss``, column or value, means all others do. A null
    or empty example is one piece of length 0 in no row. Columns as in ``pack_documents``.
    """
    kind = examples.schema[key].dataType
    arrow = pa.schema([("k", _arrow_type(examples, key))]).field(0).type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                for k, i, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield k, np.array(i or [], np.uint32), None if m is None else np.array([bool(x) for x in m], bool)

        return _packed(each(), limits, cut, arrow)

    mask = F.lit(None).cast("array<boolean>") if loss is None else F.col(loss)
    rows = examples.select(F.col(key).alias("key"), F.col(ids).cast("array<bigint>").alias("ids"), mask.alias("loss"))
    return rows.mapInArrow(pack, f"key {kind.simpleString()}, {PIECE}").withColumnRenamed("key", key)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
