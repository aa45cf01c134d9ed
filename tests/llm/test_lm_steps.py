"""The steps of the language model against the plain form of the same arithmetic."""

import numpy as np
import pytest

from isolens.llm import lm


@pytest.mark.parametrize("width, rows", [(lm.CLASSES, 5000), (lm.SEATS, 40), (lm.SEATS, 1)])
def test_step_sums_rows_of_any_number_of_uses(width, rows):
    rng = np.random.default_rng(rows)
    at = (rng.zipf(1.4, rows) % lm.FEATURES).astype(np.int32)
    grad = rng.normal(size=(rows, width)).astype(np.float32)
    weights, square, used = np.ones((lm.FEATURES, width), np.float32), np.full(lm.FEATURES, 2, np.float32), np.ones(lm.FEATURES)
    sums = np.zeros((lm.FEATURES, width))
    np.add.at(sums, at, grad)
    total = 2 + (sums * sums).mean(axis=1)
    lm._step(weights, square, used, at, grad, 0.3)
    assert (used == 1 + np.bincount(at, minlength=lm.FEATURES)).all()
    np.testing.assert_allclose(square, total, rtol=1e-4)
    np.testing.assert_allclose(weights, 1 - 0.3 / np.sqrt(total + 1)[:, None] * sums, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("gap", [0, 5, 60, 200, 5000])
def test_softmax_of_rows_far_apart(gap):
    x = np.random.default_rng(gap).normal(size=(300, lm.SEATS)).astype(np.float32)
    x[7] -= gap
    x[8, 3] += gap
    y = x.astype(float) - x.max(axis=1, keepdims=True)
    want = np.exp(y) / np.exp(y).sum(axis=1, keepdims=True)
    np.testing.assert_allclose(lm._softmax(x), want, rtol=1e-3, atol=1e-30)
    assert lm._softmax(x[:0]).shape == (0, lm.SEATS)


def test_codes_of_other_words_are_their_classes():
    codes = lm._Codes({b"known": 5})
    for w in (b"known", b"new,", b"", b"...", "é".encode(), lm.END):
        assert codes[w] == (5 if w == b"known" else -1 - lm.word_class(w))
