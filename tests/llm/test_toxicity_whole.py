"""Problem 6 learns from all labelled rows, on the driver or in the tasks."""

import numpy as np
import pytest

from vietloom.llm import toxicity

SCHEMA = "t string, y int"


@pytest.fixture
def learn(frame, monkeypatch):
    corpus = frame([("hôm nay trời đẹp quá bạn ơi",)] * 50, "t string")

    def run(rows, bound, parts=3):
        monkeypatch.setattr(toxicity, "LABELLED", bound)
        return toxicity.learn(corpus, "t", frame(rows, SCHEMA).repartition(parts), "y")

    return run


def labelled():
    rows = [(f"bạn ngu {i} như {i % 7}" if i % 2 else f"hôm nay vui {i} với {i % 5}", i % 2) for i in range(300)]
    return rows + [("đồ kh0ốn nạn", 1), ("lũ khốn nạn kia", 1), (None, 1), ("x", None), (" ", 0)] + rows[:20]


def test_rows_beyond_the_bound_count(learn):
    (c1, m1), (c2, m2), (c3, m3) = learn(labelled(), 10_000), learn(labelled(), 100), learn(labelled()[::-1], 150, 5)
    assert np.array_equal(c1.lm, c2.lm) and np.array_equal(c1.lm, c3.lm)
    for m in (m2, m3):
        assert np.array_equal(m.keys, m1.keys) and np.array_equal(m.weights, m1.weights) and m.bias == m1.bias


def test_repeated_table_is_the_same_model(learn):
    for bound in (10_000, 200):
        (c1, m1), (c2, m2) = learn(labelled(), bound), learn(labelled() * 3, bound)
        assert np.allclose(c1.lm, c2.lm) and np.array_equal(m1.keys, m2.keys) and np.allclose(m1.weights, m2.weights, atol=1e-3)


def test_no_labels(learn):
    for bound in (10, -1):
        _, m = learn([(None, 1), ("x", None)], bound)
        assert len(m.keys) == 0 and np.isfinite(m.bias)


def test_least_loss():
    """The weights are where every slope is nothing, by differences of the loss."""
    r = np.random.default_rng(3)
    row, f = np.nonzero(r.random((200, 12)) < 0.3)
    y, m, scale = (r.random(200) < 0.3).astype(float), r.integers(1, 4, 200), r.random(12) + 0.2
    w, bias = toxicity.descend(lambda v, b: toxicity.pull(row, f, y, m, v, b), scale, m.sum(), (m * y).sum() / m.sum())

    def loss(x):
        z = np.bincount(row, x[f], 200) + x[-1]
        return (m * (np.logaddexp(0, z) - y * z)).sum() / m.sum() + toxicity.L2 / 2 * ((x[:-1] / scale) ** 2).sum()

    x = np.append(w, bias)
    assert all(abs(loss(x + d) - loss(x - d)) < 1e-9 for d in np.eye(13) * 1e-3)
