"""Labelled rows weigh the same share of the character model on small and on large tables."""

import numpy as np

from vietloom.llm import toxicity


def test_learn_weighs_by_share(frame, monkeypatch):
    seen = []
    real = toxicity.Channel.__init__

    def keep(self, counts):
        seen.append(counts)
        real(self, counts)

    monkeypatch.setattr(toxicity.Channel, "__init__", keep)
    labels = frame([("đồ ngu", 1), ("chào bạn", 0), ("ngu quá", 1), ("xin chào", 0)], "t string, y int")
    text = "hôm nay trời đẹp quá bạn ơi"
    for n in (20, 20_000):
        corpus = labels.sparkSession.range(n).selectExpr(f"'{text}' as t")
        toxicity.learn(corpus, "t", labels, "y")
        assert abs(seen[-1].sum() / toxicity.trigram_counts(corpus, "t").sum() - 1.5) < 1e-9


def test_no_labels():
    counts = np.ones((27, 27, 27))
    assert np.array_equal(toxicity.weighed(counts, np.zeros_like(counts), 0.5), counts)
