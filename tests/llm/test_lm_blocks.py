"""Scoring holds what a block of windows needs, and a symbol's query, key and value are those of its embedding."""

import math
import tracemalloc

import numpy as np

from prefmill.llm import lm_score


def _model():
    rng = np.random.default_rng(5)
    counts = np.zeros(lm_score._subwords().size)
    counts[rng.integers(0, len(counts), 3000)] = rng.integers(1, 50, 3000)
    model = lm_score.Model(counts)
    model.set_table(rng.integers(0, 9, lm_score.SYMBOLS * lm_score.CLASSES).astype(float))
    model.w["P"] += rng.standard_normal(lm_score.WIDTH).astype(np.float32)
    return model, rng


def test_forward_is_masked_attention():
    model, rng = _model()
    w, s = model.w, rng.integers(0, lm_score.SYMBOLS, (3, lm_score.WIDTH))
    z = model.forward(s)[0].reshape(3, lm_score.WIDTH, -1)
    for r in range(3):
        x = w["E"][s[r]].astype(float)
        q, k, v = x @ w["Q"], x @ w["K"], x @ w["V"]
        for i in range(lm_score.WIDTH):
            a = np.exp([np.clip(q[i] @ k[j] / math.sqrt(lm_score.DIM), -60, 60) + w["P"][i - j] for j in range(i + 1)])
            assert np.allclose(z[r, i], (a / a.sum()) @ v[: i + 1] @ w["U"] + model.table[s[r, i]], rtol=1e-4, atol=1e-4)


def test_scoring_holds_a_block(monkeypatch):
    model, rng = _model()
    monkeypatch.setattr(model, "inner", lambda before, after, deep: np.zeros(len(after)))
    ids, lengths = rng.integers(0, lm_score._subwords().size, 20_000).astype(np.int32), np.array([20_000])
    monkeypatch.setattr(lm_score, "contexts", lambda ids: np.zeros(len(ids), np.uint64))
    tracemalloc.start()
    try:
        model.score(ids, lengths)
        assert tracemalloc.get_traced_memory()[1] < 6e6  # blocks of 512 windows took 20 MB
    finally:
        tracemalloc.stop()
