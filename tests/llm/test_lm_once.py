"""Training texts are cut once, each subword is trained on and scored once, and sums inside words are those of the text."""

import numpy as np

from prefmill.llm import lm_score


def _model():
    r = np.random.default_rng(7)
    model = lm_score.Model(r.integers(1, 50, lm_score._subwords().size).astype(float))
    model.set_table(r.integers(0, 9, lm_score.SYMBOLS * lm_score.CLASSES).astype(float))
    return model, r


def test_places_are_scored_and_trained_on_once():
    model, r = _model()
    lengths = np.array([2, 33, 34, 200, 3])
    ids = r.integers(0, lm_score._subwords().size, lengths.sum())
    begins = np.cumsum(lengths) - lengths
    seen = [np.arange(b + skip, b + n) for _, begin, size, skip in model.rounds(lengths, 4) for b, n in zip(begin, size)]
    assert sorted(np.concatenate(seen).tolist()) == [p for b, n in zip(begins, lengths) for p in range(b, b + n - 1)]
    assert model.train(ids, lengths, {}) == (lengths - 1).sum()


def test_later_places_of_a_window_are_as_in_the_whole():
    model, r = _model()
    s, t = r.integers(0, lm_score.SYMBOLS, (5, lm_score.WIDTH)), r.integers(0, lm_score.CLASSES, (5, lm_score.WIDTH))
    z = model.forward(s)[0].reshape(5, lm_score.WIDTH, -1)
    assert np.allclose(model.forward(s, skip=6)[0].reshape(5, lm_score.WIDTH - 6, -1), z[:, 6:], rtol=1e-5, atol=1e-5)
    mask = np.ones((5, lm_score.WIDTH), np.float32)
    mask[:, :6] = 0
    whole, part = model.gradient(s, t, mask), model.gradient(s, t[:, 6:], mask[:, 6:], 6)
    assert all(np.allclose(whole[c], part[c], rtol=1e-4, atol=1e-6) for c in whole)


def test_within_words_is_the_sum_over_the_text():
    model, r = _model()
    texts = [b"international house of the unbelievable naming", b"", b"the the unbelievable", "é漢字 x".encode()]
    words, ids, lengths = lm_score._sequences(texts)
    deep = lm_score.contexts(ids)
    last = ids[:-1].astype(np.int64)
    n = np.arange(len(last), 0, -1)
    model.add_level(last, ids[1:].astype(np.int64), n, last, False)
    model.add_level(deep[:-1], ids[1:].astype(np.int64), n, last, True)
    distinct = sorted({w for t in words for w in t})
    entries, counts = np.array([distinct.index(w) for t in words for w in t]), np.array([len(t) for t in words])
    within = model.within_words(distinct, entries, counts)
    assert np.allclose(model.score(ids, lengths, within), model.score(ids, lengths))


def test_training_texts_are_cut_once(spark, tmp_path, monkeypatch):
    cuts, encode = spark.sparkContext.accumulator(0), lm_score._encode
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, f"w{i} a b") for i in range(40)], "doc_id long, text string").coalesce(2).write.parquet(path)
    monkeypatch.setattr(lm_score, "_encode", lambda batches: encode(b for b in batches if not cuts.add(b.num_rows)))
    _, counts = lm_score.learn(spark, spark.read.parquet(path))
    assert cuts.value == 40 and counts.count() == 43
