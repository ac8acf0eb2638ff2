"""op1_lm_score learns its weights from every training document."""

import zlib

import numpy as np

from prefmill.llm import lm_score


def test_weights_learn_from_every_training_document(spark, tmp_path):
    # none of these is in the sixteenth that the weights used to see
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2 and zlib.crc32(str(i).encode()) // 7 % 16][:24]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, "the cat sat on the mat " * 9) for i in ids], "doc_id long, text string").coalesce(1).write.parquet(path)
    model, _ = lm_score.learn(spark, spark.read.parquet(path))
    _, seq, lengths = lm_score._sequences([b"the cat sat on the mat " * 9] * len(ids))
    fresh = lm_score.Model(np.bincount(seq[1:], minlength=lm_score._subwords().size).astype(float))
    assert not np.allclose(model.flat(), fresh.flat())
    fresh.table = model.table
    fresh._finish()
    assert model.score(seq, lengths).sum() > fresh.score(seq, lengths).sum()


def test_every_document_counts(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    train = lm_score._train

    def counted(model):
        run = train(model)

        def count(batches):
            def tally():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            yield from run(tally())

        return count

    monkeypatch.setattr(lm_score, "_train", counted)
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, f"w{i} a b") for i in range(50)], "doc_id long, text string").coalesce(2).write.parquet(path)
    lm_score.learn(spark, spark.read.parquet(path))
    assert seen.value == 50


def test_windows_overlap_by_six_subwords():
    model = lm_score.Model(np.ones(lm_score._subwords().size))
    _, _, _, done = model.windows(np.array([200]))
    assert done[0] == 0 and set(done[1:].tolist()) == {6}
    assert model.w["Q"].shape == (16, 16) and model.w["P"].shape == (32,)


def test_a_sent_model_has_only_the_places_that_are_taken():
    """Of a million places of a table a task is sent those with a value; probabilities stay the same."""
    import pickle

    r = np.random.default_rng(1)
    model = lm_score.Model(r.integers(1, 50, lm_score._subwords().size).astype(float))
    before, after = r.integers(0, 50_000, (2, 2000))
    n = np.sort(r.integers(1, 99, 2000))[::-1]
    model.add_level(before, after, n, before, False)
    model.add_level(before.astype(np.uint64), after, n, before, True)
    blob = pickle.dumps(model)
    ids = np.stack([before, after], 1).reshape(-1)
    args = ids[:-1], ids[1:], lm_score.contexts(ids)[:-1]
    assert len(blob) < 5_000_000 and (model.inner(*args) == pickle.loads(blob).inner(*args)).all()
    assert not model.outer().levels and len(model.levels) == 2
