"""Readers, writers, runs, markers, configurations and the whole preparation."""

import pytest
from pyspark.sql import functions as F

from prefmill.operators import evaluation as ev, preference as pf
from prefmill.plans import pipeline
from prefmill.sources import fixtures, runs, store


def test_csv_in_and_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted"\nline, é'), (2, None)], "id int, text string")
    runs.write_csv(rows, str(tmp_path / "t"))
    assert sorted(map(tuple, runs.read_csv(spark, str(tmp_path / "t"), "id int, text string").collect())) == [(1, 'a "quoted"\nline, é'), (2, None)]
    with pytest.raises(FileNotFoundError):
        runs.read_guarded(spark, str(tmp_path / "none.csv"))
    (tmp_path / "latin.csv").write_bytes("id,text\n1,café\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_text("id,text\n1,café\n")
    for name in ("latin", "utf"):
        assert runs.read_lenient(spark, str(tmp_path / f"{name}.csv")).first()["text"] == "café"
    assert runs.read_lenient(spark, str(tmp_path / "none.csv")) is None
    a = runs.read_cached(spark, str(tmp_path / "utf.csv"))
    assert runs.read_cached(spark, str(tmp_path / "utf.csv")) is a and runs.clear_cached() == 1 and runs.clear_cached() == 0
    up = runs.from_records(spark, "﻿id,text\n1,x\nbad,y\n".encode(), "id int, text string")
    assert sorted(map(tuple, up.collect()), key=str) == [(1, "x"), (None, "y")]


def test_reports_and_sheets(spark, tmp_path):
    folder = str(tmp_path)
    runs.append_rows(spark, f"{folder}/epochs.csv", [{"time": "t", "epoch": 1, "mean_train_loss": 0.5, "val_loss": 0.4, "val_acc": 0.6, "macro_f1": 0.5}])
    runs.append_rows(spark, f"{folder}/epochs.csv", [{"epoch": 2, "time": "u", "val_loss": 0.3}])
    got = runs.load_report(spark, folder, "epochs").orderBy("epoch").collect()
    assert [(r["epoch"], r["val_loss"], r["macro_f1"]) for r in got] == [(1, 0.4, 0.5), (2, 0.3, None)]
    assert runs.load_report(spark, folder, "steps").count() == 0
    assert {k: v is not None for k, v in runs.load_bundle(spark, folder).items()} == {n: n == "epochs" for n in runs.REPORTS}
    runs.write_sheet(spark.createDataFrame([(1, "é,")], "a int, b string"), f"{folder}/s.csv")
    assert (tmp_path / "s.csv").read_bytes() == '﻿a,b\n1,"é,"\n'.encode()
    runs.append_log(spark, f"{folder}/log.txt", "one", ["x"])
    runs.append_log(spark, f"{folder}/log.txt", "two", ["y", "z"])
    assert (tmp_path / "log.txt").read_text() == "[one]\nx\n[two]\ny\nz\n"
    assert runs.write_metadata(spark, f"{folder}/m.json", {"a": 1}) == {"a": 1} and runs.write_metadata(spark, f"{folder}/m.json", {"b": "é"}) == {"a": 1, "b": "é"}
    meta = runs.write_eda_metadata(spark, f"{folder}/m.json", "clean", {"tables_dir": "x"}, {"b", "a"})
    assert meta["tables"] == ["a", "b"] and meta["a"] == 1 and meta["tables_dir"] == "x" and meta["created_at"]
    runs.write_yaml(spark, f"{folder}/c.yaml", {"models": {"m1": None, "m2": {"enabled": False}}})
    config = runs.read_yaml(spark, f"{folder}/none.yaml", f"{folder}/c.yaml")
    assert runs.enabled_models(config) == ["m1"] and runs.read_yaml(spark, f"{folder}/none.yaml") == {}
    assert [f.rsplit("/", 1)[1] for f in runs.list_files(spark, folder)] == ["epochs.csv", "s.csv"] and runs.list_files(spark, f"{folder}/none") == []


def test_runs_and_readiness(spark, tmp_path):
    for name in ("run_20240101_000000", "run_20240301_000000", "other"):
        (tmp_path / "results" / name).mkdir(parents=True)
    (tmp_path / "reports" / "run_20240101_000000").mkdir(parents=True)
    (tmp_path / "results" / "run_20240301_000000" / "model.json").write_text("{}")
    table = runs.catalog_runs(spark, {"m": str(tmp_path / "results"), "none": str(tmp_path / "nowhere")}, {"m": str(tmp_path / "reports")})
    assert [(r["run"], r["ready"], r["reports_dir"] is not None) for r in table.collect()] == [("run_20240301_000000", True, False), ("run_20240101_000000", False, True)]
    assert runs.run_by_name(table, "run_20240101_000000")["model"] == "m" and runs.run_by_name(table, "x") is None


def test_markers_run_a_stage_once(spark, tmp_path):
    done, marks = [], runs.Markers(spark, str(tmp_path))
    assert marks.once("EdaDone", lambda: done.append(1)) and not marks.once("EdaDone", lambda: done.append(2))
    assert marks.once("EdaDone", lambda: done.append(3), force=True) and done == [1, 3]
    marks.remove("EdaDone")
    assert not marks.exists("EdaDone")
    with pytest.raises(KeyError):
        marks.exists("x")
    with pytest.raises(RuntimeError):
        marks.once("SummaryDone", lambda: (_ for _ in ()).throw(RuntimeError()))
    assert not marks.exists("SummaryDone")


def test_configurations():
    schema = {"loss": (str, "cross_entropy", tuple(ev.LOSSES)), "train": {"epochs": (int, ..., None), "amp": (bool, False, None)}}
    assert runs.validate({"train": {"epochs": "3", "amp": "yes"}}, schema) == {"loss": "cross_entropy", "train": {"epochs": 3, "amp": True}}
    with pytest.raises(ValueError, match="unknown key train.x; missing key train.epochs"):
        runs.validate({"train": {"x": 1}}, schema)
    with pytest.raises(ValueError, match="loss is none of"):
        runs.validate({"loss": "hinge", "train": {"epochs": 1}}, schema)
    assert runs.get_value({"a": {"b": 1}}, "a.b") == 1 and runs.get_value({"a": {}}, "a.b.c", 5) == 5
    assert ev.loss("bradley_terry") is ev.bt_loss
    with pytest.raises(ValueError):
        ev.loss("hinge")
    with pytest.raises(ValueError):
        fixtures.require_columns(type("T", (), {"columns": ["a"]})(), ["a", "b"])


def test_whole_preparation(spark):
    text = lambda i, n: " ".join(f"w{(i * 7 + k * k) % 53}x{i}" for k in range(n))
    raw = [(i, i, f"prompt {'abcdefghi'[i % 9] * 3} of them", text(i, 20 + i % 5), text(i + 100, 24), f"m{i % 3}", f"m{i % 2}", int(i % 3 == 0), int(i % 3 == 1), int(i % 3 == 2)) for i in range(60)]
    raw += [(60, 60, "prompt bbb of them", text(1, 21), text(1, 21), "m", "n", 1, 0, 0), (61, 61, None, "a", "b", "m", "n", 1, 0, 0), (62, 62, "p", "a", "b", "m", "n", 1, 1, 0)]
    out = pipeline.run(spark.createDataFrame(raw, "row_idx long, id long, prompt string, response_a string, response_b string, model_a string, model_b string, winner_model_a int, winner_model_b int, winner_tie int"))
    clean = [r["row_idx"] for r in out["clean"].collect()]
    assert out["clean_base"].count() == 61 and clean == sorted(clean) and 60 not in clean and len(clean) == 60
    train, valid = out["train_strat"], out["valid_strat"]
    assert train.count() == 2 * (60 - valid.count()) and train.filter("is_swapped = 1").count() * 2 == train.count()
    assert not set(r[0] for r in train.select("prompt_sig").collect()) & set(r[0] for r in valid.select("prompt_sig").collect())
    assert {r["splitter"] for r in out["split_meta"].collect()} == {pf.SPLITTERS[0]}
    meta = out["cluster_meta"].first()
    assert (meta["clusters_kept"], meta["capped_prompts"], meta["max_per_prompt"]) == (60, 0, 8)
    assert store.release(spark) > 0 and store.release(spark) == 0


def test_split_falls_back_and_says_so(spark):
    rows = spark.createDataFrame([(i, f"s{i}", 0 if i else 1) for i in range(20)], "row_idx int, prompt_sig string, label int")
    assert pf.split_with_tag(rows)[1] == pf.SPLITTERS[1] and pf.split_with_tag(rows.filter("label = 0"))[1] == pf.SPLITTERS[0]


def test_clusters_without_usable_terms_count_after_the_cap(spark):
    rows = [(i, "none", "x y", i) for i in range(12)] + [(20 + i, "some", f"word{i}", i) for i in range(12)]
    reps = pf.template_clusters(spark.createDataFrame(rows, "row_idx long, prompt_sig string, template string, info long"))
    assert tuple(pf.cluster_meta(reps).first()) == (8 + 12, 2, 8)
    kept = reps.filter(F.col("place") <= 8).filter("prompt_sig = 'none'")
    assert sorted(r["row_idx"] for r in kept.collect()) == list(range(4, 12))
