"""The parallel quoted reader against the library's, and files that are written or appended to whole or not at all."""

import csv
import glob
import io
import os
import random
import threading

import pytest

from prefmill.sources import quoted, runs


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(seed, rows, columns=3, newline="\n"):
    r = random.Random(seed)
    part = ["a", "b c", ",", '"', "\n", "\n\n", "é", "x" * 40, "\n" * 3 + '",', "😀"]
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=newline)
    table = [["".join(r.choice(part) for _ in range(r.randint(1, 7))) for _ in range(columns)] for _ in range(rows)]
    w.writerows([["id", "prompt, or so", "text"][:columns], *table])
    return out.getvalue(), table


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_quoting(spark, tmp_path, small_splits, seed, newline):
    text, table = made(seed, 300, newline=newline)
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
    out = quoted.read_quoted(spark, str(path))
    assert out.columns == ["id", "prompt, or so", "text"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted(map(tuple, table))
    if newline == "\n":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        assert got == sorted(tuple(r) for r in runs.read_csv(spark, str(path)).collect())


def test_a_field_over_many_splits_and_files(spark, tmp_path, small_splits):
    long = "line, with \"\"quotes\"\"\n" * 400
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text(f'id,text\n{k},"{long}"\n{k + 10},"b"\n{k + 20},"{long}')
    got = sorted(tuple(r) for r in quoted.read_quoted(spark, str(tmp_path), "id int, text string").collect())
    own = long.replace('""', '"')
    assert [(i, t.rstrip("\n")) for i, t in got] == sorted((i, t.rstrip("\n")) for k in range(3) for i, t in ((k, own), (k + 10, "b"), (k + 20, own)))


@pytest.mark.parametrize("line, state, want", [
    ("a,b", 0, 0), ("a,b", 1, 1), ('"a', 0, 1), ('a"', 1, 0), ('"a""', 0, 1), ('"a"",b"', 0, 0), ('a"b,c', 0, 0), ('x,"', 0, 1), ('",', 1, 0), ('","', 1, 1), ('"a"b",c', 0, 0), ("", 1, 1), ('""', 0, 0), ('"""', 0, 1), (',,"a', 0, 1), ('" ,"', 0, 0),
])
def test_states_of_lines(line, state, want):
    assert quoted.after(line, state) == want


def test_empty_and_header_only(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert quoted.read_quoted(spark, str(tmp_path / "e.csv"), "a int").collect() == []
    (tmp_path / "h.csv").write_text("﻿a,b\n\n1,2\n\n", encoding="utf-8")
    out = quoted.read_quoted(spark, str(tmp_path / "h.csv"))
    assert out.columns == ["a", "b"] and [tuple(r) for r in out.collect()] == [("1", "2")]


# ---- sinks ----------------------------------------------------------------------------------------------------------
def left_over(folder):
    return [f for f in os.listdir(folder) if not f.endswith((".csv", ".txt"))]


def test_sheet_of_many_parts(spark, tmp_path):
    path = str(tmp_path / "out" / "sheet.csv")
    frame = spark.range(0, 1000, 1, 7).selectExpr("id", "concat('a,\"', id, '\"\nb') as `te,xt`", "if(id % 2 = 0, null, id) as n")
    for _ in range(2):
        runs.write_sheet(frame, path)
    raw = open(path, encoding="utf-8", newline="").read()
    rows = list(csv.reader(io.StringIO(raw.removeprefix("﻿"), newline="")))
    assert raw.startswith("﻿") and rows[0] == ["id", "te,xt", "n"]
    assert rows[1:] == [[str(k), f'a,"{k}"\nb', "" if k % 2 == 0 else str(k)] for k in range(1000)]
    assert [f for f in left_over(tmp_path / "out") if not f.endswith(".crc")] == []


def test_failed_sheet_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    runs.write_sheet(spark.range(3), path)
    before = open(path, "rb").read()
    with pytest.raises(Exception):
        runs.write_sheet(spark.range(3).selectExpr("raise_error('no') as id"), path)
    assert open(path, "rb").read() == before and not glob.glob(str(tmp_path / ".s.csv.parts*"))


def test_two_writers(spark, tmp_path):
    path, failed = str(tmp_path / "epochs.csv"), []

    def write(name):
        try:
            for k in range(12):
                runs.append_rows(spark, path, [{"who": name, "k": k, "note": 'a, "b"'}])
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = list(csv.DictReader(open(path, encoding="utf-8")))
    assert not failed and sorted((r["who"], int(r["k"])) for r in rows) == [(n, k) for n in "ab" for k in range(12)]
    assert [int(r["k"]) for r in rows if r["who"] == "a"] == list(range(12)) and rows[0]["note"] == 'a, "b"'


def test_failed_append(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "steps.csv")
    runs.append_rows(spark, path, [{"a": 1, "b": 2}])
    before = open(path, "rb").read()

    def broken(self, source, out):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(runs._Files, "copy", broken)
        with pytest.raises(OSError):
            runs.append_rows(spark, path, [{"a": 3, "b": 4}])
    assert open(path, "rb").read() == before
    runs.append_rows(spark, path, [{"b": 6, "a": 5, "more": 1}])
    assert open(path).read().split() == ["a,b", "1,2", "5,6"]
    (tmp_path / ".steps.csv.lock").write_text("")
    monkeypatch.setattr(runs, "PATIENCE", 0.2)
    with pytest.raises(TimeoutError):
        runs.append_rows(spark, path, [{"a": 7, "b": 8}])


def test_log(spark, tmp_path):
    path = str(tmp_path / "audit.txt")
    runs.append_log(spark, path, "one", ["x", "y"])
    runs.append_log(spark, path, "two", [])
    assert open(path).read() == "[one]\nx\ny\n[two]\n"
