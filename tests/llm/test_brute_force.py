"""Operators without SQL, row ids and the pipeline against plain Python on small inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prefmill.llm import common, decontaminate, language_id, license_scan, line_dedup, lm_score, pieces, resample, setjoin


def stored(spark, path, rows, schema, files=2):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(str(path))
    return spark.read.parquet(str(path))


# ---- language ID: vectors bound and bundled letter by letter ---------------------------------------------------------
def profile(text, letters):
    symbols = [0]
    for c in text:
        low = ord(c.lower()[0])
        s = 0 if not c.isalpha() else low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 37
        if s or symbols[-1]:
            symbols.append(s)
    if not any(symbols):
        return None
    symbols += [0]
    total = np.zeros(letters.shape[1])
    for k in range(len(symbols) - 2):
        v = np.ones(letters.shape[1])
        for place, s in enumerate(symbols[k : k + 3]):
            v *= np.roll(letters[s], 2 - place)
        total += v
    return total


def test_language_id_letter_by_letter(spark, tmp_path):
    letters = np.random.default_rng(language_id.SEED).choice(np.array([-1, 1], np.int8), (64, language_id.DIM)).astype(float)
    train = [(1, "the cat and the hat", "en", "x"), (2, "le chat et le chapeau", "fr", "x"), (3, "ça va été", "fr", "x"), (4, "the end", "en", "x"), (5, None, "en", "x"), (6, "no lang", None, "x")]
    train += [(7, "same same", "zz", "x"), (8, "same same", "aa", "x"), (9, "12 34", "en", "x")]
    asked = ["the hat", "le château", "Straße ÉTÉ", "a", "same", "", None, "... 12", "x" * 5000, "the hat"]
    model = language_id.learn(spark.createDataFrame(train, "doc_id int, text string, lang string, source string"))
    sums = defaultdict(lambda: 0)
    for _, text, lang, _ in train:
        if text and lang and (v := profile(text, letters)) is not None:
            sums[lang] = sums[lang] + v
    docs = stored(spark, tmp_path / "d", [(i, t, "mine", 0.5) for i, t in enumerate(asked)], "doc_id int, text string, lang_pred string, point double")
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    unit = lambda v: v / np.linalg.norm(v)
    for i, t in enumerate(asked):
        v = profile(t or "", letters)
        want = ("und", 0.0)
        if v is not None and np.linalg.norm(v):
            cos = {x: float(unit(sums[x]) @ unit(v)) for x in sorted(sums)}
            best = max(cos, key=lambda x: (round(cos[x], 7), [-ord(c) for c in x]))
            want = best, min(1.0, max(0.0, cos[best]))
        assert got[i]["lang_pred"] == want[0] and abs(got[i]["score"] - want[1]) < 1e-5 and got[i]["point"] == 0.5
    assert got[4]["lang_pred"] == "aa"  # a tie goes to the first name


# ---- license scans: edit distance at every place ---------------------------------------------------------------------
def least_edits(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        diagonal, row[0] = row[0], 0
        for j, p in enumerate(pattern, 1):
            diagonal, row[j] = row[j], min(diagonal + (p != c), row[j] + 1, row[j - 1] + 1)
        best = min(best, row[-1])
    return best


def test_license_scan_against_edit_distance():
    r, scanner = random.Random(7), license_scan.NoticeScanner()
    for _ in range(120):
        words = []
        for _ in range(r.randint(0, 4)):
            t = list(r.choice(license_scan.NOTICES)[0])
            for _ in range(r.randint(0, 6)):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], ["x"], [t[k], "e"], [t[k]]])
            words += "".join(t).split() + [r.choice(["word", "and", "é", "general"])] * r.randint(0, 3)
        text = " ".join(words)
        got = scanner.scan(text.encode())
        joined = " " + " ".join(w.decode() for w in text.encode().translate(common.WORD_BYTES).split()) + " "
        base = {label for phrase, label in license_scan.PHRASES if f" {phrase} " in joined}
        edits = [(label, least_edits(t, joined), k, len(t)) for t, label, k in license_scan.NOTICES]
        near = [(label, 1 - e / n) for label, e, k, n in edits if e <= k]
        assert got["labels"] == ",".join(sorted(base | {x for x, _ in near}))
        assert abs(got["score"] - max([1.0] * bool(base) + [x for _, x in near], default=0.0)) < 1e-9


def test_license_scan_rows(spark, tmp_path):
    texts = ["CC BY", None, "", "gnu generl public license", "CC BY", "all rights reserved " * 3000]
    docs = stored(spark, tmp_path / "d", [(min(i, 3), t, "mine") for i, t in enumerate(texts)], "doc_id int, text string, spans string")
    scan = license_scan.NoticeScanner().scan
    want = Counter((min(i, 3), x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"], round(x["score"], 9), len(x["spans"])) for i, t in enumerate(texts) for x in [scan((t or "").encode())])
    got = Counter((*tuple(r)[:7], round(r["score"], 9), len(r["spans"])) for r in license_scan.scan_licenses(docs).collect())
    assert got == want


# ---- importance resampling: ratios by plain counting -----------------------------------------------------------------
def test_resample_ratios_and_noise(spark, tmp_path):
    texts = ["good text here", "bad text", "good good text", None, "", "bad bad bad here", "bad text", "bad text", "long " * 2000]
    ids = [0, 1, 2, 3, 4, 5, 6, 6, None]
    docs = stored(spark, tmp_path / "d", list(zip(ids, texts, ["mine"] * 9)), "doc_id int, text string, key string")
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (5, 1, 1), (1, 0, 0), (2, 0, None), (None, 1, 0)], "doc_id int, quality int, toxic int")
    grams = lambda t: resample.buckets((t or "").encode(), resample.BUCKETS).tolist()
    raw, target = Counter(), Counter()
    for i, t in zip(ids, texts):
        raw.update(grams(t))
        if i in (0, 2):
            target.update(grams(t))
    sizes = [sum(c.values()) + resample.BUCKETS for c in (raw, target)]
    ratio = lambda t: sum(math.log((target[g] + 1) / sizes[1]) - math.log((raw[g] + 1) / sizes[0]) for g in grams(t))
    got = resample.resample(spark, docs, labels, share=0.5).collect()
    assert Counter((r["doc_id"], round(r["log_ratio"], 6)) for r in got) == Counter((i, round(ratio(t), 6)) for i, t in zip(ids, texts))
    assert len({r["key"] for r in got}) == len(texts)  # repeated rows have noise of their own
    kept = sorted((r["key"] for r in got), reverse=True)[: round(0.5 * len(texts))]
    assert sorted(r["key"] for r in got if r["kept"]) == sorted(kept)
    assert got and sorted(map(tuple, got), key=str) == sorted(map(tuple, resample.resample(spark, docs, labels, share=0.5).collect()), key=str)


# ---- LM scoring: one window at a time --------------------------------------------------------------------------------
def test_lm_score_against_one_place_at_a_time(spark):
    docs = spark.createDataFrame([(i, f"the cat number{i % 5} sat\non the Mat and ran " * 5) for i in range(30)], "doc_id long, text string")
    model, _ = lm_score.learn(spark, docs)
    texts = [b"the cat sat on the mat " * 12, b"", b"number3 unknown\xc3\xa9 word"]
    _, ids, lengths = lm_score._sequences(texts)
    got = model.score(ids, lengths)
    at = 0
    for k, n in enumerate(lengths.tolist()):
        seq = ids[at : at + n].astype(int)
        at += n
        total, done, begin = 0.0, 0, 0
        while done < n - 1:
            window = seq[begin : begin + lm_score.WIDTH]
            for place in range(done - begin, min(lm_score.WIDTH, n - 1 - begin)):
                x = model.w["E"][model.symbol[window[: place + 1]]].astype(float)
                q, keys, v = x[-1] @ model.w["Q"], x @ model.w["K"], x @ model.w["V"]
                a = np.clip(keys @ q / math.sqrt(lm_score.DIM), -60, 60) + model.w["P"][place - np.arange(place + 1)]
                a = np.exp(a - a.max())
                z = np.clip((a / a.sum()) @ v @ model.w["U"], -20, 20) + model.table[model.symbol[window[place]]]
                z -= z.max()
                target = seq[begin + place + 1]
                total += z[model.klass[target]] - math.log(np.exp(z).sum())
                done += 1
            begin += lm_score.STRIDE
        inner = model.inner(seq[:-1], seq[1:], lm_score.contexts(seq.astype(np.int32))[:-1]).sum()
        assert abs(got[k] - (total + inner) / math.log(10)) < 1e-3 * n


def test_lm_probabilities_within_a_class_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"international nations rationalise number{i} nationality") for i in range(40)], "doc_id long, text string")
    model, _ = lm_score.learn(spark, docs)
    sub = lm_score._subwords()
    ids = np.frombuffer(sub.ids([b"rationalise"])[0], "<u2").astype(np.int32)
    every = np.arange(sub.size)
    deep = lm_score.contexts(ids)
    for k in range(len(ids)):
        p = np.exp(model.inner(np.full(sub.size, ids[k]), every, np.full(sub.size, deep[k])))
        sums = np.bincount(model.klass, p, lm_score.CLASSES)
        assert np.allclose(sums[np.bincount(model.klass, minlength=lm_score.CLASSES) > 0], 1, atol=2e-3)


def test_lm_weights_do_not_depend_on_partitions(spark, tmp_path):
    rows = [(i, f"a text number {i} of words " * 6) for i in range(60)] + [(None, "no id"), (3, None)]
    flat = []
    for files in (1, 5):
        docs = stored(spark, tmp_path / str(files), rows, "doc_id long, text string", files)
        flat.append(lm_score.learn(spark, docs, shard=400)[0].flat())
    assert np.allclose(flat[0], flat[1], atol=1e-5)


def test_lm_gradient_of_all_weights():
    r = np.random.default_rng(1)
    model = lm_score.Model(r.integers(1, 50, lm_score._subwords().size).astype(float))
    s, t = r.integers(0, 20, (2, 9)), r.integers(0, lm_score.CLASSES, (2, 9))
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}

    def loss():
        z, _ = model.forward(s)
        return -(z[np.arange(18), t.reshape(-1)] - np.log(np.exp(z).sum(1))).mean()

    g = model.gradient(s, t, np.ones((2, 9), np.float32))
    for name in ("E", "Q", "K", "V", "U"):
        at = (int(s[0, 0]), 2) if name == "E" else (1, 2)
        model.w[name][at] += 1e-4
        up = loss()
        model.w[name][at] -= 2e-4
        down = loss()
        model.w[name][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-4


# ---- row ids ---------------------------------------------------------------------------------------------------------
def test_row_ids_do_not_depend_on_the_split(spark, tmp_path):
    docs = stored(spark, tmp_path / "d", [(i, "t" * 200, f"mine{i}", i) for i in range(3000)], "doc_id int, text string, rid string, path int", 3)
    key = "spark.sql.files.maxPartitionBytes"
    before, seen = spark.conf.get(key), []
    for size in ("128m", "2000"):
        spark.conf.set(key, size)
        name = common.fresh(docs, "rid")
        rows = common.with_rid(docs, name).collect()
        assert name == "rid_" and all(r["rid"] == f"mine{r['doc_id']}" and r["path"] == r["doc_id"] for r in rows)
        seen.append({r["doc_id"]: r[name] for r in rows})
    spark.conf.set(key, before)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 3000
    union = docs.union(docs)  # no scan: stored first
    assert len({r["rid_"] for r in common.with_rid(union, "rid_").collect()}) == 6000


# ---- pipeline --------------------------------------------------------------------------------------------------------
def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def first(row):
    return row["doc_id"] is None, row["doc_id"] or 0, row["at"]


def brute_lines(rows):
    seen, out = [], []
    for r in sorted(rows, key=first):
        kept, gone = [], 0
        for line in (r["text"] or "").split("\n"):
            s = shingles(line)
            if any(setjoin.similar(s, x) for x in seen):
                gone += 1
            else:
                kept.append(line)
            if s:
                seen.append(s)
        text = "\n".join(kept) if gone else r["text"]
        if not gone or shingles(text):
            out.append(r | {"text": text})
    return out


def brute_copies(rows):
    sets, group = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if setjoin.similar(sets[a], sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for k, r in enumerate(rows):
        if sets[k] and (group[k] not in best or first(r) < first(rows[best[group[k]]])):
            best[group[k]] = k
    return [r for k, r in enumerate(rows) if not sets[k] or best[group[k]] == k]


def brute_clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {tuple(v[k : k + 10]) for t in items for v in [words(t)] if v for k in range(max(1, len(v) - 9))}
    held = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    return [r for r in rows if not held(words(r["text"]))]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rid string, point long, score double"


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path, empty):
    import public_tokenizers
    import sentencepiece

    r = random.Random(9)
    word = lambda: r.choice("the cat sat upon mat and ran home with nine other small dogs in wet sand".split())
    base = ["\n".join(" ".join(word() for _ in range(r.randint(3, 14))) for _ in range(r.randint(1, 4))) for _ in range(14)]
    leak = " ".join(f"secret{k}" for k in range(12))
    texts = base + [base[0], base[1] + " more", base[2].upper(), f"the cat {leak} ran", None, "", " \n ", "one", "One", base[3], base[3] + "\n\n" + base[4], "the cat sat upon the mat " * 800]
    ids = [None if i in (5, 14, 21) else min(i, 20) if i != 8 else 3 for i in range(len(texts))]
    rows = [] if empty else [(i, t, "en" if k % 3 else None, "s", len(t or ""), f"mine{k}", k, 0.5) for k, (i, t) in enumerate(zip(ids, texts))]
    sf = tmp_path / "sf"
    stored(spark, sf / "documents.parquet", rows, COLUMNS)
    spark.createDataFrame([(1, leak), (2, None), (None, "the cat")], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    docs = common.documents(spark, str(sf))
    brute = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialise(spark, stage(spark, docs, str(sf)), f"brute-{name}")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        if name != "language_id":
            want = {"line_dedup": brute_lines, "ngram_join": brute_copies, "decontaminate": lambda x: brute_clean(x, [leak])}[name](brute)
            changed = lambda x: len(x["text"]) if x["text"] is not None and x["text"] != texts[x["point"]] else x["n_chars"]
            assert Counter((x["point"], x["text"], x["rid"], x["score"], x["n_chars"]) for x in out.collect()) == Counter((x["point"], x["text"], x["rid"], x["score"], changed(x)) for x in want)
        docs = out
        brute = [x.asDict() | {"at": x["row_id"]} for x in common.with_rid(docs, "row_id").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = Counter((x["doc_id"], len(i), crc(i)) for x in brute for i in [sp.encode(x["text"] or "")])
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(sf)).collect())) == want


def test_user_columns_stay(spark, tmp_path):
    docs = stored(spark, tmp_path / "d", [(1, "a b c d e f\na b c d e f", "r", "l", 9), (2, "x", "r2", "l2", 8)], "doc_id int, text string, rid string, lines string, n_removed int")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark, docs, short=True).collect()}
    assert (got[1]["rid"], got[1]["lines"], got[1]["n_removed"], got[1]["text"]) == ("r", "l", 1, "a b c d e f") and got[2]["n_removed"] == 0
    out = pieces.encode(docs.withColumn("score", F.lit(1.5)).withColumn("piece_ids", F.lit("old"))).collect()
    assert all(r["score"] == 1.5 and r["rid"].startswith("r") and isinstance(r["piece_ids"], list) for r in out)


def test_many_items_share_a_passage(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(14))
    docs = stored(spark, tmp_path / "d", [(i, f"doc{i} {passage} end{i}") for i in range(200)], "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{k}", f"{passage} own{k}") for k in range(300)], "item_id string, text string")
    got = decontaminate.contaminated(spark, docs, bench).collect()
    assert len(got) == 200 and all(r["n_hit"] == 14 and len(r["items"]) == 300 and r["items"] == sorted(r["items"]) for r in got)
