"""Operators of the llm folder against brute force, round trips and odd inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prefmill.llm import common, decontaminate, exact_dedup, language_id, license_scan, line_dedup, lm_score, ngram_join, pieces, resample, setjoin, simple8b, token_output

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, point string"
LONG = " ".join(f"w{i % 977}" for i in range(30000))


@pytest.fixture(scope="session")
def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    base = [" ".join(word() for _ in range(r.randint(8, 60))) + "\n" + " ".join(word() for _ in range(12)) for _ in range(30)]
    out = []
    for i in range(120):
        t = base[i % 30].split(" ")
        for _ in range(i // 30):
            t[r.randrange(len(t))] = word()
        out.append(" ".join(t))
    out += [None, "", " \n\t ", "one", "One", "three words only", LONG, LONG + " x", "CC BY cc by", "x cc  by y", "gnu generl public license", "▁ a  b"]
    out += out[:10]
    return [(None if i == 7 else min(i, len(out) - 2), t, "en" if i % 3 else None, "s", len(t or ""), "clash", "clash") for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, SCHEMA).coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def stored(docs):
    """The rows in the order of the scan."""
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "d")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def shingles(text, lines=False):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w and not lines else [])


def test_exact_dedup(spark, docs, stored, empty):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(stored):
        groups[(t or "").encode().translate(None, common.SPACES)].append((-len(t or ""), i is None, i, k))
    want = Counter()
    for text, g in groups.items():
        keep = min(g)
        want.update((i, keep[2], len(g), (n, z, i, k) == keep, hashlib.sha256(text).hexdigest()) for n, z, i, k in g)
    for limit in (exact_dedup.TRIE_BYTES, 2000):  # the second spills
        assert Counter(map(tuple, exact_dedup.exact_dedup(spark, docs, limit).collect())) == want
    assert exact_dedup.exact_dedup(spark, empty).count() == 0


def test_patricia_trie_holds_prefixes():
    t = exact_dedup.PatriciaTrie(lambda a, b: (a or 0) + b)
    for k in (b"", b"a", b"abc", b"abd", b"ab", b"abc"):
        t.insert(k, 1)
    assert dict(t.items()) == {b"": 1, b"a": 1, b"abc": 2, b"abd": 1, b"ab": 1}


def test_jaccard_components(spark, docs, stored, empty):
    sets = [shingles(t) for _, t in stored]
    comp = list(range(len(sets)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if setjoin.similar(sets[a], sets[b]):
                comp[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(stored):
        if sets[k] and i is not None:
            least[find(k)].append(i)
    want = Counter((i, len(sets[k]), min(least[find(k)], default=i) if sets[k] else i) for k, (i, _) in enumerate(stored))
    got = ngram_join.jaccard_components(spark, docs).drop("rid").collect()
    assert Counter(map(tuple, got)) == want
    assert ngram_join.jaccard_components(spark, empty).count() == 0


def test_line_dedup(spark, docs, stored, empty):
    order = sorted(range(len(stored)), key=lambda k: (stored[k][0] is None, stored[k][0] or 0, k))
    seen, want = [], {}
    for k in order:
        i, t = stored[k]
        kept = []
        for line in (t or "").split("\n"):
            s = shingles(line, lines=True)
            if not any(setjoin.similar(s, x) for x in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want[k] = (i, None if t is None else "\n".join(kept))
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark, docs).collect())
    assert got == Counter(want.values())
    assert line_dedup.dedup_lines(spark, empty).count() == 0


def test_decontaminate(spark, docs, stored, empty):
    some = (stored[3][1] or "").split()
    items = [(1, " ".join(some[:14])), (2, "three words only"), (3, None), (None, "one"), (4, "zz qq"), (1, " ".join(some[:14]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    want = Counter()
    for i, t in stored:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for win in [v[k : k + 10] for k in range(max(1, len(v) - 9))] if v and item is not None else []:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        found.add(str(item))
        want[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    for block in (decontaminate.BLOCK, 2):  # the second takes several passes
        got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.contaminated(spark, docs, bench, block=block).collect())
        assert got == want
    none = decontaminate.contaminated(spark, docs, bench.limit(0))
    assert none.filter("n_hit > 0").isEmpty() and none.count() == len(stored)
    assert decontaminate.contaminated(spark, empty, bench).count() == 0


def test_license_scan(docs, empty):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    by_text = lambda t: license_scan.NoticeScanner().scan(t.encode())
    assert by_text("CC BY cc by")["n_base"] == 2 and by_text("CC BY cc by")["last_word"] == 2
    r = by_text("gnu generl public license")
    assert (r["n_base"], r["base_labels"], r["labels"]) == (0, "", "gpl") and 0.9 < r["score"] < 1 and r["spans"][0]["edits"] == 1
    assert by_text("nothing here")["score"] == 0 and by_text("")["n_words"] == 0
    assert len(got) and license_scan.scan_licenses(empty).count() == 0


def test_language_id(spark, docs, empty):
    text = {"xx": "abba baab abab ", "yy": "zyzy yzzy zzyy "}
    train = spark.createDataFrame([(i, text[lang] * 5, lang) for i, lang in enumerate(["xx", "yy"] * 5)], "doc_id long, text string, lang string")
    model = language_id.learn(train)
    asked = spark.createDataFrame([(1, "baab abba"), (2, "zy zzyy"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(asked, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["xx", "yy", "und", "und", "und"] and got[1][1] > 0.5 and got[3][1] == 0
    assert language_id.learn(empty) == {} and language_id.predict(empty, model).count() == 0


def test_pieces_equal_the_library_and_come_back(docs, stored, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    want = Counter((i, tuple(sp.encode(t or ""))) for i, t in stored)
    out = pieces.encode(docs)
    assert Counter((r["doc_id"], tuple(r["piece_ids"])) for r in out.collect()) == want
    back = pieces.decode(out.select("doc_id", "text", "piece_ids")).collect()
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in back)
    m = pieces.model()
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("abe  =-.\n tinghaé漢😀") for _ in range(r.randint(1, 60)))
        assert np.frombuffer(m.encode([t])[0], "<u4").tolist() == sp.encode(t)
    assert pieces.encode(empty).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5] * 300, [0] * 5000, [2**64 - 1, 0, 2**60, 2**60 - 1], list(range(70000, 73000))])
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    e = simple8b.encode(v)
    assert (simple8b.decode(e["words"], e["offsets"], e["escape_at"], e["escapes"], e["n"]) == v).all()
    for b in range(0, len(v), simple8b.BLOCK):  # a block decodes alone
        a, z = e["offsets"][b // simple8b.BLOCK], np.append(e["offsets"], len(e["words"]))[b // simple8b.BLOCK + 1]
        n = min(simple8b.BLOCK, len(v) - b)
        alone = simple8b.decode(e["words"][a:z], np.zeros(1, np.uint32), [], np.zeros(0, np.uint64), n)
        ok = v[b : b + n] < 2**60
        assert (alone[ok] == v[b : b + n][ok]).all()


def test_token_output(spark, docs, stored, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [0] for k, (_, t) in enumerate(stored)}
    for name, segment in (("a", token_output.SEGMENT), ("b", 50)):
        token_output.write_tokens(spark, docs, str(tmp_path / name), segment=segment)
        got = token_output.token_index(spark, str(tmp_path / name)).orderBy("start").collect()
        crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((stored[k][0], len(x), crc(x)) for k, x in ids.items())
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        order = [r["doc_id"] for r in got if r["doc_id"] is not None]
        assert order == sorted(order)
        lists = Counter((r["doc_id"], tuple(r["ids"])) for r in token_output.read_tokens(spark, str(tmp_path / name)).collect())
        assert lists == Counter((stored[k][0], tuple(x)) for k, x in ids.items())
    token_output.write_tokens(spark, empty, str(tmp_path / "c"))
    assert token_output.token_index(spark, str(tmp_path / "c")).count() == 0


def test_resample_takes_exactly_k_by_key(spark, docs, stored, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)] + [(3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = resample.resample(spark, docs, labels, share=0.4).collect()
    k = round(0.4 * len(stored))
    assert sum(r["kept"] for r in got) == k and len(got) == len(stored)
    assert min(r["key"] for r in got if r["kept"]) >= max(r["key"] for r in got if not r["kept"])
    assert resample.resample(spark, empty, labels).count() == 0
    tied = spark.createDataFrame([(i, i, 5) for i in range(50)], "rid long, doc_id long, code long")
    assert sorted(r["doc_id"] for r in tied.filter(resample.top_k(tied, 7)).collect()) == list(range(7))


def test_lm_base_score_and_once_scored(spark, docs, stored, empty):
    import math

    model, counts = lm_score.learn(spark, docs.filter("doc_id % 7 <> 2"))
    c = Counter()
    for i, t in stored:
        if i is not None and i % 7 != 2:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in stored:
        w = [*(t or "").encode().lower().split(), None]
        want[(i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    for head in (lm_score.HEAD, 5):
        got = lm_score.score(spark, docs, model, counts, head).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    _, ids, lengths = lm_score._sequences([b"a b c " * 50, b""])
    text, begin, size, done = model.windows(lengths)
    assert np.bincount(text, size - done, 2).tolist() == (lengths - 1).tolist()  # each place is scored once
    p = np.exp(model.forward(model.symbol[ids[:20]][None])[0])
    assert np.allclose((p / p.sum(1, keepdims=True)).sum(1), 1) and (model.score(ids, lengths) < 0).all()
    assert lm_score.score(spark, empty, model, counts).count() == 0


def test_lm_gradient():
    """Backward pass against differences."""
    r = np.random.default_rng(0)
    model = lm_score.Model(r.integers(1, 50, lm_score._subwords().size).astype(float))
    s, t, mask = r.integers(0, 50, (3, 10)), r.integers(0, lm_score.CLASSES, (3, 10)), np.ones((3, 10), np.float32)
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}

    def loss():
        z, _ = model.forward(s)
        return -(z[np.arange(30), t.reshape(-1)] - np.log(np.exp(z).sum(1))).mean()

    g = model.gradient(s, t, mask)
    for name in ("U", "V", "K", "P"):
        at = (1,) * model.w[name].ndim
        model.w[name][at] += 1e-4
        up = loss()
        model.w[name][at] -= 2e-4
        down = loss()
        model.w[name][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-4


def test_pipeline(spark, tmp_path):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs, names = common.documents(spark, sf), None
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "pieces":
            assert out.columns == docs.columns
        docs = common.materialise(spark, out, f"test-{name}")
    assert 0 < docs.count() <= before and docs.columns == ["doc_id", "n_pieces", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))
    assert names is None


def test_shingle_sets_of_texts_and_lines():
    long = b"x" * 256 + b" " + b"x" * 257 + b" a\0 a B\xc3\xa9 " + b"y" * 9 + b"\x0b" + b"y" * 17
    texts = [b"", b"a", b" \n a b\tc d e f\n\nA B c D e F g\n", b"a b c d e f", long, b"\n\n", b"a b a b a b a b"]
    owner, line, hashes = setjoin._words(texts)
    want = [(k, i, w) for k, t in enumerate(texts) for i, x in enumerate(t.lower().split(b"\n")) for w in x.split()]
    assert list(zip(owner.tolist(), line.tolist())) == [w[:2] for w in want]
    known = {}
    assert all(known.setdefault(w[2], h) == h for w, h in zip(want, hashes.tolist())) and len(set(known.values())) == len(known)
    count = lambda ws, short: len({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}) or int(short and bool(ws))
    for short in (True, False):
        assert setjoin.text_sets(texts, short)[1].tolist() == [count(t.lower().split(), short) for t in texts]
    _, sizes, owner, line = setjoin.line_sets(texts)
    lines = [(k, i, count(x.split(), False)) for k, t in enumerate(texts) for i, x in enumerate(t.lower().split(b"\n"))]
    assert list(zip(owner.tolist(), line.tolist(), sizes.tolist())) == [x for x in lines if x[2]]


def test_forward_scores_and_paths_are_those_of_the_library():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    r, m = random.Random(2), pieces.PieceModel(public_tokenizers.path(pieces.MODEL))
    words = sorted({"▁" + "".join(r.choice(["in", "ter", "nation", "al", "s", "e", ".", "x", "é", "漢", "ization"]) for _ in range(r.randint(1, 8))) for _ in range(500)})
    for word, ids, score in m.viterbi(words):
        assert ids == sp.encode(word[1:])
        assert abs(score - sum(sp.get_score(i) for i in ids if not sp.is_byte(i))) < 1e-3
    broken = pieces.PieceModel(public_tokenizers.path(pieces.MODEL))
    broken.may_follow = lambda p, t: p == 0 and len(broken.pieces[t]) < 4  # no path: words are merged instead
    assert [ids for _, ids, _ in broken.viterbi(words)] == [sp.encode(w[1:]) for w in words]


def test_cut_leaves_odd_texts_whole():
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = ["a b a", None, "", "b  c", "c", "x a"]
    words, whole, entries, counts = common.cut(pa.array(texts), lambda w: pc.equal(w, ""))
    assert whole.tolist() == [1, 2, 3] and counts.tolist() == [3, 1, 1, 1, 1, 2]
    blobs = [w.encode() for w in words] + [b"[%d]" % k for k in whole]
    values, n = common.joined(blobs, entries, counts, "u1")
    assert values.tobytes() == b"aba[1][2][3]cxa" and n.tolist() == [3, 3, 3, 3, 1, 2]
    none = common.joined([], np.zeros(0, np.int64), np.zeros(0, np.int64), "u1")
    assert len(none[0]) == 0 and len(none[1]) == 0
