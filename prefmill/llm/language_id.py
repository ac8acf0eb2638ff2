"""Language ID by hyperdimensional profiles (op 2).

Each letter has a random +-1 vector of DIM places. The vector of an n-gram binds (multiplies) the vectors of its
symbols, each permuted (rotated) by its place; a document bundles (adds) the vectors of its n-grams, a language the
vectors of its training documents; a document gets the language whose prototype has the largest cosine with it (the
first in order of name on ties), and that cosine, cut to 0..1, as score.

Text is reduced to 64 symbols: letters in lower case (a-z alone, others by a hash of the code point into 37 classes)
and one symbol for every run of other characters. Bundling is linear, so training only counts n-grams by language,
pre-aggregated in each task.

Cases: a null text or one without a letter is `und` with score 0; documents without lang are not learned from; with
nothing to learn from, every document is `und`. Rows of equal doc_id stay separate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

DIM, GRAM, SEED = 512, 3, 20240607
#: Rows of n-gram vectors that a worker keeps.
KEEP = 60_000
_STATE: dict = {}


def symbols() -> np.ndarray:
    """Symbol of each code point; 0 is no letter."""
    if "symbols" not in _STATE:
        table = np.zeros(0x110000, np.uint8)
        for p in range(0x110000):
            if 0xD800 <= p < 0xE000:
                continue
            c = chr(p)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[p] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 37
        _STATE["symbols"] = table
    return _STATE["symbols"]


def grams(text: str) -> np.ndarray:
    """Codes of the n-grams of a text; none if it has no letter."""
    s = symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not s.any():
        return np.zeros(0, np.int32)
    s = s[(s != 0) | np.concatenate([[True], s[:-1] != 0])]
    s = np.concatenate([[0], s[s.argmax() if s[0] == 0 and s.any() else 0 :], [0]]).astype(np.int32) if s[0] else np.concatenate([s, [0]]).astype(np.int32)
    return (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]


class Vectors:
    """n-gram vectors, made when first needed."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (64, dim))
        self.by_place = [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        self.row = np.full(1 << 18, -1, np.int32)
        self.kept = np.zeros((1024, dim), np.int8)
        self.n = 0

    def bind(self, codes: np.ndarray) -> np.ndarray:
        return self.by_place[0][codes >> 12] * self.by_place[1][(codes >> 6) & 63] * self.by_place[2][codes & 63]

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        at = self.row[codes]
        new = codes[at < 0]
        if len(new):
            if self.n + len(new) > KEEP:
                return self.bind(codes)
            while self.n + len(new) > len(self.kept):
                self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
            self.kept[self.n : self.n + len(new)] = self.bind(new)
            self.row[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
            at = self.row[codes]
        return self.kept[at]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.kept.shape[1], np.float64)
        for k in range(0, len(codes), 4096):
            out += counts[k : k + 4096].astype(np.float32) @ self[codes[k : k + 4096]].astype(np.float32)
        return out


def _vectors(dim: int, seed: int) -> Vectors:
    return _STATE.setdefault((dim, seed), Vectors(dim, seed))


def _count(batches):
    """(lang, code, n) of a task's training documents."""
    total: dict[str, np.ndarray] = {}

    def emit():
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "code", "n"])
        total.clear()
        common.tidy()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if len(total) > 40 and lang not in total:
                yield from emit()
            codes = grams(text)
            if len(codes):
                n = total.setdefault(lang, np.zeros(1 << 18, np.int64))
                u, c = np.unique(codes, return_counts=True)
                n[u] += c
    yield from emit()


def learn(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype of each language from all documents with text and lang. A prototype is `dim` numbers; the counts behind
    it, at most 2^18 a language, meet in one task a language."""

    def prototype(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = _vectors(dim, seed).bundle(rows["code"].to_numpy(), rows["n"].to_numpy().astype(np.float64))
        return pd.DataFrame({"lang": [key[0]], "v": [v / max(np.linalg.norm(v), 1e-12)]})

    rows = docs.select("lang", F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return {r["lang"]: np.array(r["v"], np.float32) for r in counts.groupBy("lang").applyInPandas(prototype, "lang string, v array<double>").collect()}


def predict(docs: DataFrame, model: dict[str, np.ndarray], dim: int = DIM, seed: int = SEED) -> DataFrame:
    """docs with the columns lang_pred and score, in place of columns of those names; only text is read."""
    langs = sorted(model)
    matrix = np.array([model[x] for x in langs], np.float32).reshape(len(langs), dim)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        vectors, out = _vectors(dim, seed), []
        for t in texts:
            codes = grams(t) if t else ()
            if not len(codes) or not langs:
                out.append(("und", 0.0))
                continue
            v = vectors.bundle(*np.unique(codes, return_counts=True))
            cos = matrix @ v / max(np.linalg.norm(v), 1e-12)
            best = int(np.argmax(np.round(cos, 7)))
            out.append((langs[best], float(min(1.0, max(0.0, cos[best])))))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, guess(F.col("text").cast("string")).alias("_guess")).select(*kept, F.col("_guess.lang_pred").alias("lang_pred"), F.col("_guess.score").alias("score"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = common.crc_mod_column("doc_id", 5) == 0
    model = learn(docs.filter(~held))
    return predict(docs.drop("lang"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
