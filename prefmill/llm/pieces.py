"""SentencePiece encoding and decoding by shared-prefix Viterbi (op 5).

The model file is a BPE model (public, not trained here): its encoding is the one that merging gives. The lattice of
a marked word has a piece for every arc, and the best path to a position is unique: it ends with the one piece t such
that the best path to where t begins ends with a piece p that may stand before t, i.e. merging p+t gives [p, t] again.
So the forward step keeps one state a position, as Viterbi does: the last piece, where it begins, and the forward score
(the sum of the scores, i.e. merge ranks, of the pieces so far). That test, not the larger sum, decides between arcs:
the path with the largest sum is not the encoding that the model's users have.

A text is split into marked words (a run of marks and what follows; no piece has a mark after another character, so
words are independent), and a word where no piece holds both neighbours. The distinct words of a batch are sorted,
which is a depth-first walk of their trie, and the states and forward scores of the prefix that a word shares with the
one before are used again. Characters without a piece become byte pieces. Decoding joins piece bytes, turns marks into
spaces and drops the first one.

Cases: null and empty texts have no ids and decode to empty; a literal U+2581 decodes as a space, as in the library.
Rows of equal doc_id stay separate. The other columns of the input stay as they are, but for one that is named as the
result (piece_ids, decoded), which is replaced.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words and parts that a worker remembers, and the characters of the longest of them: 130 MB or so.
CACHE, LONGEST = 600_000, 48
#: Neighbours whose test is remembered.
PAIRS = 500_000
#: Bytes of text that are encoded together, if no single text is longer.
SLICE = 12 << 20
_WORD = re.compile(MARK + "+[^" + MARK + "]*")
_RUNS = re.compile(r"[.,;:!?()\n]+|[^.,;:!?()\n]+")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.vocab = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.scores = [self.score.get(p, 0.0) for p in self.pieces]
        # lengths of the pieces that can end in three, or two, given characters, the longest first
        self.single, self.ending, sizes = (1,), {p: (2, 1) for p in self.vocab if len(p) == 2}, {}
        for piece in self.vocab:
            if len(piece) > 2:
                sizes.setdefault(piece[-3:], {1}).add(len(piece))
        for e, x in sizes.items():
            self.ending[e] = tuple(sorted(x | {2} if e[1:] in self.vocab else x, reverse=True))
        self.joins = {p[k : k + 2] for p in self.vocab for k in range(len(p) - 1)}
        self.out = [p.replace(MARK, " ").encode() for p in self.pieces]
        for value, i in self.byte.items():
            self.out[i] = bytes([value])
        self.pairs: dict = {}
        self.known: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Merging itself: the neighbours whose piece scores best become one, the leftmost of equals first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, p: int, t: int) -> bool:
        """Whether piece t may stand after piece p; p 0 is the beginning, or a character without a piece; p -1 no state."""
        piece = self.pieces[t]
        ok = p >= 0 and self.merge((self.pieces[p] if p else "") + piece) == ([self.pieces[p], piece] if p else [piece])
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[p << 24 | t] = ok
        return ok

    def viterbi(self, words: list[str]):
        """(word, ids, forward score of its end) of each word of a sorted list of distinct words."""
        vocab, ending, pairs, may, single, scores = self.vocab, self.ending, self.pairs, self.may_follow, self.single, self.scores
        last, back, forward, before = [0], [0], [0.0], ""  # of each prefix: its last piece, where that begins, its score
        for word in words:
            n, shared = len(word), 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], back[shared + 1 :], forward[shared + 1 :]
            for end in range(shared + 1, n + 1):
                state = None
                for size in (end > 2 and ending.get(word[end - 3 : end])) or (end > 1 and ending.get(word[end - 2 : end])) or single:
                    begin = end - size
                    if begin < 0:
                        continue
                    t = vocab.get(word[begin:end])
                    if t is None:
                        if size > 1:
                            continue
                        t = 0  # a character without a piece: nothing merges with it
                    else:
                        ok = pairs.get(last[begin] << 24 | t)
                        if not (may(last[begin], t) if ok is None else ok):
                            continue
                    state = t, begin
                    break
                state = state or (-1, end - 1)  # no arc fits
                last.append(state[0])
                back.append(state[1])
                forward.append(forward[state[1]] + scores[state[0]])
            before, path, at = word, [], n
            while at and last[at] >= 0:
                path += [last[at]] if last[at] else reversed(self._ids(word[at - 1]))
                at = back[at]
            if at:  # not seen so far; merging needs no path
                parts = self.merge(word)
                yield word, [i for p in parts for i in self._ids(p)], sum(self.score.get(p, 0.0) for p in parts)
            else:
                path.reverse()
                yield word, path, forward[n]

    def _ids(self, piece: str) -> list[int]:
        """A piece's id; byte pieces for a character that is none."""
        return [self.vocab[piece]] if piece in self.vocab else [self.byte.get(x, self.unknown) for x in piece.encode()]

    def cut(self, word: str) -> list[str]:
        """The word cut where no piece holds both neighbours, looked for around runs of the marks in _RUNS only."""
        found = _RUNS.findall(word)
        out = found[:1]
        for x in found[1:]:
            if out[-1][-1] + x[0] in self.joins:
                out[-1] += x
            else:
                out.append(x)
        return out

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of those of the distinct words that are not known, as little-endian integers. CACHE words and parts of
        LONGEST characters at most stay known, those seen first: mostly the common ones."""
        known = self.known
        new = {w: self.cut(w) for w in words if w not in known}
        need = sorted({p for parts in new.values() for p in parts if p not in known})
        ids = {p: struct.pack(f"<{len(path)}I", *path) for p, path, _ in self.viterbi(need)}
        get = lambda p: ids.get(p) or known[p]
        ids |= {w: b"".join(map(get, parts)) for w, parts in new.items() if len(parts) > 1}
        known.update(islice(((w, x) for w, x in ids.items() if len(w) <= LONGEST), max(0, CACHE - len(known))))
        return ids

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        values, counts = self.encode_array(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(values, np.cumsum(counts)[:-1])] if texts else []

    def encode_array(self, texts: pa.Array):
        """Ids of all texts one after the other, and the number of each text's."""
        words, whole, entries, counts = common.cut(texts, lambda w: pc.or_(pc.equal(w, ""), pc.match_substring(w, MARK)))
        marked = [MARK + w if w and MARK not in w else "" for w in words]
        odd = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in (texts[k].as_py() for k in whole.tolist())]
        new = self.encode_words([*filter(None, marked), *set().union(*odd)])
        known = self.known
        get = lambda w: known.get(w) or new[w]
        blobs = [get(w) if w else b"" for w in marked] + [b"".join(map(get, c)) for c in odd]
        return common.joined(blobs, entries, counts, "<i4")

    def decode(self, ids) -> str:
        out = b"".join(map(self.out.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


_MODELS: dict[str, PieceModel] = {}  # a Python worker serves many tasks


def model(path: str | None = None) -> PieceModel:
    import public_tokenizers

    path = path or public_tokenizers.path(MODEL)
    return _MODELS.get(path) or _MODELS.setdefault(path, PieceModel(path))


def encode(docs: DataFrame, path: str | None = None, keep: bool = True, then=None, schema: str | None = None) -> DataFrame:
    """The columns of docs and piece_ids array<int>. keep: a worker remembers words for its next task; where workers go on
    to other work, that memory is better given back. then: makes of these batches, in the same worker, those of schema;
    a mapInArrow of its own would be a second Python worker with a second model for each task."""
    kept = [c for c in docs.columns if c != "piece_ids"]
    then = then or iter

    def encoded(batches):
        m = model(path)
        for b in batches:
            for some in common.slices(b, "_text", SLICE):
                ids = common.flat_lists(*m.encode_array(some.column("_text")))
                yield pa.RecordBatch.from_arrays([some.column(c) for c in kept] + [ids], names=[*kept, "piece_ids"])

    def run(batches):
        yield from then(encoded(batches))
        m = model(path)
        common.tidy(*(() if keep else (m.known, m.pairs)))

    rows = docs.select(*kept, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, schema or docs.select(*kept).schema.add("piece_ids", T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of df and decoded string, from piece_ids."""
    kept = [c for c in df.columns if c != "decoded"]

    def run(batches):
        m = model(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                texts = [m.decode(i or ()) for i in some.column("piece_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(c) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return df.select(*kept).mapInArrow(run, df.select(*kept).schema.add("decoded", T.StringType()))


def _digest(path):
    def run(batches):
        m = model(path)
        for b in batches:
            lists = b.column("piece_ids")
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows = []
            for k, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())):
                ids = values[at[k] : at[k + 1]]
                rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), m.decode(ids.tolist()) == (text or "").replace(MARK, " ")))
            yield common.batches(rows, pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())]))

    return run


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and say whether the text came back."""
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with common.arrow_rows(spark, 4000):
        return encode(docs, then=_digest(None), schema="doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
