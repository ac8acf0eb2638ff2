"""LM scoring: a causal self-attention model in numpy on subword ids (op 1).

A text is its words [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased, and one end. Each word, with a space before it, is
cut into subwords by a public byte-level BPE. The probability of a subword has two factors: its class given what stands
before it, from the model, and the subword given its class and the subwords before it in its word, from counts. The
model adds to a table of class counts after the previous symbol the output of one causal self-attention head over the
window, whose weights are trained by Adam in numpy. Within a class, every
pair (the last subword, or the last DEPTH in the word, and the next) has what its counts say, mixed with what the shorter
context says, at last the subwords' own counts. There may be any number of pairs, so their sums are made once a word by
joins with tables of all pairs, and added to texts word by word. A Model alone holds the commonest PAIRS only.

Training: the documents are dealt out by a hash of their ids into shards of about SHARD tokens, so there are the more
shards the more documents, whatever the partitions of the table; each shard trains on its documents in order of
(doc_id, ids), on every subword once, and the weights are averaged by places trained on, in a tree of sums. Training
texts are cut once: their ids are stored, and classes are counted and weights trained on those.

Windows are WIDTH subwords wide and begin every STRIDE; a subword is scored in the first window that holds it, so
each is scored once and has WIDTH - STRIDE subwords of context at least, where the text has them. All windows of a
batch go through masked attention together.

Learnt from every training document: word counts, subword counts, pair counts, class counts and the weights.

Base score: sum of log10((c + 1) / (N + V + 1)) over tokens (words and the end). The HEAD commonest words are looked
up in a broadcast table of fixed size; the others, which by that are no hot keys, are joined with their counts.

Cases: null and empty texts have one token, the end; with no training documents c, N and V are 0, classes are equally
likely and so are subwords within a class. Rows of equal doc_id stay separate rows, and so do repeated rows. Documents
that are no scan of stored files are stored first.
"""

from __future__ import annotations

import base64
import copy
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

MOD, HELD = 7, 2
RANKS = "byte_bpe_50k.tiktoken"
HEAD = 100_000
WIDTH, STRIDE, DIM = 32, 26, 16
SYMBOLS, OWN, CLASSES = 1024, 40, 64
#: Pairs of neighbours in a table of SLOTS places, and the weight of a class's own counts against them.
PAIRS, SLOTS, PRIOR, DEPTH = 200_000, 1 << 20, 1.0, 5
#: Tokens that one model trains on before the weights are averaged, and vectors that one task adds up.
SHARD, FAN = 1_000_000, 32
#: Windows that are scored at once: what they need stays in a core's cache.
BLOCK = 64
_END = ""
_CACHE: dict = {}


class Subwords:
    """Ids of words, and the end's id; words are cached."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.starts = np.zeros(self.size, bool)
        self.first = np.zeros(self.size, np.int64)  # a class for subwords that have none of their own
        for piece, i in ranks.items():
            self.starts[i] = piece[:1] == b" "
            body = piece.strip() or b" "
            kind = body[0] % 8 if body[0] < 128 and body.isalpha() else 8 + (body[0] >= 128) * (1 + body[-1] % 2) if not body.isalpha() else 11
            self.first[i] = kind * 2 + self.starts[i]
        self.cache: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of each word."""
        cache = self.cache
        new = list(set(words).difference(cache))
        if new:
            if len(cache) > 400_000:
                cache.clear()
                new = list(set(words))
            for k in range(0, len(new), 1000):
                some = new[k : k + 1000]
                v = np.array(self.coder.encode_ordinary(" " + " ".join(x.decode("utf-8", "replace") for x in some)), "<u2")
                at = (np.flatnonzero(self.starts[v]) * 2).tolist()
                if len(at) == len(some):
                    blob = v.tobytes()
                    cache.update(zip(some, (blob[i:j] for i, j in zip(at, at[1:] + [len(blob)]))))
                else:
                    cache.update((x, np.array(self.coder.encode_ordinary(" " + x.decode("utf-8", "replace")), "<u2").tobytes()) for x in some)
        return list(map(cache.__getitem__, words))


def _subwords() -> Subwords:
    return _CACHE.get("subwords") or _CACHE.setdefault("subwords", Subwords())


def cut(texts: pa.Array):
    """The distinct words of texts, the number of each word of all texts in turn, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    words, entries, counts = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)
    if b"" in words:  # before or after white space at an end of a text
        none = words.index(b"")
        at = np.flatnonzero(entries == none)
        counts -= np.bincount(np.searchsorted(np.cumsum(counts), at, side="right"), minlength=len(counts))
        entries = np.delete(entries, at)
    return words, entries, counts


def _blobs(words: list[bytes]) -> list[bytes]:
    """Ids of each word, and of the end. cut() may list the empty word, which stands nowhere."""
    sub = _subwords()
    return [*sub.ids([w or b"a" for w in words]), np.array([sub.end], "<u2").tobytes()]


def _ids(words: list[bytes], entries: np.ndarray, counts: np.ndarray, blobs: list[bytes] | None = None):
    """Ids of each text between two ends, as one flat array, and lengths."""
    blobs = blobs or _blobs(words)
    more = np.zeros(len(entries) + 2 * len(counts), np.int64)
    stops = np.cumsum(counts + 2)
    last = np.ones(len(more), bool)
    last[stops - 1] = last[stops - counts - 2] = False
    more[last], more[~last] = entries, len(words)
    ids, lengths = common.joined(blobs, more, counts + 2, "<u2")
    return ids.astype(np.int32), lengths


def _sequences(texts: list[bytes]):
    """The words of each text, and (ids of the text between two ends) as one flat array and lengths."""
    words, entries, counts = cut(pa.array(texts, pa.binary()).cast(pa.string()))
    stops = np.cumsum(counts)
    return [[words[k] for k in entries[i:j].tolist()] for i, j in zip(stops - counts, stops)], *_ids(words, entries, counts)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def contexts(ids: np.ndarray) -> np.ndarray:
    """Hash of the last DEPTH subwords up to each place that belong to its word; the end is a word of its own."""
    sub = _subwords()
    first = sub.starts[ids] | (ids == sub.end)
    h, same = _mix(ids, np.zeros(1)), ~first
    for k in range(1, min(DEPTH, len(ids))):
        h[k:] = np.where(same[k:], _mix(h[k:], ids[:-k]), h[k:])
        same[k:] &= ~first[:-k]
        same[:k] = False
    return h


class Slots:
    """A table of 64-bit keys in fixed places: of keys that meet in one, the first stays."""

    def __init__(self, keys: np.ndarray):
        _, self.listed = np.unique(self._place(keys), return_index=True)
        self.listed.sort()
        self.keys, self.values = np.zeros(SLOTS, np.uint64), np.full(SLOTS, np.nan, np.float32)
        self.chosen = keys[self.listed]
        self.keys[self._place(self.chosen)] = self.chosen

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(20)).astype(np.int64) % SLOTS

    def fill(self, values: np.ndarray) -> None:
        self.values[self._place(self.chosen)] = values
        del self.chosen

    def __getstate__(self):
        """What is sent to tasks: the places that are taken."""
        at = np.flatnonzero(~np.isnan(self.values))
        return self.keys[at], self.values[at]

    def __setstate__(self, listed) -> None:
        keys, values = listed
        at = self._place(keys)
        self.keys, self.values = np.zeros(SLOTS, np.uint64), np.full(SLOTS, np.nan, np.float32)
        self.keys[at], self.values[at] = keys, values

    def look(self, keys: np.ndarray, other: float) -> np.ndarray:
        at = self._place(keys)
        found = np.where(self.keys[at] == keys, self.values[at], np.nan)
        return np.where(np.isnan(found), other, found)


class Model:
    """Class map, count tables and attention weights; all sizes are fixed."""

    def __init__(self, id_counts: np.ndarray, seed: int = 3):
        sub = _subwords()
        order = np.argsort(-id_counts, kind="stable")
        rest = OWN + sub.first
        self.klass = np.minimum(rest, CLASSES - 1)
        self.klass[order[:OWN]] = np.arange(OWN)
        self.symbol = SYMBOLS - CLASSES + self.klass
        top = order[: SYMBOLS - CLASSES]
        self.symbol[top] = np.arange(len(top))
        mass = np.bincount(self.klass, id_counts + 1.0, CLASSES)
        self.within = np.log((id_counts + 1.0) / mass[self.klass])
        self.levels: list = []
        self.near: DataFrame | None = None
        used = mass > 0
        self.table = np.where(used, -math.log(max(used.sum(), 1)), -1e9) * np.ones((SYMBOLS, 1))
        self.used = used
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0] if len(s) > 1 else 1)).astype(np.float32)
        self.w = {"E": 0.5 * rng.standard_normal((SYMBOLS, DIM)).astype(np.float32), "Q": r(DIM, DIM), "K": r(DIM, DIM), "V": r(DIM, DIM), "U": 0.02 * r(DIM, CLASSES), "P": np.zeros(WIDTH, np.float32)}
        self._finish()

    def outer(self) -> Model:
        """The model without its pairs, for tasks that need no probabilities within a class."""
        other = copy.copy(self)
        other.levels, other.near = [], None
        return other

    def set_table(self, pairs: np.ndarray) -> None:
        """Class counts after each symbol, backed off to the counts of all classes."""
        pairs = pairs.reshape(SYMBOLS, CLASSES)
        every = pairs.sum(0) + self.used * 0.1
        every = every / max(every.sum(), 1e-9)
        p = (pairs + 4.0 * every) / (pairs.sum(1, keepdims=True) + 4.0 * max(every.sum(), 1e-9))
        self.table = np.where(self.used & (p > 0), np.log(np.maximum(p, 1e-30)), -1e9)
        self._finish()

    def add_level(self, context: np.ndarray, after: np.ndarray, n: np.ndarray, last: np.ndarray, deep: bool) -> None:
        """Pairs of a context and the next subword, the commonest first; last is the last subword of the context. Of two
        that meet in a slot the first stays. For a listed pair, P(b | class of b, context) = (n(context, b) + PRIOR P'(b |
        class)) / (n(context, class) + PRIOR), where P' is that of the levels before and n(context, class) is over listed
        pairs; for others the first term is missing, so the sum over a class is 1."""
        lower = self.inner(last, after, last.astype(np.uint64))  # level 1 stands before level 2 only
        pair = Slots(_mix(context, after))
        some = pair.listed
        context, after, n, lower = context[some], after[some], n[some].astype(float), lower[some]
        kinds, group = np.unique(_mix(context, self.klass[after]), return_inverse=True)
        mass = np.bincount(group, n, len(kinds))
        order = Slots(kinds)
        kept = np.zeros(len(kinds), bool)
        kept[order.listed] = True  # a context whose class has no slot is not listed at all
        pair.fill(np.where(kept[group], np.log((n + PRIOR * np.exp(lower)) / (mass[group] + PRIOR)), np.nan))
        order.fill(np.log(PRIOR / (mass[order.listed] + PRIOR)))
        self.levels.append((deep, pair, order))

    def inner(self, before: np.ndarray, after: np.ndarray, deep: np.ndarray) -> np.ndarray:
        """Log probability of each subword given its class, the subword before it and the hash of those before it."""
        lp = self.within[after]
        for is_deep, pair, order in self.levels:
            context = deep if is_deep else before
            gain, back = pair.look(_mix(context, after), np.nan), order.look(_mix(context, self.klass[after]), 0.0)
            lp = np.where(np.isnan(gain), lp + back, gain)
        return lp

    def _finish(self):
        self.table32 = self.table.astype(np.float32)
        self.cells = np.arange(SYMBOLS * DIM).reshape(SYMBOLS, DIM)
        gap = np.arange(WIDTH)[:, None] - np.arange(WIDTH)[None, :]
        self.gap, self.future = np.maximum(gap, 0), np.where(gap < 0, np.float32(-1e9), np.float32(0))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].reshape(-1) for k in sorted(self.w)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.w):
            n = self.w[k].size
            self.w[k] = flat[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n

    def heads(self):
        """Query (over the root of DIM), key, value and a one of each symbol: a symbol's are the same wherever it stands.
        And bounds of the products of queries and keys, and of what attention adds to a class."""
        w = self.w
        x = np.concatenate([w["E"] @ np.concatenate([w["Q"] / np.float32(math.sqrt(DIM)), w["K"], w["V"]], 1), np.ones((SYMBOLS, 1), np.float32)], 1)
        q, k, v, u = (math.sqrt(np.einsum("ij,ij->i", c, c).max()) for c in (x[:, :DIM], x[:, DIM : 2 * DIM], x[:, 2 * DIM : 3 * DIM], w["U"].T))
        return x, q * k, v * u

    def forward(self, s: np.ndarray, heads: tuple | None = None, skip: int = 0):
        """Log probabilities of the next class at each place from skip on of windows s (n, width), and what backward()
        needs."""
        w, n = self.w, s.shape[1]
        heads, products, added = heads or self.heads()
        x = heads.take(s, axis=0)
        q, k, v = x[:, skip:, :DIM], x[..., DIM : 2 * DIM], x[..., 2 * DIM :]
        a = q @ k.transpose(0, 2, 1)
        if products > 59:
            np.clip(a, -60, 60, out=a)  # in place of taking the maximum off: exp() neither overflows nor vanishes
        a += (w["P"][self.gap[:n, :n]] + self.future[:n, :n])[skip:]
        np.exp(a, out=a)
        h = a @ v
        total, h = h[..., DIM:], np.ascontiguousarray(h[..., :DIM])
        h /= total
        z = h.reshape(-1, DIM) @ w["U"]
        if added > 19:
            np.clip(z, -20, 20, out=z)
        z += self.table32.take(s[:, skip:].reshape(-1), axis=0)
        return z, (q, k, v[..., :DIM], a, total, h)

    def windows(self, lengths: np.ndarray):
        """First place of each window, places in it, and how many of them an earlier window has scored."""
        n = lengths - 1  # places that predict
        count = np.maximum(1, -(-(n - WIDTH) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.cumsum(lengths) - lengths
        return text, begin[text] + k * STRIDE, np.minimum(WIDTH, n[text] - k * STRIDE), np.where(k > 0, WIDTH - STRIDE, 0)

    def rounds(self, lengths: np.ndarray, most: int):
        """The windows in groups of `most` at most: text, first place and places of each, and how many of the first places
        are left out. Windows that begin a text have all their places, the others those that no earlier window has."""
        text, begin, size, done = self.windows(lengths)
        for skip in (0, WIDTH - STRIDE):
            kind = np.flatnonzero(done == skip)
            for a in range(0, len(kind), most):
                some = kind[a : a + most]
                yield text[some], begin[some], size[some], skip

    def score(self, ids: np.ndarray, lengths: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each text. within: the sum of inner() over each text, if it is known."""
        symbol, klass = self.symbol[ids], self.klass[ids]
        padded = np.concatenate([symbol, np.zeros(WIDTH, symbol.dtype)])
        target = np.concatenate([klass, np.zeros(WIDTH + 1, klass.dtype)])
        total, heads, ones = np.zeros(len(lengths)), self.heads(), np.ones(CLASSES, np.float32)
        for text, begin, size, skip in self.rounds(lengths, BLOCK):
            at = begin[:, None] + np.arange(WIDTH)
            z, _ = self.forward(padded.take(at), heads, skip)
            at = at[:, skip:]
            lp = z.reshape(-1).take(np.arange(0, z.size, CLASSES) + target.take(at + 1).reshape(-1)) - np.log(np.exp(z, out=z) @ ones)
            mine = np.arange(skip, WIDTH) < size[:, None]
            total += np.bincount(text, (lp.reshape(at.shape) * mine).sum(1, dtype=np.float64), len(lengths))
        if within is None:
            after = np.ones(len(ids), bool)
            after[np.cumsum(lengths) - lengths] = False
            after = np.flatnonzero(after)
            within = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[after], self.inner(ids[after - 1], ids[after], contexts(ids)[after - 1]), len(lengths))
        return (total + within) / math.log(10)

    def within_words(self, words: list[bytes], entries: np.ndarray, counts: np.ndarray, blobs: list[bytes] | None = None) -> np.ndarray:
        """The sum of inner() over each text that cut() has cut: what stands inside a word is summed once a word, and each
        text adds the first subwords of its words and its end."""
        blobs = blobs or _blobs(words)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 2
        flat = np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
        word, deep = np.repeat(np.arange(len(blobs)), sizes), contexts(flat)
        same = np.flatnonzero(word[1:] == word[:-1])
        inside = np.bincount(word[same], self.inner(flat[same], flat[same + 1], deep[same]), len(blobs))
        last = np.cumsum(sizes) - 1
        first = last - sizes + 1
        stops = np.cumsum(counts + 1)
        after = np.full(len(entries) + len(counts), len(words))
        middle = np.ones(len(after), bool)
        middle[stops - 1] = False
        after[middle] = entries
        before = np.concatenate([[len(words)], after[:-1]])  # a text's end stands before the next one
        value = inside[after] + self.inner(flat[last][before], flat[first][after], deep[last][before])
        return np.bincount(np.repeat(np.arange(len(counts)), counts + 1), value, len(counts))

    def gradient(self, s: np.ndarray, t: np.ndarray, mask: np.ndarray, skip: int = 0):
        """Gradients of the mean loss over masked places; t and mask are of the places from skip on."""
        z, (q, k, v, a, total, h) = self.forward(s, skip=skip)
        a /= total
        dz = np.exp(z, out=z)
        share = (mask.reshape(-1) / max(mask.sum(), 1)).astype(np.float32)
        dz *= (share / (dz @ np.ones(CLASSES, np.float32)))[:, None]
        dz[np.arange(len(dz)), t.reshape(-1)] -= share
        w, root, n = self.w, np.float32(math.sqrt(DIM)), s.shape[1]
        dh = (dz @ w["U"].T).reshape(h.shape)
        ds = dh @ v.transpose(0, 2, 1)
        ds -= np.einsum("nij,nij->ni", dh, h)[..., None]
        ds *= a
        # a symbol's query, key and value are the same wherever it stands, so their gradients are summed by symbol first
        place = self.cells.take(s, axis=0)
        d = {"Q": (ds @ k, place[:, skip:]), "K": (ds.transpose(0, 2, 1) @ q, place), "V": (a.transpose(0, 2, 1) @ dh, place)}
        d = {c: np.bincount(i.reshape(-1), x.reshape(-1), SYMBOLS * DIM).reshape(SYMBOLS, DIM).astype(np.float32) for c, (x, i) in d.items()}
        d["Q"] /= root
        past = self.future[skip:n, :n] == 0
        dp = np.bincount(self.gap[skip:n, :n][past], ds.sum(0)[past], WIDTH).astype(np.float32)
        return {"E": sum(x @ w[c].T for c, x in d.items()), **{c: w["E"].T @ x for c, x in d.items()}, "U": h.reshape(-1, DIM).T @ dz, "P": dp}

    def train(self, ids: np.ndarray, lengths: np.ndarray, moments: dict, rate: float = 0.01, batch: int = 128) -> int:
        """Adam over the windows of the texts, each place once; places trained on."""
        symbol = np.concatenate([self.symbol[ids], np.zeros(WIDTH, np.int64)])
        target = np.concatenate([self.klass[ids], np.zeros(WIDTH + 1, np.int64)])
        names, flat, at = sorted(self.w), self.flat(), 0
        for name in names:  # the weights are one vector while they are trained
            w = self.w[name]
            self.w[name] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        if not moments:
            moments |= {"t": 0, "m": np.zeros_like(flat), "v": np.zeros_like(flat)}
        m, v, f = moments["m"], moments["v"], np.float32
        for _, begin, size, skip in self.rounds(lengths, batch):
            at = begin[:, None] + np.arange(WIDTH)
            g = self.gradient(symbol.take(at), target.take(at[:, skip:] + 1), (np.arange(skip, WIDTH) < size[:, None]).astype(f), skip)
            g = np.concatenate([g[name].reshape(-1) for name in names])
            moments["t"] += 1
            m *= f(0.9)
            m += f(0.1) * g
            v *= f(0.999)
            v += f(0.001) * g * g
            flat -= f(rate / (1 - 0.9 ** moments["t"])) * m / (np.sqrt(v * f(1 / (1 - 0.999 ** moments["t"]))) + f(1e-8))
        return int((lengths - 1).sum())


_ENCODED = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("word", pa.string()), ("n", pa.int64())])


def _encode(batches):
    """A row with the ids of each text (hash, doc_id, text), as little-endian 16-bit integers, and rows of the words that
    the task has counted: texts are cut once for both."""
    counts, docs = Counter(), 0

    def tally(words: list, n: list) -> pa.RecordBatch:
        none = [pa.nulls(len(words), f.type) for f in list(_ENCODED)[:3]]
        return pa.RecordBatch.from_arrays([*none, pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], schema=_ENCODED)

    def emit():
        keys = list(counts)
        for k in range(0, len(keys), 50_000):
            some = keys[k : k + 50_000]
            yield tally(some, [counts[x] for x in some])
        counts.clear()

    for b in batches:
        for some in common.slices(b):
            words, entries, each = cut(some.column("text"))
            n = np.bincount(entries, minlength=len(words)).tolist()
            counts.update({w: c for w, c in zip(words, n) if c})
            docs += some.num_rows
            ids, lengths = _ids(words, entries, each)
            ends = np.concatenate([[0], np.cumsum(2 * lengths)]).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])
            none = [pa.nulls(len(lengths), f.type) for f in list(_ENCODED)[3:]]
            yield pa.RecordBatch.from_arrays([some.column("hash"), some.column("doc_id"), blobs, *none], schema=_ENCODED)
            if len(counts) > 500_000:
                yield from emit()
    yield from emit()
    if docs:
        yield tally([_END.encode()], [docs])


def _flat(column: pa.Array):
    """The ids of stored texts as one flat array, and lengths."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 2
    return np.frombuffer(column.buffers()[2], "<u2", ends[-1])[ends[0] :].astype(np.int32), np.diff(ends)


def _vector_row(v: np.ndarray, weight: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(weight)]), common.flat_lists(np.asarray(v, np.float64), [len(v)])], names=["task", "weight", "v"])


_VECTOR = "task int, weight double, v array<double>"


def _add_up(batches):
    total, weight = None, 0.0
    for b in batches:
        for w, v in zip(b.column("weight").to_pylist(), b.column("v")):
            v = v.values.to_numpy()
            total, weight = v if total is None else total + v, weight + w
    if total is not None:
        yield _vector_row(total, weight)


def vector_sum(spark: SparkSession, rows: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """Sum of v and of weight, as a tree: each step leaves a FANth of the vectors, so neither a task nor the driver gets
    more of them the more tasks there are."""
    tasks = common.partitions(spark)
    rows = rows.repartition(tasks, "task").mapInArrow(_add_up, _VECTOR)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        rows = rows.repartition(tasks, "task").mapInArrow(_add_up, _VECTOR)
    total, weight = np.zeros(size), 0.0
    for r in sorted(rows.collect()):
        total, weight = total + np.array(r["v"]), weight + r["weight"]
    return total, weight


def _count_ids(batches):
    sub = _subwords()
    total = np.zeros(sub.size)
    for b in batches:
        for k in range(0, b.num_rows, 20_000):
            some = b.slice(k, 20_000)
            words, n = common.raw_bytes(some.column("word")), some.column("n").to_numpy()
            total[sub.end] += sum(c for w, c in zip(words, n) if not w)
            n, words = n[[bool(w) for w in words]], [w for w in words if w]
            blobs = sub.ids(words)
            lengths = [len(x) // 2 for x in blobs]
            total += np.bincount(np.frombuffer(b"".join(blobs), "<u2"), np.repeat(n, lengths).astype(float), sub.size)
    yield _vector_row(total, 1.0)


def _count_neighbours(batches):
    """(before, context, after, n) of neighbouring subwords in words (word, n)."""
    sub = _subwords()
    for b in batches:
        for k in range(0, b.num_rows, 50_000):
            some = b.slice(k, 50_000)
            words, n = common.raw_bytes(some.column("word")), some.column("n").to_numpy()
            n, words = n[[bool(w) for w in words]], [w for w in words if w]
            blobs = sub.ids(words)
            word = np.repeat(np.arange(len(blobs)), [len(x) // 2 for x in blobs])
            flat = np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
            same = word[1:] == word[:-1]
            columns = flat[:-1][same].astype(np.int32), contexts(flat)[:-1][same].view(np.int64), flat[1:][same].astype(np.int32), n[word[1:][same]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["before", "context", "after", "n"])


def _word_pairs(batches):
    """(word, before, context, after, finish) of neighbouring subwords in words, and of each word's last and the end."""
    sub = _subwords()
    end = np.array([sub.end], "<u2").tobytes()
    for b in batches:
        for k in range(0, b.num_rows, 50_000):
            words = [w for w in common.raw_bytes(b.column("word").slice(k, 50_000)) if w]
            blobs = [x + end for x in sub.ids(words)]
            word = np.repeat(np.arange(len(blobs)), [len(x) // 2 for x in blobs])
            flat = np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
            same = word[1:] == word[:-1]
            owner = pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(word[1:][same]))
            columns = flat[:-1][same].astype(np.int32), contexts(flat)[:-1][same].view(np.int64), flat[1:][same].astype(np.int32), flat[1:][same] == sub.end
            yield pa.RecordBatch.from_arrays([owner, *(pa.array(c) for c in columns)], names=["word", "before", "context", "after", "finish"])


def word_sums(spark: SparkSession, model: Model, words: DataFrame) -> DataFrame:
    """For each of words (word, once each): inside, the sum of the log probabilities of its subwords after the first, given
    their classes, and finish, that of the end after it. P(b | class, context) = (n(context, b) + PRIOR P'(b | class)) /
    (n(context, class) + PRIOR), from all pairs; P' is that of the shorter context."""
    ids = np.arange(len(model.klass), dtype=np.int32)
    classes = F.broadcast(spark.createDataFrame(pa.table({"after": ids, "kind": model.klass.astype(np.int32), "base": model.within})))
    near = model.near.join(classes, "after")
    out = words.select("word").mapInArrow(_word_pairs, "word string, before int, context long, after int, finish boolean").join(classes, "after")
    out = out.withColumn("p", F.exp("base")).drop("base")
    for context in ("before", "context"):
        out = out.join(near.groupBy(context, "after").agg(F.sum("n").alias("n_" + context)), [context, "after"], "left")
        out = out.join(near.groupBy(context, "kind").agg(F.sum("n").alias("mass_" + context)), [context, "kind"], "left")
        p = (F.coalesce("n_" + context, F.lit(0)) + F.lit(PRIOR) * F.col("p")) / (F.coalesce("mass_" + context, F.lit(0)) + F.lit(PRIOR))
        # stored, so that the shuffle files of one level go before those of the next are written
        out = common.materialise(spark, out.withColumn("p", p).drop("n_" + context, "mass_" + context, *(["before"] if context == "before" else [])), "op1-level")
    out = out.select("word", "finish", F.log("p").alias("lp"))
    return out.groupBy("word").agg(F.coalesce(F.sum(F.when(~F.col("finish"), F.col("lp"))), F.lit(0.0)).alias("inside"), F.max(F.when(F.col("finish"), F.col("lp"))).alias("finish"))


def _count_pairs(model: Model):
    def run(batches):
        total = np.zeros(SYMBOLS * CLASSES)
        for b in batches:
            for some in common.slices(b, "ids"):
                ids, lengths = _flat(some.column("ids"))
                key = model.symbol[ids[:-1]] * CLASSES + model.klass[ids[1:]]
                inner = np.ones(len(key), bool)
                inner[np.cumsum(lengths)[:-1] - 1] = False  # from one text to the next
                total += np.bincount(key[inner], minlength=len(total))
        yield _vector_row(total, 1.0)

    return run


def _train(model: Model):
    """A weighted vector of weights from each shard; the rows come in order of shards."""

    def run(batches):
        fresh, moments, seen, now = model.flat(), {}, 0, None
        for b in batches:
            shards = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if shards[i] != now:
                    if seen:
                        yield _vector_row(model.flat().astype(np.float64) * seen, float(seen))
                        model.load(fresh)
                    moments, seen, now = {}, 0, shards[i]
                for some in common.slices(b.slice(i, j - i), "ids", 1 << 20):
                    seen += model.train(*_flat(some.column("ids")), moments)
        if seen:
            yield _vector_row(model.flat().astype(np.float64) * seen, float(seen))

    return run


_SCORED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_sum", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.string())), ("last", pa.string())])


def _score(model: Model, head):
    def run(batches):
        if "head" not in _CACHE or _CACHE["head"][0] != head.value[0]:
            key, words, *values = head.value
            _CACHE["head"] = key, dict(zip(words, zip(*values)))
        get, none = _CACHE["head"][1].get, (math.nan, 0.0, 0.0)
        end = get(_END.encode())
        for b in batches:
            for some in common.slices(b):
                words, entries, counts = cut(some.column("text"))
                blobs = _blobs(words)
                owner, n = np.repeat(np.arange(len(counts)), counts), len(counts)
                value, inside, finish = np.array([get(w, none) for w in [*words, b""]], float).T  # of the end nothing is used
                first = model.within[[int.from_bytes(x[:2], "little") for x in blobs[:-1]] or [0]]
                known = ~np.isnan(value[entries])
                # what stands in words of the head; score() adds what stands in the others
                last = np.full(n, len(words))
                last[counts > 0] = entries[(np.cumsum(counts) - 1)[counts > 0]]
                far = (counts > 0) & np.isnan(value[last])
                within = np.bincount(owner, first[entries] + inside[entries], n)
                within += np.where(counts > 0, np.where(far, 0.0, finish[last]), model.within[_subwords().end])
                scores = model.score(*_ids(words, entries, counts, blobs), within)
                head_known = np.bincount(owner[known], minlength=n) + (end is not None)
                head_sum = np.bincount(owner[known], value[entries][known], n) + (end[0] if end else 0.0)
                named = pa.array([*words, b""], pa.binary()).cast(pa.string())
                tail = common.flat_lists(named.take(pa.array(entries[~known])), np.bincount(owner[~known], minlength=n))
                yield pa.RecordBatch.from_arrays([some.column("rid"), some.column("doc_id"), pa.array(counts + 1), pa.array(head_known.astype(np.int64)), pa.array(head_sum), pa.array(scores), tail, named.take(pa.array(last, mask=~far))], schema=_SCORED)

    return run


def learn(spark: SparkSession, training: DataFrame, shard: int = SHARD):
    """The model and the table of word counts (word, n; the end is the empty word) of documents (doc_id, text)."""
    texts = training.select(F.xxhash64("doc_id", "text").alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = common.materialise(spark, texts.mapInArrow(_encode, "hash long, doc_id long, ids binary, word string, n long"), "op1-ids")
    counts = common.materialise(spark, encoded.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "op1-words")
    texts = encoded.filter("ids is not null")
    id_counts, _ = vector_sum(spark, counts.mapInArrow(_count_ids, _VECTOR), _subwords().size)
    model = Model(id_counts)
    near = counts.mapInArrow(_count_neighbours, "before int, context long, after int, n long").groupBy("before", "context", "after").agg(F.sum("n").alias("n"))
    near = model.near = common.materialise(spark, near, "op1-neighbours")
    for deep, keys in ((False, ("before", "after")), (True, ("before", "context", "after"))):
        top = near.groupBy(*keys).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), *keys).limit(PAIRS).toArrow()
        before, after, n = (top.column(c).to_numpy() for c in ("before", "after", "n"))
        model.add_level(top.column("context").to_numpy().view(np.uint64) if deep else before, after, n, before, deep)
    pairs, _ = vector_sum(spark, texts.select("ids").mapInArrow(_count_pairs(model.outer()), _VECTOR), SYMBOLS * CLASSES)
    model.set_table(pairs)
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-tokens // shard))
    dealt = texts.select(F.pmod("hash", F.lit(shards)).alias("shard"), "doc_id", "ids")
    dealt = dealt.repartition(common.partitions(spark), "shard").sortWithinPartitions("shard", "doc_id", "ids").select("shard", "ids")
    weights, seen = vector_sum(spark, dealt.mapInArrow(_train(model.outer()), _VECTOR), len(model.flat()))
    if seen:
        model.load(weights / seen)
    return model, counts


def score(spark: SparkSession, docs: DataFrame, model: Model, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cut, above = 1, 0  # the least count that keeps the head within its size; the driver sees counts of counts only
    for r in counts.filter("n > 1").groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(head).collect():
        above += r["words"]
        if above > head:
            cut = r["n"] + 1
            break
        cut = r["n"]
    known = common.materialise(spark, counts.join(word_sums(spark, model, counts), "word", "left"), "op1-sums")
    top = known.filter(((F.col("n") >= cut) & (F.col("n") > 1)) | (F.col("word") == _END)).na.fill(0.0, ["inside", "finish"]).collect()  # `head` rows and the end at most
    logs = [math.log10(r["n"] + 1.0) for r in top]
    table = spark.sparkContext.broadcast((id(top), [r["word"].encode() for r in top], logs, [r["inside"] for r in top], [r["finish"] for r in top]))
    rows = common.with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    sql = "rid long, doc_id long, n_tokens long, head_known long, head_sum double, score double, tail array<string>, last string"
    scored = common.materialise(spark, rows.mapInArrow(_score(model.outer(), table), sql), "op1-scored")
    tail = scored.select("rid", F.explode("tail").alias("word"), F.lit(False).alias("ends"))
    tail = tail.unionByName(scored.filter("last is not null").select("rid", F.col("last").alias("word"), F.lit(True).alias("ends")))
    new = tail.select("word").distinct().join(counts, "word", "left_anti")
    known = known.unionByName(word_sums(spark, model, new).withColumn("n", F.lit(None).cast("long")))
    tail = tail.join(known, "word")
    count = F.when(~F.col("ends"), F.col("n"))
    tail = tail.groupBy("rid").agg(F.count(count).alias("tail_known"), F.sum(F.log10(count + 1.0)).alias("tail_sum"), F.sum(F.when(F.col("ends"), F.col("finish")).otherwise(F.col("inside"))).alias("tail_inside"))
    out = scored.drop("tail", "last").join(tail, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("head_sum") + zero("tail_sum") - F.col("n_tokens") * math.log10(n + v + 1)
    return out.select("doc_id", "n_tokens", (F.col("head_known") + zero("tail_known")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + zero("tail_inside") / math.log(10)).alias("score"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    held = common.crc_mod_column("doc_id", MOD) == HELD
    with common.arrow_rows(spark, 1000):
        model, counts = learn(spark, docs.filter(~held))
        out = score(spark, docs, model, counts)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
