"""Exact similarity join of shingle sets, shared by the n-gram Jaccard join (op 7) and line dedup (op 9).

Sets hold 64-bit hashes of shingles of five words. Two sets are similar when 100 * |x & y| >= 75 * |x | y|. The steps:

A set is known by the 128-bit hash of its sorted hashes (two longs, key and check): equal sets are one point from the
start. Up to step 2 half of it, the key, is enough: a chance meeting only keeps a set that could have gone.

1. prefix: every set is sorted by hash and gives its first n - ceil(0.75 n) + l(n) hashes, l(n) = floor(extra * n) + 1.
   Similar sets share at least min(l) of them. A task packs them into blobs by hash bucket, so the shuffle moves
   arrays, not rows; a set that a task has already seen is not sent again.
2. survivors: a hash that stands in one set only can't be shared. A set with fewer than lmin others goes away; so do
   nearly all sets without a partner.
3. rarity: the whole sets of the survivors meet by hash, which gives each hash's frequency (from MANY on all count as
   equally frequent). A set orders its hashes by that frequency, rarest first; a similar set shares ceil(0.75 n) of them, so the first
   n - ceil(0.75 n) + 1 are enough, and of these only the cells with two sets or more are kept, with the position.
4. candidates meet in kept cells, pass the length and positional bounds, and are verified on the whole sets.

No row is dropped by a cap: cells of any size stay whole. A task of steps 2 and 3 works through its entries in chunks of
CHUNK and lets the entries of a hash go as soon as its fate is known, so a hash that stands everywhere fills no memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WIDTH, PERCENT = 5, 75
_GROW = 1.06
#: Lower bounds of n by code: exact below 32, then rising by 6 %.
_LOW = np.array([c if c < 32 else int(32 * _GROW ** (c - 32)) for c in range(256)], np.int64)
_FLUSH = 800_000
#: Frequencies are exact below this.
MANY = 1 << 16
CHUNK = 4_000_000


#: Words of more bytes are hashed one by one.
_LONG = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words(texts: list[bytes]):
    """The words of texts, with A-Z lower-cased: text number, line number in the text, 64-bit hash."""
    blob = b"\n" + b"\n".join(texts).lower() + b"\n" + b" " * 8
    buf = np.frombuffer(blob, np.uint8)
    space = (buf == 32) | ((buf - np.uint8(9)) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    first = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    first = np.concatenate([[1], first[:-1] + 1])  # where each text begins
    owner = np.searchsorted(first, starts, side="right") - 1
    breaks = np.flatnonzero(buf == 10)
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, first)[owner]
    return owner, line, _word_hashes(blob, starts, ends)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _word_hashes(blob: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes of every word at a time; blob goes on for eight bytes after the last word."""
    eight = np.ndarray((len(blob) - 7,), "<u8", blob, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    long = np.flatnonzero(left > _LONG)
    h = _stir(h ^ (eight[starts] & _MASK[np.minimum(left, 8)]))
    rest = np.flatnonzero((left > 8) & (left <= _LONG))
    at, left = starts[rest], left[rest]
    while len(rest):
        at, left = at + 8, left - 8
        h[rest] = _stir(h[rest] ^ (eight[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        rest, at, left = rest[more], at[more], left[more]
    for k in long.tolist():
        h[k] = xxhash.xxh3_64_intdigest(blob[starts[k] : ends[k]])
    return h


def _mix(parts: list) -> np.ndarray:
    s = parts[0].copy()
    for h in parts[1:]:
        s = s * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
        s += h
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    s *= np.uint64(0x94D049BB133111EB)
    return s ^ (s >> np.uint64(29))


def line_sets(texts: list[bytes], short: bool = False):
    """Shingle sets of the lines of five words and more, and if short also of those of 1 to 4 words, which are one
    shingle: flat array, sizes, text numbers, line numbers."""
    owner, line, h = _words(texts)
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    enough = counts >= (1 if short else WIDTH)
    s, sizes = _sets_of(h[np.repeat(enough, counts)], counts[enough], short)
    return s, sizes, owner[at[enough]], line[at[enough]]


def text_sets(texts: list[bytes], short: bool = True):
    """Sorted distinct shingle hashes of each text: flat array and sizes. A text of 1 to 4 words is one shingle if
    short, else it has none."""
    owner, _, h = _words(texts)
    return _sets_of(h, np.bincount(owner, minlength=len(texts)), short)


def _sets_of(h: np.ndarray, counts: np.ndarray, short: bool):
    seg = np.repeat(np.arange(len(counts)), counts)
    if len(h) >= WIDTH:
        s = _mix([h[k : len(h) - WIDTH + 1 + k] for k in range(WIDTH)])
        ok = seg[: len(s)] == seg[WIDTH - 1 :]
        s, sg = s[ok], seg[: len(s)][ok]
    else:
        s, sg = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < WIDTH)) if short else ()
    if len(few):
        starts = np.cumsum(counts) - counts
        for n in range(1, WIDTH):
            own = few[counts[few] == n]
            if len(own):
                extra = _mix([h[starts[own] + j] for j in range(n)] + [np.full(len(own), n, np.uint64)])
                s, sg = np.concatenate([s, extra]), np.concatenate([sg, own])
    order = np.argsort(s)
    small = sg[order].astype(np.uint16 if len(counts) < 1 << 16 else np.int64)  # 16-bit keys are sorted by radix
    order = order[np.argsort(small, kind="stable")]
    s, sg = s[order], sg[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (sg[1:] != sg[:-1])
    s, sg = s[first], sg[first]
    return s, np.bincount(sg, minlength=len(counts))


def needed(n, extra: float):
    """l(n)."""
    return np.floor(extra * n).astype(np.int64) + 1


def prefix_length(n: np.ndarray, extra: float) -> np.ndarray:
    return np.minimum(n, n - -(-PERCENT * n // 100) + needed(n, extra))


def least_shared(code: np.ndarray, extra: float) -> np.ndarray:
    """lmin: not more than l() of the set or of any set similar to it."""
    return np.floor(extra * PERCENT / 100 / _GROW * _LOW[code]).astype(np.int64) + 1


ITEM = "id long, owner long, line int, doc_id long, n int, key long, check long, bucket int, blob binary"
_ITEM = pa.schema([("id", pa.int64()), ("owner", pa.int64()), ("line", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("check", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])


class Packer:
    """Items and blobs of one task. An id is (task << 36) + the item's number in the task. Sets of fewer than `least`
    hashes give no prefix: equal sets are one point without it."""

    def __init__(self, labels: np.ndarray, extra: float, least: int = 1):
        self.least = least
        self.task, self.next, self.seen, self.labels, self.extra = TaskContext.get().partitionId(), 0, set(), labels, extra
        self.held: list = []
        self.size = 0

    def add(self, s: np.ndarray, sizes: np.ndarray, owners, lines, doc_ids):
        """One batch of items; empty sets come back with n 0 and no key."""
        count = len(sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        raw = s.tobytes()
        keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
        fresh = np.ones(count, bool)
        for k, key in enumerate(keys):
            if key in self.seen:
                fresh[k] = False
            else:
                self.seen.add(key)
        if len(self.seen) > 500_000:
            self.seen.clear()
        local = np.arange(self.next, self.next + count)
        k, check = (np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2).T.copy() if count else np.zeros((2, 0), np.int64))
        if count:
            code = np.searchsorted(_LOW, sizes, side="right") - 1
            take = np.where(fresh & (sizes >= self.least), prefix_length(sizes, self.extra), 0)
            seg = np.repeat(np.arange(count), sizes)
            ok = np.arange(len(s)) - starts[seg] < take[seg]
            e = (s[ok] & ~np.uint64(255)) | code[seg[ok]].astype(np.uint64)
            self.held.append((e, k[seg[ok]]))
            self.size += len(e)
        none = pa.nulls(count, pa.int32()), pa.nulls(count, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(local + (self.task << 36)), pa.array(owners, pa.int64()), pa.array(lines, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(k), pa.array(check), *none], schema=_ITEM)
        self.next += count
        if self.size > _FLUSH:
            yield from self.flush()

    def close(self):
        yield from self.flush()
        common.tidy()

    def flush(self):
        if not self.size:
            return
        e, i = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        for b in _deal(e >> np.uint64(8), self.labels, [e, i]):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) if f.name not in ("bucket", "blob") else b.column(f.name) for f in _ITEM], schema=_ITEM)


def _survivors(extra: float):
    """Keys of points with enough shared prefix hashes."""

    def run(batches):
        es, ids = [], []
        for b in batches:
            for x in b.column("blob").to_pylist():
                n = len(x) // 16
                es.append(np.frombuffer(x, np.uint64, n))
                ids.append(np.frombuffer(x, np.int64, n, 8 * n))
        if not es:
            return
        point, at, c = np.unique(np.concatenate(ids), return_index=True, return_counts=True)
        code = (np.concatenate(es)[at] & np.uint64(255)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(point[c >= least_shared(code, extra)])], names=["key"])

    return run


def _deal(key: np.ndarray, labels: np.ndarray, columns: list[np.ndarray]):
    """(bucket, blob) of columns of equal length, dealt out by a mix of key, one label a partition; a blob holds one array
    after the other."""
    b = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(len(labels))
    order = np.argsort(b.astype(np.uint32), kind="stable")
    b = b[order]
    columns = [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(b)) + 1
    for a, z in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(b)]]).tolist()):
        if z > a:
            yield pa.RecordBatch.from_pylist([{"bucket": int(labels[b[a]]), "blob": b"".join(c[a:z].tobytes() for c in columns)}], schema=_BLOB)


_BLOB = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_BLOB_SQL = "bucket int, blob binary"


def _gather(batches, kinds: list, most: float = float("inf")):
    """The columns of all blobs, in chunks of `most` values and a blob more; one chunk at least."""
    parts, size, none = [[] for _ in kinds], 0, True
    width = sum(np.dtype(k).itemsize for k in kinds)
    whole = lambda: [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]
    for b in batches:
        for x in b.column("blob").to_pylist():
            n, at = len(x) // width, 0
            for part, k in zip(parts, kinds):
                part.append(np.frombuffer(x, k, n, at))
                at += n * np.dtype(k).itemsize
            size += n
            if size > most:
                yield whole()
                parts, size, none = [[] for _ in kinds], 0, False
    if size or none:
        yield whole()


def _in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of x is in the sorted array known."""
    at = np.searchsorted(known, x)
    return known[np.minimum(at, len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _cells(labels: np.ndarray):
    """Prefix entries of hashes that stand in two sets or more, dealt out by set. Of a hash that is known to do so no
    entry is held."""

    def run(batches):
        e, ids, known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for more_e, more_ids in _gather(batches, [np.uint64, np.int64], CHUNK):
            e, ids = np.concatenate([e, more_e]), np.concatenate([ids, more_ids])
            order = np.lexsort((ids, e))
            e, ids = e[order], ids[order]
            once = np.ones(len(e), bool)  # equal sets of several tasks count once
            once[1:] = (e[1:] != e[:-1]) | (ids[1:] != ids[:-1])
            e, ids = e[once], ids[once]
            h = e >> np.uint64(8)
            ok = _in(h, known)
            again = h[1:] == h[:-1]
            ok[1:] |= again
            ok[:-1] |= again
            yield from _deal(ids[ok], labels, [e[ok], ids[ok]])
            known = np.union1d(known, h[ok])
            e, ids = e[~ok], ids[~ok]

    return run


def _spread(labels: np.ndarray):
    """All hashes of whole sets, dealt out by hash."""

    def run(batches):
        held, size = [], 0

        def flush():
            s, ids, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            yield from _deal(s, labels, [s, ids, n])

        for b in batches:
            for i, n, s in zip(*(b.column(c).to_pylist() for c in ("id", "n", "s"))):
                held.append((np.frombuffer(s, np.uint64), np.full(n, i, np.int64), np.full(n, n, np.int32)))
                size += n
                if size > _FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _frequencies(labels: np.ndarray):
    """Entries with the frequency of their hash, dealt out by set. Of a hash with MANY entries none is held."""

    def run(batches):
        s, ids, n, full = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        cell = m = np.zeros(0, np.int64)
        for more in _gather(batches, [np.uint64, np.int64, np.int32], CHUNK):
            s, ids, n = (np.concatenate(x) for x in zip((s, ids, n), more))
            _, cell, m = np.unique(s, return_inverse=True, return_counts=True)
            ok = (m[cell] >= MANY) | _in(s, full)
            if ok.any():
                yield from _deal(ids[ok], labels, [s[ok], ids[ok], n[ok], np.full(ok.sum(), MANY, np.int32)])
                full = np.union1d(full, s[ok])
                s, ids, n, cell = s[~ok], ids[~ok], n[~ok], cell[~ok]
        m = m[cell].astype(np.int32)
        ok = m > 1
        yield from _deal(ids[ok], labels, [s[ok], ids[ok], n[ok], m[ok]])

    return run


def _rarest(batches):
    ((s, i, n, m),) = _gather(batches, [np.uint64, np.int64, np.int32, np.int32])
    order = np.lexsort((s, m, i))
    s, i, n = s[order], i[order], n[order].astype(np.int64)
    _, start, group, c = np.unique(i, return_index=True, return_inverse=True, return_counts=True)
    if not len(s):
        return
    c = c[group]
    pos = n - c + np.arange(len(i)) - start[group]  # hashes of this set alone are rarer still
    ok = pos < n - -(-PERCENT * n // 100) + 1
    s, i, n, c, pos = (x[ok] for x in (s, i, n, c, pos))
    for k in range(0, len(s), 200_000):
        w = slice(k, k + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(s[w].view(np.int64)), pa.array(i[w]), pa.array(n[w].astype(np.int32)), pa.array(c[w].astype(np.int32)), pa.array(pos[w].astype(np.int32))], names=["h", "point", "n", "c", "pos"])


def survivors(spark: SparkSession, packed: DataFrame, extra: float) -> DataFrame:
    """key: the sets that can have a partner, from the blobs of a packed table."""
    p = common.partitions(spark)
    labels = common.partition_labels(p)
    by_hash = packed.filter("blob is not null").select("bucket", "blob").repartition(p, "bucket").mapInArrow(_cells(labels), _BLOB_SQL)
    return by_hash.repartition(p, "bucket").mapInArrow(_survivors(extra), "key long")


def cells(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """h, point, n, c (hashes shared with any other), pos (position in order of rarity) from whole sets (id, n, s)."""
    p = common.partitions(spark)
    labels = common.partition_labels(p)
    dealt = sets.select("id", "n", "s").mapInArrow(_spread(labels), _BLOB_SQL).repartition(p, "bucket").mapInArrow(_frequencies(labels), _BLOB_SQL)
    return dealt.repartition(p, "bucket").mapInArrow(_rarest, "h long, point long, n int, c int, pos int")


def bounds():
    """Length and positional bounds of two cell rows, (n_a, pos_a) and (n_b, pos_b)."""
    need = F.ceil(PERCENT * (F.col("n_a") + F.col("n_b")) / F.lit(100 + PERCENT))
    return (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need)


def signature(s: np.ndarray) -> bytes:
    """Distinct low 16 bits of the hashes. Of two sets, |x & y| <= common values + the fewer of their collisions."""
    return np.unique(s.astype(np.uint16)).tobytes()


def _measure(kind, spare: bool):
    """Upper bound of the overlap from signatures (spare: collisions are added), or the overlap from whole sets."""

    def run(batches):
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            n = np.zeros(b.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(b.column("sa").to_pylist(), b.column("sb").to_pylist())):
                x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
                n[k] = np.intersect1d(x, y, assume_unique=True).size + (min(na[k] - len(x), nb[k] - len(y)) if spare else 0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "na", "nb")] + [pa.array(n.astype(np.int32))], names=["a", "b", "na", "nb", "both"])

    return run


_PAIR = "a long, b long, na int, nb int, both int"
#: Of a pair with `both` shingles in common.
SIMILAR = f"100L * both >= {PERCENT}L * (na + nb - both)"


#: Ids of sets that are broadcast, at most (8 MB); for more the sets are shuffled.
PICKED = 1_000_000


def picked(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of these ids. Of few ids no other set is shuffled, here or by what follows."""
    ids = ids.select("id").distinct()
    if ids.limit(PICKED + 1).count() <= PICKED:
        ids = F.broadcast(ids)
    return sets.join(ids, "id", "left_semi")


def _named(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs, stored, and the sets that they name."""
    pairs = common.stored(pairs.sparkSession, pairs.select("a", "b"))
    return pairs, picked(sets, pairs.select(F.explode(F.array("a", "b")).alias("id")))


def _with_sizes(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    size = sets.select("id", "n")
    return pairs.select("a", "b").join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")


def _with_both(df: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    one = sets.select("id", column)
    return df.join(one.select(F.col("id").alias("a"), F.col(column).alias("sa")), "a").join(one.select(F.col("id").alias("b"), F.col(column).alias("sb")), "b").select("a", "b", "na", "nb", "sa", "sb")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, both of all pairs, whether similar or not."""
    pairs, sets = _named(pairs, sets)
    one, other = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_measure(np.uint64, False), _PAIR)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs whose sets (id, n, sig, s) are similar: sizes, then signatures, then whole sets."""
    pairs, sets = _named(pairs, sets)
    near = _with_sizes(pairs, sets).filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    near = _with_both(near, sets, "sig").mapInArrow(_measure(np.uint16, True), _PAIR).filter(SIMILAR)
    return _with_both(near, sets, "s").mapInArrow(_measure(np.uint64, False), _PAIR).filter(SIMILAR).select("a", "b")


def similar(x: set, y: set) -> bool:
    """The definition, for tests."""
    return bool(x and y) and 100 * len(x & y) >= PERCENT * len(x | y)
