"""Exact dedup by Patricia-trie owners (op 6).

Texts are equal when their bytes are equal after every character of [\\x20\\x09-\\x0D] is deleted; null is empty.
Documents are dealt out by length and content hash; a task inserts whole byte strings into a compressed radix
trie, and a terminal node keeps the group's size and its owner: most code points in the original text, then
smallest doc_id (a null doc_id comes last), then the first row. Rows of equal doc_id are separate documents.

A hot group never meets in one task as rows: each scan task first inserts its own documents into a trie, so that
every group sends one copy of its bytes a task, and members find the owner by a join on that copy's id.
"""

from __future__ import annotations

import hashlib
import os
import shutil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

TRIE_BYTES = 48 << 20
_LAST = 1 << 63


class _Node:
    __slots__ = ("edge", "kids", "value")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.kids, self.value = edge, {}, value


class PatriciaTrie:
    """Compressed radix trie over byte strings. values: merge(old or None, new) -> value at the terminal node."""

    def __init__(self, merge):
        self.root, self.merge, self.bytes = _Node(b""), merge, 0

    def insert(self, key: bytes, value):
        """The value now held by the terminal node of key."""
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = _Node(key[at:])
                self.bytes += len(key) - at + 200
                node, at = kid, len(key)
                break
            edge = kid.edge
            if key.startswith(edge, at):
                node, at = kid, at + len(edge)
                continue
            rest = key[at : at + len(edge)]
            low, high = 0, min(len(rest), len(edge))
            while low < high:  # length of the common prefix
                mid = (low + high + 1) // 2
                low, high = (mid, high) if rest[:mid] == edge[:mid] else (low, mid - 1)
            fork = _Node(edge[:low])
            fork.kids[edge[low]] = kid
            kid.edge = edge[low:]
            node.kids[key[at]] = fork
            self.bytes += 200
            node, at = fork, at + low
        node.value = self.merge(node.value, value)
        return node.value

    def items(self, first: int | None = None):
        """(key, value) of the terminal nodes, of the subtree that begins with byte `first` if given."""
        stack = [(self.root, b"")] if first is None else [(self.root.kids[first], b"")]
        while stack:
            node, key = stack.pop()
            key += node.edge
            if node.value is not None:
                yield key, node.value
            stack.extend((kid, key) for kid in node.kids.values())

    def pop(self, first: int) -> list:
        out = list(self.items(first))
        del self.root.kids[first]
        self.bytes -= sum(len(k) + 200 for k, _ in out)
        return out


class SpillingOwners:
    """A trie whose largest first-byte subtrees move to the task's temp folder when it outgrows its limit.

    Values are lists (best_points, best_id, best_rid, size, [tokens]); what has been spilled is merged again,
    one subtree at a time, by drain()."""

    def __init__(self, limit: int = TRIE_BYTES, deep: int = 0):
        self.trie, self.limit, self.folder, self.files, self.deep = PatriciaTrie(_merge), limit, None, {}, deep

    def insert(self, key: bytes, value) -> None:
        self.trie.insert(key, value)
        while self.trie.bytes > self.limit and self.trie.root.kids and self.deep < 8:
            self._spill()

    def _spill(self) -> None:
        import pickle

        sizes = {b: sum(len(k) for k, _ in self.trie.items(b)) for b in self.trie.root.kids}
        first = max(sizes, key=sizes.get)
        self.folder = self.folder or common.task_temp()
        with open(os.path.join(self.folder, str(first)), "ab") as f:
            for item in self.trie.pop(first):
                pickle.dump(item, f)
        self.files[first] = f.name

    def drain(self):
        import pickle

        try:
            for first, name in self.files.items():  # a subtree on disk may have grown another part in memory
                part = SpillingOwners(max(self.limit, 1), self.deep + 1)
                if first in self.trie.root.kids:
                    for k, v in self.trie.pop(first):
                        part.insert(k[1:], v)
                with open(name, "rb") as f:
                    while True:
                        try:
                            k, v = pickle.load(f)
                        except EOFError:
                            break
                        part.insert(k[1:], v)
                yield from part.drain()
            for _, v in self.trie.items():
                yield v
        finally:
            if self.folder:
                shutil.rmtree(self.folder, ignore_errors=True)


def _merge(old, new):
    """Values: [points, id, rid, size, members]."""
    if old is None:
        return new
    if (-new[0], new[1], new[2]) < (-old[0], old[1], old[2]):
        old[:3] = new[:3]
    old[3] += new[3]
    old[4].extend(new[4])
    return old


_LOCAL = pa.schema([("rid", pa.int64()), ("copy", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("n_bytes", pa.int32()), ("h", pa.int64()), ("content", pa.binary()), ("points", pa.int64()), ("best_id", pa.int64()), ("best_rid", pa.int64()), ("size", pa.int64())])
_LOCAL_SQL = "rid long, copy long, doc_id long, text_sha256 string, n_bytes int, h long, content binary, points long, best_id long, best_rid long, size long"


def _local(batches):
    """Documents of a scan task -> one row each; the first copy of a text carries its bytes and the copies' owner."""
    trie, rows = PatriciaTrie(_merge), []

    def flush():
        for key, (points, best, rid, size, members) in trie.items():
            first = members[0]
            digest = hashlib.sha256(key).hexdigest()
            for r, doc_id in members:
                rows.append((r, first[0], doc_id, digest, len(key)) + ((xxhash.xxh3_64_intdigest(key) - _LAST, key, points, None if best == _LAST else best, rid, size) if r == first[0] else (None,) * 6))
                if len(rows) >= 2000:
                    yield common.batches(rows, _LOCAL)
                    rows.clear()
        if rows:
            yield common.batches(rows, _LOCAL)
            rows.clear()

    for batch in batches:
        texts, ids, rids = common.raw_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
        for text, doc_id, rid in zip(texts, ids, rids):
            points = len(text.decode())
            trie.insert(text.translate(None, common.SPACES), [points, _LAST if doc_id is None else doc_id, rid, 1, [(rid, doc_id)]])
            if trie.bytes > TRIE_BYTES:
                yield from flush()
                trie = PatriciaTrie(_merge)
    yield from flush()


_OWNERS = pa.schema([("copy", pa.int64()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("group_size", pa.int64())])


def _owners(limit):
    def run(batches):
        owners = SpillingOwners(limit)
        for b in batches:
            for copy, content, points, best, rid, size in zip(*(b.column(c).to_pylist() for c in ("copy", "content", "points", "best_id", "best_rid", "size"))):
                owners.insert(content, [points, _LAST if best is None else best, rid, size, [copy]])
        rows = []
        for _, best, rid, size, copies in owners.drain():
            rows += [(c, None if best == _LAST else best, rid, size) for c in copies]
            if len(rows) >= 10000:
                yield common.batches(rows, _OWNERS)
                rows.clear()
        if rows:
            yield common.batches(rows, _OWNERS)

    return run


def exact_dedup(spark: SparkSession, docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256. docs: a stored table with doc_id and text."""
    local = common.with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(_local, _LOCAL_SQL)
    local = common.materialise(spark, local, "op6-local")
    copies = local.filter("content is not null").select("copy", "n_bytes", "h", "content", "points", "best_id", "best_rid", "size")
    owners = copies.repartition(common.partitions(spark), "n_bytes", "h").mapInArrow(_owners(trie_bytes), "copy long, keep_id long, keep_rid long, group_size long")
    return local.select("rid", "copy", "doc_id", "text_sha256").join(owners, "copy").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, common.documents(spark, sf_dir))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
