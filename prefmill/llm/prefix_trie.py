"""Prefix trie of conversations, merged by families first (op 13).

Conversation c belongs to the family of base c - c % 5 (the remainder is 0 to 4, below zero too). It is rebuilt from the
first h turns of the base conversation (h = crc32 of c's digits, % 9; all turns if it has fewer, none if it is absent)
and its own turns after its first h. Each distinct beginning of a rebuilt conversation is a node, known by a 128-bit
hash of its turns; a turn is known by 128 bits of the SHA-256 of its role and text, and only those and the text's bytes
are shuffled.

1. Families. Turns meet by base, sorted by conversation and turn; a task reads its families one after the other, keeps
   of each the base's first 8 turns and builds the family's trie. What leaves it is a row for each node of a family: its
   members as 5 bits, those that end there as 5 bits, the bytes of its last text and of all before. A trie that has
   grown to NODES nodes is given out early; the rest of the family begins a new one and the parts meet in step 2.
2. Merging. Rows of the same node are added up: smallest member, number of members; then nodes by parent: children.
3. Sums over subtrees need no walk up the tree. A node's owner is its smallest member, and what a conversation owns is
   the end of its path, from a first byte B on. Of a node with `before` bytes before its last text, the subtree saves,
   for each member, the bytes of the member's path that lie after `before` and that it doesn't own: max(0, B - before).
   Each leaf is owned by one conversation. So both sums add up over members: the family rows meet the B and leaf of
   their family's conversations, and are added up by node.
4. Conversations that end in a node: ids are sorted within ranges of 2 ** RANGE ids, and the ranges of a node are hashed
   one after the other in a stream. So of a path that a third of all conversations share, a task reads a row for
   each range and holds a few. SHA-256 itself has no parallel form.

Cases: turns are ordered by turn (null first), equal turns by their hash; null role or text is empty. Rows without
conv_id go. Repeated rows are turns. A rebuilt conversation without turns is a member of the root only. No
conversations: no nodes. Other columns are not read. The turns of one conversation, however many, go through one task,
in order and with bounded memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

FAMILY, FIRST = 5, 9
#: Nodes of a family's trie that a task holds.
NODES = 200_000
#: Conversation ids of one range: 2 ** RANGE.
RANGE = 14
#: Parents whose conversations are broadcast, at most: those with the largest numbers of children.
PARENTS = 10_000
ROOT = bytes(16)

_TRIE = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("base", pa.int64()), ("members", pa.int32()), ("ends", pa.int32()), ("bytes", pa.int64()), ("before", pa.int64())])
_TRIE_SQL = "key binary, parent binary, depth long, base long, members int, ends int, bytes long, before long"


def turns(conversations: DataFrame) -> DataFrame:
    """A row for each turn: base, conv_id, h, turn, mark (16 bytes), bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    c = F.col("conv_id").cast("long")
    return conversations.filter(c.isNotNull()).select(
        (c - F.pmod(c, F.lit(FAMILY))).alias("base"), c.alias("conv_id"), (F.crc32(c.cast("string").cast("binary")) % FIRST).cast("int").alias("h"), "turn", F.unhex(F.substring(whole, 1, 32)).alias("mark"), F.octet_length(text).cast("long").alias("bytes")
    )


class _Family:
    """The trie of one family: nodes[place] is [key, parent, depth, members, ends, bytes, before]; below[place, mark] is the
    place of a child."""

    def __init__(self, base: int):
        self.base, self.first, self.nodes, self.below = base, [], [[ROOT, None, 0, 0, 0, 0, 0]], {}

    def child(self, place: int, mark: bytes, size: int) -> int:
        at = self.below.get((place, mark))
        if at is None:
            above = self.nodes[place]
            at = self.below[place, mark] = len(self.nodes)
            self.nodes.append([hashlib.sha256(above[0] + mark).digest()[:16], above[0], above[2] + 1, 0, 0, size, above[5] + above[6]])
        return at

    def take(self) -> list:
        """The nodes so far, to give out; the path that is being followed begins a trie of its own."""
        out = [(n[0], n[1], n[2], self.base, n[3], n[4], n[5], n[6]) for n in self.nodes if n[3] or n[4]]
        self.nodes, self.below = [[ROOT, None, 0, 0, 0, 0, 0]], {}
        return out

    def cut(self, place: int) -> tuple[list, int]:
        """take(), going on below the node at this place, which has been counted."""
        last = self.nodes[place][:3] + [0, 0] + self.nodes[place][5:]
        out = self.take()
        self.nodes.append(last)
        return out, len(self.nodes) - 1


def _families(limit: int):
    """Sorted turns to the nodes of their families."""

    def run(batches):
        out, family, conv, bit, place, skip = [], None, None, 0, 0, 0

        def close():
            """The conversation ends where it stands."""
            if conv is not None:
                family.nodes[place][4] |= bit

        for b in batches:
            for base, c, h, mark, size in zip(*(b.column(k).to_pylist() for k in ("base", "conv_id", "h", "mark", "bytes"))):
                if c != conv:
                    close()
                    if family is None or base != family.base:
                        out += family.take() if family else []
                        family = _Family(base)
                    conv, bit, place, skip = c, 1 << (c - base), 0, 0 if c == base else h
                    family.nodes[0][3] |= bit
                    for first in family.first[:skip]:
                        place = family.child(place, *first)
                        family.nodes[place][3] |= bit
                if c == base and len(family.first) < FIRST - 1:
                    family.first.append((mark, size))
                if skip:
                    skip -= 1
                    continue
                place = family.child(place, mark, size)
                family.nodes[place][3] |= bit
                if len(family.nodes) > limit:
                    gone, place = family.cut(place)
                    out += gone
                if len(out) >= 20_000:
                    yield common.batches(out, _TRIE)
                    out = []
        close()
        out += family.take() if family else []
        if out:
            yield common.batches(out, _TRIE)

    return run


def families(spark: SparkSession, conversations: DataFrame, limit: int = NODES) -> DataFrame:
    """The nodes of all families, as step 1 makes them."""
    rows = turns(conversations).repartition(common.partitions(spark), "base").sortWithinPartitions("base", "conv_id", F.col("turn").asc_nulls_first(), "mark")
    return rows.select("base", "conv_id", "h", "mark", "bytes").mapInArrow(_families(limit), _TRIE_SQL)


def _low(base: Column, members: Column) -> Column:
    """The smallest member."""
    bit = [F.when(members.bitwiseAND(1 << k) > 0, base + k) for k in range(FAMILY)]
    return F.coalesce(*bit)


def merged(spark: SparkSession, tries: DataFrame) -> DataFrame:
    """A row for each node: key, parent, depth, conv_id, n_convs, before, n_children."""
    same = [F.first(c).alias(c) for c in ("parent", "depth", "before")]
    low = F.min(_low(F.col("base"), F.col("members"))).alias("conv_id")
    nodes = common.materialise(spark, tries.groupBy("key").agg(*same, low, F.sum(F.bit_count("members")).alias("n_convs")), "op13-merged")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    return common.materialise(spark, nodes.join(children, "key", "left").fillna(0, ["n_children"]), "op13-nodes")


def _ending(tries: DataFrame) -> DataFrame:
    """key, base, k (conversation base + k ends in this node), total (bytes of its texts)."""
    bits = F.array(*[F.when(F.col("ends").bitwiseAND(1 << k) > 0, k) for k in range(FAMILY)])
    return tries.filter("ends > 0").select("key", "base", F.explode(F.array_compact(bits)).alias("k"), (F.col("before") + F.col("bytes")).alias("total"))


def subtree_sums(tries: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, n_leaves, saved_tokens."""
    own = nodes.select((F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("base"), F.pmod("conv_id", F.lit(FAMILY)).cast("int").alias("k"), "before", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), F.lit(None).cast("long").alias("total"))
    none = {c: F.lit(None).cast("long") for c in ("before", "depth", "leaf")}
    told = own.unionByName(_ending(tries).drop("key").withColumns(none))
    # what a conversation without nodes of its own doesn't own is all of it
    at = lambda k, c: F.when(F.col("k") == k, F.col(c))
    of = [F.struct(F.coalesce(F.min(at(k, "before")), F.max(at(k, "total"))).alias("shared"), F.coalesce(F.max_by(at(k, "leaf"), at(k, "depth")), F.lit(0)).alias("leaf")).alias(f"c{k}") for k in range(FAMILY)]
    each = tries.filter("members > 0").select("key", "base", "members", "before").join(told.groupBy("base").agg(*of), "base")
    add = lambda value: sum((F.when(F.col("members").bitwiseAND(1 << k) > 0, value(F.col(f"c{k}"))).otherwise(0) for k in range(FAMILY)), F.lit(0))
    saved = add(lambda c: F.greatest(c["shared"] - F.col("before"), F.lit(0)))
    return each.groupBy("key").agg(F.sum(add(lambda c: c["leaf"])).alias("n_leaves"), F.sum(saved).alias("saved_tokens"))


def _hashed(batches):
    key, h, n = None, None, 0
    for b in batches:
        out = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, h.hexdigest(), n))
                key, h, n = k, hashlib.sha256(), 0
            h.update((("," if n else "") + ",".join(map(str, ids))).encode())
            n += len(ids)
        if out:
            yield common.batches(out, _HASHED)
    if key is not None:
        yield common.batches([(key, h.hexdigest(), n)], _HASHED)


_HASHED = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string()), ("n_ends", pa.int64())])


def end_hashes(spark: SparkSession, tries: DataFrame) -> DataFrame:
    """key, ends_sha256, n_ends of the nodes in which conversations end."""
    ids = _ending(tries).select("key", (F.col("base") + F.col("k")).alias("id"))
    ranges = ids.groupBy("key", F.shiftright("id", RANGE).alias("range")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    with common.arrow_rows(spark, 500):
        return ranges.repartition(common.partitions(spark), "key").sortWithinPartitions("key", "range").mapInArrow(_hashed, "key binary, ends_sha256 string, n_ends long")


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. The children of the parents with most children don't meet in one task."""
    of = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    often = F.col("siblings") * PARENTS >= nodes.count()  # of PARENTS parents at most
    large = F.broadcast(of.filter(often).drop("siblings"))
    rest = nodes.join(large.select("parent"), "parent", "left_anti")
    return nodes.join(large, "parent").unionByName(rest.join(of.filter(~often).drop("siblings"), "parent", "left"))


def prefix_trie(spark: SparkSession, conversations: DataFrame, limit: int = NODES) -> DataFrame:
    """A row for each node: key, parent (keys of 16 bytes), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, n_ends, ends_sha256."""
    tries = common.materialise(spark, families(spark, conversations, limit), "op13-families")
    nodes = merged(spark, tries)
    out = with_parents(nodes).join(subtree_sums(tries, nodes), "key").join(end_hashes(spark, tries), "key", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("n_ends", F.lit(0)).alias("n_ends"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("key", "parent", "n_ends")


OP13_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(said ORDER BY k) AS own,
  -- crc32: for each byte its value and eight steps
  xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, c.h), list_slice(c.own, c.h + 1, len(c.own))) AS path FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, d, d = len(path) AS ends, md5(to_json(list_slice(path, 1, d))::VARCHAR) AS key, CASE WHEN d > 0 THEN md5(to_json(list_slice(path, 1, d - 1))::VARCHAR) END AS parent, CASE WHEN d > 0 THEN strlen(path[d].t) ELSE 0 END AS bytes FROM (SELECT *, unnest(generate_series(0, len(path))) AS d FROM r)),
n AS (SELECT key, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
under AS (SELECT DISTINCT a.key AS top, x.key FROM m AS a JOIN m AS x ON a.conv_id = x.conv_id AND a.d <= x.d),
sums AS (SELECT top AS key, count(*) FILTER (kids.key IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens FROM under JOIN n USING (key) LEFT JOIN kids USING (key) GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN sums ON sums.key = n.key LEFT JOIN kids ON kids.key = n.key LEFT JOIN n AS p ON p.key = n.parent
"""
