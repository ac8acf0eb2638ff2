"""Line dedup by an exact set-similarity join (op 9).

A line (between \\n characters) is the set of its five-word shingles, words being [^\\x20\\x09-\\x0D]+ after A-Z are
lower-cased. A line of 1 to 4 words is one shingle if `short`, as the queries have it; else it has no set and stays.
Lines without a word always stay. Two lines match when 100 * |x & y| >= 75 * |x | y|. A line goes when an earlier line matches it, earlier by doc_id (null last), then by the
document's place in the table, then by line number; whether that earlier line stays itself does not matter, so the
result does not depend on any order of work.

The join is that of setjoin.py: tokens in order of rarity, prefix, positional and length filters, verified Jaccard.
Lines of equal sets are one point, whose first line stands for it. A first round tries, for each point, the earliest
line that it meets in most cells; what that does not settle is compared with every earlier point in its cells.

Cases: a null text stays null; a text whose lines all go becomes empty; rows of equal doc_id are separate documents;
an empty table stays empty; other columns of the documents stay as they are, whatever their names. Documents that are no
scan of stored files are stored first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, setjoin

EXTRA = 0.06
#: Different sets of which one has fewer hashes than this can't match: 2 shared of 3 are less than 75 of 100.
LEAST = 3


def _groups(batch, most: int = 2 << 20):
    texts = common.raw_bytes(batch.column("text"))
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held > most or k == len(texts) - 1:
            yield slice(start, k + 1), texts[start : k + 1]
            start, held = k + 1, 0


def _pack(labels: np.ndarray, extra: float, short: bool):
    def run(batches):
        out = setjoin.Packer(labels, extra, LEAST)
        for b in batches:
            rids, ids = b.column("rid"), b.column("doc_id")
            for some, texts in _groups(b):
                s, sizes, owner, line = setjoin.line_sets(texts, short)
                owner = pa.array(owner)
                yield from out.add(s, sizes, rids[some].take(owner), line.astype(np.int32), ids[some].take(owner))
        yield from out.close()

    return run


def _sets(batches):
    """Sets of the lines named in `wanted` of each document."""
    for b in batches:
        wanted = b.column("wanted").to_pylist()
        for some, texts in _groups(b):
            ids, own = [], []
            for w, text in zip(wanted[some], texts):
                lines = text.split(b"\n")
                ids += [x["point"] for x in w]
                own += [lines[x["line"]] for x in w]
            s, sizes = setjoin.text_sets(own, short=False)
            raw, ends = s.tobytes(), np.cumsum(sizes)
            cut = list(zip((ends - sizes).tolist(), ends.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int32)), pa.array([setjoin.signature(s[a:z]) for a, z in cut], pa.binary()), pa.array([raw[8 * a : 8 * z] for a, z in cut], pa.binary())], names=["id", "n", "sig", "s"])
    common.tidy()


def repeated_lines(spark: SparkSession, docs: DataFrame, extra: float = EXTRA, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents with row ids (in the column `rid`, or if they have one of that name in the last), and rid, lines:
    numbers of the lines that go."""
    rows = common.with_rid(docs, common.fresh(docs, "rid"))
    texts = rows.select(F.col(rows.columns[-1]).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = texts.mapInArrow(_pack(common.partition_labels(common.partitions(spark)), extra, short), setjoin.ITEM)
    packed = common.materialise(spark, packed, "op9-packed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("owner").alias("rid"), F.col("line"))
    items = packed.filter("id is not null").select("id", "key", "check", order.alias("o"))
    alive = common.materialise(spark, setjoin.survivors(spark, packed, extra), "op9-survivors")

    # most lines stand once and have no partner: they are let go by the key alone, and what follows is for the others
    several = packed.filter("id is not null").groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key")
    items = common.materialise(spark, items.join(several.union(alive).hint("shuffle_hash"), "key", "left_semi"), "op9-lines")

    # a point's first line stands for it, and its smallest item id is its name; points of one line that can't match are done
    first = items.groupBy("key", "check").agg(F.min("o").alias("o"), F.min("id").alias("point"), F.count("*").alias("times"))
    first = first.join(alive.withColumn("alive", F.lit(True)), "key", "left").filter("times > 1 or alive")
    first = common.materialise(spark, first, "op9-points")
    wanted = first.filter("alive").groupBy(F.col("o.rid").alias("rid")).agg(F.collect_list(F.struct("point", F.col("o.line").alias("line"))).alias("wanted"))
    chosen = texts.select("rid", "text").join(wanted.hint("shuffle_hash"), "rid").select("text", "wanted")
    sets = common.materialise(spark, chosen.mapInArrow(_sets, "id long, n int, sig binary, s binary"), "op9-sets")
    met = setjoin.cells(spark, sets).join(first.select("point", "o"), "point")
    met = common.materialise(spark, met, "op9-cells")

    lead = met.groupBy("h").agg(F.min_by(F.struct("point", "n", "pos"), "o").alias("lead"))
    meets = met.join(lead, "h").filter(F.col("lead.point") != F.col("point")).groupBy("point", F.col("lead.point").alias("lead")).agg(F.count("*").alias("times"))
    home = meets.groupBy("point").agg(F.max_by("lead", F.struct("times", -F.col("lead"))).alias("lead"))
    home = common.materialise(spark, home.select(F.col("lead").alias("a"), F.col("point").alias("b")), "op9-home")
    gone = common.materialise(spark, setjoin.verify(home, sets).select(F.col("b").alias("point")), "op9-gone")
    open_ = met.join(home.select(F.col("b").alias("point")), "point", "left_semi").join(gone, "point", "left_anti")
    y = open_.select("h", F.col("point").alias("b"), F.col("o").alias("o_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    x = met.select("h", F.col("point").alias("a"), F.col("o").alias("o_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"))
    pairs = x.join(y, "h").filter((F.col("o_a") < F.col("o_b")) & setjoin.bounds()).select("a", "b").distinct().join(home, ["a", "b"], "left_anti")
    more = setjoin.verify(pairs, sets).select(F.col("b").alias("point"))
    gone = common.materialise(spark, gone.union(more).distinct(), "op9-gone")

    # every line of a point that goes, and all but the first of a point that stays
    state = first.join(gone.withColumn("gone", F.lit(True)), "point", "left").filter("times > 1 or gone").select("key", "check", "o", "gone")
    out = items.withColumnRenamed("o", "own").join(state, ["key", "check"]).filter(F.col("gone") | (F.col("own") != F.col("o")))
    return rows, out.groupBy(F.col("own.rid").alias("rid")).agg(F.collect_list("own.line").alias("lines"))


def _without(texts: pd.Series, lines: pd.Series) -> pd.Series:
    out = []
    for t, gone in zip(texts, lines):
        if gone is not None and t is not None:
            gone = set(gone)
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out.append(t)
    return pd.Series(out, dtype=object)


def dedup_lines(spark: SparkSession, docs: DataFrame, extra: float = EXTRA, short: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_removed, in place of a column of that name."""
    rows, gone = repeated_lines(spark, docs, extra, short)
    rid, lines = rows.columns[-1], common.fresh(rows, "lines")
    kept = [c for c in docs.columns if c not in ("text", "n_removed")]
    names = [c for c in docs.columns if c != "n_removed"]
    both = rows.withColumn("text", F.col("text").cast("string")).join(gone.select(F.col("rid").alias(rid), F.col("lines").alias(lines)).hint("shuffle_hash"), rid, "left")
    once = F.pandas_udf(_without, "string").asNondeterministic()  # else a filter on text runs it again, in workers of its own
    cut = once(F.when(F.col(lines).isNotNull(), F.col("text")), lines)
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(cut).alias("text")
    return both.select(*kept, text, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_removed")).select(*names, "n_removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.arrow_rows(spark, 1000):
        out = dedup_lines(spark, common.documents(spark, sf_dir).select("doc_id", "text"), short=True)
        return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
