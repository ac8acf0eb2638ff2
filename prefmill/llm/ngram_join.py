"""N-gram Jaccard join in the metric space of shingle sets (op 7).

Distance is 1 - Jaccard, a metric; two documents link at 0.25 or less. Documents of equal sets are one point. The points
that can have a partner, and the cells (rare shingles of their prefixes) in one of which any two near points meet, come
from setjoin.py. Then, round by round:

- pivots: in every cell the point that shares most of its prefix with others is the cell's pivot. The region of a pivot
  is all points of its cells; a point at the border of several regions stands in each of them. The distance of every
  point to every pivot whose region it is in is measured exactly.
- balls: points within 0.25 of a pivot are linked with it, hence with each other, and not compared any more.
- windows: for a point y outside the ball, d(y, pivot) <= d(x, pivot) + 0.25 for any x that is near it (triangle
  inequality), so y meets only the points x of the ball at d(y, pivot) - 0.25 or more: none at all if y is further than
  0.5 from the pivot.
- recursion: the points outside the ball are a smaller cell with a pivot of its own in the next round. Rounds end when
  no cell has more than SMALL points, or when a round has not made the cells above that smaller by a tenth (points that
  are all far from each other, which no distance separates). Two points of what is left of a cell are compared if their
  distances to each of the cell's pivots so far differ by 0.25 at most.

All comparisons also have to pass the length and positional bounds of the cell they meet in, and are left out where the
two are linked already; what remains is measured exactly.

Why cells come first: of unrelated documents nearly all have distance exactly 1 to every pivot, so windows over
sampled pivots alone would replicate every document into every region (README).

Result: component_id, the smallest doc_id reachable by links. Cases: no words or null text: empty set, linked with
nothing; 1 to 4 words: one shingle; a null doc_id counts as larger than any other, so a component has component_id
null only if no member has an id; rows of equal doc_id are points of their own; an empty table gives no rows. Documents
that are no scan of stored files are stored first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, setjoin

EXTRA, SMALL = 0.1, 16
#: The largest distance of a link, as a bound that rounding can't undercut.
NEAR = 0.25 + 1e-9


def _in_groups(batch, most: int = 2 << 20):
    """Slices of a batch with about `most` bytes of text."""
    texts = common.raw_bytes(batch.column("text"))
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held > most or k == len(texts) - 1:
            yield start, k + 1, texts[start : k + 1]
            start, held = k + 1, 0


def _pack(labels: np.ndarray, extra: float):
    def run(batches):
        out = setjoin.Packer(labels, extra)
        for b in batches:
            rids, ids = b.column("rid").to_pylist(), b.column("doc_id").to_pylist()
            for a, z, texts in _in_groups(b):
                s, sizes = setjoin.text_sets(texts)
                yield from out.add(s, sizes, rids[a:z], [0] * (z - a), ids[a:z])
        yield from out.close()

    return run


def _sets(batches):
    for b in batches:
        ids = b.column("id").to_pylist()
        for a, z, texts in _in_groups(b):
            s, sizes = setjoin.text_sets(texts)
            raw, ends = s.tobytes(), np.cumsum(sizes)
            whole = [raw[8 * (e - n) : 8 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
            sig = [setjoin.signature(s[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:z], pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(sig, pa.binary()), pa.array(whole, pa.binary())], names=["id", "n", "sig", "s"])
    common.tidy()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of all ends of edges (a, b), by label propagation with pointer jumping."""
    both = common.materialise(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label")
    labels = common.materialise(spark, labels, "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(seen, labels["id"] == seen["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        new = common.materialise(spark, low.join(up, "label", "left").select("id", "old", F.least("label", "above").alias("label")), "labels")
        labels = new.select("id", "label")
        if new.filter("label <> old").isEmpty():
            return labels


def _pairs(x: DataFrame, y: DataFrame, window) -> DataFrame:
    """a, b of the rows of x and y that meet in a cell and pass its bounds and the window."""
    sides = [t.select("h", *(F.col(c).alias(f"{c}_{side}") for c in ("point", "n", "pos", "d"))) for t, side in ((x, "a"), (y, "b"))]
    met = sides[0].join(sides[1], "h").filter(setjoin.bounds() & window)
    return met.select(F.least("point_a", "point_b").alias("a"), F.greatest("point_a", "point_b").alias("b"))


def regions(spark: SparkSession, met: DataFrame, sets: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of points with pivots, and pairs (a, b) that are still to be measured, from cells (h, point, n, pos,
    share) and whole sets. Each round stores its own, and all rounds are read as one scan: the plans of what follows, and
    the driver's memory for them, are the same for any number of rounds. Whenever half of the points have left, the sets
    of the others are stored anew, so a round reads about as much as its cells hold."""
    points = sets.count()
    left = met.withColumn("d", F.array().cast("array<double>"))
    measured_at, pairs_at, before = [], [], None
    scan = lambda schema, paths: spark.read.schema(schema).parquet(*paths)
    while True:
        pivot = left.groupBy("h").agg(F.max_by("point", F.struct("share", -F.col("point"))).alias("pivot"), F.count("*").alias("m")).filter("m > 1").drop("m")
        rows = common.materialise(spark, left.join(pivot, "h"), "op7-region")
        asked = rows.filter("point <> pivot").select(F.col("pivot").alias("a"), F.col("point").alias("b")).distinct()
        far = 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
        known = setjoin.overlaps(asked, sets).select("a", "b", far.alias("far"), F.expr(setjoin.SIMILAR).alias("near"))
        measured_at.append(common.write(spark, known, "op7-distances"))
        known = scan(known.schema, measured_at[-1:])
        measured = known.select(F.col("a").alias("pivot"), F.col("b").alias("point"), "far", "near")
        placed = rows.join(measured, ["pivot", "point"], "left").select("h", "point", "n", "pos", "share", F.concat("d", F.array(F.coalesce("far", F.lit(0.0)))).alias("d"), F.coalesce("near", F.lit(True)).alias("near"))
        placed = common.materialise(spark, placed, "op7-placed")
        last = lambda side: F.element_at(f"d_{side}", -1)
        outside = placed.filter("not near")
        border = outside.filter(F.element_at("d", -1) <= 2 * NEAR)
        inside = placed.filter(F.col("near") & (F.element_at("d", -1) > 0)).join(border.select("h").distinct(), "h", "left_semi")
        some = _pairs(inside, border, last("b") <= last("a") + NEAR)
        pairs_at.append(common.write(spark, some, "op7-pairs"))
        sizes = outside.groupBy("h").agg(F.count("*").alias("m")).agg(F.max("m").alias("most"), F.sum(F.when(F.col("m") > small, F.col("m"))).alias("large"), F.sum("m").alias("rows")).first()
        left = outside.drop("near")
        large = sizes["large"] or 0
        if not large or (before is not None and large > 0.9 * before):
            break
        before = large
        if sizes["rows"] <= points / 2:
            sets, points = common.materialise(spark, setjoin.picked(sets, left.select(F.col("point").alias("id"))), "op7-sets"), sizes["rows"]
    window = F.forall(F.zip_with("d_a", "d_b", lambda x, y: F.abs(x - y)), lambda x: x <= NEAR) & (F.col("point_a") < F.col("point_b"))
    pairs_at.append(common.write(spark, _pairs(left, left, window), "op7-pairs"))
    return scan(known.schema, measured_at).filter("near").select("a", "b"), scan("a long, b long", pairs_at).distinct()


def jaccard_components(spark: SparkSession, docs: DataFrame, extra: float = EXTRA, small: int = SMALL, groups: bool = False) -> DataFrame:
    """rid, doc_id, n_shingles, component_id of each document; with groups also group_id, which is the same in a
    component and null where a document has no shingle."""
    rows = common.with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    packed = rows.mapInArrow(_pack(common.partition_labels(common.partitions(spark)), extra), setjoin.ITEM)
    packed = common.materialise(spark, packed, "op7-packed")
    items = packed.filter("id is not null").select("id", F.col("owner").alias("rid"), "doc_id", "n", "key", "check")
    alive = common.materialise(spark, setjoin.survivors(spark, packed, extra), "op7-survivors")
    firsts = items.join(alive, "key", "left_semi").groupBy("key", "check").agg(F.min(F.struct("id", "rid")).alias("first")).select("first.*")
    texts = rows.select("rid", "text").join(firsts, "rid").select("id", "text")
    sets = common.materialise(spark, texts.mapInArrow(_sets, "id long, n int, sig binary, s binary"), "op7-sets")
    met = common.materialise(spark, setjoin.cells(spark, sets).withColumn("share", F.col("c") / F.col("n")).drop("c"), "op7-cells")

    links, pairs = regions(spark, met, sets, small)
    label = components(spark, links)
    side = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"of_{c}"))
    apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    rest = common.materialise(spark, setjoin.verify(apart, sets), "op7-across")
    if not rest.isEmpty():
        label = components(spark, links.union(rest))

    ends = items.filter("n > 0").groupBy("key", "check").agg(F.min("doc_id").alias("least"), F.min("id").alias("id")).join(label, "id", "left")
    ends = ends.withColumn("label", F.coalesce("label", "id"))
    ends = ends.join(ends.groupBy("label").agg(F.min("least").alias("component")), "label").select("key", "check", "component", "label")
    empty = items.filter("n = 0").select("rid", "doc_id", "n", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("label"))
    out = items.filter("n > 0").join(ends, ["key", "check"]).select("rid", "doc_id", "n", "component", "label").union(empty)
    more = [F.col("label").alias("group_id")] * groups
    return out.select("rid", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *more)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.arrow_rows(spark, 1000):
        return jaccard_components(spark, common.documents(spark, sf_dir)).drop("rid")
