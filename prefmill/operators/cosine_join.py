"""Pairs of rows of a group whose TF-IDF cosine reaches a threshold: a weighted prefix filter.

A row is a unit vector over the terms of its text, with inverse document frequencies of its group. Its terms stand in
order of rarity in the group, then of text. If two vectors have a cosine of t or more, they share a term among those at
which the rest of either vector, from that term on, still has a length of t: else all they share lies in the rest of
the one, which is shorter than t. So only these prefixes are joined, on (group, term), and of a match the rests' lengths
must have a product of t. Prefix terms are the rarest of their rows, and a large group is spread over its terms. Pairs
that are left are measured on all their terms.

Rows with the same terms, equally often, are one vector, known by its smallest row: copies are linked with that row and
not with each other, which loses no connection.

A group of up to TASK_ROWS rows and TASK_CHARS characters is measured where its rows meet: they are shuffled once, as
texts, and the same prefixes are joined in arrays. Larger groups, of which there are few, are joined term by term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import similarity as sim
from ..sources.store import store

SLACK = 1e-9
#: The largest group that one task measures, and the pairs or terms that it holds at a time.
TASK_ROWS, TASK_CHARS, BLOCK = 4096, 16_000_000, 2_000_000


def vectors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df: row_idx, prompt_sig, template. The members of vectors: rep, row_idx; and the vectors of groups that have two
    rows and more, a row a term: rep, prompt_sig, term, u (weight), rest (length of the vector from this term on)."""
    bags = df.select("row_idx", F.col("prompt_sig").alias("g"), F.sort_array(sim.terms(F.col("template"))).alias("terms"))
    bags = store(bags.withColumn("bag", F.sha2(F.array_join("terms", " ").cast("binary"), 256)), "bags")
    reps = store(bags.groupBy("g", "bag").agg(F.min("row_idx").alias("rep"), F.count("*").alias("times")), "reps")
    members = bags.filter(F.size("terms") > 0).join(reps, bags["g"].eqNullSafe(reps["g"]) & (bags["bag"] == reps["bag"])).select("rep", "row_idx")
    n = reps.groupBy("g").agg(F.sum("times").alias("n")).filter("n > 1").withColumnRenamed("g", "of")
    own = reps.join(n, reps["g"].eqNullSafe(n["of"])).drop("of", "bag")
    tf = own.join(bags.select(F.col("row_idx").alias("rep"), "terms"), "rep").select("rep", "g", "times", "n", F.explode("terms").alias("term"))
    tf = tf.groupBy("rep", "g", "times", "n", "term").agg(F.count("*").alias("tf"))
    docs = tf.groupBy(F.col("g").alias("of"), F.col("term").alias("t")).agg(F.sum("times").alias("df"), F.count("*").alias("holders"))
    w = tf.join(docs, tf["g"].eqNullSafe(docs["of"]) & (tf["term"] == docs["t"])).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    row = W.partitionBy("rep").orderBy("df", "term")  # the terms of one text
    w = w.withColumns({"norm": F.sqrt(F.sum(F.col("w") ** 2).over(W.partitionBy("rep"))), "rest": F.sum(F.col("w") ** 2).over(row.rowsBetween(W.currentRow, W.unboundedFollowing))})
    return members, store(w.select("rep", F.col("g").alias("prompt_sig"), "term", "holders", (F.col("w") / F.col("norm")).alias("u"), (F.sqrt("rest") / F.col("norm")).alias("rest")), "vectors")


def candidates(terms: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of vectors that share a term of their prefixes."""
    prefix = terms.filter((F.col("rest") >= threshold - SLACK) & (F.col("holders") > 1)).select("rep", "prompt_sig", "term", "rest")
    x, y = prefix.alias("x"), prefix.alias("y")
    same = F.col("x.prompt_sig").eqNullSafe(F.col("y.prompt_sig")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.rep") < F.col("y.rep"))
    return x.join(y, same & (F.col("x.rest") * F.col("y.rest") >= threshold - SLACK)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def measured(terms: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """prompt_sig, a, b, cosine of the pairs that reach the threshold."""
    left = terms.select(F.col("rep").alias("a"), "prompt_sig", "term", F.col("u").alias("ua"))
    right = terms.select(F.col("rep").alias("b"), "term", F.col("u").alias("ub"))
    dots = pairs.join(left, "a").join(right, ["b", "term"])
    return dots.groupBy("prompt_sig", "a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine")).filter(F.col("cosine") >= threshold)


def _blocks(counts: np.ndarray):
    """Ranges of places whose counts add up to BLOCK or are one place."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        yield slice(at, to)
        at = to


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of each of counts[owner] items."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def near_rows(texts: pa.Array, threshold: float):
    """Of one group: the first equal row of each row (-1: no terms), the squared length of its unit vector, and pairs of
    such first rows that reach the threshold, with their cosines. texts are terms between single spaces."""
    n = len(texts)
    terms, sizes = sim.flat_terms(texts)
    coded = terms.dictionary_encode()
    wide = max(len(coded.dictionary), 1)
    keys, tf = np.unique(np.repeat(np.arange(n), sizes) * wide + coded.indices.to_numpy(), return_counts=True)
    row, term = np.divmod(keys, wide)
    df = np.bincount(term, minlength=wide)
    stops = np.searchsorted(row, np.arange(n + 1))
    seen: dict = {}
    first = np.array([seen.setdefault((term[i:j].tobytes(), tf[i:j].tobytes()), k) if i < j else -1 for k, (i, j) in enumerate(zip(stops, stops[1:]))], np.int64)
    w = tf * (np.log((1 + n) / (1 + df[term])) + 1)
    u = w / np.sqrt(np.bincount(row, w * w, n))[row]
    own = np.bincount(row, u * u, n)

    kept = first[row] == row
    holders = np.bincount(term[kept], minlength=wide)
    order = np.lexsort((term, df[term], row))
    order = order[kept[order]]
    mass = np.cumsum((u * u)[order][::-1])[::-1]
    after = np.append(mass, 0.0)[np.searchsorted(row[order], row[order], side="right")]
    rest = np.sqrt(np.maximum(mass - after, 0.0))
    prefix = (rest >= threshold - SLACK) & (holders[term[order]] > 1)
    at, rest = order[prefix], rest[prefix]
    by_term = np.lexsort((row[at], term[at]))
    at, rest = at[by_term], rest[by_term]
    later = np.searchsorted(term[at], term[at], side="right") - np.arange(len(at)) - 1
    pairs = np.zeros(0, np.int64)
    for some in _blocks(later):
        x, k = _spread(later[some])
        x = x + some.start
        y = x + 1 + k
        close = rest[x] * rest[y] >= threshold - SLACK
        pairs = np.union1d(pairs, row[at[x[close]]] * n + row[at[y[close]]])
    a, b = np.divmod(pairs, max(n, 1))
    cosine = np.zeros(len(pairs))
    length = stops[a + 1] - stops[a]
    for some in _blocks(length):
        pair, k = _spread(length[some])
        pair = pair + some.start
        left = stops[a[pair]] + k
        wanted = b[pair] * wide + term[left]
        right = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        cosine[some] = np.bincount(pair - some.start, u[left] * u[right] * (keys[right] == wanted), some.stop - some.start)
    near = cosine >= threshold
    return first, own, a[near], b[near], cosine[near]


def _measure(threshold: float, out: pa.Schema):
    def run(key, table):
        table = table.sort_by("row_idx")
        ids = table.column("row_idx").to_numpy()
        first, own, a, b, cosine = near_rows(table.column("words").combine_chunks(), threshold)
        some = np.zeros(len(ids) + 1, bool)  # vectors that have copies or neighbours; the last place is that of none
        some[a] = some[b] = True
        some[first[(first >= 0) & (first != np.arange(len(ids)))]] = True
        rows = np.flatnonzero(some[first])
        left, right = np.concatenate([a, first[rows]]), np.concatenate([b, rows])
        columns = [pa.repeat(key[0], len(left)).cast(out.field(0).type), ids[left], ids[right], np.concatenate([cosine, own[first[rows]]]), np.arange(len(left)) >= len(a)]
        return pa.table(columns, schema=out)

    return run


def in_tasks(df: DataFrame, threshold: float) -> DataFrame:
    """prompt_sig, a, b, cosine, copy of groups that fit a task: pairs of vectors, and of vectors that are in such a pair
    or have copies the rows (copy; a: the vector, b: the row)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = df.select(F.col("row_idx").cast("long").alias("row_idx"), "prompt_sig", F.array_join(sim.terms(F.col("template")), " ").alias("words"))
    kind = df.select("prompt_sig").schema.add("a", "long").add("b", "long").add("cosine", "double").add("copy", "boolean")
    return store(rows.groupBy("prompt_sig").applyInArrow(_measure(threshold, to_arrow_schema(kind)), kind), "near")


def by_size(df: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Rows of groups that fit a task; those of larger groups, known by their smallest row in place of prompt_sig, or
    None; and the names of these groups: prompt_sig, of. A task's worth of rows or characters has one of them at most, so
    they are broadcast."""
    groups = df.groupBy("prompt_sig").agg(F.min("row_idx").alias("of"), F.count("*").alias("rows"), F.sum(F.length("template")).alias("chars"))
    large = store(groups.filter((F.col("rows") > TASK_ROWS) | (F.col("chars") > TASK_CHARS)).select("prompt_sig", "of"), "large")
    if large.isEmpty():
        return df, None, large
    named = F.broadcast(large.withColumnRenamed("prompt_sig", "name"))
    same = df["prompt_sig"].eqNullSafe(F.col("name"))
    wide = df.join(named, same).select("row_idx", F.col("of").alias("prompt_sig"), "template")
    return df.join(named, same, "left_anti"), wide, large


def links(df: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b) that connect the same rows as all pairs do: pairs of vectors, and each vector's rows with its first."""
    small, wide, _ = by_size(df)
    found = in_tasks(small, threshold).filter("a < b").select("a", "b")
    if wide is None:
        return found
    members, terms = vectors(wide)
    near = measured(terms, candidates(terms, threshold), threshold).select("a", "b")
    return found.unionByName(near).unionByName(members.filter("rep < row_idx").select(F.col("rep").alias("a"), F.col("row_idx").alias("b")))


def pairs(df: DataFrame, threshold: float) -> DataFrame:
    """prompt_sig, a, b, cosine: all pairs of rows, copies with each other too."""
    small, wide, large = by_size(df)
    found = in_tasks(small, threshold)
    near = found.filter("not copy or a = b").drop("copy")
    members = found.filter("copy").select(F.col("a").alias("rep"), F.col("b").alias("row_idx"))
    if wide is not None:
        more, terms = vectors(wide)
        own = terms.groupBy("rep", "prompt_sig").agg(F.sum(F.col("u") ** 2).alias("cosine")).select("prompt_sig", F.col("rep").alias("a"), F.col("rep").alias("b"), "cosine")
        joined = measured(terms, candidates(terms, threshold), threshold).unionByName(own).withColumnRenamed("prompt_sig", "of")
        near, members = near.unionByName(joined.join(F.broadcast(large), "of").drop("of")), members.unionByName(more)
    of = lambda c: members.select(F.col("rep").alias(c), F.col("row_idx").alias(f"{c}_row"))
    all_rows = near.join(of("a"), "a").join(of("b"), "b").filter((F.col("a") != F.col("b")) | (F.col("a_row") < F.col("b_row")))
    return all_rows.select("prompt_sig", F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b"), "cosine")
