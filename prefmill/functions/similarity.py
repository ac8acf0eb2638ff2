"""Token Jaccard and pairwise TF-IDF cosine of two text columns.

The cosine counts the terms of a row where the row is. The HEAD commonest terms are weighed there too, by a broadcast
table of fixed size; only the other terms, which by that are no hot keys, are joined with their document frequencies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ..sources.store import store
from .text import WORD, let, tokens

#: Terms whose document frequencies are broadcast, and rows that are counted at a time.
HEAD, ROWS = 200_000, 1000


def jaccard(a: Column, b: Column) -> Column:
    def share(sets: Column) -> Column:
        total = F.size(sets["x"]) + F.size(sets["y"])
        both = F.size(F.array_intersect(sets["x"], sets["y"]))
        return F.when(total == 0, F.lit(1.0)).otherwise(let(both, lambda n: n / F.greatest(total - n, F.lit(1))))

    return let(F.struct(F.array_distinct(tokens(a)).alias("x"), F.array_distinct(tokens(b)).alias("y")), share)


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[{WORD}]{{2,}}"), 0)


def flat_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts one after the other, and the number of each text's; texts are terms between single spaces.
    Empty texts go by a filter: pc.if_else with a null reads strange bytes where an array of strings is a slice."""
    some = pc.fill_null(pc.not_equal(texts, ""), False)
    lists = pc.split_pattern(texts.filter(some), " ")
    sizes = np.zeros(len(texts), np.int64)
    sizes[some.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
    return lists.flatten(), sizes


def _weigh(head):
    """From rows of (key, the joined terms of both texts, other columns): the key, the sums over head terms, the other
    terms with their counts, and the other columns."""

    def run(batches):
        words, idf = head.value
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                n = b.num_rows
                (left, of_left), (right, of_right) = flat_terms(b.column(1)), flat_terms(b.column(2))
                coded = pa.concat_arrays([left, right]).dictionary_encode()
                wide = max(len(coded.dictionary), 1)
                row = np.concatenate([np.repeat(np.arange(n), x) for x in (of_left, of_right)])
                first = len(left)
                keys, at = np.unique(row * wide + coded.indices.to_numpy(), return_inverse=True)
                ta, tb = np.bincount(at[:first], minlength=len(keys)), np.bincount(at[first:], minlength=len(keys))
                row, term = np.divmod(keys, wide)
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy()
                known = place[term] >= 0
                w = idf[place[term[known]]]
                wa, wb = ta[known] * w, tb[known] * w
                sums = [pa.array(np.bincount(row[known], x, n), pa.float64()) for x in (wa * wb, wa * wa, wb * wb)]
                rest = ~known
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=n))]), pa.int32())
                tails = [pa.ListArray.from_arrays(offsets, x) for x in (coded.dictionary.take(pa.array(term[rest])), pa.array(ta[rest]), pa.array(tb[rest]))]
                others = [b.column(j) for j in range(3, b.num_columns)]
                yield pa.RecordBatch.from_arrays([b.column(0), *sums, *tails, *others], names=[b.schema.field(0).name, "num", "na", "nb", "term", "ta", "tb", *b.schema.names[3:]])

    return run


def _frequencies(df: DataFrame, a: str, b: str) -> DataFrame:
    """term, df: texts of both columns that hold the term."""
    each = F.concat(*(F.array_distinct(terms(F.col(c))) for c in (a, b)))
    return store(df.select(F.explode(each).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")


def _commonest(docs: DataFrame, head: int) -> DataFrame:
    """At most `head` terms, all those of some frequency and more. The driver sees counts of frequencies."""
    cut, above = None, 0
    for r in docs.groupBy("df").agg(F.count("*").alias("terms")).orderBy(F.desc("df")).limit(head).collect():
        above += r["terms"]
        if above > head:
            break
        cut = r["df"]
    return docs.filter(F.lit(False) if cut is None else F.col("df") >= cut)


def _cosine(num: Column, na: Column, nb: Column) -> Column:
    # rows of unit length: a text without terms has length 0
    unit = lambda c: F.when(c > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when((na > 0) & (nb > 0), num / (na * nb)).otherwise(0.0) / (unit(na) * unit(nb) + 1e-12)


def cosines(df: DataFrame, key: str, a: str, b: str, others: dict[str, Column] | None = None, head: int = HEAD) -> DataFrame:
    """key, cosine_tfidf and other columns over df, for each row; the key is unique. The corpus is both columns of all
    rows; idf is ln((1+n)/(1+df)) + 1, tf is raw. df is read twice."""
    spark, others = df.sparkSession, others or {}
    docs, n = _frequencies(df, a, b), 2 * df.count()
    top = _commonest(docs, head).toArrow()
    idf = np.log((1 + n) / (1 + top.column("df").to_numpy())) + 1
    table = spark.sparkContext.broadcast((top.column("term").combine_chunks().cast(pa.string()), idf))
    joined = lambda c: F.array_join(terms(F.col(c)), " ")
    rows = df.select(key, joined(a).alias("a"), joined(b).alias("b"), *(c.alias(name) for name, c in others.items()))
    kinds = StructType([rows.schema[0]]).add("num", "double").add("na", "double").add("nb", "double").add("term", ArrayType(StringType())).add("ta", ArrayType(LongType())).add("tb", ArrayType(LongType()))
    scored = store(rows.mapInArrow(_weigh(table), StructType(kinds.fields + rows.schema.fields[3:])), "weighed")
    tail = scored.select(key, F.explode(F.arrays_zip("term", "ta", "tb")).alias("x")).select(key, "x.*").join(docs, "term")
    w = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    tail = tail.select(key, (F.col("ta") * w).alias("wa"), (F.col("tb") * w).alias("wb"))
    tail = tail.groupBy(key).agg(F.sum(F.col("wa") * F.col("wb")).alias("num_"), F.sum(F.col("wa") ** 2).alias("na_"), F.sum(F.col("wb") ** 2).alias("nb_"))
    total = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_"), F.lit(0.0))
    return scored.drop("term", "ta", "tb").join(tail, key, "left").select(key, _cosine(total("num"), F.sqrt(total("na")), F.sqrt(total("nb"))).alias("cosine_tfidf"), *others)


def tfidf_cosine(df: DataFrame, key: str, a: str, b: str, by: str | None = None) -> DataFrame:
    """df with cosine_tfidf: the corpus is both columns of all rows (of a `by` group if given); idf is
    ln((1+n)/(1+df)) + 1, tf is raw. Terms are counted by row first, so a frequent term costs one row a text."""
    if by is None:
        return df.join(cosines(df, key, a, b), key, "left").withColumn("cosine_tfidf", F.coalesce("cosine_tfidf", F.lit(0.0)))
    long = df.select(key, by, F.explode(F.array(F.struct(F.lit(0).alias("side"), terms(F.col(a)).alias("ts")), F.struct(F.lit(1).alias("side"), terms(F.col(b)).alias("ts")))).alias("x")).select(key, by, "x.side", F.explode("x.ts").alias("term"))
    tf = long.groupBy(key, by, "term").agg(F.sum((F.col("side") == 0).cast("double")).alias("ta"), F.sum((F.col("side") == 1).cast("double")).alias("tb"))
    docs = tf.groupBy(by, "term").agg(F.sum((F.col("ta") > 0).cast("int") + (F.col("tb") > 0).cast("int")).alias("df"))
    n = df.groupBy(by).agg((2 * F.count("*")).alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    sums = tf.join(docs, [by, "term"]).join(n, by).select(key, (F.col("ta") * idf).alias("wa"), (F.col("tb") * idf).alias("wb")).groupBy(key).agg(F.sum(F.col("wa") * F.col("wb")).alias("num"), F.sqrt(F.sum(F.col("wa") ** 2)).alias("na"), F.sqrt(F.sum(F.col("wb") ** 2)).alias("nb"))
    cos = _cosine(F.col("num"), F.col("na"), F.col("nb"))
    return df.join(sums.select(key, cos.alias("cosine_tfidf")), key, "left").withColumn("cosine_tfidf", F.coalesce("cosine_tfidf", F.lit(0.0)))


def pair_features(df: DataFrame, key: str, a: str, b: str, len_a: str, len_b: str) -> DataFrame:
    """df with cosine_tfidf, jaccard_tokens, abs_len_diff. The features come by a join with their stored table, so texts
    that nobody asks for are not shuffled."""
    found = store(cosines(df, key, a, b, {"jaccard_tokens": jaccard(F.col(a), F.col(b))}), "features")
    return df.join(found, key).withColumn("abs_len_diff", F.abs(F.col(len_a) - F.col(len_b)))
