"""Benchmark decontamination by a prefix-filtered set join (op 8). DataFrame functions only.

Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. A window is `size` consecutive words of an
item; an item of fewer, but not none, is one window. The tokens of a window are its shingles of SHINGLE words; a window
of fewer words is one shingle. A window occurs only where all its shingles do, so of its shingles in order of rarity (by
their counts in the documents) a prefix of one is enough: the join is on the window's rarest shingle, known by 64 bits.
The shingle's place in the window bounds where the window may begin, its length where it must end.

Documents are read twice. The first time all their shingles meet the windows' (64 bits each, broadcast in blocks of a
checked size; a benchmark with more takes one pass a block), and places of those that meet are stored: they give the
counts of the shingles and the documents that have one of the anchors. The second time only these documents are read:
their shingles meet the anchored windows, in broadcast blocks again, and the slice of the document that a window would
be is compared word for word inside the join, so the join's output is true occurrences only. A window does not carry the items that hold it but
a hash (SHA-256) of their list, so a passage that many items share costs no more than another; the lists meet the
documents only after equal sets of such hashes have become one, so 3,000 documents with one shared passage expand its
items once. Each document adds one row with a place below 0, which holds its number of words: so documents without
hits, empty texts and null texts come out of the same pass.

Cases: a null text has no words; an item without id or words is left out; rows of equal doc_id stay separate rows;
an empty benchmark gives n_hit 0 throughout. Documents that are no scan of stored files are stored first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SHINGLE = 10, 5
#: Shingles or windows in a broadcast: 16 and about 300 bytes each.
BLOCK = 250_000
#: What stands for a shingle in the row that each document adds.
OWN = (1 << 62) + 1
#: Distinct sets of hit lists that are broadcast, at most; more are joined by a shuffle.
SETS = 50_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows: ws array of words, items sorted array of the ids that hold it, of hash `held`."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("item is not null and size(w) > 0")
    begin = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    wins = items.select("item", "w", begin.alias("at")).select("item", F.slice("w", F.col("at"), F.lit(size)).alias("ws")).groupBy("ws").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return wins.withColumn("held", F.unhex(F.sha2(F.to_json("items").cast("binary"), 256)))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle(hashes: Column, at: Column, n: int) -> Column:
    """64 bits of the n words from a place on, out of the words' own."""
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(n)])


def window_shingles(wins: DataFrame, lengths: list[int]) -> DataFrame:
    """ws, held, off, h: the shingles of each window, at their places."""
    n = F.least(F.size("ws"), F.lit(SHINGLE))
    each = wins.withColumn("hs", hashed(F.col("ws"))).select("*", F.explode(F.sequence(F.lit(0), F.size("ws") - n)).alias("off"))
    h = F.coalesce(*[F.when(n == k, shingle(F.col("hs"), F.col("off"), k)) for k in lengths])
    return each.select("ws", "held", "off", h.alias("h"))


def places(base: DataFrame, vocabulary: DataFrame, lengths: list[int], block: int) -> DataFrame:
    """rid, doc_id, pos, h of all shingles of the documents that are in the vocabulary; and a row with pos = -1 - number
    of words for each document."""
    docs = base.withColumn("hs", hashed(F.col("words")))
    size, parts = F.size("hs"), max(1, -(-vocabulary.count() // block))
    found = None
    for k in range(parts):
        some = vocabulary if parts == 1 else vocabulary.filter(F.pmod("h", F.lit(parts)) == k)
        for n in lengths:
            own = k == 0 and n == lengths[0]  # this pass adds the documents' own rows
            first = -1 if own else 0
            at = F.explode(F.when(size >= n, F.sequence(F.lit(first), size - n)).otherwise(F.sequence(F.lit(-1), F.lit(-1)) if own else F.array().cast("array<int>"))).alias("at")
            rows = docs.select("rid", "doc_id", "hs", at)
            h = F.when(F.col("at") < 0, F.lit(OWN)).otherwise(shingle(F.col("hs"), F.col("at"), n))
            rows = rows.select("rid", "doc_id", F.when(F.col("at") < 0, -1 - size).otherwise(F.col("at")).alias("pos"), h.alias("h"))
            marked = some.union(vocabulary.sparkSession.range(1).select(F.lit(OWN).alias("h"))).distinct()
            hits = rows.join(F.broadcast(marked), "h").select("rid", "doc_id", "pos", "h")
            found = hits if found is None else found.unionByName(hits)
    return found


def anchored(hits: DataFrame, shingled: DataFrame) -> DataFrame:
    """Windows with their rarest shingle (anchor) and its place (off). Counts are over all documents; a window with a
    shingle that no document has can't occur."""
    counts = hits.filter("pos >= 0").groupBy("h").agg(F.count("*").alias("c"))
    first = F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h", "off")).alias("a")
    return shingled.join(counts, "h", "left").groupBy("ws", "held").agg(first).filter("a.c > 0").select(F.col("a.h").alias("h"), F.col("a.off").alias("off"), F.size("ws").alias("n"), "ws", "held")


def occurrences(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """A row for each document: rid, doc_id, n_words, n_hit, spans (start, n) of occurring windows, held (sorted hashes of
    their lists of items); and the lists: held, items."""
    rows = common.with_rid(docs.select(F.col("doc_id"), F.col("text")))
    base = rows.select("rid", "doc_id", words(F.col("text")).alias("words"))
    every = common.materialise(spark, windows(benchmark, size), "op8-windows")
    lengths = sorted(r["n"] for r in every.select(F.least(F.size("ws"), F.lit(SHINGLE)).alias("n")).distinct().collect()) or [SHINGLE]  # SHINGLE at most
    shingled = common.materialise(spark, window_shingles(every, lengths), "op8-shingles")
    hits = common.materialise(spark, places(base, shingled.select("h").distinct(), lengths, block), "op8-places")
    wins = common.materialise(spark, anchored(hits, shingled), "op8-anchored")
    asked = hits.filter("pos >= 0").join(wins.select("h").distinct(), "h", "left_semi").select("rid").distinct()
    asked = common.materialise(spark, asked, "op8-asked")
    asked = F.broadcast(asked) if asked.count() <= block else asked
    again = rows.join(asked, "rid", "left_semi").select("rid", words(F.col("text")).alias("words")).withColumn("hs", hashed(F.col("words")))
    parts, spans = max(1, -(-wins.count() // block)), None
    begin = F.col("at") - F.col("off")
    fits = (begin >= 0) & (F.slice("words", F.greatest(begin + 1, F.lit(1)), F.col("n")) == F.col("ws"))
    for k in range(parts):
        some = wins if parts == 1 else wins.filter(F.pmod(F.xxhash64("ws"), F.lit(parts)) == k)
        for n in lengths:
            at = F.explode(F.when(F.size("hs") >= n, F.sequence(F.lit(0), F.size("hs") - n)).otherwise(F.array().cast("array<int>"))).alias("at")
            each = again.select("rid", "words", "hs", at).select("rid", "words", "at", shingle(F.col("hs"), F.col("at"), n).alias("h"))
            own = F.broadcast(some.filter(F.least("n", F.lit(SHINGLE)) == n).withColumnRenamed("h", "anchor"))
            hit = each.join(own, (F.col("h") == F.col("anchor")) & fits).select("rid", F.struct(begin.alias("start"), "n").alias("span"), "held")
            spans = hit if spans is None else spans.unionByName(hit)
    none = {"doc_id": F.lit(None).cast(hits.schema["doc_id"].dataType), "n_words": F.lit(None).cast("int")}
    own = hits.filter("pos < 0").select("rid", "doc_id", (-1 - F.col("pos")).alias("n_words"), F.lit(None).cast("struct<start:int,n:int>").alias("span"), F.lit(None).cast("binary").alias("held"))
    found = own.unionByName(spans.withColumns(none))
    per_doc = found.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("held")).alias("held"))
    # spans in order of their start: each adds what lies beyond the end reached so far
    start, end = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")), lambda s: s["start"] + s["n"]
    step = lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), end(s) - F.greatest(a["end"], s["start"]))).alias("hit"), F.greatest(a["end"], end(s)).alias("end"))
    out = per_doc.select("rid", "doc_id", "n_words", F.aggregate("spans", start, step, lambda a: a["hit"]).cast("long").alias("n_hit"), "spans", "held")
    return out, every.select("held", "items").dropDuplicates(["held"])


def item_lists(found: DataFrame, lists: DataFrame) -> DataFrame:
    """held (array of hashes), items (sorted): what each distinct set of lists adds up to."""
    sets = found.filter(F.size("held") > 0).select("held").distinct()
    return sets.select("held", F.explode("held").alias("one")).join(lists.withColumnRenamed("held", "one"), "one").select("held", F.explode("items").alias("item")).distinct().groupBy("held").agg(F.sort_array(F.collect_list("item")).alias("items"))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row for each document: rid, doc_id, n_words, n_hit, items (sorted), spans (start, n) of occurring windows."""
    found, lists = occurrences(spark, docs, benchmark, size, block)
    found = common.materialise(spark, found, "op8-found")
    out = found.join(item_lists(found, lists), "held", "left")
    return out.select("rid", "doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, lists = occurrences(spark, common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = common.materialise(spark, found, "op8-found")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    sets = common.materialise(spark, item_lists(found, lists).select("held", F.size("items").cast("long").alias("n_items"), digest(F.array_join("items", ",")).alias("items_sha256")), "op8-sets")
    if sets.count() <= SETS:
        sets = F.broadcast(sets)
    out = found.join(sets, "held", "left")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", digest(F.lit(""))).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + 9), ' ') AS ws FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM i WHERE len(w) > 0 AND item_id IS NOT NULL)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS ws FROM (SELECT rid, n, w, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes)),
hit AS (SELECT rid, item_id, p, n FROM dw JOIN win USING (n, ws)),
pos AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT rid, p, n FROM hit)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
