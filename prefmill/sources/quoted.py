"""Delimited files whose quoted fields hold line breaks, read in parallel.

A file is read as physical lines, in as many splits as it has blocks. Where a line break ends a record can't be seen in
a split alone, but a split has only two ways to begin, at a record or inside quotes, and each line of it leads from one
of these states to one of them. So a first pass composes the lines of each split to a function of two states, and the
functions of a file's splits in order say how each begins. In the second pass each split cuts its lines at the breaks
that end records. What stands before its first such break belongs to a record of an earlier split: these heads, with
the open ends, are put together by file and place, one or two rows a split. Records are then parsed by Spark.

A field is quoted if it begins with a quote; within it two quotes are one. After a closing quote that is no end of a
field the rest of the field is plain. Quotes in plain fields are text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .store import store

START, INSIDE = 0, 1


def after(line: str, state: int, sep: str = ",", quote: str = '"') -> int:
    """The state in which the next line begins."""
    if quote not in line:
        return state
    k, n = 0, len(line)
    inside = state == INSIDE
    while True:
        if inside:
            k = line.find(quote, k)
            if k < 0:
                return INSIDE
            if line.startswith(quote, k + 1):
                k += 2
                continue
            inside, k = False, k + 1
        elif k < n and line[k] == quote:  # a field begins here
            inside, k = True, k + 1
            continue
        k = line.find(sep, k)
        if k < 0:
            return START
        k += len(sep)


def _lines(spark: SparkSession, path) -> DataFrame:
    """file, at (where its split begins) and line, in the order of the file within a split. Breaks inside are kept but
    for the last: a line may end with a carriage return."""
    at = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(at.getField("file_path").alias("file"), at.getField("file_block_start").alias("at"), F.col("value").alias("line"))


def _composed(sep: str, quote: str):
    """For each split its two ends, by the state in which it begins."""

    def run(batches):
        now, ends = None, None
        for b in batches:
            for file, at, line in zip(*(b.column(c).to_pylist() for c in ("file", "at", "line"))):
                if (file, at) != now:
                    if now is not None:
                        yield _row(now, ends)
                    now, ends = (file, at), [START, INSIDE]
                if quote in line:
                    ends = [after(line, s, sep, quote) for s in ends]
        if now is not None:
            yield _row(now, ends)

    return run


def _row(now, ends):
    return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([ends[0]], pa.int32()), pa.array([ends[1]], pa.int32())], names=["file", "at", "from_start", "from_inside"])


def _records(begins: dict, sep: str, quote: str):
    """file, at, n, kind, text: whole records (0), what a split holds of a record of an earlier one (1: it ends here, 2:
    it goes on), and the beginning of a record that ends later (3)."""
    names = ["file", "at", "n", "kind", "text"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())

    def run(batches):
        now, state, head, open_, n, out = None, START, False, [], 0, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        def close():
            if open_:
                out.append((*now, n, 2 if head else 3, "\n".join(open_)))

        for b in batches:
            for file, at, line in zip(*(b.column(c).to_pylist() for c in ("file", "at", "line"))):
                if (file, at) != now:
                    close()
                    now, state, open_, n = (file, at), begins[file, at], [], 0
                    head = state == INSIDE
                open_.append(line)
                state = after(line, state, sep, quote)
                if state == START:
                    out.append((*now, n, 1 if head else 0, "\n".join(open_)))
                    open_, head, n = [], False, n + 1
                if len(out) >= 10_000:
                    yield flush()
                    out = []
        close()
        if out:
            yield flush()

    return run


def records(spark: SparkSession, path, sep: str = ",", quote: str = '"') -> DataFrame:
    """file, at, n, text of each record, in the order of (file, at, n) where it begins. An open quote at a file's end
    closes there. path: a file, a folder or a list of them."""
    lines = _lines(spark, path)
    ends = lines.mapInArrow(_composed(sep, quote), "file string, at long, from_start int, from_inside int").collect()  # one row a split
    begins, state, file = {}, START, None
    for r in sorted(ends, key=lambda r: (r["file"], r["at"])):
        state = START if r["file"] != file else state
        file = r["file"]
        begins[file, r["at"]] = state
        state = r["from_inside"] if state == INSIDE else r["from_start"]
    cut = store(lines.mapInArrow(_records(begins, sep, quote), "file string, at long, n long, kind int, text string"), "records")
    edges = cut.filter("kind > 0")
    # a record that begins at the end of a split owns all heads up to the next such beginning
    order = W.partitionBy("file").orderBy("at", "n")  # two rows a split at most
    owned = edges.withColumn("first", F.max(F.when(F.col("kind") == 3, F.struct("at", "n"))).over(order))
    whole = owned.groupBy("file", "first").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "n", "text"))), lambda x: x["text"]), "\n").alias("text"))
    joined = whole.select("file", F.col("first.at").alias("at"), F.col("first.n").alias("n"), "text")
    return cut.filter("kind = 0").drop("kind").unionByName(joined)


OPTIONS = {"multiLine": "true", "maxCharsPerColumn": "-1"}


def read_quoted(spark: SparkSession, path, schema: str | None = None, sep: str = ",", quote: str = '"', header: bool = True) -> DataFrame:
    """The fields of each record. A file's first record is its header; of the first file it names the columns, as strings,
    unless a schema is given. Blank records are left out, and so is a byte order mark."""
    rows = records(spark, path, sep, quote).withColumn("text", F.regexp_replace("text", "^\ufeff|\r$", ""))
    options = OPTIONS | {"sep": sep, "quote": quote, "escape": quote}
    first = "at = 0 and n = 0"
    if schema is None:
        head = rows.filter(first).orderBy("file").select("text").limit(1).collect()
        text = head[0]["text"] if head else "value"
        most = ", ".join(f"c{k} string" for k in range(text.count(sep) + 1))
        names = [c for c in spark.range(1).select(F.from_csv(F.lit(text), most, options).alias("r")).select("r.*").first() if c is not None]
        schema = ", ".join("`{}` string".format(c.replace("`", "``") if header else f"_c{k}") for k, c in enumerate(names))
    rows = rows.filter(f"not ({first})") if header else rows
    return rows.filter("text <> ''").select(F.from_csv("text", schema, options).alias("r")).select("r.*")
