"""What the operators share: tables, row ids, the shared folder, words."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import fixtures, store

#: Deletes nothing but ASCII white space; lower-cases nothing but A-Z.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Every byte that is not part of an ASCII-letter, digit or non-ASCII word becomes a space; A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return store.folder(spark)


def materialise(spark: SparkSession, df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and a lost executor costs a read."""
    return spark.read.schema(df.schema).parquet(write(spark, df, tag, compression))


def write(spark: SparkSession, df: DataFrame, tag: str, compression: str = "zstd") -> str:
    """The path in the shared folder that df has been written to; spark.read.parquet(*paths) reads several as one scan.
    The shuffle files of the write are of no more use then and go at once, not when the driver next collects garbage.
    store.release() deletes the table."""
    path = store.note(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", compression).option("parquet.block.size", 16 << 20).parquet(path)
    finally:
        spark.conf.set(key, before)
    return path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Files whose numbers are broadcast, at most: a path of 150 bytes each makes 15 MB. More are joined by a shuffle.
FILES = 100_000


def _is_scan(df: DataFrame) -> bool:
    """Whether df is a scan of files, of which columns are picked or rows filtered: then its rows know their place."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if not plan.nodeName().startswith(("LogicalRelation", "Relation")):
        return False
    try:
        df.select(df.metadataColumn("_metadata").getField("row_index"))
    except AnalysisException:
        return False
    return True


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df if it is a scan of files, else a stored copy, so that it has the same rows and ids whenever it is read."""
    return df if _is_scan(df) else materialise(spark, df, "rows")


def with_rid(df: DataFrame, name: str = "rid") -> DataFrame:
    """df with a unique long for each row: the number of its file, in order of path, and its place in the file. So the
    ids are the same in every job, however the scan is split, however many files and whatever executors there are. What
    is not a scan of stored Parquet files is stored first, with ids."""
    if not _is_scan(df):
        return materialise(df.sparkSession, df.withColumn(name, F.monotonically_increasing_id()), "rows")
    at = df.metadataColumn("_metadata")
    path, file, row = (fresh(df, c) for c in ("path", "file", "row"))
    paths = df.select(at.getField("file_path").alias(path)).distinct()
    some = paths.limit(FILES + 1).collect()
    if len(some) <= FILES:
        numbers = df.sparkSession.createDataFrame([(p, k) for k, p in enumerate(sorted(r[path] for r in some))], f"`{path}` string, `{file}` long")
        numbers = F.broadcast(numbers)
    else:
        numbers = fixtures.with_row_index(paths, path, name=file)
    placed = df.withColumns({path: at.getField("file_path"), row: at.getField("row_index")})
    return placed.join(numbers, path).withColumn(name, F.shiftleft(file, 40) + F.col(row)).drop(path, file, row)


def crc_mod(ids, n: int) -> np.ndarray:
    """crc32 of each id as decimal text, modulo n; a null id is the empty text."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % n for i in ids), np.int64, len(ids))


def crc_mod_column(column: str, n: int):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def raw_bytes(column: pa.Array) -> list:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def flat_lists(values: np.ndarray, lengths) -> pa.Array:
    """A list column from one flat array and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def slices(batch, column: str = "text", most: int = 4 << 20):
    """Slices of a batch with about `most` bytes of text, one row at least."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block, start = np.cumsum(lengths) // most, 0
    for end in [*(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
            start = end


def cut(texts: pa.Array, odd):
    """Texts (null: empty) cut at their spaces: the distinct words; the numbers of the texts that hold a word for which
    odd(words) marks, which are left whole; and the entries of all texts, one after the other, with how many each has. An entry
    is the number of a word, or len(words) + k for the k-th whole text."""
    words, *rest = cut_words(texts, odd)
    return words.to_pylist(), *rest


def cut_words(texts: pa.Array, odd):
    """As cut(), with the words as an Arrow array."""
    lists = pc.split_pattern(texts.fill_null(""), " ")
    coded = lists.flatten().dictionary_encode()
    words, entries, counts = coded.dictionary, coded.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)
    stops = np.cumsum(counts)
    places = np.flatnonzero(odd(words).to_numpy(zero_copy_only=False)[entries])
    whole = np.unique(np.searchsorted(stops, places, side="right"))
    if len(whole):
        keep = np.ones(len(entries), bool)
        for k in whole.tolist():
            keep[stops[k] - counts[k] : stops[k]] = False
        entries = entries[keep]
        counts[whole] = 0
        entries = np.insert(entries, np.cumsum(counts)[whole], len(words) + np.arange(len(whole)))
        counts[whole] = 1
    return words, whole, entries, counts


def joined(blobs: list, entries: np.ndarray, counts: np.ndarray, kind: str):
    """The blobs of entries one after the other as an array, and the number of values of each text."""
    taken = pa.array(blobs, pa.large_binary()).take(pa.array(entries))
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(entries) + 1) if len(entries) else np.zeros(1, np.int64)
    stops = ends[np.concatenate([[0], np.cumsum(counts)])] // np.dtype(kind).itemsize
    return np.frombuffer(taken.buffers()[2], kind, stops[-1]) if stops[-1] else np.zeros(0, kind), np.diff(stops)


def batches(rows, schema: pa.Schema) -> pa.RecordBatch:
    """One batch from a list of tuples."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def task_temp() -> str:
    """A folder for spills that live no longer than their task."""
    return tempfile.mkdtemp(prefix="spill-", dir=os.environ.get("TMPDIR") or None)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most: rows with long texts or sets fill a batch soon. The setting stays, for
    results are evaluated after the operator has returned; a smaller one that is set already is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    yield


def partition_labels(n: int) -> np.ndarray:
    """For each of n partitions an int that repartition(n, column) sends there (Murmur3 of an int, seed 42)."""
    labels, missing, start = np.full(n, -1, np.int64), n, 0
    with np.errstate(over="ignore"):
        while missing:
            i = np.arange(start, start + 4 * n + 64, dtype=np.uint32)
            k = i * np.uint32(0xCC9E2D51)
            k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
            h = np.uint32(42) ^ k
            h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
            h ^= np.uint32(4)
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
            to = h.view(np.int32).astype(np.int64) % n
            part, at = np.unique(to, return_index=True)
            new = labels[part] < 0
            labels[part[new]] = i[at[new]]
            missing, start = int((labels < 0).sum()), start + len(i)
    return labels


def tidy(*caches) -> None:
    """Empty a worker's caches at the end of a task and give freed memory back: workers serve other tasks too."""
    import ctypes
    import gc

    for c in caches:
        c.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
