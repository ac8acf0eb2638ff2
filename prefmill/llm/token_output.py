"""Token-id output in Simple-8b files (op 10).

File format: Parquet files as the container (Spark's commit protocol makes retried and lost tasks safe, on any file
system); a row is a segment of whole documents in ascending doc_id order:
  part, seq        number of the range partition and of the segment in it; (part, seq) is the global order
  before           ids in earlier segments of the part
  doc_ids, lengths of its documents; a length counts the end id
  n, words, offsets, escape_at, escapes   Simple-8b (simple8b.py): little-endian 64-bit words, 32-bit offsets of blocks

Documents are range-partitioned by doc_id and sorted inside the partition (null ids first, then by text). A null text
has the end id only. Rows of equal doc_id stay separate. An empty table gives no segments.

Byte-level BPE works on pieces that begin at a space before a non-space, and a line break between non-spaces is a piece,
so a text without adjoining white space is cut at its spaces and line breaks and each distinct word of a batch is encoded
once, its letters apart from the marks after them; other texts are encoded whole.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import store
from . import common, simple8b

TOKENIZER = "byte_bpe_50k.json"
END = 0
SEGMENT = 1 << 18
#: Byte-level BPE always cuts between a letter and these, and takes a run of them for one piece.
_MARKS = ".,;:!?)]}*%#$&\"+=/\\>|~^@<([{-_"
CACHE = 500_000
#: Bytes of text that are encoded together, if no single text is longer.
SLICE = 12 << 20
_SEGMENT_SQL = "part int, seq int, before long, doc_ids array<long>, lengths array<int>, n int, words binary, offsets binary, escape_at binary, escapes binary"


def _body(words: pa.Array) -> pa.Array:
    """Words without the line break that may stand before them; there is none within."""
    return pc.replace_substring(words, "\n", "", max_replacements=1)


def _odd(words: pa.Array) -> pa.Array:
    """Words that adjoin more white space than one space or line break."""
    body = _body(words)
    return pc.or_(pc.equal(body, ""), pc.not_equal(pc.utf8_trim_whitespace(body), body))


def _endings(words: pa.Array, starts: pa.Array) -> pa.Array:
    """What each word has after its start."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)[1:].astype(np.int64)
    sizes = (pc.binary_length(words).to_numpy() - pc.binary_length(starts).to_numpy()).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(ends - offsets[1:], sizes) + np.arange(offsets[-1])
    data = np.frombuffer(words.buffers()[2], np.uint8)[at] if len(at) else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


class PieceEncoder:
    """Ids of texts as little-endian 32-bit integers. Each distinct word of a batch, with its space or line break, is
    encoded once, many at a time, without the marks after its letters; CACHE words stay known, those seen first: mostly
    the common ones."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        pieces = self.tok.get_vocab()
        self.begins = {lead: np.zeros(max(pieces.values()) + 1, bool) for lead in " \n"}
        self.begins[" "][[i for p, i in pieces.items() if p.startswith("Ġ")]] = True
        self.begins["\n"][[i for p, i in pieces.items() if p.startswith("Ċ")]] = True
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _after(self, lead: str, words: list[str]) -> list[bytes]:
        """Ids of each word with a space or a line break before it."""
        out = []
        for k in range(0, len(words), 500):
            some = words[k : k + 500]
            blob = self._ids([lead + lead.join(some)])[0]
            at = (np.flatnonzero(self.begins[lead][np.frombuffer(blob, "<u4")]) * 4).tolist()
            if len(at) == len(some):
                out += [blob[i:j] for i, j in zip(at, at[1:] + [len(blob)])]
            else:
                out += self._ids([lead + p for p in some])
        return out

    def encode(self, texts: pa.Array):
        """Ids of all texts one after the other, and the number of each text's."""
        words, whole, entries, counts = common.cut_words(pc.replace_substring(texts.fill_null(""), "\n", " \n"), _odd)
        starts = np.cumsum(counts) - counts
        split = np.ones(len(counts), bool)
        split[whole] = False
        firsts = entries[starts[split]]  # first words have no space before them
        entries[starts[split]] = len(words) + len(whole) + np.arange(len(firsts))
        more = self._ids([texts[k].as_py() or "" for k in whole.tolist()] + words.take(pa.array(firsts)).to_pylist())
        return common.joined(pa.concat_arrays([self._words(words), pa.array(more, pa.large_binary())]), entries, counts, "<u4")

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, each with its space or line break; the marks after letters are encoded apart."""
        bare = pc.utf8_rtrim(words, _MARKS)
        bare = pc.if_else(pc.utf8_is_alpha(_body(bare)), bare, words)
        cores = bare.dictionary_encode()
        tails = _endings(words, bare).dictionary_encode()
        return pc.binary_join_element_wise(self._cores(cores.dictionary).take(cores.indices), self._tails(tails.dictionary).take(tails.indices), pa.scalar(b"", pa.large_binary()))

    def _tails(self, tails: pa.Array) -> pa.Array:
        tails = tails.to_pylist()
        if len(self.tails) > CACHE:
            self.tails = {"": b""}
        need = [t for t in tails if t not in self.tails]
        self.tails.update(zip(need, self._ids(need)))
        return pa.array([self.tails[t] for t in tails], pa.large_binary())

    def _cores(self, cores: pa.Array) -> pa.Array:
        cores = cores.to_numpy(zero_copy_only=False).tolist()
        blobs = list(map(self.known.get, cores))
        need = [k for k, x in enumerate(blobs) if x is None]
        lines = [k for k in need if cores[k][:1] == "\n"]
        need = [k for k in need if cores[k][:1] != "\n"]
        for some, new in ((need, self._after(" ", [cores[k] for k in need])), (lines, self._after("\n", [cores[k][1:] for k in lines]))):
            for k, x in zip(some, new):
                blobs[k] = x
            self.known.update(islice(zip([cores[k] for k in some], new), max(0, CACHE - len(self.known))))
        return pa.array(blobs, pa.large_binary())


_CODERS: dict[str, PieceEncoder] = {}  # a Python worker serves many tasks


def _encode(path: str, end: int, segment: int):
    def run(batches):
        coder, part, seq, before = _CODERS.get(path) or _CODERS.setdefault(path, PieceEncoder(path)), TaskContext.get().partitionId(), 0, 0
        tail = np.array([end], "<u4").tobytes()
        ids, lengths, blobs, held = [], [], [], 0

        def flush():
            nonlocal seq, before, held
            v = np.frombuffer(b"".join(blobs), "<u4")
            e = simple8b.encode(v)
            row = {"part": part, "seq": seq, "before": before, "doc_ids": list(ids), "lengths": list(lengths), "n": len(v), "words": e["words"].astype("<u8").tobytes(), "offsets": e["offsets"].astype("<u4").tobytes(), "escape_at": e["escape_at"].astype("<u4").tobytes(), "escapes": e["escapes"].astype("<u8").tobytes()}
            seq, before, held = seq + 1, before + len(v), 0
            for x in (ids, lengths, blobs):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n", pa.int32()), *((c, pa.binary()) for c in ("words", "offsets", "escape_at", "escapes"))]))

        for b in batches:
            for some in common.slices(b, "text", SLICE):
                values, counts = coder.encode(some.column("text"))
                whole, stops = values.tobytes(), (np.cumsum(counts) * 4).tolist()
                for doc_id, i, j in zip(some.column("doc_id").to_pylist(), [0, *stops], stops):
                    ids.append(doc_id)
                    blobs += whole[i:j], tail
                    lengths.append((j - i) // 4 + 1)
                    held += lengths[-1]
                    if held >= segment:
                        yield flush()
        if ids:
            yield flush()

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, segment: int = SEGMENT) -> None:
    """Encode whole texts and write segments to path. tokenizer: a file for the tokenizers library."""
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encode(tokenizer, end, segment), _SEGMENT_SQL).write.option("compression", "zstd").parquet(path)


def _decode(batches):
    for b in batches:
        for r in b.to_pylist():
            a = {k: np.frombuffer(r[k], t) for k, t in (("words", "<u8"), ("offsets", "<u4"), ("escape_at", "<u4"), ("escapes", "<u8"))}
            ids = simple8b.decode(a["words"], a["offsets"], a["escape_at"], a["escapes"], r["n"]).astype("<u4")
            lengths = np.array(r["lengths"], np.int64)
            ends = np.cumsum(lengths)
            yield r, ids, lengths, ends


def _digest(batches):
    for r, ids, lengths, ends in _decode(batches):
        sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
        yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * len(ends), pa.int32()), pa.array(ends - lengths + r["before"]), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "part", "rel", "n_tokens", "ids_crc32"])


def _lists(batches):
    for r, ids, lengths, _ in _decode(batches):
        yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), common.flat_lists(ids.astype(np.int32), lengths)], names=["doc_id", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids from the files."""
    return spark.read.schema(_SEGMENT_SQL).parquet(path).mapInArrow(_lists, "doc_id long, ids array<int>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files; start counts the ids of all documents before."""
    files = spark.read.schema(_SEGMENT_SQL).parquet(path)
    totals = files.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).orderBy("part").collect()  # one row a range partition
    bases, at = [], 0
    for t in totals:
        bases.append((t["part"], at))
        at += t["n"]
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    return files.mapInArrow(_digest, "doc_id long, part int, rel long, n_tokens long, ids_crc32 long").join(base, "part").select("doc_id", (F.col("base") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.note(f"{common.shared_dir(spark)}/op10-{uuid.uuid4().hex}")
    write_tokens(spark, common.documents(spark, sf_dir), path)
    return token_index(spark, path)
