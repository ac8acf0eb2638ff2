"""Vector code compression: product codebooks by Hamerly's form of Lloyd's rounds (op 12).

A vector is kept if it is not null and all its components are finite. A component x becomes the integer floor(256 * x),
held to +-LIMIT so that sums of squares stay exact; vectors are cut into `parts` equal consecutive parts. The codebook of
a part position starts as that part of the `entries` smallest vec_ids. A round assigns each part to the nearest entry
(squared Euclidean distance, ties to the lower index) and replaces each entry by the floor of the mean of its parts;
unused entries stay. After the last round parts are assigned once more.

Bounds: the first assignment measures all distances. It stores for each part its entry, an upper bound of the distance
to it and a lower bound of the distance to all others. When entries have moved, the upper bound grows by the move of the
part's entry and the lower one shrinks by the largest move of the others. Only if the upper bound is then strictly below
the larger one of the lower bound and half the distance from the entry to its nearest neighbour, the part keeps its entry
unmeasured; else the upper bound becomes the true distance, and if that is not enough either, all entries are measured
as integers. Bounds are 32-bit and rounded outwards, so a tie is always measured. The state is a stored table, read by
one task a split; sums go out as one row for each part position and entry of a task and are added by Spark. A codebook
has parts * entries rows, whatever the number of vectors: it is the only thing that passes through the driver.

Cases: of all vectors the one with the smallest vec_id (null last, then by components) whose length is a positive
multiple of `parts` gives the dimension; vectors of another length go. Repeated vec_ids stay separate rows, each may
start an entry. Fewer vectors than entries make a smaller codebook; no vectors make none and no rows. Null labels count
as one label. Other columns are not carried on.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Bound of an integer component: 2 ** 12 components of it have exact distances in 63 bits.
LIMIT = 1 << 24
#: Labels that are broadcast, at most; of more, those with a large share of all rows are, and the others are joined.
LABELS = 100_000
#: Distances that are measured together.
_BLOCK = 1 << 22


@dataclass
class Codebooks:
    """values[part, entry] is an entry's integers; measured counts the parts whose entries were all measured, by pass."""

    values: np.ndarray
    measured: list[int]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))


def kept(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """vec_id, label, v (integers) of the rows that are kept, whatever their length."""
    whole = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    picked = rows.select(F.col(id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    return picked.filter(whole & (F.size("x") > 0) & (F.size("x") % parts == 0)).select("vec_id", "label", integers(F.col("x")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fixed(values: np.ndarray) -> pa.Array:
    """A list column from a row of values for each row."""
    return common.flat_lists(np.ascontiguousarray(values).ravel(), np.full(len(values), values.shape[1]))


def _square(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to all entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def _up(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _down(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def _measure(x: np.ndarray, entries: np.ndarray):
    """Nearest entry of each row (the lower index of equals), its distance from above, the next one's from below."""
    at, upper, lower = np.empty(len(x), np.int16), np.empty(len(x), np.float32), np.empty(len(x), np.float32)
    step = max(1, _BLOCK // len(entries))
    for i in range(0, len(x), step):
        d = _square(x[i : i + step], entries)
        rows, first = np.arange(len(d)), d.argmin(1)
        at[i : i + step], upper[i : i + step] = first, _up(d[rows, first])
        d[rows, first] = np.iinfo(np.int64).max
        lower[i : i + step] = _down(d.min(1)) if len(entries) > 1 else np.float32(np.inf)
    return at, upper, lower


def _moves(old: np.ndarray, new: np.ndarray):
    """For each entry of a part position: its own move and the largest move of the others, both from above, and half the
    distance to its nearest neighbour from below."""
    own = _up(((new - old) ** 2).sum(1))
    own[(new == old).all(1)] = 0
    order = np.argsort(own)
    others = np.full(len(own), own[order[-1]], np.float32)
    others[order[-1]] = own[order[-2]] if len(own) > 1 else 0
    apart = _square(new, new)
    np.fill_diagonal(apart, np.iinfo(np.int64).max)
    half = np.nextafter(_down(apart.min(1)) / np.float32(2), np.float32(-np.inf)) if len(own) > 1 else np.full(1, np.inf, np.float32)
    return own, others, half


def _assign(values: np.ndarray, before: np.ndarray | None):
    """Arrow batches with at, upper and lower bounds for these entries; before: the entries that the batches' bounds
    are of, None for the first time."""
    parts, _, width = values.shape
    inf = np.float32(np.inf)

    def run(batches):
        moves = None if before is None else [_moves(before[p], values[p]) for p in range(parts)]
        for b in (b for b in batches if b.num_rows):
            v = _matrix(b.column("v")).astype(np.int64).reshape(b.num_rows, parts, width)
            shape = (b.num_rows, parts)
            if moves is None:
                at, upper, lower = np.empty(shape, np.int16), np.empty(shape, np.float32), np.empty(shape, np.float32)
            else:
                at, upper, lower = (np.array(_matrix(b.column(c))) for c in ("at", "upper", "lower"))
            full = np.zeros(b.num_rows, np.int64)
            for p in range(parts):
                x, some = v[:, p], np.arange(b.num_rows)
                if moves is not None:
                    own, others, half = moves[p]
                    a = at[:, p]
                    still = own[a] == 0
                    u = np.where(still, upper[:, p], np.nextafter(upper[:, p] + own[a], inf))
                    low = np.where(others[a] == 0, lower[:, p], np.nextafter(lower[:, p] - others[a], -inf))
                    enough = np.maximum(low, half[a])
                    near = np.flatnonzero(~(u < enough))
                    u[near] = _up(((x[near] - values[p][a[near]]) ** 2).sum(1))
                    some = near[~(u[near] < enough[near])]
                    upper[:, p], lower[:, p] = u, low
                if len(some):
                    at[some, p], upper[some, p], lower[some, p] = _measure(x[some], values[p])
                    full[some] += 1
            names = ["vec_id", "label", "v", "at", "upper", "lower", "full"]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), _fixed(at), _fixed(upper), _fixed(lower), pa.array(full)], names=names)

    return run


def _sums(parts: int, entries: int, width: int):
    """A row for each part position and entry that the task has met: how many parts, and the sum of each component."""

    def run(batches):
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in (b for b in batches if b.num_rows):
            slot = _matrix(b.column("at")).astype(np.int64) + np.arange(parts) * entries
            n += np.bincount(slot.ravel(), minlength=len(n))
            np.add.at(total, slot.ravel(), _matrix(b.column("v")).astype(np.int64).reshape(-1, width))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), _fixed(total[met])], names=["slot", "n", "total"])

    return run


def compress(spark: SparkSession, rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The kept vectors as vec_id, label, v (integers), at (an entry a part), and the final codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte")
    state = common.materialise(spark, kept(rows, id, vector, label, parts), "op12-kept")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    dim = len(first[0]["v"]) if first else 0
    if dim > 4096:
        raise ValueError("distances are exact up to 4096 components")
    state = state.filter(F.size("v") == dim)
    start = [r["v"] for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()] if dim else []
    values = np.array(start, np.int64).reshape(len(start), parts, dim // parts).transpose(1, 0, 2)
    books = Codebooks(values, [])
    kind = state.schema["vec_id"].dataType.simpleString(), state.schema["label"].dataType.simpleString()
    schema = f"vec_id {kind[0]}, label {kind[1]}, v array<int>, at array<smallint>, upper array<float>, lower array<float>, full long"
    if not start:
        return spark.createDataFrame([], schema).select("vec_id", "label", "v", "at"), books
    before = None
    for k in range(rounds + 1):
        state = common.materialise(spark, state.mapInArrow(_assign(values, before), schema), f"op12-round{k}")
        books.measured.append(state.agg(F.sum("full")).first()[0])
        if k < rounds:
            sums = state.select("v", "at").mapInArrow(_sums(parts, len(start), dim // parts), "slot long, n long, total array<long>")
            added = [F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(dim // parts)]
            before, values = values, values.copy()
            for r in sums.groupBy("slot").agg(F.sum("n").alias("n"), *added).collect():  # parts * entries rows at most
                values[divmod(r["slot"], len(start))] = [r[f"t{i}"] // r["n"] for i in range(dim // parts)]
    books.values = values
    return state.select("vec_id", "label", "v", "at"), books


def _coded(values: np.ndarray):
    parts, _, width = values.shape

    def run(batches):
        for b in (b for b in batches if b.num_rows):
            at = _matrix(b.column("at"))
            near = values[np.arange(parts), at]
            d = _matrix(b.column("v")).astype(np.int64).reshape(near.shape) - near
            codes = at.astype(np.uint8).tobytes().hex()
            texts = [codes[i : i + 2 * parts] for i in range(0, len(codes), 2 * parts)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(texts), pa.array((d * d).sum((1, 2)))], names=["vec_id", "label", "code", "error"])

    return run


def codes(state: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distance to what the code stands for)."""
    kind = state.schema["vec_id"].dataType.simpleString(), state.schema["label"].dataType.simpleString()
    schema = f"vec_id {kind[0]}, label {kind[1]}, code string, error long"
    if not books.values.size:
        return state.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return state.mapInArrow(_coded(books.values), schema)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector that its code stands for, as doubles (the middle of each integer's interval)."""
    values = books.values

    def run(batches):
        for b in (b for b in batches if b.num_rows):
            at = np.frombuffer(bytes.fromhex("".join(b.column("code").to_pylist())), np.uint8).reshape(b.num_rows, len(values))
            near = values[np.arange(len(values)), at].reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _fixed((near + 0.5) / 256)], names=["vec_id", "vector"])

    return coded.select("vec_id", "code").mapInArrow(run, f"vec_id {coded.schema['vec_id'].dataType.simpleString()}, vector array<double>")


def with_label_error(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """coded and label_error, the sum of error over equal labels (nulls together)."""
    sums = common.materialise(spark, coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "op12-labels")
    some, join = sums.agg(F.count("*").alias("labels"), F.sum("n").alias("rows")).first(), lambda a, b: a.join(b, a["label"].eqNullSafe(b["of"])).drop("of", "n")
    sums = sums.withColumnRenamed("label", "of")
    if some["labels"] <= LABELS:
        return join(coded, F.broadcast(sums))
    often = F.col("n") * LABELS >= some["rows"]  # LABELS labels at most
    hot = F.broadcast(sums.filter(often))
    rest = coded.join(hot.select("of"), coded["label"].eqNullSafe(hot["of"]), "left_anti")
    return join(coded, hot).unionByName(join(rest, sums.filter(~often)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, books = compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = common.materialise(spark, codes(state, books), "op12-codes")
    return with_label_error(spark, coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


_NEAREST = """
{at} AS (SELECT r, vec_id, label, p, v, min(list_aggregate(list_transform(generate_series(1, len(v)), lambda i: (v[i] - c[i]) * (v[i] - c[i])), 'sum')::BIGINT * 64 + e) AS best FROM pieces JOIN {book} USING (p) GROUP BY ALL)"""
_MEANS = """
{next} AS (SELECT p, e, coalesce(mean, c) AS c FROM {book} LEFT JOIN (
  SELECT p, e, list(m ORDER BY i) AS mean FROM (SELECT p, best % 64 AS e, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM {at}) GROUP BY ALL) GROUP BY ALL) USING (p, e))"""
OP12_SQL = f"""
WITH ints AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (SELECT r, vec_id, label, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS v FROM (SELECT *, unnest(generate_series(0, 15)) AS p FROM ints)),
book0 AS (SELECT p, r - 1 AS e, v AS c FROM pieces WHERE r <= 64),{_NEAREST.format(at="at0", book="book0")},{_MEANS.format(next="book1", book="book0", at="at0")},{_NEAREST.format(at="at1", book="book1")},{_MEANS.format(next="book2", book="book1", at="at1")},{_NEAREST.format(at="at2", book="book2")},
coded AS (SELECT r, vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM at2 GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256 FROM coded
"""
