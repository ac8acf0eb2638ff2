"""Exact quantiles of many columns and classes by radix selection.

A double's 64 bits, with the sign turned, have the order of the values. Each pass over the rows counts, for each class
and column, the next DIGITS bits of the values whose leading bits are those of a wanted rank, and so fixes these bits of
the order statistic: six passes for any number of rows, columns and quantiles. Tasks send sums of counts (2 ** DIGITS a
wanted rank at most); no task or buffer holds values. Between two order statistics the quantile is interpolated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DIGITS, BITS = 11, 64
#: Classes times columns times quantiles.
TARGETS = 2_000


def order_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0 is 0, NaN comes last."""
    x = np.where(np.isnan(values), np.nan, values) + 0.0
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(bits: int) -> float:
    raw = bits & ((1 << 63) - 1) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _count(columns: list[str], shift: int, width: int, wanted: dict):
    """Counts of the digits at this shift, by class, column and the bits before; wanted: the leading bits by (class,
    column), None in the first pass, when all values count."""
    digit = np.uint64((1 << width) - 1)

    def run(batches):
        found: dict = {}
        for b in batches:
            codes = b.column("by").dictionary_encode()
            names, at = codes.dictionary.to_pylist(), codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for n, c in enumerate(columns):
                values = b.column(c)
                have = np.asarray(values.is_valid())
                bits = order_bits(np.asarray(values.fill_null(0.0), np.float64))
                for k in np.unique(at).tolist():
                    by = names[k] if k >= 0 else None
                    own = bits[have & (at == k)]
                    for lead in [0] if wanted is None else wanted.get((by, n), ()):
                        some = own if wanted is None else own[(own >> np.uint64(shift + width)) == np.uint64(lead)]
                        if len(some):
                            add = np.bincount(((some >> np.uint64(shift)) & digit).astype(np.int64), minlength=1 << width)
                            found[by, n, lead] = found.get((by, n, lead), 0) + add
        rows = [(by, n, str(lead), int(d), int(add[d])) for (by, n, lead), add in found.items() for d in np.flatnonzero(add)]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["by", "col", "lead", "digit", "n"])

    return run


def quantiles(df: DataFrame, columns: list[str], at: list[float], by: str | None = None) -> DataFrame:
    """by (as text; null is a class of its own), column, q, n (values that are not null), value: for each class and
    column that has values, linearly interpolated between the values of rank floor and ceil of q * (n - 1). The rows are
    read six times, so what is dear to compute should be stored."""
    rows = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)], (F.col(by).cast("string") if by else F.lit("")).alias("by"))
    names, left, wanted, targets = [f"c{k}" for k in range(len(columns))], BITS, None, {}
    sizes: dict = {}
    while left:
        width = min(DIGITS, left)
        left -= width
        counted = rows.mapInArrow(_count(names, left, width, wanted), "by string, col int, lead string, digit int, n long")
        counts: dict = {}
        for r in counted.groupBy("by", "col", "lead", "digit").agg(F.sum("n").alias("n")).collect():  # 2 ** DIGITS a wanted rank at most
            counts.setdefault((r["by"], r["col"], int(r["lead"])), []).append((r["digit"], r["n"]))
        if wanted is None:
            sizes = {(b, c): sum(n for _, n in x) for (b, c, _), x in counts.items()}
            if len(sizes) * len(at) > TARGETS:
                raise ValueError(f"more than {TARGETS} quantiles")
            ranks = {(b, c): sorted({k for q in at for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}) for (b, c), n in sizes.items()}
            targets = {(b, c, k): (0, k) for (b, c), x in ranks.items() for k in x}  # leading bits, rank among their values
        for key, (lead, rank) in targets.items():
            for d, n in sorted(counts[key[0], key[1], lead]):
                if rank < n:
                    targets[key] = ((lead << width) | d, rank)
                    break
                rank -= n
        wanted = {}
        for (b, c, _), (lead, _) in targets.items():
            wanted.setdefault((b, c), set()).add(lead)
    out = []
    for (b, c), n in sizes.items():
        for q in at:
            low, high = math.floor(q * (n - 1)), math.ceil(q * (n - 1))
            x, y = (from_bits(targets[b, c, k][0]) for k in (low, high))
            out.append((b, columns[c], float(q), n, x if x == y else x + (y - x) * (q * (n - 1) - low)))
    return df.sparkSession.createDataFrame(out, "by string, column string, q double, n long, value double")
