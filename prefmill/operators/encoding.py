"""Encoded pairs of texts: subword ids with marks, segments, mask and padding.

Training: either text is cut to its own limit, then ids go from the end of the longer one (of equal ones the second)
until the pair and its three marks fit; every pair is padded to the full length. Serving: no cut by side, and a batch is
padded to its longest pair. The tokenizer is a file for the tokenizers library; ids of the marks are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARKS = 3


@dataclass(frozen=True)
class PairFormat:
    tokenizer: str
    begin: int
    between: int
    end: int
    pad: int
    max_first: int = 96
    max_second: int = 320
    tokenizer_max: int = 512

    @property
    def longest(self) -> int:
        return min(self.max_first + self.max_second + MARKS, self.tokenizer_max)


def fitted(a: list[int], b: list[int], room: int) -> tuple[list[int], list[int]]:
    """Both cut from the end until they fit: the longer one, of equal ones the second."""
    over = max(0, len(a) + len(b) - room)
    uneven = min(over, abs(len(a) - len(b)))
    rest = over - uneven
    less_a = (uneven if len(a) > len(b) else 0) + rest // 2
    less_b = (uneven if len(b) > len(a) else 0) + rest - rest // 2
    return a[: max(0, len(a) - less_a)], b[: max(0, len(b) - less_b)]


_TOKENIZERS: dict = {}  # a Python worker serves many tasks


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _lists(rows: list, kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind)))


def encode_pairs(df: DataFrame, fmt: PairFormat, first: str, second: str, id: str = "id", serving: bool = False, batch: int = 32) -> DataFrame:
    """id, input_ids, segments (0: first text and its marks, 1: second), mask (0: padding). A null text is empty. Serving
    pads the pairs of a batch (of `batch` rows at most, as they come) to the longest of them."""
    longest = fmt.longest if not serving else fmt.max_first + fmt.max_second + MARKS

    def run(batches):
        encode = _tokenizer(fmt.tokenizer).encode_batch_fast
        for b in batches:
            texts = [[x or "" for x in b.column(c).to_pylist()] for c in ("first", "second")]
            for k in range(0, b.num_rows, batch):
                left, right = ([e.ids for e in encode(t[k : k + batch], add_special_tokens=False)] for t in texts)
                if not serving:
                    left, right = [x[: fmt.max_first] for x in left], [x[: fmt.max_second] for x in right]
                pairs = [fitted(x, y, longest - MARKS) for x, y in zip(left, right)]
                width = longest if not serving else max(len(x) + len(y) for x, y in pairs) + MARKS
                ids, segments, mask = [], [], []
                for x, y in pairs:
                    row = [fmt.begin, *x, fmt.between, *y, fmt.end]
                    fill = width - len(row)
                    ids.append(row + [fmt.pad] * fill)
                    segments.append([0] * (len(x) + 2) + [1] * (len(y) + 1) + [0] * fill)
                    mask.append([1] * len(row) + [0] * fill)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(k, batch), _lists(ids, np.int32), _lists(segments, np.int8), _lists(mask, np.int8)], names=["id", "input_ids", "segments", "mask"])

    rows = df.selectExpr(f"`{id}` as id", f"cast(`{first}` as string) as first", f"cast(`{second}` as string) as second")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, input_ids array<int>, segments array<tinyint>, mask array<tinyint>")
