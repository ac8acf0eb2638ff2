"""Dense heads over vectors, and class probabilities of a batch of pairs from their scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import evaluation as ev

#: Bytes of weights that a head may have: they go to each task.
WEIGHTS = 64 << 20
ACTIVATIONS = {"tanh": np.tanh, "relu": lambda x: np.maximum(x, 0), "none": lambda x: x}


@dataclass
class Head:
    """layers: (weights of shape (out, in), bias of shape (out,), activation), from the input on."""

    layers: list

    def __post_init__(self):
        self.layers = [(np.asarray(w, np.float64), np.asarray(b, np.float64), a) for w, b, a in self.layers]
        for (w, b, a), below in zip(self.layers, [None, *self.layers]):
            if w.ndim != 2 or b.shape != w.shape[:1] or a not in ACTIVATIONS or below is not None and below[0].shape[0] != w.shape[1]:
                raise ValueError("layers don't fit together")
        if sum(w.nbytes + b.nbytes for w, b, _ in self.layers) > WEIGHTS:
            raise ValueError(f"weights of more than {WEIGHTS} bytes")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for w, b, a in self.layers:
            x = ACTIVATIONS[a](x @ w.T + b)
        return x


def two_layers(w1, b1, w2, b2) -> Head:
    """The head of a pair scorer: linear, tanh, linear to one score. (Dropout does nothing when a model only scores.)"""
    return Head([(w1, b1, "tanh"), (w2, b2, "none")])


def with_scores(df: DataFrame, head: Head, vectors: dict[str, str]) -> DataFrame:
    """df and a score for each column of vectors (vectors: column to name of the score): the first output of the head. A
    vector that is null, has a null component or another length than the head's input has a null score. Rows go through
    the head in Arrow batches, its weights with the task."""
    dim = head.layers[0][0].shape[1]

    def run(batches):
        for b in batches:
            columns, names = list(b.columns), list(b.schema.names)
            for column, name in vectors.items():
                lists = b.column(column)
                good = [k for k, v in enumerate(lists.to_pylist()) if v is not None and len(v) == dim and None not in v] if lists.null_count or lists.flatten().null_count else None
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                good = np.flatnonzero(sizes == dim) if good is None else np.array(good, np.int64)
                x = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), dim)
                score = np.full(b.num_rows, np.nan)
                score[good] = head(x)[:, 0] if len(good) else 0
                missing = np.ones(b.num_rows, bool)
                missing[good] = False
                columns.append(pa.array(score, mask=missing))
                names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    if taken := set(vectors.values()) & set(df.columns):
        raise ValueError(f"there are columns {', '.join(sorted(taken))}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in vectors.values())])
    return df.mapInArrow(run, schema)


def predict(df: DataFrame, head: Head | None, first: str = "va", second: str = "vb") -> DataFrame:
    """id, prob_A, prob_B, prob_TIE, pred_label of pairs of vectors; without a head, or where a score is missing, the
    placeholder's equal shares and a tie."""
    if head is None:
        return ev.placeholder(df)
    scored = with_scores(df.select("id", first, second), head, {first: "s_a", second: "s_b"})
    p = ev.argmax(ev.bt_probabilities(scored))
    known = F.col("s_a").isNotNull() & F.col("s_b").isNotNull()
    shares = [F.when(known, F.col(c)).otherwise(0.3333).alias(f"prob_{n}") for c, n in zip(ev.P, ev.NAMES)]
    names = F.array(*map(F.lit, ev.NAMES))
    return p.select("id", *shares, F.when(known, F.get(names, F.col("y_pred"))).otherwise("TIE").alias("pred_label"))
