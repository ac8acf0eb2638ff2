"""A group split that keeps the shares of the labels.

Groups are hashed to BINS bins, so what has to be chosen is a set of bins: their label counts are all that the driver
sees, BINS * LABELS numbers at most whatever the number of rows. Bins go to the valid side, the largest first, where
that brings the labels' shares nearer to the wanted one; then single bins, and pairs of bins of either side, change sides
while that still helps. Rows learn their side from the hash of their own group: no row is shuffled, and a group that
holds a third of all rows is one number of one bin.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BINS, LABELS = 4096, 64
#: Bins up to which pairs are tried.
PAIRS = 512


def bin_of(group: Column, bins: int = BINS) -> Column:
    """A bin for each group; null is a group of its own."""
    text = F.coalesce(F.concat(F.lit("g"), group.cast("string")), F.lit("null"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % bins).cast("int")


def label_counts(df: DataFrame, group: str, label: str, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bins that have labelled rows, and for each the number of rows of each label."""
    rows = df.filter(F.col(label).isNotNull()).groupBy(bin_of(F.col(group), bins).alias("bin"), label).agg(F.count("*").alias("n"))
    found = rows.limit(bins * LABELS + 1).collect()
    labels = {y: k for k, y in enumerate(sorted({r[label] for r in found}))}
    if len(labels) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    at = {b: k for k, b in enumerate(sorted({r["bin"] for r in found}))}
    counts = np.zeros((len(at), len(labels)), np.int64)
    for r in found:
        counts[at[r["bin"]], labels[r[label]]] += r["n"]
    return np.array(sorted(at), np.int64), counts


def choose(counts: np.ndarray, share: float) -> np.ndarray:
    """Which rows of counts (bins by labels) make up the share of each label, as nearly as this finds. A label that two
    bins have is on both sides."""
    part = counts / np.maximum(counts.sum(0), 1)
    side = np.zeros(len(part), bool)
    cost = lambda have: ((have - share) ** 2).sum(-1)
    have = np.zeros(part.shape[1])
    for k in np.argsort(-part.max(1, initial=0), kind="stable"):
        if cost(have + part[k]) < cost(have):
            side[k], have = True, have + part[k]
    sign = lambda: np.where(side, -1.0, 1.0)[:, None]
    for _ in range(4 * len(part)):
        have = part[side].sum(0)
        moves = have + sign() * part
        after, now = cost(moves), cost(have)
        k = int(after.argmin()) if len(after) else 0
        if len(after) and after[k] < now - 1e-15:
            side[k] = ~side[k]
            continue
        a, z = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(a) or not len(z) or len(part) > PAIRS:
            break
        both = cost(have - part[a][:, None] + part[z][None])
        i, j = np.unravel_index(both.argmin(), both.shape)
        if both[i, j] >= now - 1e-15:
            break
        side[a[i]], side[z[j]] = False, True
    has, every = counts > 0, np.arange(len(part))

    def lonely(k: int) -> bool:
        """Whether a label would lose its side if this bin left it."""
        return any(has[:, y].sum() > 1 and not (has[:, y] & (side == side[k]) & (every != k)).any() for y in np.flatnonzero(has[k]))

    for y in np.argsort(has.sum(0), kind="stable"):
        holders = np.flatnonzero(has[:, y])
        for wanted in (True, False):
            if len(holders) > 1 and not (side[holders] == wanted).any():
                after = cost(part[side].sum(0) + sign()[holders] * part[holders])
                k = holders[np.lexsort((after, [lonely(k) for k in holders]))[0]]
                side[k] = wanted
    return side


def valid_bins(df: DataFrame, group: str, label: str, n: int = 10, bins: int = BINS) -> list[int]:
    at, counts = label_counts(df, group, label, bins)
    return at[choose(counts, 1 / n)].tolist()
