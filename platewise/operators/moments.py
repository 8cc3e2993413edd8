"""Means and sums of products of many columns, by tiles of columns, as one grouped aggregate.

The scatter matrix (sums of products about the mean) of d columns is cut into tiles of ``TILE`` x ``TILE`` columns, of
which those on and above the diagonal are kept. A task adds up its own rows and sends a row per subset and tile; the
rows of a tile are merged in two steps by the exact rule for counts, means and scatters of two parts. So no task and
no driver holds more than a tile per subset, however many rows and columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256
#: Numbers of unsent tiles that a task holds; beyond it, it sends them after every batch.
HELD = 1 << 23
#: Parts of a tile that meet in the first of the two merges: a task's number modulo this one.
MERGED = 64

_FIELDS = ("n", "mean_i", "mean_j", "var_i", "var_j", "scatter")


def _merge(a: tuple, b: tuple) -> tuple:
    """Count, means, squares about the means and scatter of two parts of a tile together."""
    n, mi, mj, vi, vj, s = a
    m, ni, nj, wi, wj, t = b
    di, dj, total = ni - mi, nj - mj, n + m
    share = n * m / total
    return total, mi + di * (m / total), mj + dj * (m / total), vi + wi + di * di * share, vj + wj + dj * dj * share, s + t + np.outer(di, dj) * share


def moments(df: DataFrame, vec: str, by: Sequence[str] = (), tile: int = TILE, held_numbers: int = HELD) -> DataFrame:
    """``by, ti, tj, n, mean_i, mean_j, var_i, var_j, scatter`` of the vectors of every subset, a row per tile ti <= tj.

    ``mean_i`` and ``var_i`` (sums of squares about the mean) are of the columns from ti * tile, ``mean_j`` and ``var_j``
    of those from tj * tile, and ``scatter`` holds their sums of products row by row. Vectors have one length.
    """
    by = list(by)
    kinds = ["ti int", "tj int", "n double", *[f"{c} array<double>" for c in _FIELDS[1:]]]
    typed = ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for c in by], *kinds])

    def frame(tiles: dict[tuple, tuple]) -> pd.DataFrame:
        rows = [(*key, n, *(a.ravel().tolist() for a in rest)) for key, (n, *rest) in tiles.items()]
        return pd.DataFrame(dict(zip([*by, "ti", "tj", *_FIELDS], zip(*rows))))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                v = np.stack(part["_v"].to_numpy())
                mean = v.mean(axis=0)
                off = v - mean
                square = (off * off).sum(axis=0)
                cuts = range(0, v.shape[1], tile)
                for i in cuts:
                    for j in cuts[i // tile :]:
                        at = (*key, i // tile, j // tile)
                        a, b = slice(i, i + tile), slice(j, j + tile)
                        new = (float(len(v)), mean[a], mean[b], square[a], square[b], off[:, a].T @ off[:, b])
                        held[at] = _merge(held[at], new) if at in held else new
            if sum(t[-1].size for t in held.values()) > held_numbers:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for n, *rest, s in zip(*(pdf[c] for c in _FIELDS)):
            mi, mj, vi, vj = map(np.asarray, rest)
            part = (n, mi, mj, vi, vj, np.asarray(s).reshape(len(mi), len(mj)))
            out = part if out is None else _merge(out, part)
        return frame({tuple(pdf[c].iloc[0] for c in (*by, "ti", "tj")): out})

    parts = df.select(*by, F.col(vec).cast("array<double>").alias("_v")).mapInPandas(partial, typed)
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    first = salted.groupBy(*by, "ti", "tj", "_salt").applyInPandas(merged, typed)
    return first.groupBy(*by, "ti", "tj").applyInPandas(merged, typed)


def whole_scatter(tiles: Sequence, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter matrix of one subset from all its tiles."""
    ends = {t["tj"]: t["mean_j"] for t in tiles}
    mean = np.concatenate([ends[k] for k in sorted(ends)])
    out = np.zeros((len(mean), len(mean)))
    for t in tiles:
        i, j = t["ti"] * tile, t["tj"] * tile
        s = np.reshape(t["scatter"], (len(t["mean_i"]), len(t["mean_j"])))
        out[i : i + s.shape[0], j : j + s.shape[1]] = s
        out[j : j + s.shape[1], i : i + s.shape[0]] = s.T
    return mean, out
