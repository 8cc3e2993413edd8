"""Imputation, scaling and shuffling of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.numeric import no_nan, sanitize
from platewise.operators.ordered import grid_quantiles, table_quantiles

QUANTILES = 1000


def replace_columns(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with some columns replaced in place, in one projection."""
    return df.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in df.columns])


def _col(f: str) -> Column:
    return F.col(f"`{f}`").cast("double")


def sanitize_columns(df: DataFrame, features: Sequence[str], limit: float = 1e12) -> DataFrame:
    return replace_columns(df, {f: sanitize(_col(f), limit) for f in features})


def table_stats(df: DataFrame, aggs: Sequence[Column]) -> list:
    """Whole-table aggregates; a single row comes to the driver and is used as literals."""
    return list(df.agg(*[c.alias(f"_{i}") for i, c in enumerate(aggs)]).first())


def impute_mean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing values become the column's mean over the whole table."""
    means = table_stats(df, [F.avg(_col(f)) for f in features])
    return replace_columns(df, {f: F.coalesce(_col(f), F.lit(m)) for f, m in zip(features, means)})


def impute_group_mean(
    df: DataFrame, group: str, levels: Sequence, features: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Missing values become the mean of their group; also the features with none left missing.

    ``levels`` are the design's group levels: the broadcast means have one row per level.
    """
    means = (
        df.where(F.col(group).isin(list(levels)))
        .groupBy(group)
        .agg(*[F.avg(_col(f)).alias(f"_m{i}") for i, f in enumerate(features)])
    )
    filled = df.join(F.broadcast(means), group, "left")
    fix = {f: F.coalesce(_col(f), F.col(f"_m{i}")) for i, f in enumerate(features)}
    out = filled.select(*[fix[c].alias(c) if c in fix else F.col(f"`{c}`") for c in df.columns])
    left = table_stats(out, [F.count_if(F.col(f"`{f}`").isNull()) for f in features])
    return out, [f for f, holes in zip(features, left) if holes == 0]


def impute_median(
    df: DataFrame, features: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Missing values become the column's median; also the features that have any value."""
    med = table_quantiles(df, features, [0.5]).first()
    known = [f for f in features if med[f]]
    gone = [f for f in features if not med[f]]
    fix = {f: F.coalesce(_col(f), F.lit(med[f][0])) for f in known}
    return replace_columns(df, fix).drop(*gone), known


def min_max(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rescale to [0, 1] over the whole table; a constant column becomes 0."""
    ends = table_stats(df, [g(_col(f)) for f in features for g in (F.min, F.max)])
    out = {}
    for i, f in enumerate(features):
        lo, hi = ends[2 * i], ends[2 * i + 1]
        v = _col(f)
        if lo is None or hi == lo:
            out[f] = F.when(v.isNotNull(), F.lit(0.0))
        else:
            out[f] = (v - F.lit(lo)) / F.lit(hi - lo)
    return replace_columns(df, out)


def center(df: DataFrame, features: Sequence[str]) -> DataFrame:
    means = table_stats(df, [F.avg(_col(f)) for f in features])
    return replace_columns(df, {f: _col(f) - F.lit(m) for f, m in zip(features, means)})


def quantile_uniform(
    df: DataFrame,
    features: Sequence[str],
    quantiles: int = QUANTILES,
    ranges: int | None = None,
) -> DataFrame:
    """Map each column to [0, 1] through its own empirical quantiles (at most one per row).

    Between two reference quantiles the mapping is linear; a value equal to a run of references
    gets the middle of the run. The references are ``features x quantiles`` doubles.
    """
    features = list(features)
    rows = df.count()
    n = min(quantiles, rows)
    grid = np.linspace(0, 1, n) if n > 1 else np.zeros(1)
    found = grid_quantiles(df, features, n, ranges).collect() if rows else []
    refs = {r["feature"]: np.asarray(r["q"], dtype=float) for r in found}

    def placed(q: np.ndarray):
        @F.pandas_udf("double")
        def place(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float)
            up = np.interp(v, q, grid)
            down = -np.interp(-v, -q[::-1], -grid[::-1])
            u = np.where(v >= q[-1], 1.0, (up + down) / 2)
            return pd.Series(np.where(v <= q[0], 0.0, u)).mask(np.isnan(v), None)

        return place

    # Only the features themselves go through Arrow. A missing value comes back from pandas as NaN.
    return replace_columns(df, {f: no_nan(placed(refs[f])(_col(f))) if f in refs else _col(f) for f in features})


def clip_scale(
    df: DataFrame,
    features: Sequence[str],
    lower: float = 5,
    upper: float = 95,
) -> DataFrame:
    """Clip to two percentiles and rescale to [0, 1]; NULL when the percentiles coincide."""
    bounds = table_quantiles(df, features, [lower / 100, upper / 100]).first()
    out = {}
    for f in features:
        if not bounds[f]:
            continue
        lo, hi = (F.lit(b) for b in bounds[f])
        v = F.when(_col(f).isNotNull(), F.least(F.greatest(_col(f), lo), hi))
        out[f] = F.try_divide(v - lo, hi - lo)
    return replace_columns(df, out)


def shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """The same pseudo-random row order on every run."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)
