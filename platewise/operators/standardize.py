"""Row and day standardization, robust z-scores and percentile trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.numeric import at_least, at_most, no_nan
from platewise.operators.identity import require, select_listed
from platewise.operators.ordered import TASK_VALUES, with_group_quantiles
from platewise.roles import Roles
from platewise.session import stage


def _minus_group_median(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], task_values: int
) -> DataFrame:
    keep = [c for c in df.columns if c not in set(features)]
    got = with_group_quantiles(df, keys, features, [0.5], task_values=task_values)
    left = [(F.col(f"`{f}`") - F.get(f"`_q_{f}`", F.lit(0))).alias(f) for f in features]
    return got.select(*keep, *left)


def standardize_row_day(
    df: DataFrame,
    roles: Roles,
    features: Sequence[str] | None = None,
    materialize: bool = False,
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """Subtract the median of the plate row, then the day's median of what is left.

    Output is the metadata and ``rp_norm_{feature}``. Rows with a missing key get NULL features.
    ``materialize`` writes the row step to the shared folder, so the day step does not repeat it.
    """
    require(df, [roles.day, roles.biorep, roles.tech_rep])
    meta = roles.metadata(df)
    features = list(features or roles.features(df))
    values = df.select(*meta, *[no_nan(F.col(f"`{f}`").cast("double")).alias(f) for f in features])
    rows = _minus_group_median(values, [roles.day, roles.biorep, roles.tech_rep], features, task_values)
    if materialize:
        rows = stage(rows, "row-standardized")
    days = _minus_group_median(rows, [roles.day], features, task_values)
    return days.select(*meta, *[F.col(f"`{f}`").alias(f"rp_norm_{f}") for f in features])


def robust_z(
    df: DataFrame,
    roles: Roles,
    features: Sequence[str] | None = None,
    materialize: bool = False,
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """``rZs_{feature}`` = 0.6745 (x - median) / MAD within day and biorep; NULL when the MAD is 0."""
    keys = [roles.day, roles.biorep]
    require(df, keys)
    meta = roles.metadata(df)
    features = list(features or roles.features(df))
    values = df.select(*meta, *[no_nan(F.col(f"`{f}`").cast("double")).alias(f) for f in features])
    off = _minus_group_median(values, keys, features, task_values)
    if materialize:
        off = stage(off, "median-deviations")
    size = [f"_abs_{f}" for f in features]
    off = off.select("*", *[F.abs(F.col(f"`{f}`")).alias(a) for f, a in zip(features, size)])
    got = with_group_quantiles(off, keys, size, [0.5], task_values=task_values)
    scores = [
        F.try_divide(F.lit(0.6745) * F.col(f"`{f}`"), F.get(f"`_q_{a}`", F.lit(0))).alias(f"rZs_{f}")
        for f, a in zip(features, size)
    ]
    return got.select(*meta, *scores)


def trim_wells(
    df: DataFrame,
    roles: Roles,
    lower: float = 2.5,
    upper: float = 97.5,
    features: Sequence[str] | None = None,
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """Values outside the well's percentile bounds become NULL; rows stay.

    Bounds are inclusive up to a relative 1e-9, so an interpolated bound cannot drop a value equal
    to it. A missing day or well is a group of its own; rows without a biorep are left out.
    """
    require(df, [roles.day, roles.biorep, roles.well])
    features = list(features or roles.features(df, downstream=True))
    keys = ["_group_day", roles.biorep, "_group_well"]
    named = {"_group_day": F.coalesce(F.col(roles.day), F.lit("NAN")), "_group_well": F.coalesce(F.col(roles.well), F.lit("NAN"))}
    keyed = df.where(F.col(roles.biorep).isNotNull()).withColumns(named)
    got = with_group_quantiles(keyed, keys, features, [lower / 100, upper / 100], task_values=task_values)
    chosen = set(features)
    out = []
    for c in df.columns:
        if c in chosen:
            v = F.col(f"`{c}`")
            lo, hi = F.get(f"`_q_{c}`", F.lit(0)), F.get(f"`_q_{c}`", F.lit(1))
            out.append(F.when(at_least(v, lo) & at_most(v, hi), v).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return got.select(*out)


def trim_selected(
    df: DataFrame,
    wanted: Sequence[str],
    roles: Roles,
    lower: float = 2.5,
    upper: float = 97.5,
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """Keep the metadata and the listed features of a standardized table, then trim by well."""
    narrow = select_listed(df, wanted, roles)
    return trim_wells(narrow, roles, lower, upper, task_values=task_values)
