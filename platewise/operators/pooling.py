"""Per-cell and per-well pooling of object tables by exact median."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.identity import clean_well_table, object_features, parse_well
from platewise.operators.ordered import TASK_VALUES, group_quantiles
from platewise.roles import Roles, numeric_columns


def pool(
    tables: Mapping[str, DataFrame],
    key: str,
    features: Mapping[str, Sequence[str]],
    metadata_from: str | None = None,
    metadata: Sequence[str] = (),
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """Medians ``{feature}_{object}`` and ``counts_{object}`` per key over all object tables.

    Each table is pooled on its own (one shuffle of its own width), then the far smaller pooled
    rows are brought together by key. A key without objects of a type has NULL for that type,
    counts included. The metadata columns come from ``metadata_from``: one row per key, the
    smallest in column order when objects of a key disagree.
    """
    pooled = []
    for name, df in tables.items():
        extra = [F.count(F.lit(1)).alias(f"counts_{name}")]
        carry = name == metadata_from and len(metadata) > 0
        if carry:
            extra.append(F.min(F.struct(*metadata)).alias("_meta"))
        med = group_quantiles(df, [key], features[name], [0.5], extra, task_values)
        pooled.append(
            med.select(
                key,
                *[F.get(f"`{f}`", F.lit(0)).alias(f"{f}_{name}") for f in features[name]],
                f"counts_{name}",
                *(["_meta"] if carry else []),
            )
        )
    if len(pooled) == 1:
        out = pooled[0]
    else:
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pooled)
        values = [c for c in stacked.columns if c != key]
        out = stacked.groupBy(key).agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in values])
    values = [c for c in out.columns if c not in (key, "_meta") and not c.startswith("counts_")]
    counts = [c for c in out.columns if c.startswith("counts_")]
    meta = [F.col(f"_meta.{m}").alias(m) for m in metadata] if "_meta" in out.columns else []
    return out.select(key, *values, *counts, *meta)


def pool_cells(
    tables: Mapping[str, DataFrame], roles: Roles, cells: str = "Cells", task_values: int = TASK_VALUES
) -> DataFrame:
    """Cell profiles: pooled features, object counts, metadata of the cell, parsed well name."""
    features = {n: object_features(df, roles.cell) for n, df in tables.items()}
    meta = [roles.well, roles.day, roles.biorep, roles.well_key]
    out = pool(tables, roles.cell, features, cells, meta, task_values)
    return parse_well(out, roles)


def pool_wells(
    tables: Mapping[str, DataFrame], roles: Roles, cells: str = "Cells", task_values: int = TASK_VALUES
) -> DataFrame:
    """Well profiles: the same per well, with the columns that are not measurements cleaned away."""
    features = {n: [c for c in numeric_columns(df) if c != roles.well_key] for n, df in tables.items()}
    meta = [roles.well, roles.day, roles.biorep]
    out = pool(tables, roles.well_key, features, cells, meta, task_values)
    return clean_well_table(parse_well(out, roles), roles.well_key)
