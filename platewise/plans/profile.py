"""The main analysis end to end: objects to cell profiles to dose scores to selected features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from platewise.operators.correlate import prune_correlated
from platewise.operators.distance import distances_by_day
from platewise.operators.doseresponse import fit_models, select_features
from platewise.operators.emd import emd_concentrations
from platewise.operators.identity import normalize_keys
from platewise.operators.pooling import pool_cells
from platewise.operators.standardize import standardize_row_day, trim_selected, trim_wells
from platewise.operators.subsets import ALWAYS_EXCLUDED, DAY_CAP, filter_features, sample_capped
from platewise.plans import inputs
from platewise.roles import Roles
from platewise.session import stage


def cell_profiles(tables: Mapping[str, DataFrame], roles: Roles) -> DataFrame:
    """Pooled and standardized cells, stored: scores and both trims start from this table."""
    pooled = stage(normalize_keys(pool_cells(tables, roles), roles), "cells")
    counts = [c for c in pooled.columns if c.startswith("counts_")]
    features = [f for f in roles.features(pooled) if f not in counts]
    return stage(standardize_row_day(pooled, roles, features, materialize=True), "standardized")


def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMD of every pair of concentrations per day and feature, from the object tables."""
    roles = inputs.ROLES
    std = cell_profiles(inputs.object_tables(spark, sf_dir), roles)
    return emd_concentrations(trim_wells(std, roles), roles)


def selected_profiles(
    std: DataFrame, roles: Roles, days: Sequence[str], excluded: Sequence[int] = (2,)
) -> tuple[list[str], list[str], DataFrame]:
    """Features that respond to dose, those left after pruning, and the trimmed table of the latter.

    ``std`` is a stored standardized table. Only feature names come to the driver.
    """
    scores = stage(emd_concentrations(trim_wells(std, roles), roles), "dose-scores")
    responding = sorted(r["Feature"] for r in select_features(fit_models(scores, roles, excluded), days).collect())
    first = stage(trim_selected(std, responding, roles), "selected")
    kept = responding
    if len(responding) > 1:
        kept = sorted(r["feature"] for r in prune_correlated(first, roles, responding).collect())
    return responding, kept, trim_selected(std, kept, roles)


def sampled_distances(
    df: DataFrame, roles: Roles, cap: int = DAY_CAP, excluded: Sequence[str] = ALWAYS_EXCLUDED
) -> DataFrame:
    """The three population distances of every day, on a sample of each day and concentration.

    Features are filtered by the sample's own missing share and variance; of what is left every value is used.
    """
    drawn = stage(sample_capped(df, roles, cap), "sample")
    return distances_by_day(filter_features(drawn, roles, excluded), roles)
