"""Correlation of well profiles, feature clusters and their representatives."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.numeric import all_present, no_nan
from platewise.operators.components import connected_components
from platewise.operators.moments import TILE, moments
from platewise.operators.ordered import TASK_VALUES, group_quantiles
from platewise.operators.scaling import impute_mean
from platewise.roles import Roles
from platewise.session import stage

CLUSTER_BELOW = 0.1
#: A standard deviation below this share of the mean is rounding.
CONSTANT = 1e-13


def well_medians(
    df: DataFrame, roles: Roles, features: Sequence[str], task_values: int = TASK_VALUES
) -> DataFrame:
    """One row per day, biorep and well with each feature's median after mean imputation."""
    keys = [roles.day, roles.biorep, roles.well]
    filled = impute_mean(df.select(*keys, *[F.col(f"`{f}`") for f in features]), features)
    med = group_quantiles(filled.where(all_present(keys)), keys, features, [0.5], task_values=task_values)
    return med.select(*keys, *[F.get(f"`{f}`", F.lit(0)).alias(f) for f in features])


def pearson_pairs(profiles: DataFrame, features: Sequence[str], tile: int = TILE) -> DataFrame:
    """``feature_a < feature_b, r`` for every pair; NULL where a column is constant or empty. Missing values count as 0.

    Sums of products come by tiles of features and each tile becomes pairs where it was merged: nothing passes the driver.
    """
    names = sorted(features)
    vector = F.array(*[F.coalesce(no_nan(F.col(f"`{f}`").cast("double")), F.lit(0.0)) for f in names])

    def spread(n: float, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
        """Standard deviations, NaN for a column that is constant but for rounding."""
        size = np.sqrt(np.maximum(var, 0.0) / max(n - 1, 1.0))
        return np.where((var > 0) & (size > CONSTANT * np.abs(mean)), np.sqrt(var), np.nan)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples():
                mi, mj, vi, vj = map(np.asarray, (t.mean_i, t.mean_j, t.var_i, t.var_j))
                r = np.asarray(t.scatter).reshape(len(mi), len(mj)) / np.outer(spread(t.n, mi, vi), spread(t.n, mj, vj))
                a, b = np.indices(r.shape)
                a, b, r = a.ravel() + t.ti * tile, b.ravel() + t.tj * tile, r.ravel()
                above = a < b
                if not above.any():
                    continue
                r = pd.Series(np.clip(r[above], -1.0, 1.0))
                yield pd.DataFrame({"feature_a": [names[i] for i in a[above]], "feature_b": [names[i] for i in b[above]], "r": r})

    tiles = moments(profiles.select(vector.alias("v")), "v", tile=tile)
    found = tiles.mapInPandas(pairs, "feature_a string, feature_b string, r double")
    return found.withColumn("r", no_nan(F.col("r")))


def feature_correlation(
    df: DataFrame, roles: Roles, features: Sequence[str] | None = None, task_values: int = TASK_VALUES
) -> DataFrame:
    """Pearson correlation of the well medians for every pair of features.

    ``df`` should be a stored table (it is read for the means, the group sizes and the medians); the
    medians, one row per well, are written once because the matrix takes two passes over them.
    """
    features = list(features or roles.features(df, downstream=True))
    return pearson_pairs(stage(well_medians(df, roles, features, task_values), "well-medians"), features)


def corr_distance(r: str | Column) -> Column:
    """1 - |r|, never negative; 1 where the correlation is undefined."""
    r = F.col(r) if isinstance(r, str) else r
    # greatest skips NULL, so an undefined correlation is told apart first.
    return F.when(r.isNull() | F.isnan(r), F.lit(1.0)).otherwise(F.greatest(F.lit(1.0) - F.abs(r), F.lit(0.0)))


def _average_linkage(names: list[str], dist: np.ndarray, below: float) -> list[list[str]]:
    """Average linkage by chains of nearest neighbours, cut where the mean distance reaches the threshold.

    A chain steps from a cluster to its nearest until two are each other's nearest; those merge, and what is left of
    the chain stays valid. Mean distances never shrink by a merge, so the merges below the threshold are those that
    merging the closest two first would do; the work is quadratic.
    """
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    m = len(names)
    size, chain = np.ones(m), []
    alive = np.ones(m, bool)
    joins: list[tuple[int, int]] = []
    for _ in range(m - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            last = chain[-1]
            near = int(np.argmin(d[last]))
            # Between equals the one before goes first, or the chain would run in circles.
            if len(chain) > 1 and d[last, chain[-2]] <= d[last, near]:
                near = chain[-2]
                break
            chain.append(near)
        i, j = sorted((chain.pop(), chain.pop()))
        if d[i, j] < below:
            joins.append((i, j))
        joined = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
    parent = list(range(m))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in joins:
        parent[top(j)] = top(i)
    members: dict[int, list[str]] = {}
    for i, name in enumerate(names):
        members.setdefault(top(i), []).append(name)
    return sorted(sorted(c) for c in members.values())


def cluster_features(distances: DataFrame, below: float = CLUSTER_BELOW, subset: str = "subset") -> DataFrame:
    """``subset, cluster, features`` by average linkage over ``feature_a, feature_b, distance``.

    Two clusters whose mean distance is below the threshold hold some pair below it, so every cluster lies within a
    connected component of the pairs below the threshold, and merges in one component don't touch another. Components
    are found by joins and linked side by side; a group is one component's pairs. Clusters are numbered by their first
    feature name.
    """

    def clusters(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.feature_a) | set(pdf.feature_b))
        at = {n: i for i, n in enumerate(names)}
        d = np.full((len(names), len(names)), 1.0)
        a, b = pdf.feature_a.map(at).to_numpy(), pdf.feature_b.map(at).to_numpy()
        d[a, b] = d[b, a] = pdf.distance.to_numpy()
        found = _average_linkage(names, d, below)
        return pd.DataFrame({subset: pdf[subset].iloc[0], "features": found})

    if subset not in distances.columns:
        distances = distances.withColumn(subset, F.lit("all"))
    pairs = stage(distances.select(subset, "feature_a", "feature_b", "distance"), "distances")

    def node(feature: str) -> Column:
        return F.struct(F.col(subset).alias("s"), F.col(feature).alias("f"))

    near = pairs.where(F.col("distance") < below).select(node("feature_a").alias("a"), node("feature_b").alias("b"))
    group = connected_components(near).select(F.col("node.s").alias(subset), F.col("node.f").alias("f"), F.col("component.f").alias("g"))
    inside = pairs.join(group.select(subset, F.col("f").alias("feature_a"), F.col("g").alias("_group")), [subset, "feature_a"])
    other = group.select(subset, F.col("f").alias("feature_b"), F.col("g").alias("_other"))
    inside = inside.join(other, [subset, "feature_b"]).where(F.col("_group") == F.col("_other"))
    linked = inside.groupBy(subset, "_group").applyInPandas(clusters, f"{subset} string, features array<string>")
    names = pairs.select(subset, F.col("feature_a").alias("f")).union(pairs.select(subset, "feature_b")).distinct()
    alone = names.join(group, [subset, "f"], "left_anti").select(subset, F.array("f").alias("features"))
    number = F.row_number().over(W.partitionBy(subset).orderBy(F.get("features", F.lit(0)))) - 1
    return linked.unionByName(alone).select(subset, number.alias("cluster"), "features")


def representatives(clusters: DataFrame) -> DataFrame:
    """The first feature of each cluster in name order."""
    return clusters.select(F.array_min("features").alias("feature"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    size = F.size("features")
    return clusters.select("cluster", size.alias("members"), (size > 2).alias("flagged"))


def prune_correlated(
    df: DataFrame, roles: Roles, features: Sequence[str] | None = None, below: float = CLUSTER_BELOW
) -> DataFrame:
    """``feature``: one per group of features that say the same over the wells."""
    pairs = feature_correlation(df, roles, features)
    pairs = pairs.withColumn("distance", corr_distance("r"))
    return representatives(cluster_features(pairs, below))
