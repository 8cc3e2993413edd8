"""Distances between whole populations: MMD, Mahalanobis and mean EMD, for all subsets (days) at once.

Kernel means need every pair of vectors. Pairs are never rows: distinct vectors are dealt into hashed blocks, each pair
of blocks meets once in one task, and only its sum leaves the task. With N vectors there are about sqrt(N / BLOCK_ROWS)
blocks, so a vector is copied to that many tasks, not to N / BLOCK_ROWS, until a task would hold more than ``TILE_ROWS``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.numeric import sanitize
from platewise.operators.emd import emd_pairs
from platewise.operators.moments import moments, whole_scatter
from platewise.operators.ordered import long_form
from platewise.operators.scaling import impute_group_mean, min_max, sanitize_columns
from platewise.roles import Roles
from platewise.session import stage

GAMMA = 0.24
RIDGE = 1e-6
BLOCK_ROWS = 2048
#: Vectors of one side that a task holds at most.
TILE_ROWS = 1 << 17


def vector_of(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features])


def _blocks(distinct: Column, block_rows: int) -> Column:
    tiles = F.ceil(F.sqrt(F.ceil(distinct / block_rows)))
    return F.greatest(tiles, F.ceil(distinct / TILE_ROWS)).cast("int")


def _kernel_sum(by: Sequence[str], gamma: float):
    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side != 2], pdf[pdf.side != 1]
        out = 0.0
        if len(left) and len(right):
            a, b = np.stack(left.v.to_numpy()), np.stack(right.v.to_numpy())
            wa, wb = left.n.to_numpy(float), right.n.to_numpy(float)
            aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
            for i in range(0, len(a), 256):
                for j in range(0, len(b), 4096):
                    d2 = aa[i : i + 256, None] + bb[None, j : j + 4096] - 2.0 * a[i : i + 256] @ b[j : j + 4096].T
                    out += float(wa[i : i + 256] @ np.exp(-gamma * np.maximum(d2, 0.0)) @ wb[j : j + 4096])
        first = pdf.iloc[0]
        twice = 2.0 if first.ga == first.gb and first.ba != first.bb else 1.0
        return pd.DataFrame({**{c: [first[c]] for c in by}, "ga": [first.ga], "gb": [first.gb], "total": [out * twice]})

    return total


def kernel_blocks(
    df: DataFrame, group: str, control, others: Sequence, vec: str, by: Sequence[str], block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors, one row per meeting of their block with another, and the size of every population.

    ``by, v, n, ga, gb, ba, bb, side``: block ``ba`` of population ``ga`` meets block ``bb`` of ``gb``, this vector on the
    left (1), the right (2) or both (0). A population meets itself and the control; subsets without control have no rows.
    """
    by, kind = list(by), df.schema[group].dataType
    rows = df.where(F.col(group).isin([control, *others])).groupBy(*by, group, F.col(vec).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows, "distinct-vectors")
    # One row per subset and population, then one per subset.
    sizes = rows.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_distinct"), F.sum("n").cast("double").alias("_size"))
    sizes = stage(sizes.withColumn("_blocks", _blocks(F.col("_distinct"), block_rows)), "population-sizes")
    against = F.when(F.col(group) != F.lit(control), F.struct(F.col(group).alias("g"), F.col("_blocks").alias("blocks")))
    subsets = sizes.groupBy(*by).agg(
        F.max(F.when(F.col(group) == F.lit(control), F.col("_blocks"))).alias("_control"), F.collect_list(against).alias("_others")
    ).where(F.col("_control").isNotNull())
    dealt = rows.join(sizes.select(*by, group, "_blocks"), [*by, group])
    dealt = dealt.join(subsets, by)
    me, my = F.col(group), F.pmod(F.xxhash64("v"), F.col("_blocks")).cast("int")

    def meeting(ga, gb, ba, bb, side) -> Column:
        return F.struct(
            ga.cast(kind).alias("ga"), gb.cast(kind).alias("gb"),
            ba.cast("int").alias("ba"), bb.cast("int").alias("bb"), side.cast("int").alias("side"),
        )

    # Within a population block i meets every block j once; side 0 is a block that meets itself.
    def own_block(j: Column) -> Column:
        mine = F.col("_my")
        side = F.when(j == mine, 0).when(mine < j, 1).otherwise(2)
        return meeting(me, me, F.least(mine, j), F.greatest(mine, j), side)

    def numbers(count: Column) -> Column:
        return F.sequence(F.lit(0), count - 1)

    within = F.transform(numbers(F.col("_blocks")), own_block)
    as_control = F.flatten(F.transform(
        "_others", lambda o: F.transform(numbers(o["blocks"]), lambda j: meeting(F.lit(control), o["g"], F.col("_my"), j, F.lit(1)))
    ))
    as_other = F.transform(numbers(F.col("_control")), lambda i: meeting(F.lit(control), me, i, F.col("_my"), F.lit(2)))
    meetings = F.concat(within, F.when(me == F.lit(control), as_control).otherwise(as_other))
    return dealt.withColumn("_my", my).select(*by, "v", "n", F.inline(meetings)), sizes.select(*by, group, "_size")


def mmd(
    df: DataFrame, group: str, control, others: Sequence, vec: str = "v", gamma: float = GAMMA,
    block_rows: int = BLOCK_ROWS, by: Sequence[str] = (),
) -> DataFrame:
    """``by, Group_A, Group_B, MMD_Score``: biased squared MMD with an RBF kernel, control against each, per subset.

    The control's own kernel mean is computed once per subset. ``group`` is a numeric level column.
    """
    if not by:
        whole = mmd(df.withColumn("_subset", F.lit(0)), group, control, others, vec, gamma, block_rows, ["_subset"])
        return whole.drop("_subset")
    by, name = list(by), df.schema[group].dataType.simpleString()
    spread, sizes = kernel_blocks(df, group, control, others, vec, by, block_rows)
    typed = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    sums = spread.groupBy(*by, "ga", "gb", "ba", "bb").applyInPandas(_kernel_sum(by, gamma), f"{typed}ga {name}, gb {name}, total double")
    sums = sums.groupBy(*by, "ga", "gb").agg(F.sum("total").alias("total"))
    # From here on one row per subset and pair of populations.
    size_a = sizes.select(*by, F.col(group).alias("ga"), F.col("_size").alias("_sa"))
    size_b = sizes.select(*by, F.col(group).alias("gb"), F.col("_size").alias("_sb"))
    means = stage(sums.join(size_a, [*by, "ga"]).join(size_b, [*by, "gb"]).withColumn("m", F.col("total") / (F.col("_sa") * F.col("_sb"))), "kernel-means")
    own = means.where(F.col("ga") == F.col("gb"))
    cross = means.where((F.col("ga") == F.lit(control)) & (F.col("gb") != F.lit(control))).select(*by, "ga", "gb", F.col("m").alias("_cross"))
    mine = own.select(*by, "ga", F.col("m").alias("_mine"))
    theirs = own.select(*by, "gb", F.col("m").alias("_theirs"))
    joined = cross.join(mine, [*by, "ga"]).join(theirs, [*by, "gb"])
    return joined.select(
        *by, F.col("ga").alias("Group_A"), F.col("gb").alias("Group_B"),
        (F.col("_mine") + F.col("_theirs") - 2 * F.col("_cross")).alias("MMD_Score"),
    )


def _inverse(cov: np.ndarray, pivot: float = 1e-12) -> np.ndarray:
    """Inverse of a covariance; a ridge is added when it is singular to working precision."""
    scale = max(float(np.trace(cov)) / max(len(cov), 1), np.finfo(float).tiny)
    if not np.all(np.isfinite(cov)) or np.linalg.eigvalsh(cov)[0] <= pivot * scale:
        cov = cov + np.eye(len(cov)) * RIDGE
    return np.linalg.inv(cov)


def mahalanobis(df: DataFrame, group: str, control, others: Sequence, vec: str = "v", by: Sequence[str] = (), used: dict | None = None) -> DataFrame:
    """``by, Group_A, Group_B, Mahalanobis_Score``: mean distance of each group's rows from the control, per subset.

    Mean and covariance (ddof 1) come from one grouped aggregate; a features x features matrix per subset reaches the
    driver. A control of fewer than two rows has no covariance: then there are no rows. ``used`` maps a subset's key to
    the positions of the vector that count there (default: all).
    """
    if not by:
        return mahalanobis(df.withColumn("_subset", F.lit(0)), group, control, others, vec, ["_subset"]).drop("_subset")
    by, kind = list(by), df.schema[group].dataType
    reference = {}
    tiles: dict[tuple, list] = {}
    for r in moments(df.where(F.col(group) == F.lit(control)), vec, by).where("n >= 2").collect():
        tiles.setdefault(tuple(r[c] for c in by), []).append(r)
    for key, own in tiles.items():
        mean, scatter = whole_scatter(own)
        at = (used or {}).get(key, list(range(len(mean))))
        reference[repr(key)] = (at, mean[at], _inverse(scatter[np.ix_(at, at)] / (own[0]["n"] - 1)))
    if not reference:
        fields = [*[df.schema[c] for c in by], T.StructField("Group_A", kind), T.StructField("Group_B", kind), T.StructField("Mahalanobis_Score", T.DoubleType())]
        return df.sparkSession.createDataFrame([], T.StructType(fields))

    @F.pandas_udf("double")
    def distances(v: pd.Series, keys: pd.DataFrame) -> pd.Series:
        out = np.full(len(v), np.nan)
        named = [repr(k) for k in keys.itertuples(index=False, name=None)]
        for key, (at, mean, inv) in reference.items():
            rows = np.flatnonzero([k == key for k in named])
            if len(rows):
                off = np.stack(v.to_numpy()[rows])[:, at] - mean
                out[rows] = np.sqrt(np.maximum(((off @ inv) * off).sum(axis=1), 0.0))
        return pd.Series(out)

    each = df.where(F.col(group).isin(list(others)))
    each = each.select(*by, F.col(group).alias("Group_B"), distances(vec, F.struct(*by)).alias("_d"))
    scored = each.where(~F.isnan("_d")).groupBy(*by, "Group_B").agg(F.avg("_d").alias("Mahalanobis_Score"))
    return scored.select(*by, F.lit(control).cast(kind).alias("Group_A"), "Group_B", "Mahalanobis_Score")


def mean_emd(
    df: DataFrame, group: str, control, others: Sequence, features: Sequence[str], ranges: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """``by, Group_A, Group_B, EMD_Score``: EMD against the control averaged over the features that have values, per subset."""
    by, levels = list(by), [control, *others]
    long = long_form(df.where(F.col(group).isin(levels)), [*by, group], features)
    pairs = [(0, i) for i in range(1, len(levels))]
    got = emd_pairs(long, [*by, "feature"], group, levels, pairs, ranges)
    kind = df.schema[group].dataType
    other = F.get(F.array(*[F.lit(v).cast(kind) for v in levels]), F.col("second"))
    return (
        got.select(*by, other.alias("Group_B"), "EMD_score")
        .groupBy(*by, "Group_B")
        .agg(F.avg("EMD_score").alias("EMD_Score"))
        .select(*by, F.lit(control).cast(kind).alias("Group_A"), "Group_B", "EMD_Score")
    )


def prepare_population(df: DataFrame, group: str, levels: Sequence, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Sanitize, fill by group mean, drop features still incomplete, rescale to [0, 1]."""
    clean = sanitize_columns(df.where(F.col(group).isin(list(levels))), features)
    filled, complete = impute_group_mean(clean, group, levels, features)
    filled = sanitize_columns(filled, complete)
    if not complete:
        raise ValueError("every feature has missing values in some group")
    return min_max(filled.drop(*[f for f in features if f not in complete]), complete), complete


def prepare_populations(
    df: DataFrame, subset: str, subsets: Sequence, group: str, levels: Sequence, features: Sequence[str]
) -> tuple[DataFrame, dict]:
    """``prepare_population`` of every subset in the same passes; also the features that are complete, per subset.

    Features that stay incomplete in a subset are NULL there. Means have one row per subset and level of the design, ends
    one per subset; both are joined by key.
    """
    features = list(features)
    rows = df.where(F.col(subset).isin(list(subsets)) & F.col(group).isin(list(levels)))
    value = {f: sanitize(F.col(f"`{f}`").cast("double")) for f in features}
    clean = rows.select(subset, group, *[v.alias(f) for f, v in value.items()])
    means = clean.groupBy(subset, group).agg(*[F.avg(f"`{f}`").alias(f"_m{i}") for i, f in enumerate(features)])
    means = stage(means, "population-means")
    filled = clean.join(means, [subset, group]).select(
        subset, group, *[sanitize(F.coalesce(F.col(f"`{f}`"), F.col(f"_m{i}"))).alias(f) for i, f in enumerate(features)]
    )
    ends = filled.groupBy(subset).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[g(f"`{f}`").alias(f"_{g.__name__}{i}") for i, f in enumerate(features) for g in (F.min, F.max, F.count)],
    )
    ends = stage(ends, "population-ends")
    scaled = []
    for i, f in enumerate(features):
        lo, hi = F.col(f"_min{i}"), F.col(f"_max{i}")
        v = F.when(hi > lo, (F.col(f"`{f}`") - lo) / (hi - lo)).otherwise(F.lit(0.0))
        scaled.append(F.when(F.col(f"_count{i}") == F.col("_rows"), v).alias(f))
    complete = {
        r[subset]: [f for i, f in enumerate(features) if r[f"_count{i}"] == r["_rows"]] for r in ends.collect()
    }
    return filled.join(ends, subset).select(subset, group, *scaled), complete


def population_distances(
    df: DataFrame,
    roles: Roles,
    condition: str,
    features: Sequence[str] | None = None,
    gamma: float = GAMMA,
    block_rows: int = BLOCK_ROWS,
    ranges: int | None = None,
) -> DataFrame:
    """The three scores of one subset, control against every other concentration; ``condition`` labels it (its day)."""
    rows = df.withColumn(roles.day, F.lit(condition))
    return _distances(rows, roles, [condition], features, gamma, block_rows, ranges)


def distances_by_day(df: DataFrame, roles: Roles, features: Sequence[str] | None = None) -> DataFrame:
    """The three scores of every day of the design, all days side by side in the same jobs."""
    return _distances(df, roles, list(roles.days), features, GAMMA, BLOCK_ROWS, None)


def _distances(df, roles: Roles, days: Sequence[str], features, gamma: float, block_rows: int, ranges: int | None) -> DataFrame:
    """A pair that lacks one score has NULL there; a day without control has no rows.

    The prepared features are stored once, because every score reads them.
    """
    features, day = list(features or roles.features(df, downstream=True)), roles.day
    others = [c for c in sorted(roles.concentrations, reverse=True) if c != roles.control]
    ready, used = prepare_populations(df, day, days, roles.conc, [roles.control, *others], features)
    if used and not any(used.values()):
        raise ValueError("every feature has missing values in some group")
    ready = stage(ready, "population")
    # What doesn't count on a day is 0 in all its vectors and so adds nothing to a distance.
    vectors = ready.select(day, roles.conc, F.array(*[F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) for f in features]).alias("v"))
    at = {(d,): [features.index(f) for f in kept] for d, kept in used.items()}
    keys, by = [day, "Group_A", "Group_B"], [day]
    got = (
        mmd(vectors, roles.conc, roles.control, others, "v", gamma, block_rows, by)
        .join(mahalanobis(vectors, roles.conc, roles.control, others, "v", by, at), keys, "full")
        .join(mean_emd(ready, roles.conc, roles.control, others, features, ranges, by), keys, "full")
    )
    return got.select("Group_A", "Group_B", "MMD_Score", "Mahalanobis_Score", "EMD_Score", F.col(day).alias("Condition"))
