"""Earth mover's distance between populations, and what is read off it."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.operators.ordered import long_form, running_totals
from platewise.operators.standardize import trim_wells
from platewise.roles import Roles

INACTIVE_BELOW = 0.05
NOISY_QUANTILE = 0.75
LOG_PANEL_ABOVE = 7.0


def emd_pairs(
    long: DataFrame,
    by: Sequence[str],
    population: str,
    populations: Sequence,
    pairs: Sequence[tuple[int, int]] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """1-D Wasserstein distance for pairs of populations within ``by``, all from one ordering.

    ``long`` holds ``by``, ``population`` and ``value``; ``by`` includes ``feature``. ``pairs`` are
    index pairs into ``populations`` (default: all, in list order). Output is ``by``, ``first``,
    ``second`` (indexes), ``Count1``, ``Count2``, ``EMD_score``; a pair with an empty side is absent.
    """
    by = list(by)
    pairs = list(pairs if pairs is not None else combinations(range(len(populations)), 2))
    used = sorted({i for pair in pairs for i in pair})
    counted = (
        long.where(F.col(population).isin([populations[i] for i in used]))
        .groupBy(*by, population, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    member = {
        f"p{i}": F.when(F.col(population) == F.lit(populations[i]), F.col("n")).otherwise(F.lit(0))
        for i in used
    }
    steps = running_totals(counted, by, "value", member, ranges=ranges)
    # Many small expressions: written as SQL text, which costs one call each instead of one per node.
    shares = [f"try_divide(p{i}_upto, p{i}_total) AS _f{i}" for i in used]
    totals = [f"p{i}_total" for i in used]
    steps = steps.selectExpr(*[f"`{c}`" for c in by], "next_value - value AS _dx", *shares, *totals)
    area = steps.groupBy(*by).agg(
        *[F.expr(f"max(p{i}_total) AS _n{i}") for i in used],
        *[F.expr(f"sum(abs(_f{i} - _f{j}) * _dx) AS _d{i}_{j}") for i, j in pairs],
    )
    rows = ", ".join(
        f"named_struct('first', {i}, 'second', {j}, 'Count1', _n{i}, 'Count2', _n{j}, "
        f"'EMD_score', coalesce(_d{i}_{j}, 0.0D))"
        for i, j in pairs
    )
    scored = area.selectExpr(*[f"`{c}`" for c in by], f"inline(array({rows}))")
    return scored.where((F.col("Count1") > 0) & (F.col("Count2") > 0))


def _named(index: str, names: Sequence) -> Column:
    return F.get(F.array(*[F.lit(str(n)) for n in names]), F.col(index))


def emd_controls(
    df: DataFrame,
    roles: Roles,
    lower: float = 2.5,
    upper: float = 97.5,
    features: Sequence[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Distances among the control populations of a day's bioreps, each well trimmed first.

    ``df`` is standardized but not trimmed.
    """
    features = list(features or roles.features(df, downstream=True))
    control = df.where(
        (F.col(roles.conc) == roles.control)
        & F.col(roles.day).isin(list(roles.days))
        & F.col(roles.biorep).isin(list(roles.bioreps))
    )
    trimmed = trim_wells(control, roles, lower, upper, features)
    long = long_form(trimmed, [roles.day, roles.biorep], features)
    got = emd_pairs(long, [roles.day, "feature"], roles.biorep, roles.bioreps, ranges=ranges)
    first, second = _named("first", roles.bioreps), _named("second", roles.bioreps)
    for day, there in roles.day_bioreps.items():
        both = first.isin(list(there)) & second.isin(list(there))
        got = got.where((F.col(roles.day) != day) | both)
    tail = F.concat(F.lit("_"), F.col(roles.day), F.lit(f"_{roles.control}"))
    return got.select(
        F.col("feature").alias("Feature"),
        F.concat(first, tail).alias("Population1"),
        F.concat(second, tail).alias("Population2"),
        F.lit(str(roles.control)).alias("Concentration"),
        F.col(roles.day).alias("Metadata_Day"),
        "Count1", "Count2", "EMD_score",
    )


def emd_concentrations(
    df: DataFrame, roles: Roles, features: Sequence[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """Distances of every pair of concentrations per day over a trimmed table, bioreps together."""
    features = list(features or roles.features(df, downstream=True))
    doses = list(roles.concentrations)
    kept = df.where(F.col(roles.day).isin(list(roles.days)))
    long = long_form(kept, [roles.day, roles.conc], features)
    got = emd_pairs(long, [roles.day, "feature"], roles.conc, doses, ranges=ranges)
    first, second = _named("first", doses), _named("second", doses)
    return got.select(
        F.col("feature").alias("Feature"),
        first.alias("Population1"),
        second.alias("Population2"),
        F.concat(first, F.lit("_vs_"), second).alias("Concentration"),
        F.col(roles.day).alias("Metadata_Day"),
        "Count1", "Count2", "EMD_score",
    )


def against_control(emd: DataFrame, roles: Roles) -> DataFrame:
    """The rows of a concentration score table that compare a dose with the control."""
    labels = [f"{c}_vs_{roles.control}" for c in roles.concentrations if c != roles.control]
    return emd.where(F.col("Concentration").isin(labels))


def rank_features(emd: DataFrame) -> DataFrame:
    """Features by ascending median score; ``position`` starts at 0, ties by name."""
    medians = emd.groupBy("Feature").agg(F.median("EMD_score").alias("median_emd"))
    # One row per feature.
    place = F.row_number().over(W.orderBy("median_emd", "Feature")) - 1
    return medians.select("Feature", "median_emd", place.alias("position"))


def score_panels(emd: DataFrame) -> DataFrame:
    """Every score with the position of its feature and the axis it is shown on."""
    panel = F.when(F.col("EMD_score") > LOG_PANEL_ABOVE, "log").otherwise("linear")
    return emd.join(rank_features(emd), "Feature").withColumn("panel", panel)


def _control_means(control: DataFrame) -> DataFrame:
    means = control.groupBy("Feature").agg(F.avg("EMD_score").alias("control_mean"))
    threshold = means.agg(F.percentile("control_mean", F.lit(NOISY_QUANTILE)).alias("t")).scalar()
    return means.withColumn("threshold", threshold)


def classify_features(treatment: DataFrame, control: DataFrame) -> DataFrame:
    """``noisy``, ``inactive`` or ``normal`` per feature, and whether it is selected.

    Noisy: mean control score above the 75th percentile over features. Inactive: no treatment
    score reaches 0.05 (also when there is none). Selected: not noisy and some score does.
    """
    active = treatment.groupBy("Feature").agg(
        F.max(F.col("EMD_score") >= INACTIVE_BELOW).alias("active")
    )
    got = _control_means(control).join(active, "Feature", "left")
    noisy = F.col("control_mean") > F.col("threshold")
    live = F.coalesce(F.col("active"), F.lit(False))
    return got.select(
        "Feature",
        "control_mean",
        "threshold",
        F.when(noisy, "noisy").when(~live, "inactive").otherwise("normal").alias("class"),
        (~noisy & live).alias("selected"),
    )


def select_high_low(treatment: DataFrame, control: DataFrame) -> DataFrame:
    return classify_features(treatment, control).where("selected").select("Feature")
