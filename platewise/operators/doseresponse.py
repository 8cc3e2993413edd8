"""Dose series, model fits by information criterion, and feature selection from them.

A series has as many points as there are doses, known when the plan is built, so straight lines and
constants are plain expressions in generated code. Curves are fitted in Arrow batches of series
(:mod:`platewise.functions.curves`): the linear parameters are projected out, damped steps from
several starts find slope and midpoint, and nothing bounds these. The residuals can be smaller
than those of a local solver started at one guess.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.curves import fit
from platewise.functions.numeric import natural_log, no_nan
from platewise.roles import Roles
from platewise.session import stage

# Parameters per model.
MODEL_PARAMETERS = {"BC4": 4, "BC5": 5, "LL4": 4, "WB1.4": 4, "Lin": 2, "Con": 1}
CURVES = ("BC4", "BC5", "LL4", "WB1.4")


def fitted_doses(roles: Roles, excluded: Sequence[int] = (2,)) -> list[int]:
    """Concentrations compared with the control, highest first."""
    return [c for c in sorted(roles.concentrations, reverse=True) if c != roles.control and c not in excluded]


def dose_series(emd: DataFrame, roles: Roles, excluded: Sequence[int] = (2,)) -> DataFrame:
    """``Feature, Day, y``: scores against the control in fitted order; incomplete series are absent.

    Population order within a pair does not matter.
    """
    doses = fitted_doses(roles, excluded)
    control = str(roles.control)
    p1, p2 = F.col("Population1"), F.col("Population2")
    other = F.when(p1 == control, p2).when(p2 == control, p1)
    score = F.when(~F.isnan("EMD_score"), F.col("EMD_score"))
    pairs = emd.select("Feature", F.col("Metadata_Day").alias("Day"), other.alias("_dose"), p1, p2, score.alias("_y"))
    ranked = F.struct("Population1", "Population2", "_y")
    got = pairs.where(F.col("_dose").isin([str(c) for c in doses])).groupBy("Feature", "Day").agg(
        *[F.min(F.when(F.col("_dose") == str(c), ranked)).alias(f"_s{i}") for i, c in enumerate(doses)]
    )
    ys = [F.col(f"_s{i}._y") for i in range(len(doses))]
    whole = F.lit(True)
    for y in ys:
        whole = whole & y.isNotNull()
    return got.where(whole).select("Feature", "Day", F.array(*ys).alias("y"))


def _sum(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


# Sums over the points of a series are SQL text: one call per sum instead of one per term.
def _ys(n: int) -> list[str]:
    return [f"y[{i}]" for i in range(n)]


def fit_linear(series: DataFrame, n: int) -> DataFrame:
    """Least-squares line through ``y`` over x = 0..n-1: ``Feature, Day, Slope, Intercept, ssr``."""
    y = _ys(n)
    mid = (n - 1) / 2
    sxx = sum((i - mid) ** 2 for i in range(n))
    slope = _sum([f"{_number(i - mid)} * {y[i]}" for i in range(n)]) + f" / {_number(sxx or 1.0)}"
    got = series.select("*", F.expr(f"{slope} AS Slope"), F.expr(f"{_sum(y)} / {_number(n)} AS _mean"))
    got = got.select("*", F.expr(f"_mean - Slope * {_number(mid)} AS Intercept"))
    ssr = _sum([f"power({y[i]} - (Intercept + Slope * {_number(i)}), 2)" for i in range(n)])
    return got.select("Feature", "Day", "Slope", "Intercept", F.expr(f"{ssr} AS ssr"))


def fit_constant(series: DataFrame, n: int) -> DataFrame:
    y = _ys(n)
    got = series.select("*", F.expr(f"{_sum(y)} / {_number(n)} AS Level"))
    ssr = _sum([f"power({v} - Level, 2)" for v in y])
    return got.select("Feature", "Day", "Level", F.expr(f"{ssr} AS ssr"))


def fit_curves(series: DataFrame, n: int, models: Sequence[str] = CURVES) -> DataFrame:
    """``Feature, Day, Model, b, e, ssr`` of the Brain-Cousens, log-logistic and Weibull curves.

    Residuals of a curve never exceed those of the curves it contains. Where the best curve lies at infinity (a step, a
    power of the dose), b and e are where the steps stopped. A series with a value that is not finite has nulls.
    """
    models = list(models)
    key = series.select("Feature", "Day").schema.simpleString()[len("struct<"):-1]

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                got = fit(np.array(batch["y"].tolist(), dtype=float).reshape(len(batch), n), models)
                for model, (b, e, ssr) in got.items():
                    yield batch[["Feature", "Day"]].assign(Model=model, b=b, e=e, ssr=ssr)

    # A few hundred series fill a task, so the small table is spread over all of the cluster.
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = series.select("Feature", "Day", "y").repartition(parts, "Feature", "Day")
    out = spread.mapInPandas(fitted, key + ", Model: string, b: double, e: double, ssr: double")
    return out.select("Feature", "Day", "Model", *[no_nan(F.col(c)).alias(c) for c in ("b", "e", "ssr")])


def score_models(residuals: DataFrame, n: int) -> DataFrame:
    """``Feature, Day, Model, AIC, BIC, Slope`` from ``ssr`` (and ``Slope`` of the line).

    A perfect fit scores -Infinity.
    """
    k = F.lit(None).cast("int")
    for model, count in MODEL_PARAMETERS.items():
        k = F.when(F.col("Model") == model, count).otherwise(k)
    size = F.lit(float(n))
    fit = size * natural_log(F.col("ssr") / size)
    return residuals.select(
        "Feature", "Day", "Model",
        (fit + 2 * k).alias("AIC"),
        (fit + k * F.lit(math.log(n))).alias("BIC"),
        "Slope",
    )


def fit_models(emd: DataFrame, roles: Roles, excluded: Sequence[int] = (2,)) -> DataFrame:
    """All six models of every complete dose series.

    The series (one row per feature and day) are written once; three fits read them.
    """
    n = len(fitted_doses(roles, excluded))
    series = stage(dose_series(emd, roles, excluded), "dose-series")
    none = F.lit(None).cast("double").alias("Slope")
    curves = fit_curves(series, n).select("Feature", "Day", "Model", "ssr", none)
    line = fit_linear(series, n).select("Feature", "Day", F.lit("Lin").alias("Model"), "ssr", "Slope")
    flat = fit_constant(series, n).select("Feature", "Day", F.lit("Con").alias("Model"), "ssr", none)
    return score_models(curves.unionByName(line).unionByName(flat), n)


def select_features(fits: DataFrame, days: Sequence[str], slope_rule: str = "any") -> DataFrame:
    """Features that rise with dose and that no chosen day explains best by a constant.

    Rising: the line's slope is positive on any chosen day (``slope_rule="all"``: on every day that
    has one). On a day where the constant ties for the best AIC + BIC, the feature is rejected.
    """
    total = F.col("AIC") + F.col("BIC")
    rises = F.col("Slope") > 0
    per_day = (
        fits.where(F.col("Day").isin(list(days)))
        .groupBy("Feature", "Day")
        .agg(
            F.min(F.when(~F.isnan(total), total)).alias("_best"),
            F.min(F.when((F.col("Model") == "Con") & ~F.isnan(total), total)).alias("_flat"),
            F.max(F.when(F.col("Model") == "Lin", F.coalesce(rises, F.lit(False)))).alias("_rises"),
        )
    )
    combine = F.max if slope_rule == "any" else F.min
    got = per_day.groupBy("Feature").agg(
        combine("_rises").alias("_rises"),
        F.max(F.coalesce(F.col("_flat") == F.col("_best"), F.lit(False))).alias("_flat_wins"),
    )
    keep = F.coalesce(F.col("_rises"), F.lit(False)) & ~F.col("_flat_wins")
    return got.where(keep).select("Feature")
