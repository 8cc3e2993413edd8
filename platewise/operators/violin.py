"""Per-dose distribution statistics, rank test and mean-difference flags of each feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.numeric import chi2_tail
from platewise.operators.ordered import TASK_VALUES, group_quantiles, running_totals

MEAN_DIFFERENCE = 0.3
SIGNIFICANT = 0.05


def group_stats(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], task_values: int = TASK_VALUES
) -> DataFrame:
    """``keys, feature, n, median, mean`` over the non-missing values (sanitize them first)."""
    keys, features = list(keys), list(features)
    extra = []
    for f in features:
        extra += [F.count(f"`{f}`").alias(f"_n_{f}"), F.avg(f"`{f}`").alias(f"_a_{f}")]
    wide = group_quantiles(df, keys, features, [0.5], extra, task_values)
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"`_n_{f}`").alias("n"),
            F.get(f"`{f}`", F.lit(0)).alias("median"),
            F.col(f"`_a_{f}`").alias("mean"),
        )
        for f in features
    ]
    return wide.select(*keys, F.inline(F.array(*rows))).where(F.col("n") > 0)


def kruskal(long: DataFrame, by: Sequence[str], group: str, ranges: int | None = None) -> DataFrame:
    """Kruskal-Wallis test of ``value`` across ``group`` levels within ``by``, corrected for ties.

    Levels with a single distinct value do not take part; at least two must remain. There may be any
    number of levels. Output: ``by, groups, n, h, p, significant``.
    """
    by = list(by)
    counted = long.groupBy(*by, group, "value").agg(F.count(F.lit(1)).alias("n"))
    varied = (
        counted.groupBy(*by, group)
        .agg((F.min("value") < F.max("value")).alias("_varies"))
        .where("_varies")
        .select(*by, group)
    )
    taking_part = counted.join(varied, [*by, group], "left_semi")
    ranked = running_totals(taking_part, by, "value", {"n": F.col("n")}, ranges=ranges, ties=True)
    mean_rank = F.col("n_upto") - (F.col("n_ties") - 1) / 2
    squares = F.col("n_ties").cast("double") * F.col("n_ties") - 1
    per_level = ranked.groupBy(*by, group).agg(
        F.sum("n").alias("_ng"),
        F.sum(F.col("n") * mean_rank).alias("_ranks"),
        F.sum(F.col("n") * squares).alias("_ties"),
    )
    # H from deviations of the mean ranks: the same statistic with less cancellation.
    total = per_level.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("_ng").alias("n"),
        F.sum("_ties").alias("_ties"),
    )
    size = F.col("n").cast("double")
    off = F.col("_ranks") / F.col("_ng") - (size + 1) / 2
    spread = per_level.drop("_ties").join(total, by).groupBy(*by).agg(F.sum(F.col("_ng") * off * off).alias("_spread"))
    total = total.join(spread, by)
    plain = F.lit(12.0) * F.col("_spread") / (size * (size + 1))
    fixed = F.lit(1.0) - F.try_divide(F.col("_ties"), size * size * size - size)
    out = total.where(F.col("groups") >= 2).withColumn("h", F.try_divide(plain, fixed))
    out = out.withColumn("p", chi2_tail(F.col("h"), (F.col("groups") - 1).cast("double")))
    return out.select(*by, "groups", "n", "h", "p", (F.col("p") < SIGNIFICANT).alias("significant"))


def mean_difference_flags(
    stats: DataFrame, by: Sequence[str], group: str, tested: DataFrame, threshold: float = MEAN_DIFFERENCE
) -> DataFrame:
    """Which panels and which groups stand out by their mean.

    ``mean_flag``: for some ordered pair of means |a - b| / b exceeds the threshold, with the sign
    of b kept. ``star`` per group: the same with |b|, only where the panel is flagged. Only panels
    in ``tested`` (where the rank test ran) can be flagged.
    """
    by = list(by)
    panel = stats.groupBy(*by).agg(F.collect_list("mean").alias("_means"))

    def apart(a, b, scale):
        return (b != a) & (b != 0) & (F.try_divide(F.abs(a - b), scale) > threshold)

    flagged = F.exists("_means", lambda a: F.exists("_means", lambda b: apart(a, b, b)))
    ran = tested.select(*by, F.lit(True).alias("_ran"))
    panel = panel.join(ran, by, "left").select(
        *by, "_means", F.coalesce(F.col("_ran") & flagged, F.lit(False)).alias("mean_flag")
    )
    # One row per panel on the right, one per panel and group on the left.
    got = stats.join(panel, by)
    star = F.col("mean_flag") & F.exists("_means", lambda b: apart(F.col("mean"), b, F.abs(b)))
    return got.select(*by, group, "n", "median", "mean", "mean_flag", star.alias("star"))
