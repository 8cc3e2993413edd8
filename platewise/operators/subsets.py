"""Stratum counts, reproducible capped samples and feature filtering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.numeric import finite
from platewise.roles import Roles

# Leading hex digits of the hash that name a bucket.
BUCKET_DIGITS = 4
# Rows per concentration and day in the concentration view; others get the default.
CONCENTRATION_CAPS = {2: 5000, 3: 7000}
DEFAULT_CAP = 10000
DAY_CAP = 5000
# Features that are always filtered out, and a name fragment that is.
ALWAYS_EXCLUDED = (
    "rp_norm_AreaShape_Compactness_RelateLysoCell",
    "rp_norm_Texture_AngularSecondMoment_GrayLys_3_00_256_RelateLysoCell",
)
EXCLUDED_FRAGMENT = "Number_Object_Number"
MISSING_PERCENT = 30.0


def stratum_counts(df: DataFrame, roles: Roles) -> DataFrame:
    """The six count tables in one pass: ``stratum`` names the table a row belongs to.

    Rows with a missing value in a table's keys do not count in that table.
    """
    d, c, b = roles.day, roles.conc, roles.biorep
    tables = {"day_concentration": (d, c), "day_biorep": (d, b), "concentration_biorep": (c, b),
              "day_concentration_biorep": (d, c, b), "day": (d,), "concentration": (c,)}
    # Set bit = column not part of the grouping set, in the order day, concentration, biorep.
    bits = {d: 4, c: 2, b: 1}
    ids = {sum(v for k, v in bits.items() if k not in keys): name for name, keys in tables.items()}
    grouped = df.groupingSets([[F.col(k) for k in keys] for keys in tables.values()], d, c, b).agg(
        F.count(F.lit(1)).alias("Counts"), F.grouping_id().cast("int").alias("_id")
    )
    name = F.lit(None).cast("string")
    whole = F.lit(False)
    for number, table in ids.items():
        name = F.when(F.col("_id") == number, table).otherwise(name)
        present = F.lit(True)
        for k in tables[table]:
            present = present & F.col(k).isNotNull()
        whole = F.when(F.col("_id") == number, present).otherwise(whole)
    return grouped.where(whole).select(name.alias("stratum"), d, c, b, "Counts")


def _draw(df: DataFrame, strata: Sequence[str], id_col: str, seed: int, cap: Column) -> DataFrame:
    """The ``cap`` rows of each stratum with the smallest md5 of id and seed; ``cap`` depends on the stratum alone.

    Rows are counted per stratum and hash bucket (map-side), so each stratum's last bucket is known before any row
    moves: lower buckets stay as a whole, and only the rows of the last one are put in order.
    """
    strata = list(strata)
    draw = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    pool = df.withColumn("_draw", draw).withColumn("_bucket", F.substring("_draw", 1, BUCKET_DIGITS))
    counts = pool.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*strata).orderBy("_bucket"))
    counts = counts.withColumn("_upto", upto).withColumn("_cap", cap).where((F.col("_upto") - F.col("_n") < F.col("_cap")) & (F.col("_upto") >= F.col("_cap")))
    edges = counts.select(*strata, F.col("_bucket").alias("_edge"), (F.col("_cap") - F.col("_upto") + F.col("_n")).alias("_left"))
    # One row per stratum; a stratum below its cap has no edge and stays whole, one with a cap of 0 goes.
    near = pool.where(cap > 0).join(edges, strata, "left").where(F.col("_edge").isNull() | (F.col("_bucket") <= F.col("_edge")))
    sure = near.where(F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge")))
    at = F.row_number().over(W.partitionBy(*strata).orderBy("_draw", id_col))
    last = near.where(F.col("_bucket") == F.col("_edge")).withColumn("_at", at).where(F.col("_at") <= F.col("_left"))
    return sure.select(*df.columns).unionByName(last.select(*df.columns))


def _in_design(df: DataFrame, roles: Roles, exclude: Sequence[int]) -> DataFrame:
    doses = [c for c in roles.concentrations if c not in set(exclude)]
    return df.where(F.upper(F.col(roles.day)).isin(list(roles.days)) & F.col(roles.conc).isin(doses))


def sample_capped(
    df: DataFrame, roles: Roles, cap: int = DAY_CAP, exclude: Sequence[int] = (), seed: int = 1
) -> DataFrame:
    """At most ``cap`` rows of every day and concentration, the same rows on every run."""
    return _draw(_in_design(df, roles, exclude), [roles.day, roles.conc], roles.cell, seed, F.lit(cap))


def sample_by_cap(
    df: DataFrame,
    roles: Roles,
    caps: Mapping[int, int] = CONCENTRATION_CAPS,
    default: int = DEFAULT_CAP,
    seed: int = 1,
) -> DataFrame:
    """As ``sample_capped`` with a cap per concentration."""
    cap = F.lit(default)
    for dose, n in caps.items():
        cap = F.when(F.col(roles.conc) == dose, n).otherwise(cap)
    return _draw(_in_design(df, roles, ()), [roles.day, roles.conc], roles.cell, seed, cap)


def sample_equal(df: DataFrame, roles: Roles, exclude: Sequence[int] = (), seed: int = 1) -> DataFrame:
    """As many rows of every concentration as the day's rarest one has.

    The stratum sizes (days x concentrations, from a key-only scan) come to the driver first.
    """
    kept = _in_design(df, roles, exclude)
    sizes = kept.groupBy(roles.day, roles.conc).count().collect()
    smallest: dict[str, int] = {}
    for day, _, n in sizes:
        smallest[day] = min(n, smallest.get(day, n))
    if not smallest:
        return kept
    cap = F.lit(0)
    for day, n in smallest.items():
        cap = F.when(F.col(roles.day) == day, n).otherwise(cap)
    return _draw(kept, [roles.day, roles.conc], roles.cell, seed, cap)


def filter_report(
    df: DataFrame,
    features: Sequence[str],
    excluded: Sequence[str] = ALWAYS_EXCLUDED,
    missing_percent: float = MISSING_PERCENT,
) -> DataFrame:
    """One row per feature: percent missing, and which reasons remove it.

    Infinite values are present for the missing share and absent for the variance; zero variance
    means at least two values, all equal.
    """
    features = list(features)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for f in features:
        v = F.col(f"`{f}`").cast("double")
        aggs += [
            F.count(F.when(~F.isnan(v), v)).alias(f"_p_{f}"),
            F.count(finite(v)).alias(f"_k_{f}"),
            F.min(finite(v)).alias(f"_lo_{f}"),
            F.max(finite(v)).alias(f"_hi_{f}"),
        ]
    rows = []
    for f in features:
        missing = F.lit(100.0) * F.try_divide(F.col("_rows") - F.col(f"`_p_{f}`"), F.col("_rows"))
        rows.append(
            F.struct(
                F.lit(f).alias("feature"),
                missing.alias("missing_percent"),
                F.coalesce(missing >= missing_percent, F.lit(False)).alias("too_missing"),
                F.coalesce(
                    (F.col(f"`_k_{f}`") >= 2) & (F.col(f"`_lo_{f}`") == F.col(f"`_hi_{f}`")), F.lit(False)
                ).alias("zero_variance"),
                F.lit(EXCLUDED_FRAGMENT in f).alias("object_number"),
                F.lit(f in excluded).alias("excluded"),
            )
        )
    report = df.agg(*aggs).select(F.inline(F.array(*rows)))
    gone = F.col("too_missing") | F.col("zero_variance") | F.col("object_number") | F.col("excluded")
    return report.withColumn("removed", gone)


def filter_summary(report: DataFrame) -> DataFrame:
    """Features removed in all and per reason; a feature counts under each of its reasons."""
    reasons = ("removed", "too_missing", "zero_variance", "object_number", "excluded")
    return report.agg(
        F.count(F.lit(1)).alias("features"),
        *[F.count_if(F.col(r)).alias(r) for r in reasons],
    )


def filter_features(df: DataFrame, roles: Roles, excluded: Sequence[str] = ALWAYS_EXCLUDED) -> DataFrame:
    """``df`` without the features its own report removes."""
    report = filter_report(df, roles.features(df, downstream=True), excluded)
    # One name per feature at most comes to the driver, to choose columns.
    gone = [r["feature"] for r in report.where("removed").select("feature").collect()]
    return df.drop(*gone)


