"""Measurement category and organelle of features, from names and a curated lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Organelle of each stain channel and of each measured object, in naming convention.
CHANNEL_ORGANELLES = {"GrayLys": "Lysosomes", "GrayMito": "Mitochondria", "GrayNuclei": "Nuclei"}
OBJECT_ORGANELLES = {
    "RelateLysoCell": "Lysosomes",
    "RelateMitoCell": "Mitochondria",
    "FilteredNuclei": "Nuclei",
    "Cells": "Other",
    "Cytoplasm": "Other",
}
# Labels and order of the cross-tab.
CATEGORY_LABELS = {
    "Counts": "Counts",
    "Number": "Counts",
    "AreaShape": "AreaShape",
    "Granularity": "Granularity",
    "Intensity": "Intensity",
    "RadialDistribution": "Radial Distribution",
    "Texture": "Texture",
    "Correlation": "Other/Correlation",
}
ORGANELLE_LABELS = {
    "Nuclei": "Nuclei (Hoecst)",
    "Lysosomes": "Lysosomes (Quinacrine)",
    "Mitochondria": "Mitochondria (TMRM)",
    "Other": "Other",
}
CATEGORY_COLUMNS = (
    "Counts", "AreaShape", "Granularity", "Intensity", "Radial Distribution", "Texture", "Other/Correlation",
)
ORGANELLE_ROWS = ("Nuclei (Hoecst)", "Lysosomes (Quinacrine)", "Mitochondria (TMRM)", "Other")
FEATURE_PREFIX = "rp_norm_"


def _pick(c: Column, mapping: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in mapping.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def guess_category(feature: str | Column) -> Column:
    f = F.col(feature) if isinstance(feature, str) else feature
    token = F.substring_index(F.substr(f, F.lit(len(FEATURE_PREFIX) + 1)), "_", 1)
    return (
        F.when(f.startswith("counts_"), "Counts")
        .when(f.startswith(FEATURE_PREFIX), F.when(token == "Mean", "Correlation").otherwise(token))
        .otherwise("")
    )


def guess_organelle(feature: str | Column, category: Column) -> Column:
    """The first stain channel in the name, else the last measured object, else blank."""
    f = F.col(feature) if isinstance(feature, str) else feature
    parts = F.split(f, "_")
    channels = F.filter(parts, lambda p: p.isin(list(CHANNEL_ORGANELLES)))
    objects = F.filter(parts, lambda p: p.isin(list(OBJECT_ORGANELLES)))
    channel = _pick(F.get(channels, F.lit(0)), CHANNEL_ORGANELLES)
    measured = _pick(F.get(objects, F.size(objects) - 1), OBJECT_ORGANELLES)
    return F.when(category == "Correlation", "Other").otherwise(F.coalesce(channel, measured, F.lit("")))


def upsert_lookup(lookup: DataFrame, features: DataFrame) -> DataFrame:
    """The lookup with the new ``features`` guessed and added; existing rows win and stay.

    ``added`` marks new rows, ``unresolved`` new rows with a blank category or organelle.
    """
    known = lookup.select("feature", "category", "organelle", F.lit(True).alias("_known"))
    names = features.where((F.col("feature").isNotNull()) & (F.col("feature") != "")).select("feature").distinct()
    merged = known.join(names, "feature", "full")
    added = F.col("_known").isNull()
    category = F.when(added, guess_category("feature")).otherwise(F.col("category"))
    merged = merged.withColumn("category", category).withColumn("added", added)
    organelle = F.when(added, guess_organelle("feature", F.col("category"))).otherwise(F.col("organelle"))
    merged = merged.withColumn("organelle", organelle)
    blank = (F.col("category") == "") | (F.col("organelle") == "")
    return merged.select("feature", "category", "organelle", "added", (added & blank).alias("unresolved"))


def duplicate_names(header: DataFrame) -> DataFrame:
    """Names that occur more than once in a header table ``pos, name``."""
    counted = header.where(F.col("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("times"))
    return counted.where(F.col("times") > 1)


def _placed(selected: DataFrame, lookup: DataFrame) -> DataFrame:
    known = lookup.select("feature", "category", "organelle", F.lit(True).alias("_known"))
    got = selected.join(known, "feature", "left")
    return got.select(
        "*",
        _pick(F.col("category"), CATEGORY_LABELS).alias("_column"),
        _pick(F.col("organelle"), ORGANELLE_LABELS).alias("_row"),
    )


def crosstab(selected: DataFrame, lookup: DataFrame) -> DataFrame:
    """Organelle x category counts of the selected features in display order; zeros are NULL."""
    placed = _placed(selected, lookup).where(F.col("_column").isNotNull() & F.col("_row").isNotNull())
    counted = placed.groupBy("_row").pivot("_column", list(CATEGORY_COLUMNS)).count()
    rows = selected.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(r) for r in ORGANELLE_ROWS])).alias("position", "organelle")
    )
    # At most one row per organelle on either side.
    got = rows.join(counted, F.col("organelle") == F.col("_row"), "left")
    return got.select("position", "organelle", *[F.col(f"`{c}`") for c in CATEGORY_COLUMNS])


def margins(selected: DataFrame, lookup: DataFrame) -> DataFrame:
    """Placed features per category column, and in all (NULL category)."""
    placed = _placed(selected, lookup).where(F.col("_column").isNotNull() & F.col("_row").isNotNull())
    return placed.rollup(F.col("_column").alias("category")).agg(F.count(F.lit(1)).alias("features"))


def unplaced(selected: DataFrame, lookup: DataFrame, table: str = "the lookup") -> DataFrame:
    """Selected features that cannot be counted, with the reason."""
    got = _placed(selected, lookup)

    def why(axis: str, label: str) -> Column:
        c = F.col(axis)
        unknown = F.concat(F.lit(f"{axis} '"), c, F.lit(f"' is not in {axis}_labels"))
        return F.when(F.coalesce(c, F.lit("")) == "", f"{axis} blank").when(F.col(label).isNull(), unknown)

    reasons = F.concat_ws("; ", why("category", "_column"), why("organelle", "_row"))
    reason = F.when(F.col("_known").isNull(), f"not in {table}").otherwise(reasons)
    return got.select("feature", reason.alias("reason")).where(F.col("reason") != "")
