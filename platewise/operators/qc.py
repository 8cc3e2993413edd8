"""Image manifest quality control: tags, removal list, keep/remove split, work ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag columns as the tagging tool writes them (two spaces).
TAG_COLUMNS = ("Artefacts  Image Count", "Empty  Image Count", "Oversaturated  Image Count")
# Manifest columns a tag table may repeat.
TAG_TABLE_REPEATS = ("Image_Metadata_Biorep", "Image_Metadata_Well", "Total Image Count")
FILE_COLUMNS = ("Image_FileName_Lys", "Image_FileName_Mito", "Image_FileName_Nuclei")


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without quotes and line breaks."""
    return df.toDF(*[c.replace('"', "").replace("\n", " ").strip() for c in df.columns])


def attach_tags(
    manifest: DataFrame,
    tags: Sequence[DataFrame],
    key: str = "ImageNumber",
    repeats: Sequence[str] = TAG_TABLE_REPEATS,
) -> DataFrame:
    """The manifest once per tag table, each copy left-joined with that table's tags."""
    flagged = []
    for tag in tags:
        tag = clean_names(tag)
        tag = tag.drop(*[c for c in repeats if c in tag.columns]).where(F.col(key).isNotNull())
        flagged.append(manifest.join(tag, key, "left"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flagged)


def removal_list(
    flagged: DataFrame,
    flags: Sequence[str] = TAG_COLUMNS,
    files: Sequence[str] = FILE_COLUMNS,
) -> DataFrame | None:
    """Distinct file names of images with any flag equal to 1, or None unless all flags exist."""
    if any(f not in flagged.columns for f in flags):
        return None
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"`{f}`") == 1, F.lit(False)) for f in flags))
    names = F.array(*[F.col(f"`{f}`") for f in files])
    return flagged.where(hit).select(F.explode(names).alias("remove")).distinct()


def split_manifest(
    files: DataFrame, removal: DataFrame, name: str = "file", listed: str = "remove"
) -> DataFrame:
    """``file, status``: ``removed`` / ``kept`` for existing files, ``missing`` for listed ones not found."""
    gone = removal.select(F.col(listed).alias(name)).where(F.col(name).isNotNull()).distinct().withColumn("_listed", F.lit(True))
    have = files.select(name).withColumn("_there", F.lit(True))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_listed"), "removed").otherwise("kept")
    return have.join(gone, name, "full").select(name, status.alias("status"))


def image_ranges(files: DataFrame, instances: int = 20, files_per_image: int = 3) -> DataFrame:
    """First and last image of each of ``instances`` contiguous ranges; the last takes the rest.

    With fewer images than instances every range but the last is empty (first 1, last 0).
    """
    counted = files.agg(F.floor(F.count(F.lit(1)) / files_per_image).cast("bigint").alias("images"))
    i = F.col("instance")
    per = F.floor(F.col("images") / instances).cast("bigint")
    numbers = F.sequence(F.lit(1), F.lit(instances)).cast("array<bigint>")
    return counted.select("images", F.explode(numbers).alias("instance")).select(
        "instance",
        ((i - 1) * per + 1).alias("first_image"),
        F.when(i == instances, F.col("images")).otherwise(i * per).alias("last_image"),
    )
