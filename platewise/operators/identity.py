"""Column selection, composite ids, object lineage and key clean-up."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.roles import Roles, numeric_columns

# Name fragments of columns that are not measurements of the object type's own
# channel, per object type.
UNWANTED_FRAGMENTS = {
    "FilteredNuclei": ("Children", "Location", "GrayLys", "GrayMito", "_01_", "_02_", "_03_"),
    "RelateLysoCell": ("Children", "Location", "GrayNuclei", "GrayMito", "_01_", "_02_", "_03_"),
    "PunctaLyso": ("Children", "Location", "GrayNuclei", "GrayMito", "_01_", "_02_", "_03_"),
    "PunctaMito": ("Children", "Location", "GrayNuclei", "GrayLys", "_01_", "_02_", "_03_"),
    "RelateMitoCell": ("Children", "Location", "GrayNuclei", "GrayLys", "_01_", "_02_", "_03_"),
    "Cells": ("Children", "Location", "_01_", "_02_", "_03_"),
    "Cytoplasm": ("Children", "Location", "_01_", "_02_", "_03_"),
}

# Columns of an object table that describe it rather than measure it.
OBJECT_METADATA = (
    "ImageNumber",
    "ObjectNumber",
    "Metadata_Biorep",
    "Metadata_Channel",
    "Metadata_Chemical",
    "Metadata_Day",
    "Metadata_Frame",
    "Metadata_Series",
    "Metadata_Site",
    "Metadata_Well",
    "Subfolder",
    "Day_Well_BR",
)
LINK_PREFIXES = ("link_", "Parent_", "FileName_", "PathName_")
# Names dropped from a well table by prefix.
WELL_TABLE_PREFIXES = (
    *LINK_PREFIXES,
    "Metadata_Channel",
    "Metadata_Frame",
    "Metadata_Series",
    "Metadata_Site",
    "ObjectNumber_",
    "ImageNumber_",
)
WELL_TABLE_NAMES = ("ImageNumber", "ObjectNumber", "Metadata_Chemical", "Subfolder")


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def drop_matching(df: DataFrame, fragments: Sequence[str]) -> DataFrame:
    """Drop the columns whose name contains any of the fragments."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not any(s in c for s in fragments)])


def composite_id(*parts: str) -> Column:
    """``a_b``; NULL when any part is NULL. Whole numbers held as doubles print as integers."""
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit("_"))
        pieces.append(F.col(p).cast("bigint").cast("string"))
    return F.concat(*pieces)


def with_id(df: DataFrame, name: str, image: str, number: str) -> DataFrame:
    return df.withColumn(name, composite_id(image, number))


def with_well_key(df: DataFrame, roles: Roles) -> DataFrame:
    """Add day_well_biorep when all three columns are there; leave the table alone otherwise."""
    parts = (roles.day, roles.well, roles.biorep)
    if any(p not in df.columns for p in parts):
        return df
    day, well, biorep = (F.col(p) for p in parts)
    return df.withColumn(roles.well_key, F.concat(day, F.lit("_"), well, F.lit("_"), biorep))


def left_link(child: DataFrame, lookup: DataFrame, child_key: str, lookup_key: str) -> DataFrame:
    """Left join keeping every match; keys that are NULL match nothing."""
    right = lookup.where(F.col(lookup_key).isNotNull()).withColumnRenamed(lookup_key, "_link")
    return child.join(right, F.col(child_key) == F.col("_link"), "left").drop("_link")


def link_chain(
    cells: DataFrame,
    middle: DataFrame,
    leaves: DataFrame,
    image: str = "ImageNumber",
    number: str = "ObjectNumber",
    cell_parent: str = "Parent_partialCells",
    middle_parent: str = "Parent_FilteredNuclei",
    cell_id: str = "cell_ID",
) -> DataFrame:
    """Give ``leaves`` the id of the cell that reaches them through the middle objects."""
    owners = cells.select(
        composite_id(image, number).alias(cell_id), composite_id(image, cell_parent).alias("_to_middle")
    )
    via = middle.select(
        composite_id(image, number).alias("_middle"), composite_id(image, middle_parent).alias("_to_leaf")
    )
    via = left_link(via, owners, "_middle", "_to_middle").select(cell_id, "_to_leaf")
    keyed = leaves.withColumn("_leaf", composite_id(image, number))
    return left_link(keyed, via, "_leaf", "_to_leaf").drop("_leaf")


def link_via(
    relate: DataFrame,
    puncta: DataFrame,
    parent: str,
    image: str = "ImageNumber",
    number: str = "ObjectNumber",
    parent_cell: str = "Parent_Cells",
    cell_id: str = "cell_ID",
) -> DataFrame:
    """Give ``relate`` the cell of the punctum its ``parent`` column points at."""
    keyed = relate.withColumn("_relate", composite_id(image, number))
    links = keyed.select(F.col("_relate").alias("_owner"), composite_id(image, parent).alias("_to_punctum"))
    spots = puncta.select(
        composite_id(image, number).alias("_punctum"), composite_id(image, parent_cell).alias(cell_id)
    )
    back = left_link(spots, links, "_punctum", "_to_punctum").select("_owner", cell_id)
    return left_link(keyed, back, "_relate", "_owner").drop("_relate")


def exclude_site(
    df: DataFrame, well: str = "B11", pattern: str = r"^5_\d+",
    well_col: str = "Metadata_Well", site_col: str = "Metadata_Site",
) -> DataFrame:
    """Leave out rows of one well whose site starts with the pattern; missing values stay."""
    hit = (F.col(well_col) == well) & F.col(site_col).cast("string").rlike(pattern)
    return df.where(~F.coalesce(hit, F.lit(False)))


def object_features(df: DataFrame, key: str = "cell_ID") -> list[str]:
    """Numeric measurement columns of an object table."""
    return [
        c
        for c in numeric_columns(df)
        if c != key
        and not c.endswith("_ID")
        and not c.startswith(LINK_PREFIXES)
        and c not in OBJECT_METADATA
    ]


def suffix(df: DataFrame, tag: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename every column but ``keep`` to ``{column}_{tag}``."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else f"{c}_{tag}") for c in df.columns])


def clean_well_table(df: DataFrame, key: str = "Day_Well_BR") -> DataFrame:
    """Key first, then every column that is not an id, link, path, site or object number."""
    kept = [
        c
        for c in dict.fromkeys(df.columns)
        if c != key
        and not c.endswith("_ID")
        and not c.startswith(WELL_TABLE_PREFIXES)
        and c not in WELL_TABLE_NAMES
    ]
    return df.select(key, *kept)


def parse_well(df: DataFrame, roles: Roles) -> DataFrame:
    """Technical replica (first capital letter) and concentration (first number) of the well name."""
    well = F.col(roles.well)
    number = F.nullif(F.regexp_extract(well, r"(\d+)", 1), F.lit(""))
    return df.withColumn(
        roles.tech_rep, F.nullif(F.regexp_extract(well, r"([A-Z])", 1), F.lit(""))
    ).withColumn(roles.conc, number.try_cast("int"))


def normalize_keys(df: DataFrame, roles: Roles) -> DataFrame:
    """Trim and upper-case the text keys; a missing key stays NULL."""
    keys = (roles.day, roles.biorep, roles.well, roles.well_key, roles.cell)
    present = {k: F.upper(F.trim(F.col(k).cast("string"))) for k in keys if k in df.columns}
    return df.withColumns(present) if present else df


def select_listed(df: DataFrame, wanted: Sequence[str], roles: Roles) -> DataFrame:
    """Metadata, then the listed features, both in table order."""
    listed = set(wanted)
    meta = roles.metadata(df, downstream=True)
    return df.select(*meta, *[c for c in df.columns if c in listed and c not in meta])


def remap(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(mapping), subset=[column])


def highlight(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """One copy of the rows per value, flagging the rows that carry it and sizing their marker."""
    chosen = F.explode(F.array(*[F.lit(v) for v in values]))
    hit = F.coalesce(F.col(column) == F.col("highlight"), F.lit(False))
    label = F.concat(F.lit(f"{column} "), F.col("highlight").cast("string"))
    return df.withColumn("highlight", chosen).withColumns(
        {
            "Color": F.when(hit, label).otherwise("Other"),
            "Size": F.when(hit, F.lit(20)).otherwise(F.lit(9)),
        }
    )


# Plot colors, blue to red.
DOSE_PALETTE = (
    "#313695", "#4575b4", "#74add1", "#abd9e9", "#e0f3f8",
    "#fee090", "#fdae61", "#f46d43", "#d73027", "#a50026",
)


def assign_colors(df: DataFrame, conc: str, palette: Sequence[str] = DOSE_PALETTE) -> DataFrame:
    """Color per concentration level, highest first, reusing the palette when it runs out."""
    levels = df.select(conc).where(F.col(conc).isNotNull()).distinct()
    place = F.dense_rank().over(W.orderBy(F.desc(conc))) - 1
    colors = F.array(*[F.lit(c) for c in palette])
    return levels.select(conc, F.get(colors, F.pmod(place, F.lit(len(palette)))).alias("color"))


def day_label(column: str) -> Column:
    """``D5`` as ``Day 5``."""
    return F.concat(F.lit("Day "), F.substr(F.col(column), F.lit(2)))
