"""Profile-shaped views of the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators.ordered import long_form
from platewise.roles import Roles

ROLES = Roles(days=("D1", "D5", "D7", "D9"))
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
OBJECTS = {"A": "Cells", "N": "Cytoplasm", "R": "FilteredNuclei"}
DIMENSIONS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(c: str | Column, digits: int = 4) -> Column:
    """Rounded, with negative zero as zero."""
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def scored(df: DataFrame, digits: int = 6) -> DataFrame:
    """Scores rounded half up. Distances are sums of fractions of counts and do lie on ties, where floating point can put
    them on either side; a billionth more makes all of them go up."""
    return df.withColumn("EMD_score", F.round(F.col("EMD_score") + F.lit(1e-9), digits) + F.lit(0.0))


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    chosen = set(columns)
    return df.select(*[rnd(c, digits).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def _of(at: Column, values: Sequence[str], other: Column) -> Column:
    """The value at 0, 1, ... as a constant, which costs less than making the text; ``other`` beyond."""
    out = F.when(at == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(at == i, F.lit(v))
    return out.otherwise(other)


def measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as one measured object."""
    li = table(spark, sf_dir, "lineitem")
    year = F.pmod(F.year("l_shipdate"), F.lit(4))
    flag = F.col("l_returnflag")
    supplier, line = F.col("l_suppkey") % 4, F.col("l_linenumber") % 3
    biorep = F.concat(F.lit("BR"), (supplier + 1).cast("string"))
    tech = F.substr(F.lit("BCD"), (line + 1).cast("int"), F.lit(1))
    out = li.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("cell_ID"),
        F.when(flag == "A", "Cells").when(flag == "N", "Cytoplasm").otherwise("FilteredNuclei").alias("object"),
        F.when(year == 0, "D1").when(year == 1, "D5").when(year == 2, "D7").otherwise("D9").alias("Metadata_Day"),
        _of(supplier, ("BR1", "BR2", "BR3", "BR4"), biorep).alias("Metadata_Biorep"),
        _of(line, ("B", "C", "D"), tech).alias("Tech_replica"),
        (F.col("l_partkey") % 10 + 2).cast("int").alias("Concentration"),
        "l_orderkey",
        *MEASURES,
    )
    well = F.concat("Tech_replica", F.col("Concentration").cast("string"))
    out = out.withColumn("Metadata_Well", well)
    key = F.concat_ws("_", "Metadata_Day", "Metadata_Well", "Metadata_Biorep")
    return out.withColumn("Day_Well_BR", key)


def object_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    m = measure(spark, sf_dir)
    keep = ["cell_ID", "Metadata_Well", "Metadata_Day", "Metadata_Biorep", "Day_Well_BR", *MEASURES]
    return {name: m.where(F.col("object") == name).select(*keep) for name in OBJECTS.values()}


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measured objects as a profile table (metadata and features only)."""
    return measure(spark, sf_dir).drop("object", "l_orderkey")


def flawed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with missing, infinite and absurdly large values where the order key says so."""
    m = measure(spark, sf_dir)
    k = F.col("l_orderkey")
    q = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    p = F.when(k % 13 == 0, F.lit(-1e13)).when(k % 17 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return m.withColumns({"l_quantity": q, "l_extendedprice": p}).drop("object")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as profiles: ``vec_id, Concentration, f0..f63``."""
    e = table(spark, sf_dir, "embeddings")
    dims = [F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(DIMENSIONS)]
    return e.select("vec_id", (F.col("label") + 2).cast("int").alias("Concentration"), *dims)


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Metadata_Day, event_type, value`` of all events."""
    e = table(spark, sf_dir, "events")
    day = F.concat(F.lit("D"), F.pmod(F.dayofmonth("ts"), F.lit(4)).cast("string"))
    return e.select(day.alias("Metadata_Day"), "event_type", "value")


def event_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(event_values(spark, sf_dir), ["Metadata_Day", "event_type"], ["value"])


def named_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature names spelled out of the parts: module, size, channel and measured object."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    modules = ["AreaShape", "Granularity", "Intensity", "RadialDistribution", "Texture", "Mean", "Number", "Shade"]
    channels = ["GrayLys", "GrayMito", "GrayNuclei", "None"]
    objects = ["RelateLysoCell", "RelateMitoCell", "FilteredNuclei", "Cells", "Cytoplasm", "Blob"]

    def nth(values: list[str], at: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))

    name = F.concat(
        F.lit("rp_norm_"), nth(modules, k % 8), F.lit("_"), F.col("p_size").cast("string"), F.lit("_"),
        nth(channels, k % 4), F.lit("_"), nth(objects, k % 6),
    )
    counted = F.concat(F.lit("counts_"), nth(objects, k % 6))
    feature = F.when(k % 50 == 0, counted).when(k % 77 == 0, F.concat(F.lit("raw_"), F.col("p_brand"))).otherwise(name)
    return p.select(k.alias("p_partkey"), "p_size", feature.alias("feature"))


def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curated lookup of the features of parts up to size 30, with gaps and unknown labels."""
    names = named_features(spark, sf_dir).where("p_size <= 30").groupBy("feature").agg(F.min("p_partkey").alias("k"))
    k = F.col("k")
    category = F.when(k % 9 == 0, "").when(k % 10 == 0, "Odd").otherwise(
        F.get(F.array(*[F.lit(c) for c in ("Texture", "Intensity", "AreaShape", "Correlation")]), (k % 4).cast("int"))
    )
    organelle = F.when(k % 12 == 0, "").when(k % 15 == 0, "Golgi").otherwise(
        F.get(F.array(*[F.lit(o) for o in ("Nuclei", "Lysosomes", "Mitochondria", "Other")]), (k % 4).cast("int"))
    )
    return names.select("feature", category.alias("category"), organelle.alias("organelle"))


def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    base = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"))
    files = {"Lys": "lys", "Mito": "mito", "Nuclei": "nuc"}
    return d.select(
        F.col("doc_id").alias("ImageNumber"),
        *[F.concat(base, F.lit(f"_{tag}.tif")).alias(f"Image_FileName_{name}") for name, tag in files.items()],
    )


def tag_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three tag tables with the untidy headers of the tagging tool."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents")
    one = F.lit(1).cast("bigint")
    artefacts = labels.select(
        F.col("doc_id").alias("ImageNumber"),
        F.when(F.col("quality") == 0, one).otherwise(one * 0).alias("Artefacts \nImage Count"),
        one.alias("Total\nImage Count"),
    )
    empty = docs.select(
        F.col("doc_id").alias("ImageNumber"),
        F.when(F.col("n_chars") < 200, one).otherwise(one * 0).alias("Empty \nImage Count"),
    )
    over = labels.select(
        F.col("doc_id").alias("ImageNumber"), F.col("toxic").cast("bigint").alias(' Oversaturated \nImage Count ')
    )
    return [artefacts, empty, over]


def lineage_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, customers and nations as cells, middle objects and nuclei of one image per region."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey"
    )
    orders = table(spark, sf_dir, "orders").join(
        customer.select(F.col("c_custkey").alias("o_custkey"), "n_regionkey"), "o_custkey"
    )
    cells = orders.select(
        F.col("n_regionkey").cast("bigint").alias("ImageNumber"),
        F.col("o_orderkey").alias("ObjectNumber"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("Parent_partialCells"),
    )
    middle = customer.select(
        F.col("n_regionkey").cast("bigint").alias("ImageNumber"),
        F.col("c_custkey").alias("ObjectNumber"),
        F.col("c_nationkey").cast("bigint").alias("Parent_FilteredNuclei"),
    )
    nuclei = nation.select(
        F.col("n_regionkey").cast("bigint").alias("ImageNumber"),
        F.col("n_nationkey").cast("bigint").alias("ObjectNumber"),
        "n_name",
    )
    return cells, middle, nuclei
