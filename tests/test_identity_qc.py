import pytest
from pyspark.sql import functions as F

from platewise.operators import identity as I
from platewise.operators import qc as Q
from platewise.roles import Roles

R = Roles()


def test_composite_id_is_null_safe_and_integral(spark):
    df = spark.createDataFrame([(5, 3.0), (5, None)], "a long, b double")
    assert [r["id"] for r in I.with_id(df, "id", "a", "b").collect()] == ["5_3", None]


def test_link_chain_keeps_fan_out_and_orphans(spark):
    cells = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (1, 3, None)], "ImageNumber long, ObjectNumber long, Parent_partialCells long")
    middle = spark.createDataFrame([(1, 7, 4), (1, 8, None)], "ImageNumber long, ObjectNumber long, Parent_FilteredNuclei long")
    leaves = spark.createDataFrame([(1, 4), (1, 5)], "ImageNumber long, ObjectNumber long")
    got = sorted((r["ObjectNumber"], r["cell_ID"] or "") for r in I.link_chain(cells, middle, leaves).collect())
    assert got == [(4, "1_1"), (4, "1_2"), (5, "")]


def test_link_via_brings_the_cell_back(spark):
    relate = spark.createDataFrame([(1, 1, 9), (1, 2, None), (1, 3, 8)], "ImageNumber long, ObjectNumber long, Parent_PunctaMito long")
    puncta = spark.createDataFrame([(1, 9, 2), (1, 8, None)], "ImageNumber long, ObjectNumber long, Parent_Cells long")
    got = {r["ObjectNumber"]: r["cell_ID"] for r in I.link_via(relate, puncta, "Parent_PunctaMito").collect()}
    assert got == {1: "1_2", 2: None, 3: None}


def test_exclude_site_matches_prefix_and_keeps_missing(spark):
    rows = [("B11", "5_12"), ("B11", "5_1x"), ("B11", "15_1"), ("B10", "5_1"), (None, "5_1"), ("B11", None)]
    df = spark.createDataFrame(rows, "Metadata_Well string, Metadata_Site string")
    assert {tuple(r) for r in I.exclude_site(df).collect()} == set(rows[2:])


def test_parse_well_without_letter_or_number(spark):
    df = spark.createDataFrame([("B11",), ("7",), ("x",), (None,)], "Metadata_Well string")
    got = [(r["Tech_replica"], r["Concentration"]) for r in I.parse_well(df, R).collect()]
    assert got == [("B", 11), (None, 7), (None, None), (None, None)]


def test_normalize_and_well_key(spark):
    df = spark.createDataFrame([(" d1", "br1 ", "b2"), (None, "br1", "b2")], "Metadata_Day string, Metadata_Biorep string, Metadata_Well string")
    got = [r["Day_Well_BR"] for r in I.with_well_key(I.normalize_keys(df, R), R).collect()]
    assert got == ["D1_B2_BR1", None]
    assert "Day_Well_BR" not in I.with_well_key(df.drop("Metadata_Day"), R).columns


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 2.0, "a", 3)], "ImageNumber long, Parent_X long, AreaShape double, x_01_y double, FileName_Z string, link_q long")
    assert I.object_features(df) == ["AreaShape", "x_01_y"]
    assert I.drop_matching(df, ["_01_", "Parent"]).columns == ["ImageNumber", "AreaShape", "FileName_Z", "link_q"]
    assert I.suffix(df.select("ImageNumber", "AreaShape"), "Cells", ["ImageNumber"]).columns == ["ImageNumber", "AreaShape_Cells"]
    with pytest.raises(ValueError, match="nope"):
        I.require(df, ["nope"])


def test_select_listed_keeps_table_order(spark):
    df = spark.createDataFrame([(11, 1.0, 2.0, 3.0)], "Concentration int, b double, a double, c double")
    assert I.select_listed(df, ["c", "b"], R).columns == ["Concentration", "b", "c"]


def test_well_table_clean_up(spark):
    df = spark.createDataFrame([(1.0,) * 6], "ObjectNumber_Cells double, Area_Cells double, Metadata_Site double, x_ID double, Day_Well_BR double, Metadata_Day double")
    assert I.clean_well_table(df).columns == ["Day_Well_BR", "Area_Cells", "Metadata_Day"]


def test_palette_wraps_from_the_highest_dose(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("Concentration"))
    got = {r[0]: r[1] for r in I.assign_colors(df, "Concentration").collect()}
    assert got[12] == I.DOSE_PALETTE[0] and got[2] == I.DOSE_PALETTE[0] and got[11] == I.DOSE_PALETTE[1]


def test_removal_needs_all_flags_and_ignores_nulls(spark):
    df = spark.createDataFrame([("l", "m", "n", 1, None), ("o", "p", "q", None, 0)], "f1 string, f2 string, f3 string, a int, b int")
    files = ["f1", "f2", "f3"]
    assert Q.removal_list(df, ["a", "c"], files) is None
    assert {r["remove"] for r in Q.removal_list(df, ["a", "b"], files).collect()} == {"l", "m", "n"}


def test_attach_tags_repeats_the_manifest(spark):
    manifest = spark.createDataFrame([(1,), (2,)], "ImageNumber long")
    t1 = spark.createDataFrame([(1, 1, 9)], ["ImageNumber", 'Empty \nImage "Count"', "Total Image Count"])
    t2 = spark.createDataFrame([(2, 1)], ["ImageNumber", "Artefacts  Image Count"])
    got = Q.attach_tags(manifest, [t1, t2])
    assert got.columns == ["ImageNumber", "Empty  Image Count", "Artefacts  Image Count"]
    assert got.count() == 4


def test_split_reports_listed_but_missing(spark):
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    removal = spark.createDataFrame([("b",), ("c",)], "remove string")
    assert {tuple(r) for r in Q.split_manifest(files, removal).collect()} == {("a", "kept"), ("b", "removed"), ("c", "missing")}


@pytest.mark.parametrize("n,k,want", [(65, 4, [(1, 5), (6, 10), (11, 15), (16, 21)]), (7, 3, [(1, 0), (1, 0), (1, 2)])])
def test_image_ranges(spark, n, k, want):
    got = Q.image_ranges(spark.range(n), k).orderBy("instance").collect()
    assert [(r["first_image"], r["last_image"]) for r in got] == want
