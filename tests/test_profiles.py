import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewise.operators import emd as W
from platewise.operators import pooling as P
from platewise.operators import standardize as T
from platewise.roles import Roles

R = Roles(days=("D1", "D5"), bioreps=("BR1", "BR2"), concentrations=(2, 3, 11))


@pytest.fixture(scope="module")
def plate(spark):
    rng = np.random.default_rng(3)
    n = 900
    pdf = pd.DataFrame(
        {
            "cell_ID": [f"c{i}" for i in range(n)],
            "Metadata_Day": rng.choice(["D1", "D5"], n),
            "Metadata_Biorep": rng.choice(["BR1", "BR2"], n),
            "Tech_replica": rng.choice(["B", "C"], n),
            "Concentration": rng.choice([2, 3, 11], n).astype(np.int32),
            "x": rng.normal(size=n),
            "y": np.round(rng.exponential(size=n), 1),
        }
    )
    pdf["Metadata_Well"] = pdf.Tech_replica + pdf.Concentration.astype(str)
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def wasserstein(a, b):
    grid = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, "right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, "right") / len(b)
    return float(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)))


@pytest.mark.parametrize("budget", [10**7, 10])
def test_standardize_leaves_zero_day_median(plate, budget):
    pdf, df = plate
    got = T.standardize_row_day(df, R, ["x", "y"], task_values=budget).toPandas()
    assert list(got.columns[-2:]) == ["rp_norm_x", "rp_norm_y"] and len(got) == len(pdf)
    r = pdf.x - pdf.groupby(["Metadata_Day", "Metadata_Biorep", "Tech_replica"]).x.transform("median")
    want = r - r.groupby(pdf.Metadata_Day).transform("median")
    merged = got.set_index("cell_ID").loc[pdf.cell_ID].rp_norm_x.to_numpy()
    np.testing.assert_allclose(merged, want.to_numpy(), atol=1e-12)
    assert abs(got.groupby("Metadata_Day").rp_norm_x.median()).max() < 1e-12


def test_robust_z_zero_mad_is_null(plate, spark):
    pdf, df = plate
    flat = df.withColumn("flat", F.lit(1.0))
    got = T.robust_z(flat, R, ["x", "flat"]).toPandas().set_index("cell_ID").loc[pdf.cell_ID]
    g = pdf.groupby(["Metadata_Day", "Metadata_Biorep"]).x
    off = pdf.x - g.transform("median")
    mad = off.abs().groupby([pdf.Metadata_Day, pdf.Metadata_Biorep]).transform("median")
    np.testing.assert_allclose(got.rZs_x.to_numpy(), (0.6745 * off / mad).to_numpy(), atol=1e-12)
    assert got.rZs_flat.isna().all()


@pytest.mark.parametrize("budget", [10**7, 10])
def test_trim_matches_numpy_and_adds_nothing(plate, budget):
    pdf, df = plate
    got = T.trim_wells(df, R, features=["x", "y"], task_values=budget).toPandas().set_index("cell_ID").loc[pdf.cell_ID]
    keys = ["Metadata_Day", "Metadata_Biorep", "Metadata_Well"]
    for f in ("x", "y"):
        lo = pdf.groupby(keys)[f].transform(lambda v: np.nanpercentile(v, 2.5))
        hi = pdf.groupby(keys)[f].transform(lambda v: np.nanpercentile(v, 97.5))
        want = pdf[f].where((pdf[f] >= lo) & (pdf[f] <= hi))
        np.testing.assert_array_equal(got[f].to_numpy(), want.to_numpy())


def test_trim_keeps_rows_without_day_or_well(spark):
    rows = [("D1", "BR1", None, 1.0), ("D1", "BR1", "B2", 1.0), (None, "BR1", "B2", 5.0), ("D1", None, "B2", 9.0)]
    rows += [("D1", "BR1", None, float(v)) for v in range(2, 101)]
    df = spark.createDataFrame(rows, "Metadata_Day string, Metadata_Biorep string, Metadata_Well string, x double")
    got = T.trim_wells(df, R)
    assert got.columns == df.columns
    assert got.count() == len(rows) - 1
    assert got.where("Metadata_Biorep is null").count() == 0
    # The group without a well has its own bounds.
    assert got.where("Metadata_Well is null and x is null").count() == 6


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_emd_concentrations_match_numpy(plate, ranges):
    pdf, df = plate
    got = W.emd_concentrations(df, R, ["x", "y"], ranges=ranges).collect()
    assert len(got) == 2 * 2 * 3
    for r in got:
        day = pdf[pdf.Metadata_Day == r["Metadata_Day"]]
        a = day[day.Concentration == int(r["Population1"])][r["Feature"]].dropna()
        b = day[day.Concentration == int(r["Population2"])][r["Feature"]].dropna()
        assert (r["Count1"], r["Count2"]) == (len(a), len(b))
        assert r["Concentration"] == f"{r['Population1']}_vs_{r['Population2']}"
        assert abs(r["EMD_score"] - wasserstein(a.to_numpy(), b.to_numpy())) < 1e-12


def test_emd_shift_self_and_empty_side(spark):
    rows = [("f", "a", float(v)) for v in (0, 1, 1, 4)] + [("f", "b", float(v) + 2.5) for v in (0, 1, 1, 4)]
    rows += [("g", "a", 1.0), ("f", "c", None)]
    df = spark.createDataFrame(rows, "feature string, pop string, value double").where("value is not null")
    got = {(r["feature"], r["first"], r["second"]): r["EMD_score"] for r in W.emd_pairs(df, ["feature"], "pop", ["a", "b", "c"]).collect()}
    assert got == {("f", 0, 1): 2.5}


def test_emd_controls_follow_the_day_design(plate):
    pdf, df = plate
    roles = Roles(days=("D1", "D5"), bioreps=("BR1", "BR2"), concentrations=(2, 3, 11), day_bioreps={"D5": ("BR1",)})
    got = W.emd_controls(df, roles, features=["x"]).collect()
    assert [(r["Population1"], r["Population2"]) for r in got] == [("BR1_D1_11", "BR2_D1_11")]
    part = pdf[(pdf.Concentration == 11) & (pdf.Metadata_Day == "D1")]
    sides = []
    for b in ("BR1", "BR2"):
        kept = []
        for _, well in part[part.Metadata_Biorep == b].groupby("Metadata_Well"):
            v = well.x.dropna()
            kept.append(v[(v >= np.percentile(v, 2.5)) & (v <= np.percentile(v, 97.5))])
        sides.append(pd.concat(kept).to_numpy())
    assert abs(got[0]["EMD_score"] - wasserstein(*sides)) < 1e-12


def test_classes_vacuous_inactive(spark):
    schema = "Feature string, EMD_score double"
    control = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 9.0), ("d", 0.1)], schema)
    treat = spark.createDataFrame([("a", 0.05), ("b", 0.01), ("c", 5.0)], schema)
    got = {r["Feature"]: (r["class"], r["selected"]) for r in W.classify_features(treat, control).collect()}
    assert got == {"a": ("normal", True), "b": ("inactive", False), "c": ("noisy", False), "d": ("inactive", False)}


def test_rank_breaks_ties_by_name(spark):
    emd = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "Feature string, EMD_score double")
    assert [r["Feature"] for r in W.rank_features(emd).orderBy("position").collect()] == ["c", "a", "b"]


def _objects(spark):
    schema = "cell_ID string, Metadata_Well string, Metadata_Day string, Metadata_Biorep string, Day_Well_BR string, Area double"
    meta = ("B11", "D1", "BR1", "D1_B11_BR1")
    cells = spark.createDataFrame([("1_1", *meta, 1.0), ("1_2", *meta, None)], schema)
    cyto = spark.createDataFrame([("1_1", *meta, 1.0), ("1_1", *meta, 4.0), ("1_9", *meta, 2.0), (None, *meta, 7.0)], schema)
    return {"Cells": cells, "Cytoplasm": cyto}


@pytest.mark.parametrize("budget", [10**7, 1])
def test_pool_cells_outer_and_counts(spark, budget):
    got = {r["cell_ID"]: r.asDict() for r in P.pool_cells(_objects(spark), R, task_values=budget).collect()}
    assert set(got) == {"1_1", "1_2", "1_9"}
    assert got["1_1"]["Area_Cytoplasm"] == 2.5 and got["1_1"]["counts_Cytoplasm"] == 2
    assert got["1_2"]["Area_Cells"] is None and got["1_2"]["counts_Cells"] == 1
    assert got["1_2"]["counts_Cytoplasm"] is None
    assert got["1_9"]["Metadata_Well"] is None and got["1_9"]["Concentration"] is None
    assert got["1_1"]["Tech_replica"] == "B" and got["1_1"]["Concentration"] == 11


def test_pool_wells(spark):
    got = P.pool_wells(_objects(spark), R).collect()
    assert len(got) == 1 and got[0]["Area_Cytoplasm"] == 3.0 and got[0]["counts_Cytoplasm"] == 4
