import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewise.functions.numeric import chi2_tail, natural_log
from platewise.operators import doseresponse as M
from platewise.operators import subsets as U
from platewise.operators import violin as V
from platewise.roles import Roles

R = Roles()


def test_chi2_tail_known_values(spark):
    # Critical values of standard tables.
    rows = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (16.918977604620448, 9, 0.05),
            (0.0, 3, 1.0), (500.0, 4, 0.0), (2.0, 2, math.exp(-1.0))]
    df = spark.createDataFrame(rows, "x double, k int, p double")
    for r in df.withColumn("got", chi2_tail(F.col("x"), F.col("k").cast("double"))).collect():
        assert abs(r["got"] - r["p"]) < 1e-12


def kruskal_numpy(groups):
    values = np.concatenate(groups)
    ranks = pd.Series(values).rank().to_numpy()
    n, at, h = len(values), 0, 0.0
    for g in groups:
        h += ranks[at : at + len(g)].sum() ** 2 / len(g)
        at += len(g)
    h = 12 / (n * (n + 1)) * h - 3 * (n + 1)
    t = pd.Series(values).value_counts().to_numpy(float)
    return h / (1 - (t**3 - t).sum() / (n**3 - n))


@pytest.mark.parametrize("ranges", [1, 8])
def test_kruskal_with_ties_and_constant_group(spark, ranges):
    rng = np.random.default_rng(5)
    groups = {1: rng.integers(0, 6, 40), 2: rng.integers(1, 8, 25), 3: np.array([4, 4, 4])}
    rows = [("f", g, float(v)) for g, vs in groups.items() for v in vs] + [("only", 1, 1.0), ("only", 1, 2.0), ("only", 2, 3.0)]
    long = spark.createDataFrame(rows, "feature string, g int, value double")
    got = V.kruskal(long, ["feature"], "g", ranges=ranges).collect()
    assert [r["feature"] for r in got] == ["f"]
    assert got[0]["groups"] == 2 and got[0]["n"] == 65
    assert abs(got[0]["h"] - kruskal_numpy([groups[1], groups[2]])) < 1e-9


def test_mean_flags_keep_the_sign(spark):
    schema = "feature string, g int, n long, median double, mean double"
    rows = [("neg", 1, 2, 0.0, -1.0), ("neg", 2, 2, 0.0, -5.0), ("pos", 1, 2, 0.0, 1.0), ("pos", 2, 2, 0.0, 1.1),
            ("pos", 3, 2, 0.0, 2.0), ("untested", 1, 2, 0.0, 1.0), ("untested", 2, 2, 0.0, 9.0)]
    tested = spark.createDataFrame([("neg",), ("pos",)], "feature string")
    got = V.mean_difference_flags(spark.createDataFrame(rows, schema), ["feature"], "g", tested).collect()
    flags = {(r["feature"], r["g"]): (r["mean_flag"], r["star"]) for r in got}
    assert flags["neg", 1] == (False, False) and flags["untested", 2] == (False, False)
    assert flags["pos", 3] == (True, True) and flags["pos", 1] == (True, True)


@pytest.mark.parametrize("budget", [10**6, 1])
def test_group_stats(spark, budget):
    df = spark.createDataFrame([(1, 1.0, None), (1, 4.0, None), (1, None, 3.0), (2, 2.0, None)], "g int, a double, b double")
    got = {(r["g"], r["feature"]): (r["n"], r["median"], r["mean"]) for r in V.group_stats(df, ["g"], ["a", "b"], budget).collect()}
    assert got == {(1, "a"): (2, 2.5, 2.5), (1, "b"): (1, 3.0, 3.0), (2, "a"): (1, 2.0, 2.0)}


def _cells(spark, sizes):
    rows = [(f"{d}{c}-{i}", d, c) for (d, c), n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "cell_ID string, Metadata_Day string, Concentration int")


def test_samples_have_exact_sizes_and_members(spark):
    sizes = {("D1", 2): 40, ("D1", 11): 7, ("D5", 3): 90, ("D5", 11): 12, ("D2", 2): 5, ("D1", 99): 4}
    df = _cells(spark, sizes)
    all_ids = {r["cell_ID"] for r in df.collect()}

    def drawn(out):
        ids = [r["cell_ID"] for r in out.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= all_ids
        return {(r["Metadata_Day"], r["Concentration"]): r["count"] for r in out.groupBy("Metadata_Day", "Concentration").count().collect()}

    assert drawn(U.sample_capped(df, R, 10)) == {("D1", 2): 10, ("D1", 11): 7, ("D5", 3): 10, ("D5", 11): 10}
    assert ("D1", 2) not in drawn(U.sample_capped(df, R, 10, exclude=(2,)))
    assert drawn(U.sample_equal(df, R)) == {("D1", 2): 7, ("D1", 11): 7, ("D5", 3): 12, ("D5", 11): 12}
    assert drawn(U.sample_by_cap(df, R, {2: 5, 3: 20}, 9)) == {("D1", 2): 5, ("D1", 11): 7, ("D5", 3): 20, ("D5", 11): 9}
    again = [sorted(r["cell_ID"] for r in U.sample_capped(df.repartition(k), R, 10).collect()) for k in (1, 5)]
    assert again[0] == again[1]


def test_bucketed_draw_equals_plain_draw(spark):
    df = _cells(spark, {("D1", 2): 3000})
    got = {r["cell_ID"] for r in U.sample_capped(df, R, 50).collect()}
    plain = df.orderBy(F.md5(F.concat("cell_ID", F.lit(":1"))), "cell_ID").limit(50).collect()
    assert got == {r["cell_ID"] for r in plain}


def test_stratum_counts_drop_missing_keys_per_table(spark):
    rows = [("D1", 2, "BR1"), ("D1", None, "BR1"), (None, 2, "BR2"), ("D5", 2, None)]
    df = spark.createDataFrame(rows, "Metadata_Day string, Concentration int, Metadata_Biorep string")
    got = {(r["stratum"], r[1], r[2], r[3]): r["Counts"] for r in U.stratum_counts(df, R).collect()}
    assert got["day", "D1", None, None] == 2 and got["concentration", None, 2, None] == 3
    assert got["day_concentration", "D1", 2, None] == 1 and got["day_concentration_biorep", "D1", 2, "BR1"] == 1
    assert sum(k[0] == "day_concentration_biorep" for k in got) == 1
    assert ("day_biorep", "D1", None, "BR1") in got


def test_filter_report_edges(spark):
    inf = float("inf")
    rows = [(None if i < 3 else 1.0, 2.0, inf if i else 5.0, float(i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "holes double, flat double, lone double, ok double, a_Number_Object_Number_b double")
    report = U.filter_report(df, df.columns, excluded=("ok",))
    got = {r["feature"]: r.asDict() for r in report.collect()}
    assert got["holes"]["too_missing"] and got["holes"]["missing_percent"] == 30.0 and got["holes"]["zero_variance"]
    assert got["flat"]["zero_variance"] and not got["lone"]["zero_variance"] and not got["lone"]["too_missing"]
    assert got["a_Number_Object_Number_b"]["object_number"] and got["ok"]["excluded"]
    assert U.filter_summary(report).first().asDict() == {"features": 5, "removed": 4, "too_missing": 1, "zero_variance": 2, "object_number": 1, "excluded": 1}
    assert U.filter_features(df, R, excluded=("ok",)).columns == ["lone"]


def _emd(spark, series):
    rows = []
    for (feature, day), ys in series.items():
        for c, y in zip(range(10, 2, -1), ys):
            pair = ("11", str(c)) if c % 2 else (str(c), "11")
            rows.append((feature, day, *pair, y))
        rows.append((feature, day, "2", "11", 99.0))
    return spark.createDataFrame(rows, "Feature string, Metadata_Day string, Population1 string, Population2 string, EMD_score double")


def test_series_order_and_completeness(spark):
    emd = _emd(spark, {("a", "D1"): [float(i) for i in range(8)], ("b", "D1"): [1.0] * 7})
    got = M.dose_series(emd, R).collect()
    assert [(r["Feature"], r["y"]) for r in got] == [("a", [float(i) for i in range(8)])]


X = np.arange(8.0)
LOGX = np.log(X + 1e-10)


def curve(model, b, e, c, d, f):
    z = np.exp(b * (LOGX - np.log(e + 1e-10)))
    g = np.exp(-z) if model == "WB1.4" else 1 / (1 + z)
    if model == "BC4":
        return (d + f * X) * g
    if model == "BC5":
        return c + (d - c + f * X) * g
    return c + (d - c) * g


@pytest.mark.parametrize("model,p", [
    ("LL4", (3.0, 2.7, 0.5, 2.0, 0)), ("LL4", (-2.0, 4.1, 0.1, 1.5, 0)), ("WB1.4", (1.4, 3.3, 0.2, 1.1, 0)),
    ("BC4", (2.5, 3.9, 0, 1.0, 0.4)), ("BC5", (2.2, 3.1, 0.3, 1.0, 0.5)),
])
def test_curves_recover_noise_free_data(spark, model, p):
    y = curve(model, *p)
    series = spark.createDataFrame([("f", "D1", [float(v) for v in y])], "Feature string, Day string, y array<double>")
    got = M.fit_curves(series, 8, [model]).first()
    assert got["ssr"] < 1e-5 * ((y - y.mean()) ** 2).sum()


def test_fit_models_rows_scores_and_nesting(spark):
    rng = np.random.default_rng(2)
    y = 0.3 + 0.2 * X + rng.normal(scale=0.1, size=8)
    fits = {r["Model"]: r.asDict() for r in M.fit_models(_emd(spark, {("a", "D1"): [float(v) for v in y]}), R).collect()}
    assert set(fits) == set(M.MODEL_PARAMETERS)
    slope, intercept = np.polyfit(X, y, 1)
    ssr = ((y - slope * X - intercept) ** 2).sum()
    assert abs(fits["Lin"]["Slope"] - slope) < 1e-12
    assert abs(fits["Lin"]["AIC"] - (8 * np.log(ssr / 8) + 4)) < 1e-9
    assert abs(fits["Con"]["BIC"] - (8 * np.log(y.var()) + np.log(8))) < 1e-9
    # BC5 contains BC4 and LL4, so apart from the penalty it fits at least about as well.
    fit = {m: fits[m]["AIC"] - 2 * k for m, k in M.MODEL_PARAMETERS.items()}
    assert fit["BC5"] <= min(fit["BC4"], fit["LL4"]) + 1e-3


def test_perfect_constant_is_rejected(spark):
    assert spark.range(1).select(natural_log(F.lit(0.0))).first()[0] == float("-inf")
    flat, rising = [0.5] * 8, [float(v) for v in 0.1 + X * 0.5 + np.sin(X) * 0.01]
    emd = _emd(spark, {("flat", "D1"): flat, ("up", "D1"): rising, ("down", "D1"): rising[::-1], ("mixed", "D1"): rising, ("mixed", "D5"): flat})
    fits = M.fit_models(emd, R)
    assert {r[0] for r in M.select_features(fits, ["D1"]).collect()} == {"up", "mixed"}
    assert {r[0] for r in M.select_features(fits, ["D1", "D5"]).collect()} == {"up"}


def test_select_features_slope_rules(spark):
    schema = "Feature string, Day string, Model string, AIC double, BIC double, Slope double"
    rows = [("a", "D1", "Lin", 1.0, 1.0, 0.5), ("a", "D5", "Lin", 1.0, 1.0, -0.5), ("a", "D1", "Con", 2.0, 2.0, None),
            ("tie", "D1", "Lin", 1.0, 1.0, 0.5), ("tie", "D1", "Con", 1.0, 1.0, None),
            ("nocon", "D1", "Lin", 1.0, 1.0, 0.1)]
    fits = spark.createDataFrame(rows, schema)
    assert {r[0] for r in M.select_features(fits, ["D1", "D5"]).collect()} == {"a", "nocon"}
    assert {r[0] for r in M.select_features(fits, ["D1", "D5"], "all").collect()} == {"nocon"}
