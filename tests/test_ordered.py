import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewise.functions.numeric import order_image
from platewise.operators import ordered as O


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 600
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["a", "a", "a", "b", "c"], n),
            "x": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n).round(2)),
            "y": rng.exponential(size=n),
        }
    )
    pdf.loc[rng.random(n) < 0.1, "y"] = np.nan
    pdf.loc[:3, "g"] = None
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("budget", [10**7, 1])
def test_group_quantiles_match_numpy_hot_or_not(frame, budget):
    pdf, df = frame
    probs = [0.025, 0.5, 0.975]
    got = O.group_quantiles(df, ["g"], ["x", "y"], probs, [F.count(F.lit(1)).alias("n")], budget)
    got = {r["g"]: r for r in got.collect()}
    assert set(got) == {"a", "b", "c"}
    for g, part in pdf.dropna(subset=["g"]).groupby("g"):
        assert got[g]["n"] == len(part)
        for f in ("x", "y"):
            want = np.nanpercentile(part[f], [2.5, 50, 97.5])
            np.testing.assert_allclose(got[g][f], want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("budget", [10**7, 1, 500])
def test_with_group_quantiles_keeps_every_row(frame, budget):
    pdf, df = frame
    got = O.with_group_quantiles(df, ["g"], ["x", "y"], [0.5], task_values=budget).toPandas()
    assert len(got) == len(pdf)
    assert got[got.g.isna()]["_q_x"].isna().all() and got.g.isna().sum() == 4
    for g, part in got.dropna(subset=["g"]).groupby("g"):
        med = np.nanmedian(pdf[pdf.g == g].y)
        assert all(abs(q[0] - med) < 1e-12 for q in part["_q_y"])


def test_table_quantiles(frame):
    pdf, df = frame
    row = O.table_quantiles(df, ["x", "y"], [0.0, 0.25, 1.0]).first()
    np.testing.assert_allclose(row["y"], np.nanquantile(pdf.y, [0, 0.25, 1.0]), rtol=1e-12)


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_running_totals_with_ties(frame, ranges):
    pdf, df = frame
    long = O.long_form(df.where("g is not null"), ["g"], ["x"])
    counted = long.groupBy("g", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    got = O.running_totals(counted, ["g", "feature"], "value", {"n": F.col("n")}, ranges=ranges, ties=True)
    got = got.toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("value")
        np.testing.assert_array_equal(part.n.cumsum(), part.n_upto)
        assert (part.n_total == part.n.sum()).all() and (part.n_ties == part.n).all()
        np.testing.assert_array_equal(part.value.iloc[1:], part.next_value.iloc[:-1])
        assert np.isnan(part.next_value.iloc[-1])


def test_all_missing_group_is_kept(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "g string, x double")
    for budget in (10**7, 1):
        got = {r["g"]: r["x"] for r in O.group_quantiles(df, ["g"], ["x"], [0.5], task_values=budget).collect()}
        assert got["b"] == [1.0] and not got["a"]


@pytest.mark.parametrize("points,ranges", [(2, 3), (11, 1), (250, 8)])
def test_grid_quantiles(frame, points, ranges):
    pdf, df = frame
    got = {r["feature"]: r["q"] for r in O.grid_quantiles(df, ["x", "y"], points, ranges).collect()}
    for f in ("x", "y"):
        want = np.nanquantile(pdf[f], np.linspace(0, 1, points))
        np.testing.assert_allclose(got[f], want, rtol=1e-9, atol=1e-12)


def test_grid_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(3.0, None)], "x double, y double")
    got = {r["feature"]: r["q"] for r in O.grid_quantiles(df, ["x", "y"], 4).collect()}
    assert got == {"x": [3.0] * 4}


def test_order_images_are_the_bits_in_order(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(-(2**63), 2**63 - 1, 20_000, dtype=np.int64)
    powers = np.ldexp(1.0, np.arange(-1074, 1024))
    edges = np.concatenate([powers, np.nextafter(powers, np.inf), np.nextafter(powers, 0), [0.0, -0.0, np.inf, 1.7976931348623157e308]])
    v = np.concatenate([bits.view(float), edges, -edges])
    v = v[~np.isnan(v)]
    got = spark.createDataFrame(pd.DataFrame({"v": v})).select("v", order_image(F.col("v")).alias("i")).toPandas()
    size = np.abs(got.v.to_numpy()).view(np.int64)
    np.testing.assert_array_equal(got.i.to_numpy(), np.where(got.v < 0, -size, size))


@pytest.mark.parametrize("enough", [0, 3, 50, 10**6])
def test_select_ranks(frame, enough):
    pdf, df = frame
    got = O.select_ranks(df.where("g is not null"), ["g"], ["x", "y"], [0, 0.31, 0.5, 1], enough).collect()
    known = pdf.dropna(subset=["g"])
    seen = set()
    for r in got:
        values = np.sort(known[known.g == r["g"]][r["feature"]].dropna().to_numpy())
        want = values[r["rank"]]
        seen.add((r["g"], r["feature"], r["rank"]))
        assert r["n"] == len(values) and r["inside"] > 0
        if r["value"] is not None:
            assert r["value"] == want
        else:
            size = np.abs(values).view(np.int64)
            image = np.where(values < 0, -size, size)
            assert r["below"] == (image < r["low"]).sum() and r["inside"] == ((r["low"] <= image) & (image <= r["high"])).sum() <= enough
            assert r["below"] <= r["rank"] < r["below"] + r["inside"]
    for g, part in known.groupby("g"):
        for f in ("x", "y"):
            n = part[f].count()
            assert {(g, f, int(k(p * (n - 1)))) for p in (0, 0.31, 0.5, 1) for k in (np.floor, np.ceil)} <= seen


@pytest.mark.parametrize("task_values", [10**7, 400, 12, 1])
def test_quantiles_of_hard_values(spark, task_values):
    """One value in most rows, infinities, signs, neighbours in the last bit, values over the whole range."""
    rng = np.random.default_rng(11)
    hard = np.concatenate([
        np.full(300, 7.25), -np.exp(rng.uniform(-700, 700, 100)), np.exp(rng.uniform(-700, 700, 100)),
        1e6 + np.arange(120) * 2.0**-33, [np.inf, -np.inf, 0.0, -0.0, 5e-324], np.full(40, -3.0),
    ])
    pdf = pd.DataFrame({"g": "a", "x": hard, "y": rng.permutation(hard) * 0.5})
    pdf = pd.concat([pdf, pd.DataFrame({"g": ["b"] * 3, "x": [1.0, np.nan, 2.0], "y": [np.nan] * 3})])
    probs = [0.0, 0.1, 0.35, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in O.group_quantiles(spark.createDataFrame(pdf), ["g"], ["x", "y"], probs, task_values=task_values).collect()}
    assert got["b"]["x"] == [1.0, 1.1, 1.35, 1.5, 1.9, 2.0] and got["b"]["y"] == []
    for f in ("x", "y"):
        values = np.sort(pdf[pdf.g == "a"][f].to_numpy())
        for p, q in zip(probs, got["a"][f]):
            h = p * (len(values) - 1)
            lo, hi = int(np.floor(h)), int(np.ceil(h))
            want = values[lo] if lo == hi else (hi - h) * values[lo] + (h - lo) * values[hi]
            assert q == pytest.approx(want, rel=1e-12)


def test_ranges_follow_the_size_of_a_group(spark):
    rows = [("small", float(i)) for i in range(40)] + [("large", float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = O.assign_ranges(df, ["g"], "value", 64).groupBy("g").agg(F.countDistinct("_range").alias("r")).collect()
    ranges = {r["g"]: r["r"] for r in got}
    assert ranges["large"] > 50 and ranges["small"] <= 6


def test_large_groups_are_narrowed_in_one_counting_pass(spark):
    """Radix passes over all values took most of the time; now few values are left after bounds and one count."""
    n = 200_000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.xxhash64("id").cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    ranks, left = O._selected(df, ["g"], ["x", "y"], [0.1, 0.5], 10_000)
    assert left.count() < 0.02 * n and left.where("feature = 'y'").isEmpty()
    values = {g: np.sort([r["x"] for r in df.where(F.col("g") == g).collect()]) for g in (0, 1)}
    got = {r["g"]: r for r in O.group_quantiles(df, ["g"], ["x", "y"], [0.1, 0.5], [F.count("*").alias("n")], 100_000).collect()}
    for g, v in values.items():
        np.testing.assert_allclose(got[g]["x"], np.quantile(v, [0.1, 0.5]), rtol=1e-12)
        assert got[g]["n"] == n // 2 and got[g]["y"] == [0.0, 2.0]


def _written(spark, tmp_path, rows=20_000):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], rows), "x": rng.normal(size=rows), "y": rng.normal(size=rows)})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "t"))
    return pdf, spark.read.parquet(str(tmp_path / "t"))


def test_only_rows_near_a_wanted_rank_are_stacked(spark, tmp_path, monkeypatch):
    pdf, df = _written(spark, tmp_path)
    stacked, plain = [], O.long_form

    def counted(some, ids, features):
        stacked.append(some.count())
        return plain(some, ids, features)

    monkeypatch.setattr(O, "long_form", counted)
    got = {r["g"]: r for r in O.group_quantiles(df, ["g"], ["x", "y"], [0.5], task_values=1000).collect()}
    for g, part in pdf.groupby("g"):
        for f in ("x", "y"):
            np.testing.assert_allclose(got[g][f], [np.median(part[f])], rtol=1e-12)
    assert 0 < sum(stacked) < len(pdf) / 10


def test_rows_are_not_read_again_where_all_groups_are_large(spark, tmp_path):
    pdf, df = _written(spark, tmp_path)
    large = O.group_quantiles(df, ["g"], ["x"], [0.5], task_values=1000)
    assert not set(large.inputFiles()) & set(df.inputFiles())
    assert {r["g"]: r["x"][0] for r in large.collect()} == pytest.approx(pdf.groupby("g").x.median().to_dict(), rel=1e-12)
    few = df.unionByName(spark.createDataFrame([("c", 1.0, 2.0), ("c", 3.0, None)], df.schema))
    mixed = {r["g"]: r["x"][0] for r in O.group_quantiles(few, ["g"], ["x"], [0.5], task_values=1000).collect()}
    assert mixed == pytest.approx({**pdf.groupby("g").x.median().to_dict(), "c": 2.0}, rel=1e-12)


def test_cuts_share_the_shuffle_of_the_counted_rows(spark, tmp_path, capsys):
    _, df = _written(spark, tmp_path)
    counted = O.long_form(df, ["g"], ["x", "y"]).groupBy("g", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    got = O.running_totals(counted, ["g", "feature"], "value", {"n": F.col("n")})
    got.collect()
    got.explain("formatted")
    # The cuts read the shuffle of the counted rows, the totals that of the ranges.
    assert capsys.readouterr().out.count("- ReusedExchange") == 2
