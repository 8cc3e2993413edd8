import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewise.operators import categories as C
from platewise.operators import correlate as K
from platewise.operators import distance as D
from platewise.operators import embedding as E
from platewise.operators import scaling as S
from platewise.roles import Roles

R = Roles(days=("D1",), concentrations=(2, 3, 11))


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    n = 240
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=["a", "b", "c"])
    pdf["c"] = pdf.a * 0.7 + pdf.c * 0.4
    pdf["id"] = np.arange(n)
    pdf["Concentration"] = rng.choice([2, 3, 11], n).astype(np.int32)
    return pdf, spark.createDataFrame(pdf)


def rbf_mean(x, y, gamma=0.24):
    d2 = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    return np.exp(-gamma * d2).mean()


@pytest.mark.parametrize("block_rows", [7, 40, 5000])
def test_mmd_matches_brute_force_in_any_blocking(cloud, spark, block_rows):
    pdf, df = cloud
    twice = df.unionByName(df.where("Concentration = 3"))
    vec = twice.select("Concentration", D.vector_of(["a", "b", "c"]).alias("v"))
    got = {r["Group_B"]: r["MMD_Score"] for r in D.mmd(vec, "Concentration", 11, [3, 2, 5], block_rows=block_rows).collect()}
    x = pdf[pdf.Concentration == 11][["a", "b", "c"]].to_numpy()
    for c in (2, 3):
        y = pdf[pdf.Concentration == c][["a", "b", "c"]].to_numpy()
        want = rbf_mean(x, x) + rbf_mean(y, y) - 2 * rbf_mean(x, y)
        assert abs(got[c] - want) < 1e-12
    assert 5 not in got


def test_mmd_of_equal_populations_is_zero(cloud, spark):
    _, df = cloud
    same = df.where("Concentration = 11")
    both = same.unionByName(same.withColumn("Concentration", F.lit(2).cast("int")))
    vec = both.select("Concentration", D.vector_of(["a", "b"]).alias("v"))
    assert abs(D.mmd(vec, "Concentration", 11, [2], block_rows=10).first()["MMD_Score"]) < 1e-12


def test_mmd_without_control(cloud):
    _, df = cloud
    vec = df.where("Concentration <> 11").select("Concentration", D.vector_of(["a"]).alias("v"))
    assert D.mmd(vec, "Concentration", 11, [2]).collect() == []


def test_mahalanobis_matches_numpy(cloud):
    pdf, df = cloud
    vec = df.select("Concentration", D.vector_of(["a", "b", "c"]).alias("v"))
    got = {r["Group_B"]: r["Mahalanobis_Score"] for r in D.mahalanobis(vec, "Concentration", 11, [3, 2]).collect()}
    x = pdf[pdf.Concentration == 11][["a", "b", "c"]].to_numpy()
    inv = np.linalg.inv(np.cov(x, rowvar=False))
    for c in (2, 3):
        off = pdf[pdf.Concentration == c][["a", "b", "c"]].to_numpy() - x.mean(axis=0)
        want = np.sqrt(np.einsum("ij,jk,ik->i", off, inv, off)).mean()
        assert abs(got[c] - want) < 1e-9


def test_singular_covariance_gets_a_ridge():
    inv = D._inverse(np.array([[1.0, 1.0], [1.0, 1.0]]))
    np.testing.assert_allclose(inv @ (np.ones((2, 2)) + np.eye(2) * 1e-6), np.eye(2), atol=1e-6)


def test_population_distances_drop_incomplete_features(cloud):
    _, df = cloud
    inf = F.lit(float("inf"))
    flawed = df.withColumn("gone", F.when(F.col("Concentration") == 2, inf).otherwise(F.lit(1.0)))
    flawed = flawed.withColumn("a", F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("a")))
    got = D.population_distances(flawed.drop("id"), R, "D1")
    rows = {r["Group_B"]: r for r in got.collect()}
    assert set(rows) == {2, 3} and got.columns == ["Group_A", "Group_B", "MMD_Score", "Mahalanobis_Score", "EMD_Score", "Condition"]
    assert all(r["EMD_Score"] > 0 and r["Mahalanobis_Score"] > 0 for r in rows.values())


@pytest.mark.parametrize("block_rows", [30, 1000])
def test_knn_matches_brute_force(cloud, block_rows):
    pdf, df = cloud
    vec = df.select("id", D.vector_of(["a", "b", "c"]).alias("v"))
    got = E.knn(vec, "id", "v", 5, block_rows).toPandas().sort_values(["id", "rank"])
    x = pdf[["a", "b", "c"]].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    np.testing.assert_array_equal(got.neighbour.to_numpy().reshape(-1, 5), want)
    assert (got[got["rank"] == 1].neighbour.to_numpy() == got[got["rank"] == 1].id.to_numpy()).all()


def test_knn_skips_far_blocks(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(100, 5)) + c for c in rng.normal(size=(12, 5)) * 60])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = E.knn(df, "id", "v", 4, 50).toPandas().sort_values(["id", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.testing.assert_array_equal(got.neighbour.to_numpy().reshape(-1, 4), np.argsort(d, axis=1, kind="stable")[:, :4])
    blocks = E.neighbour_blocks(df, "id", "v", 50)
    sizes = blocks.groupBy("block").count().collect()
    assert max(r["count"] for r in sizes) <= 50 and sum(r["count"] for r in sizes) == 1200
    reach = blocks.select("block").distinct().withColumn("reach", F.lit(15.0))
    pairs = E.block_pairs(blocks, reach).count()
    # All pairs of blocks would copy every row to twice the number of blocks.
    assert pairs < 0.2 * len(sizes) ** 2


def test_closest_rows_keep_ties_and_exact_distances():
    rng = np.random.default_rng(21)
    b = np.concatenate([rng.normal(size=(300, 8)), np.tile(rng.normal(size=(1, 8)), (40, 1)), 1e6 + rng.normal(size=(50, 8))])
    a = np.concatenate([b[::3], rng.normal(size=(20, 8)), [[np.inf] * 8, [np.nan] * 8]])
    with np.errstate(all="ignore"):
        d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    for keep in (1, 7, len(b)):
        near, far = E._closest_rows()(a, b, keep)
        want = np.argsort(d, axis=1, kind="stable")[:, :keep]
        np.testing.assert_array_equal(near, want)
        np.testing.assert_array_equal(far, np.take_along_axis(d, want, axis=1))


def test_knn_of_equal_vectors_and_few_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)] + [(99, [5.0, 2.0])], "id long, v array<double>")
    got = {}
    for r in E.knn(df, "id", "v", 3, 7).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    assert all(sorted(v) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)] for i, v in got.items() if i != 99)
    assert sorted(got[99]) == [(1, 99, 0.0), (2, 0, 4.0), (3, 1, 4.0)]
    assert E.knn(df.limit(2), "id", "v", 15).count() == 4


def quantile_reference(x, n):
    if n == len(x):  # every row is a reference: its mean rank
        return (pd.Series(x).rank().to_numpy() - 1) / (n - 1) * (x > x.min()) * (x < x.max()) + (x == x.max())
    grid = np.linspace(0, 1, n)
    q = np.percentile(x, grid * 100)
    u = 0.5 * (np.interp(x, q, grid) - np.interp(-x, -q[::-1], -grid[::-1]))
    u[x == q[-1]] = 1
    u[x == q[0]] = 0
    return u


@pytest.mark.parametrize("quantiles", [1000, 20])
def test_quantile_uniform_ties_constants_and_holes(spark, quantiles):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.zeros(30), rng.normal(size=70).round(1)])
    pdf = pd.DataFrame({"x": x, "k": 3.0})
    got = S.quantile_uniform(spark.createDataFrame(pdf), ["x", "k"], quantiles).toPandas()
    np.testing.assert_allclose(np.sort(got.x), np.sort(quantile_reference(x, min(quantiles, 100))), atol=1e-12)
    assert (got.k == 0).all()
    holed = spark.createDataFrame([(1.0,), (None,), (2.0,)], "x double")
    assert sorted(str(r["x"]) for r in S.quantile_uniform(holed, ["x"]).collect()) == ["0.0", "1.0", "None"]


def test_imputation_and_scaling_edges(spark):
    df = spark.createDataFrame([(1, 1.0, None, 5.0), (1, 3.0, None, 5.0), (2, None, None, 5.0), (2, 8.0, 2.0, 5.0)], "g int, x double, y double, k double")
    assert sorted(r["x"] for r in S.impute_mean(df, ["x"]).collect()) == [1.0, 3.0, 4.0, 8.0]
    out, known = S.impute_group_mean(df, "g", [1, 2], ["x", "y"])
    assert known == ["x"] and sorted(r["x"] for r in out.collect()) == [1.0, 3.0, 8.0, 8.0]
    out, known = S.impute_median(df.withColumn("none", F.lit(None).cast("double")), ["x", "none"])
    assert known == ["x"] and "none" not in out.columns
    scaled = S.min_max(df, ["x", "k"]).collect()
    assert [r["k"] for r in scaled] == [0.0] * 4 and {r["x"] for r in scaled} == {0.0, 2 / 7, 1.0, None}
    assert all(r["k"] is None for r in S.clip_scale(df, ["k"]).collect())
    values = spark.createDataFrame([(float("nan"),), (float("-inf"),), (1e12,), (-2e12,)], "v double")
    assert [r["v"] for r in S.sanitize_columns(values, ["v"]).collect()] == [None, None, 1e12, None]


def test_density_matches_gaussian_kde_and_flat(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "flat": 2.0}))
    got = E.density(df, ["x", "flat"], points=50).toPandas()
    v = np.clip(x, *np.percentile(x, [5, 95]))
    w = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min() - 3 * w, v.max() + 3 * w, 50)
    want = np.exp(-0.5 * ((grid[:, None] - v) / w) ** 2).sum(axis=1) / (len(v) * w * np.sqrt(2 * np.pi))
    one = got[got.feature == "x"].sort_values("point")
    np.testing.assert_allclose(one.x, grid, atol=1e-12)
    np.testing.assert_allclose(one.density, want, atol=1e-12)
    assert (got[got.feature == "flat"].density == 0).all() and (got.feature == "flat").sum() == 50


def test_density_between_far_lumps_is_zero_and_kernels_stay_in_reach(spark):
    x = np.concatenate([np.linspace(0, 1, 4000), [1000.0, 1000.5]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = E.density(df, ["x"], 0, 100).toPandas().sort_values("point")
    w = x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((got.x.to_numpy()[:, None] - x) / w) ** 2).sum(axis=1) / (len(x) * w * np.sqrt(2 * np.pi))
    assert len(got) == 200 and got.density.min() == 0
    np.testing.assert_allclose(got.density, want, atol=1e-15)
    values = df.select(F.lit("x").alias("feature"), F.col("x").alias("value"), F.lit(1).alias("n"))
    low, high = x.min() - 3 * w, x.max() + 3 * w
    shape = df.limit(1).select(F.lit("x").alias("feature"), F.lit(w).alias("bandwidth"), F.lit(low).alias("_low"), F.lit(high).alias("_high"))
    rows = E.kernel_rows(values, shape)
    grid = np.linspace(low, high, 200)
    assert rows.count() == (np.abs(grid[:, None] - x) <= 9 * w).sum() < 0.2 * 200 * len(x)


def test_embedding_is_keyed_and_oriented(cloud):
    pdf, df = cloud
    got = E.embed(df, "id", ["a", "b", "c"], 2, scale=False).toPandas().sort_values("id")
    x = pdf[["a", "b", "c"]].to_numpy()
    _, vec = np.linalg.eigh(np.cov(x, rowvar=False))
    for j in range(2):
        v = vec[:, 2 - j]
        v = v if v[np.argmax(np.abs(v))] >= 0 else -v
        np.testing.assert_allclose(got[f"dim{j + 1}"], x @ v, atol=1e-9)
    third = E.embed(df.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), "id", ["a", "b", "c"], 3)
    assert third.columns == ["id", "dim1", "dim2", "dim3"] and third.count() == len(pdf)


def naive_average_linkage(d, below):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min(((np.mean([d[a, b] for a in g for b in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j))
        if not best[0] < below:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(sorted(g) for g in groups)


def test_clusters_match_naive_average_linkage(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 60))
    y = np.vstack([x[i % 4] + rng.normal(scale=0.45, size=60) for i in range(14)])
    d = 1 - np.abs(np.corrcoef(y))
    names = [f"f{i:02d}" for i in range(14)]
    rows = [(names[i], names[j], float(d[i, j])) for i in range(14) for j in range(i + 1, 14)]
    pairs = spark.createDataFrame(rows, "feature_a string, feature_b string, distance double")
    for below in (0.1, 0.2, 0.3):
        got = [r["features"] for r in K.cluster_features(pairs, below).orderBy("cluster").collect()]
        assert got == [[names[i] for i in g] for g in naive_average_linkage(d, below)]
    clusters = K.cluster_features(pairs, 0.3)
    assert {r[0] for r in K.representatives(clusters).collect()} == {g[0] for g in got}
    assert {(r["members"], r["flagged"]) for r in K.cluster_sizes(clusters).collect()} == {(len(g), len(g) > 2) for g in got}


def test_correlation_of_constant_and_empty_columns(spark):
    rows = [("D1", "BR1", f"B{i}", float(i), 1.0, None, float(-i)) for i in range(2, 8)]
    df = spark.createDataFrame(rows, "Metadata_Day string, Metadata_Biorep string, Metadata_Well string, x double, k double, e double, m double")
    got = {(r["feature_a"], r["feature_b"]): r for r in K.feature_correlation(df, R).withColumn("d", K.corr_distance("r")).collect()}
    assert got["m", "x"]["d"] < 1e-12 and abs(got["m", "x"]["r"] + 1) < 1e-12
    assert got["k", "x"]["r"] is None and got["k", "x"]["d"] == 1.0 and got["e", "k"]["d"] == 1.0
    assert {r[0] for r in K.prune_correlated(df, R).collect()} == {"e", "k", "m"}


def test_category_guesses(spark):
    names = ["counts_RelateLysoCell", "rp_norm_Texture_x_GrayMito_Cells", "rp_norm_Mean_PunctaLyso_d_Cells", "rp_norm_AreaShape_FilteredNuclei_Cells", "raw_x", "rp_norm_Odd"]
    df = spark.createDataFrame([(n,) for n in names], "feature string").withColumn("category", C.guess_category("feature"))
    got = [(r["category"], r["organelle"]) for r in df.withColumn("organelle", C.guess_organelle("feature", F.col("category"))).collect()]
    assert got == [("Counts", "Lysosomes"), ("Texture", "Mitochondria"), ("Correlation", "Other"), ("AreaShape", "Other"), ("", ""), ("Odd", "")]


def test_lookup_upsert_crosstab_and_reasons(spark):
    schema = "feature string, category string, organelle string"
    lookup = spark.createDataFrame([("a", "Texture", "Nuclei"), ("b", "", "Golgi"), ("old", "Number", "Other"), ("c", "Odd", "")], schema)
    names = spark.createDataFrame([("a",), ("a",), ("raw",), ("",)], "feature string")
    got = {r["feature"]: (r["category"], r["added"], r["unresolved"]) for r in C.upsert_lookup(lookup, names).collect()}
    assert got == {"a": ("Texture", False, False), "b": ("", False, False), "old": ("Number", False, False), "c": ("Odd", False, False), "raw": ("", True, True)}
    selected = spark.createDataFrame([("a",), ("b",), ("old",), ("c",), ("zzz",)], "feature string")
    reasons = {r["feature"]: r["reason"] for r in C.unplaced(selected, lookup).collect()}
    assert reasons == {
        "b": "category blank; organelle 'Golgi' is not in organelle_labels",
        "c": "category 'Odd' is not in category_labels; organelle blank",
        "zzz": "not in the lookup",
    }
    table = [tuple(r) for r in C.crosstab(selected, lookup).orderBy("position").collect()]
    assert [t[1] for t in table] == list(C.ORGANELLE_ROWS)
    assert table[0][2:] == (None, None, None, None, None, 1, None) and table[3][2] == 1
    assert {r["category"]: r["features"] for r in C.margins(selected, lookup).collect()} == {None: 2, "Texture": 1, "Counts": 1}
    header = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, ""), (4, "")], "pos int, name string")
    assert [tuple(r) for r in C.duplicate_names(header).collect()] == [("x", 2)]
