"""Many hot groups, tail probabilities of any size, samples by hash thresholds, populations without control."""

from __future__ import annotations

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from platewise import session
from platewise.functions.numeric import chi2_tail
from platewise.operators import correlate, moments
from platewise.operators import distance as D
from platewise.operators import ordered as O
from platewise.operators import qc, subsets
from platewise.roles import Roles


def test_every_group_can_be_hot(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 300, 3000), rng.normal(size=3000).round(2))]
    df = spark.createDataFrame([*rows, (None, 1.0), (999, None)], "g int, x double")
    assert O._crowded(df.where("g is not null"), ["g"], 1).count() == 300
    got = {r["g"]: r["x"] for r in O.group_quantiles(df, ["g"], ["x"], [0.5, 0.9], task_values=1).collect()}
    for g in {g for g, _ in rows}:
        np.testing.assert_allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.5, 0.9]), rtol=1e-12)


def test_statistics_are_joined_back_without_a_shuffle_of_rows(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("g"), F.col("id").cast("double").alias("x"))
    plan = O.with_group_quantiles(df, ["g"], ["x"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "hashpartitioning" not in plan


def survival(x, df):
    """The same by the series of the other side, in logarithms."""
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    return 1 - math.fsum(math.exp((a + i) * math.log(y) - y - math.lgamma(a + i + 1)) for i in range(6000))


@pytest.mark.parametrize("x,df", [(300, 300), (401, 400), (450, 500), (399, 350), (3.84, 1), (1e-9, 1), (5.99, 2), (0.0, 4), (1.0, 7), (2000, 2001), (12.5, 1), (12.4, 1)])
def test_chi2_tail(spark, x, df):
    got = spark.createDataFrame([(float(x), float(df))], "x double, d double").select(chi2_tail(F.col("x"), F.col("d"))).first()[0]
    assert got == pytest.approx(survival(x, df), abs=2e-12)


def test_chi2_small_tails_keep_their_digits(spark):
    got = spark.createDataFrame([(700.0, 2.0), (600.0, 1.0)], "x double, d double").select(chi2_tail(F.col("x"), F.col("d"))).collect()
    assert got[0][0] == pytest.approx(math.exp(-350), rel=1e-10)
    assert got[1][0] == pytest.approx(math.erfc(math.sqrt(300)), rel=1e-10)


@pytest.mark.parametrize("cap", [0, 1, 7, 400, 10**6])
def test_samples_are_the_smallest_hashes(spark, cap):
    rng = random.Random(1)
    rows = [(f"c{i}", rng.choice(["D1", "D1", "D5", "D9"]), rng.choice([2, 11])) for i in range(900)]
    df = spark.createDataFrame(rows, "cell_ID string, Metadata_Day string, Concentration int")
    roles = Roles(days=("D1", "D5"), concentrations=(2, 3, 11))
    got = {r["cell_ID"] for r in subsets.sample_capped(df, roles, cap=cap).collect()}
    want = set()
    for day in ("D1", "D5"):
        for dose in (2, 11):
            ids = [c for c, d, k in rows if (d, k) == (day, dose)]
            want |= set(sorted(ids, key=lambda c: (hashlib.md5(f"{c}:1".encode()).hexdigest(), c))[:cap])
    assert got == want


def test_no_control_no_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), rng.normal(size=3).tolist()) for g in rng.integers(2, 5, 60)]
    df = spark.createDataFrame(rows, "g int, v array<double>")
    assert D.mahalanobis(df, "g", 11, [2, 3]).count() == 0
    assert D.mahalanobis(df.unionByName(spark.createDataFrame([(11, [0.0, 0.0, 0.0])], df.schema)), "g", 11, [2]).count() == 0
    assert D.mmd(df, "g", 11, [2, 3]).count() == 0


def test_mmd_plan_does_not_grow_with_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), rng.normal(size=2).tolist()) for g in rng.choice([2, 11], 400)]
    df = spark.createDataFrame(rows, "g int, v array<double>").cache()
    sizes = [len(D.mmd(df, "g", 11, [2], block_rows=b)._jdf.queryExecution().optimizedPlan().toString()) for b in (200, 5)]
    assert abs(sizes[0] - sizes[1]) < 200
    one, many = (D.mmd(df, "g", 11, [2], block_rows=b).first()["MMD_Score"] for b in (200, 5))
    assert one == pytest.approx(many, rel=1e-9)


def test_manifest_statuses(spark):
    files = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "file string")
    gone = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "remove string")
    got = sorted((tuple(r) for r in qc.split_manifest(files, gone).collect()), key=str)
    assert got == sorted([("a", "removed"), ("a", "removed"), ("b", "kept"), (None, "kept"), ("x", "missing")], key=str)


def test_stages_are_deleted(spark):
    df = spark.range(5).toDF("i")
    with session.stages(spark):
        path = session.new_folder(spark, "kept")
        df.write.parquet(path)
        assert session.stage(df, "inner").count() == 5
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
    path = session.new_folder(spark, "again")
    df.write.parquet(path)
    # A folder that is never written does no harm.
    session.new_folder(spark, "unused")
    with session.stages(spark):
        pass
    assert spark.read.parquet(path).count() == 5


@pytest.mark.parametrize("tile,held", [(256, 1 << 23), (3, 1 << 23), (2, 1)])
def test_moments_over_many_parts(spark, tile, held):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4)) * [1, 10, 0.1, 1] + [1e6, 0, -3, 5]
    rows = [("ab"[i % 3 == 0], r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(23)
    got = moments.moments(df, "v", ["g"], tile, held).collect()
    for g in "ab":
        own = np.array([v for h, v in rows if h == g])
        mean, scatter = moments.whole_scatter([r for r in got if r["g"] == g], tile)
        assert {r["n"] for r in got if r["g"] == g} == {len(own)}
        np.testing.assert_allclose(mean, own.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(scatter / (len(own) - 1), np.cov(own, rowvar=False), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("tile", [256, 3])
def test_pearson_pairs_by_tiles(spark, tile):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) + 1e4
    x[:, 3] = 0.1
    names = [f"f{i}" for i in range(7)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in correlate.pearson_pairs(df, names, tile).collect()}
    assert len(got) == 21
    for (a, b), r in got.items():
        i, j = int(a[1]), int(b[1])
        assert r is None if 3 in (i, j) else r == pytest.approx(np.corrcoef(x[:, i], x[:, j])[0, 1], abs=1e-9)


def greedy_average_linkage(names, dist, below):
    groups = [[i] for i in range(len(names))]
    while len(groups) > 1:
        d, a, b = min((np.mean([dist[x, y] for x in g for y in h]), a, b) for a, g in enumerate(groups) for b, h in enumerate(groups) if a < b)
        if d >= below:
            break
        groups[a] += groups.pop(b)
    return sorted(sorted(names[i] for i in g) for g in groups)


def test_chains_merge_like_the_closest_two_first():
    rng = np.random.default_rng(9)
    for below in (0.05, 0.1, 0.2, 0.6):
        for n in (1, 2, 9, 25):
            x = rng.uniform(size=(n, 2)) * 0.7
            d = np.abs(x[:, None] - x[None]).sum(axis=2)
            names = [f"f{i:02}" for i in range(n)]
            assert correlate._average_linkage(names, d, below) == greedy_average_linkage(names, d, below)


def test_a_component_of_many_features_is_linked_in_seconds():
    rng = np.random.default_rng(10)
    x = rng.uniform(size=(2500, 1))
    start = time.perf_counter()
    found = correlate._average_linkage([str(i) for i in range(2500)], np.abs(x - x.T), 0.1)
    assert time.perf_counter() - start < 20 and sum(map(len, found)) == 2500


def test_a_vector_is_copied_to_the_root_of_the_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(g, rng.normal(size=3).tolist()) for g in (11, 2) for _ in range(900)]
    df = spark.createDataFrame(rows, "g int, v array<double>").withColumn("day", F.lit("D1"))
    spread, _ = D.kernel_blocks(df, "g", 11, [2], "v", ["day"], block_rows=9)
    # 100 blocks of nine rows make 10 tiles: a vector meets 10 of its own population and 10 of the other.
    per_vector = spread.groupBy("v").agg(F.count("*").alias("n")).agg(F.max("n"), F.min("n")).first()
    assert tuple(per_vector) == (20, 20)


def test_days_side_by_side_equal_days_alone(spark):
    rng = np.random.default_rng(8)
    rows = [(d, int(g), *map(float, rng.normal(size=3))) for d in ("D1", "D5") for g in rng.choice([11, 2, 3], 80)]
    df = spark.createDataFrame(rows, "Metadata_Day string, Concentration int, a double, b double, c double")
    # On one day a feature is missing in a whole group, and one is constant.
    df = df.withColumn("b", F.when(~((F.col("Metadata_Day") == "D5") & (F.col("Concentration") == 2)), F.col("b")))
    df = df.withColumn("c", F.when(F.col("Metadata_Day") == "D1", F.lit(1.5)).otherwise(F.col("c")))
    roles = Roles(days=("D1", "D5", "D9"), concentrations=(2, 3, 11))
    every = {(r["Condition"], r["Group_B"]): r for r in D.distances_by_day(df, roles, ["a", "b", "c"]).collect()}
    assert set(every) == {(d, g) for d in ("D1", "D5") for g in (2, 3)}
    for d in ("D1", "D5"):
        for r in D.population_distances(df.where(F.col("Metadata_Day") == d), roles, d, ["a", "b", "c"]).collect():
            for c in ("MMD_Score", "Mahalanobis_Score", "EMD_Score"):
                assert every[d, r["Group_B"]][c] == pytest.approx(r[c], rel=1e-9)
    # The day's own features alone give the same scores.
    alone = D.population_distances(df.where("Metadata_Day = 'D5'").drop("b"), roles, "D5", ["a", "c"]).collect()
    for r in alone:
        assert all(every["D5", r["Group_B"]][c] == pytest.approx(r[c], rel=1e-9) for c in ("MMD_Score", "Mahalanobis_Score", "EMD_Score"))
