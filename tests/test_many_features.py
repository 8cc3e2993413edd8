"""Operators on more features than passes hold as columns side by side."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewise.operators import embedding as E
from platewise.operators import ordered as O

NAMES = [f"f{i}" for i in range(12)]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) * rng.uniform(0.5, 20, 12)
    x[:, 1] = np.round(x[:, 1])
    x[:, 2] = 7.25
    x[rng.random(300) < 0.2, 3] = np.nan
    x[:, 4] = np.nan
    x[:4, 5] = [np.inf, -np.inf, 0.0, -0.0]
    pdf = pd.DataFrame(x, columns=NAMES).assign(g=rng.choice(["a", "a", "b"], 300), id=np.arange(300))
    pdf.loc[pdf.g == "b", "f6"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("f7", F.when(F.col("id") % 3 > 0, F.col("f7")))


def column(pdf, f):
    return pdf[f].where(pdf["id"] % 3 > 0) if f == "f7" else pdf[f]


def quantiles(values, probs):
    values = np.sort(values.dropna().to_numpy())
    if not len(values):
        return None
    at = [p * (len(values) - 1) for p in probs]
    ends = [(h, int(np.floor(h)), int(np.ceil(h))) for h in at]
    return [values[lo] if lo == hi else (hi - h) * values[lo] + (h - lo) * values[hi] for h, lo, hi in ends]


def test_table_quantiles_of_many_features(wide, monkeypatch):
    pdf, df = wide
    monkeypatch.setattr(O, "SKETCHED_FEATURES", 5)
    probs = [0.0, 0.05, 0.5, 1.0]
    row = O.table_quantiles(df, NAMES, probs).first()
    for f in NAMES:
        want = quantiles(column(pdf, f), probs)
        assert row[f] == (want if want is None else pytest.approx(want, rel=1e-12)), f
    assert O.table_quantiles(df.where("id < 0"), NAMES, probs).first()["f0"] is None


@pytest.mark.parametrize("budget", [2000, 1])
def test_group_quantiles_of_many_features(wide, budget):
    pdf, df = wide
    got = {r["g"]: r for r in O.group_quantiles(df, ["g"], NAMES, [0.1, 0.5], [F.count(F.lit(1)).alias("n")], budget).collect()}
    assert set(got) == {"a", "b"}
    for g, part in pdf.groupby("g"):
        assert got[g]["n"] == len(part)
        for f in NAMES:
            assert got[g][f] == pytest.approx(quantiles(column(part, f), [0.1, 0.5]) or [], rel=1e-12), (g, f)


def test_few_and_many_features_agree(wide, monkeypatch):
    _, df = wide
    some = NAMES[:8]
    few = O.table_quantiles(df, some, [0.25, 0.9]).first()
    monkeypatch.setattr(O, "WIDE_FEATURES", 0)
    assert O.table_quantiles(df, some, [0.25, 0.9]).first() == few


@pytest.mark.parametrize("step", ["median", "embedded", "uniform", "three", "coloured", "clipped"])
def test_no_filter_reads_many_features(wide, monkeypatch, step):
    """The optimizer's time and memory doubled with each of them: 64 features filled a driver's heap of 750 MB on 500 rows."""
    pdf, df = wide
    plain, seen = O.stage, []

    def watched(some, name):
        plan = some._jdf.queryExecution().analyzed().toString()
        seen.append(name)
        for line in plan.splitlines():
            if re.match(r"[ :+-]*Filter ", line):
                assert len(set(re.findall(r"\b(?:_v|f)\d+#", line))) <= O.WIDE_FEATURES, name
        return plain(some, name)

    monkeypatch.setattr(O, "stage", watched)
    monkeypatch.setattr(E, "stage", watched)
    if step in ("median", "uniform"):
        ready, known = E.ready_features(df, NAMES, step == "uniform")
        got = ready.orderBy("id").toPandas()
        assert known == [f for f in NAMES if f != "f4"] and len(got) == len(pdf)
        assert not got[known].isna().any().any()
        finite = column(pdf, "f3").replace([np.inf, -np.inf], np.nan)
        if step == "median":
            np.testing.assert_allclose(got.f3, finite.fillna(finite.median()), rtol=1e-12)
        else:
            assert got[known].min().min() >= 0 and got[known].max().max() <= 1
            assert got.f0.rank().tolist() == pdf.f0.rank().tolist()
    elif step == "clipped":
        # f7 lacks 100 values, and f2 has no spread.
        coords = df.select("id", F.col("f0").alias("dim1"))
        got = E.embedding_features(coords, df, "id", [f for f in NAMES if f != "f4"])
        rows = got.where("feature = 'f8'").orderBy("id").toPandas()
        lo, hi = np.percentile(pdf.f8, [5, 95])
        np.testing.assert_allclose(rows["value"], (pdf.f8.clip(lo, hi) - lo) / (hi - lo), rtol=1e-9, atol=1e-12)
        assert got.groupBy("missing").count().orderBy("missing").collect() == [(False, 11 * 300 - 400), (True, 400)]
    else:
        k, scale = (3, True) if step == "three" else (2, False)
        coords = E.embed(df, "id", NAMES, k, scale)
        got = coords.orderBy("id").toPandas()
        if step == "coloured":
            rows = E.embedding_features(coords, df, "id", NAMES)
            assert rows.groupBy("feature").count().where("count = 300").count() == 12
            rows = rows.where("feature = 'f8'").orderBy("id").toPandas()
            np.testing.assert_allclose(rows[["dim1", "dim2"]], got[["dim1", "dim2"]], rtol=1e-9)
            assert rows["value"].between(0, 1).all() and rows["value"].nunique() == pdf.f8.clip(*np.percentile(pdf.f8, [5, 95])).nunique()
        ready, known = E.ready_features(df, NAMES, scale)
        x = ready.orderBy("id").toPandas()[known].to_numpy()
        _, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
        for j in range(1, k + 1):
            axis = vectors[:, -j]
            axis = axis * (1 if axis[np.argmax(np.abs(axis))] >= 0 else -1)
            np.testing.assert_allclose(got[f"dim{j}"], x @ axis, rtol=1e-6, atol=1e-6)
    assert "rank-values" in seen
