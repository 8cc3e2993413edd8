"""Curve fits against known parameters, a dense search and the curves they contain."""

import numpy as np
import pytest

from platewise.functions import curves as C
from platewise.operators import doseresponse as M

X = np.arange(8.0)
LOGX = np.log(X + 1e-10)
MODELS = list(M.CURVES)


def _shape(model, b, e):
    z = np.exp(np.minimum(b * (LOGX - np.log(e)), 700.0))
    return np.exp(-z) if model == "WB1.4" else 1 / (1 + z)


def _series(count, seed):
    rng = np.random.default_rng(seed)
    return np.array([
        rng.normal(size=8) * rng.choice([0.01, 0.1, 1]) + rng.normal() * X * 0.3 + rng.normal() * (X > rng.integers(1, 7))
        for _ in range(count)
    ])


@pytest.mark.parametrize("model", MODELS)
@pytest.mark.parametrize("b, e", [(2.0, 3.0), (-1.5, 4.5), (0.03, 2.0), (5.0, 60.0), (0.8, 0.004), (30.0, 3.1)])
def test_known_parameters_inside_and_outside_any_box(model, b, e):
    g = _shape(model, b, e)
    y = (0.0 if model == "BC4" else 0.4) + 1.7 * g + (0.25 * X * g if model in C.WITH_X else 0.0)
    _, _, ssr = C.fit(y[None], [model])[model]
    # What the steps leave, against the spread of the series.
    assert ssr[0] <= 1e-7 * max(((y - y.mean()) ** 2).sum(), 1e-12)


@pytest.mark.parametrize("model", MODELS)
def test_no_point_of_a_dense_grid_is_better(model):
    ys = _series(12, 3)
    _, _, ssr = C.fit(ys, [model])[model]
    use = ys if model == "BC4" else ys - ys.mean(axis=1, keepdims=True)
    for sign in (1, -1):
        b, m = np.meshgrid(sign * np.geomspace(0.01, 300, 150), np.linspace(-24, 24, 900), indexing="ij")
        p, q = C._basis(model, X, b, m)
        miss = (use**2).sum(axis=1) - (np.einsum("sn,bmn->sbm", use, p) ** 2 + np.einsum("sn,bmn->sbm", use, q) ** 2).max(axis=(1, 2))
        assert (ssr <= miss * (1 + 1e-6) + 1e-12).all()


def test_contained_curves_never_fit_better():
    ys = _series(40, 5)
    got = {m: v[2] for m, v in C.fit(ys, MODELS).items()}
    constant = ((ys - ys.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    assert (got["BC5"] <= got["BC4"] * (1 + 1e-9)).all() and (got["BC5"] <= got["LL4"] * (1 + 1e-9)).all()
    assert (got["LL4"] <= constant).all() and (got["WB1.4"] <= constant).all()


def test_scale_values_and_sizes():
    ys = _series(6, 7)
    plain, huge = C.fit(ys, ["LL4"])["LL4"], C.fit(ys * 2.0**400, ["LL4"])["LL4"]
    np.testing.assert_allclose(huge[2] / 2.0**800, plain[2], rtol=1e-9)
    flawed = np.vstack([ys[:2], np.full(8, np.nan), np.r_[np.inf, np.zeros(7)]])
    b, e, ssr = C.fit(flawed, ["BC5"])["BC5"]
    assert np.isfinite(ssr[:2]).all() and np.isnan(ssr[2:]).all() and np.isnan(b[2:]).all()
    assert all(len(v) == 0 for v in C.fit(np.empty((0, 8)), ["LL4"])["LL4"])
    # Series of a chunk do not influence each other.
    many = _series(C.CHUNK + 5, 9)
    whole, alone = C.fit(many, ["WB1.4"])["WB1.4"][2], C.fit(many[-3:], ["WB1.4"])["WB1.4"][2]
    np.testing.assert_allclose(whole[-3:], alone, rtol=1e-9)


def test_series_in_spark_keep_their_keys(spark):
    ys = _series(5, 11)
    rows = [(f"f{i}", "D1", [float(v) for v in y]) for i, y in enumerate(ys)] + [("bad", None, [float("nan")] * 8)]
    got = M.fit_curves(spark.createDataFrame(rows, "Feature string, Day string, y array<double>"), 8).collect()
    want = C.fit(ys, MODELS)
    assert len(got) == 4 * len(rows)
    for r in got:
        if r["Feature"] == "bad":
            assert r["ssr"] is None and r["b"] is None and r["Day"] is None
        else:
            assert r["ssr"] == pytest.approx(want[r["Model"]][2][int(r["Feature"][1:])], rel=1e-9)
    empty = spark.createDataFrame([], "Feature string, Day string, y array<double>")
    assert M.fit_curves(empty, 8).count() == 0
