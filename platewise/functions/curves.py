"""Least-squares fits of dose-response curves, many series at a time.

Each curve is linear in all but two of its parameters: the slope ``b`` and the midpoint ``e``, searched as ln|b| and ln e.
Whatever they are, the linear ones are those of the least-squares solution, so they are projected out and damped
Gauss-Newton steps move the other two. A fit starts from the best local minima of a coarse grid on either side of b = 0
and from the optima of the curves it contains. The grid only places the starts: steps lead anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Fixed value: the offset inside the logarithms.
LOG_OFFSET = 1e-10
# Curves without an intercept, and those with a term x g beside g.
NO_INTERCEPT = ("BC4",)
WITH_X = ("BC4", "BC5")
# A curve contains these: their optima are starts of its own fit.
CONTAINS = {"BC5": ("BC4", "LL4")}

STARTS = 6  # per sign of b
STEPS = 600
CHUNK = 64
COLLINEAR = 1e-7
EXTREME = 700.0


def _grid(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of b and, per size, midpoints ln e: dense among the doses, sparse beyond, and where a steep curve bends at one."""
    u = np.log(x + LOG_OFFSET)
    inner = u[x > 0] if (x > 0).any() else np.zeros(1)
    near = np.linspace(inner.min() - 1.0, inner.max() + 1.0, 44)
    below = np.linspace(u.min() - 1.0, near[0], 16)
    above = np.linspace(near[-1], near[-1] + 16.0, 10)
    mids = np.unique(np.concatenate([below, near, above, inner]))
    sizes = np.geomspace(0.02, 200.0, 26)
    bends = inner[None, :, None] + np.array([-5.0, -2.5, 2.5, 5.0]) / sizes[:, None, None]
    return sizes, np.sort(np.hstack([np.tile(mids, (len(sizes), 1)), bends.reshape(len(sizes), -1)]), axis=1)


def _unit(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Vectors of length 1; zero where next to nothing is left of ``size``."""
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    ok = norm > size
    return np.where(ok, v / np.where(ok, norm, 1.0), 0.0)


def _largest_one(logs: np.ndarray) -> np.ndarray:
    """Numbers given by logarithms, scaled so that the largest is 1: no size of b or e leaves the range of doubles."""
    top = logs.max(-1, keepdims=True)
    return np.exp(logs - np.where(np.isfinite(top), top, 0.0))


def _basis(model: str, x: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions of g and x g (the latter zero in curves without it), free of the intercept."""
    s = b[..., None] * (np.log(x + LOG_OFFSET) - m[..., None])
    if model == "WB1.4":
        z = np.exp(np.minimum(s, EXTREME))
        g, rest = -z, np.where(s < -30.0, s, np.log(-np.expm1(-np.maximum(z, 1e-300))))
    else:
        g, rest = -np.logaddexp(0.0, s), -np.logaddexp(0.0, -s)
    if model in NO_INTERCEPT:
        first = _largest_one(g)
    else:
        # Beside an intercept 1 - g spans the same as g; the smaller one keeps its digits where the curve is nearly flat.
        low = np.median(s, axis=-1, keepdims=True) < 0
        first = _largest_one(np.where(low, rest, g))
        first = first - first.mean(-1, keepdims=True)
    p = _unit(first, np.full(first.shape[:-1] + (1,), 1e-13))
    if model not in WITH_X:
        return p, np.zeros_like(p)
    with np.errstate(divide="ignore"):
        second = _largest_one(g + np.log(x))
    if model not in NO_INTERCEPT:
        second = second - second.mean(-1, keepdims=True)
    size = COLLINEAR * np.linalg.norm(second, axis=-1, keepdims=True)
    for _ in range(2):
        second = second - (second * p).sum(-1, keepdims=True) * p
    return p, _unit(second, size)


def _left(model: str, x: np.ndarray, y: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Residuals of ``y`` (intercept taken out where the curve has one) beside the curve's span."""
    p, q = _basis(model, x, b, m)
    out = y - (y * p).sum(-1, keepdims=True) * p
    out = out - (out * q).sum(-1, keepdims=True) * q
    return out


def _starts(model: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, b, m`` of the best local minima of the grid, per series and sign of b."""
    sizes, mids = _grid(x)
    # With an intercept, b and -b give the same log-logistic curve.
    signs = (1.0,) if model == "LL4" else (1.0, -1.0)
    rows, bs, ms = [], [], []
    for sign in signs:
        b, m = np.broadcast_to(sign * sizes[:, None], mids.shape), mids
        p, q = _basis(model, x, b, m)
        gain = np.einsum("sn,bmn->sbm", y, p) ** 2 + np.einsum("sn,bmn->sbm", y, q) ** 2
        edge = np.pad(gain, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
        high = np.ones(gain.shape, dtype=bool)
        for i in (0, 1, 2):
            for j in (0, 1, 2):
                high &= gain >= edge[:, i : i + mids.shape[0], j : j + mids.shape[1]]
        flat = np.where(high, gain, -np.inf).reshape(len(y), -1)
        best = np.argsort(-flat, axis=1, kind="stable")[:, :STARTS]
        row = np.repeat(np.arange(len(y)), best.shape[1])
        at = best.ravel()
        found = np.isfinite(flat[row, at])
        rows.append(row[found])
        bs.append(b.ravel()[at[found]])
        ms.append(m.ravel()[at[found]])
    return np.concatenate(rows), np.concatenate(bs), np.concatenate(ms)


def _descend(
    model: str, x: np.ndarray, y: np.ndarray, b: np.ndarray, m: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Damped Gauss-Newton from every start (``y`` has a row per start): ``b, m`` and the residual sum of squares."""
    sign, lb, m = np.sign(b), np.log(np.abs(b)), m.copy()

    def left(at, l, k):
        return _left(model, x, y[at], sign[at] * np.exp(l), k)

    every = np.arange(len(y))
    ssr = (left(every, lb, m) ** 2).sum(-1)
    damping = np.full(len(y), 1e-2)
    still = np.zeros(len(y), dtype=int)
    for _ in range(STEPS):
        at = np.flatnonzero((still < 8) & (damping < 1e12))
        if not len(at):
            break
        l, k = lb[at], m[at]
        reach = 1.0 + np.exp(-l)  # the midpoint of a shallow curve moves in wide steps
        h = 1e-6
        r = left(at, l, k)
        jl = (left(at, l + h, k) - left(at, l - h, k)) / (2 * h)
        w = (h * reach)[:, None]
        jm = (left(at, l, k + h * reach) - left(at, l, k - h * reach)) / (2 * w)
        a, c, d = (jl * jl).sum(-1), (jl * jm).sum(-1), (jm * jm).sum(-1)
        u, v = (jl * r).sum(-1), (jm * r).sum(-1)
        a, d = a * (1 + damping[at]) + 1e-300, d * (1 + damping[at]) + 1e-300
        det = a * d - c * c
        ok = det > 0
        det = np.where(ok, det, 1.0)
        sm = np.clip(np.where(ok, -(a * v - c * u) / det, 0.0), -reach, reach)
        # Along a valley the midpoint's step is cut off; the slope's step is the best one beside what is left of it.
        sl = np.clip(np.where(ok, -(u + c * sm) / a, 0.0), -0.5, 0.5)
        l2, k2 = np.clip(l + sl, -EXTREME, EXTREME), k + sm
        new = (left(at, l2, k2) ** 2).sum(-1)
        better = new < ssr[at]
        gain = ssr[at] - new
        still[at] = np.where(better & (gain > 1e-12 * ssr[at]), 0, still[at] + 1)
        up = at[better]
        lb[up], m[up], ssr[up] = l2[better], k2[better], new[better]
        damping[at] = np.where(better, np.maximum(damping[at] / 5, 1e-12), damping[at] * 4)
    return sign * np.exp(lb), m, ssr


def fit(y: np.ndarray, models: Sequence[str]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``b, e, ssr`` of each series (a row of ``y``, doses 0, 1, ...) per model; NaN where a value is not finite."""
    x = np.arange(y.shape[1], dtype=float)
    out = {model: tuple(np.full(len(y), np.nan) for _ in range(3)) for model in models}
    finite = np.flatnonzero(np.isfinite(y).all(axis=1))
    order = sorted(models, key=lambda model: model in CONTAINS)
    for low in range(0, len(finite), CHUNK):
        at = finite[low : low + CHUNK]
        # Scaled by a power of two, so that neither huge nor tiny scores leave the range of squares.
        power = np.exp2(np.floor(np.log2(np.maximum(np.abs(y[at]).max(axis=1), 1e-300))))
        raw = y[at] / power[:, None]
        for model in order:
            use = raw if model in NO_INTERCEPT else raw - raw.mean(axis=1, keepdims=True)
            row, b, m = _starts(model, x, use)
            for inner in CONTAINS.get(model, ()):
                if inner in out:
                    ib, im, _ = out[inner]
                    for sign in (1.0, -1.0) if inner == "LL4" else (1.0,):
                        row = np.concatenate([row, np.arange(len(at))])
                        b = np.concatenate([b, sign * ib[at]])
                        m = np.concatenate([m, im[at]])
            b, m, ssr = _descend(model, x, use[row], b, m)
            best = np.lexsort((m, b, ssr, row))
            first = best[np.r_[True, row[best][1:] != row[best][:-1]]]
            for column, values in zip(out[model], (b, m, ssr)):
                column[at[row[first]]] = values[first]
            out[model][2][at] *= power**2
    with np.errstate(over="ignore"):
        return {model: (b, np.exp(m), ssr) for model, (b, m, ssr) in out.items()}
