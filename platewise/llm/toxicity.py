"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with its ends marked), hashed into buckets. Each bucket has
a small embedding; a word's vector is the mean of its bag, a window's the mean of its words, and a linear softmax over two
classes reads it. Embeddings and softmax are learned together by stochastic gradients (Adagrad). A misspelt word shares
most n-grams with the word it stands for.

A text is toxic if any of its windows is, however long it is, so its score comes from its highest window; every window of
the whole text counts. Labels are given per text: training starts from all windows of the sample and then goes on with the
highest windows of each text. Toxic texts whose highest window is as low as those of clean ones count a quarter there, but
none is left out. A logistic curve turns the highest window's margin into a score. It is fitted at the class shares of all
labelled texts, over the third of the sample that a model of the other two thirds has not seen; the model itself learns
from all of it.

Training uses at most ``per_class`` texts of each class and ``clean_share`` times as many clean ones, those whose hashed
doc_id is smallest; all else is done for every text.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import whole_text
from platewise.llm.word_grams import WordTable, grams, plain

SIZES = (3, 4, 5)
BUCKETS = 1 << 17
WINDOW = 3
#: What a toxic text counts whose highest window does not exceed the clean ones' 0.9 quantile.
DOUBTFUL = 0.25


@dataclasses.dataclass(frozen=True)
class ToxicityModel:
    """margins: the softmax margin each bucket adds (its embedding times the weights' difference)."""

    margins: np.ndarray
    bias: float
    slope: float
    offset: float


def word_margins(words: list[str], margins: np.ndarray) -> np.ndarray:
    """The mean margin of each word's bag; NaN for no word at all."""
    bucket, owner = grams(words, SIZES, BUCKETS, whole=False)
    count = np.maximum(np.bincount(owner, minlength=len(words)), 1)
    out = np.bincount(owner, margins[bucket], minlength=len(words)) / count
    out[[not w for w in words]] = np.nan
    return out[:, None]


def highest(values: np.ndarray) -> float:
    """The highest mean of WINDOW words in a row (of all of them, if fewer)."""
    if len(values) <= WINDOW:
        return float(values.mean())
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return float((sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW)


def chunks_of(text: str) -> list[str]:
    return text.lower().split()


def _bags(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, word after word, and how many each has."""
    buckets, sizes = [], []
    for at in range(0, len(words), at_once):
        some = words[at : at + at_once]
        bucket, owner = grams(some, SIZES, BUCKETS, whole=False)
        buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(some)).astype(np.int32))
    return np.concatenate(buckets), np.concatenate(sizes).astype(np.int64)


def train(
    texts: list[str], labels: np.ndarray, totals: tuple[int, int] | None = None, dim: int = 8, rounds: int = 3, seed: int = 7
) -> ToxicityModel:
    """A model from whole texts and their labels (0 or 1). totals: clean and toxic texts there are beyond the sample."""
    # Texts become numbers one by one, so that their words are not held as strings.
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in map(plain, chunks_of(t)) if w], np.int32) for t in texts]
    y = np.array([v for v, d in zip(labels.tolist(), words) if len(d)])
    words = [d for d in words if len(d)]
    if len(set(y.tolist())) < 2:
        # Nothing to tell apart: every text gets the one class there is, or none.
        return ToxicityModel(np.zeros(BUCKETS), 0.0, 0.0, 30.0 if len(y) and y[0] else -30.0)
    bucket, size = _bags(list(vocabulary))
    del vocabulary
    which = np.empty(len(y), np.int64)
    for value in (0, 1):
        which[y == value] = np.arange((y == value).sum()) % 3
    # The curve is fitted where the model has not learned; of a class with fewer than three texts, there is no such part.
    unseen = which == 2
    if len(set(y[unseen].tolist())) < 2:
        unseen[:] = True
    seen = np.flatnonzero(~unseen) if not unseen.all() else np.arange(len(y))
    margins, bias = _learn([words[i] for i in seen], y[seen], bucket, size, dim, rounds, seed)
    values = _word_values(margins, bucket, size)
    top, marks = np.array([highest(values[words[i]]) for i in np.flatnonzero(unseen)]) + bias, y[unseen]
    weight = np.ones(2) if totals is None else np.array(totals) / np.maximum(1, np.bincount(marks, minlength=2))
    slope, shift = _logistic(top, marks, weight[marks] / weight[marks].mean())
    if len(seen) < len(y):
        margins, bias = _learn(words, y, bucket, size, dim, rounds, seed)
    return ToxicityModel(margins, bias, slope, shift)


def _word_values(margins: np.ndarray, bucket: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The mean margin of each word's bag."""
    first, out = np.cumsum(size) - size, np.empty(len(size))
    for at in range(0, len(size), 50_000):
        to = min(len(size), at + 50_000)
        part = bucket[first[at] : first[to - 1] + size[to - 1]]
        out[at:to] = np.add.reduceat(margins[part], first[at:to] - first[at]) / size[at:to]
    return out


def _learn(
    words: list[np.ndarray], y: np.ndarray, bucket: np.ndarray, size: np.ndarray, dim: int, rounds: int, seed: int
) -> tuple[np.ndarray, float]:
    """Margins of the buckets and the bias, from texts as word numbers."""
    first = np.cumsum(size) - size
    # All windows, side by side; the last of a text is shorter.
    starts = [np.arange(0, len(w), WINDOW) for w in words]
    flat = np.concatenate(words)
    offset = np.cumsum([0] + [len(w) for w in words[:-1]])
    doc_of = np.repeat(np.arange(len(words)), [len(s) for s in starts])
    begin = np.concatenate([s + o for s, o in zip(starts, offset)])
    length = np.concatenate([np.minimum(WINDOW, len(w) - s) for w, s in zip(words, starts)])
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (dim, BUCKETS)) / dim
    e_seen = np.full((dim, BUCKETS), 1e-8)
    w, w_seen = rng.normal(0, 0.5, (2, dim)), np.full((2, dim), 1e-8)
    b, b_seen = np.zeros(2), np.full(2, 1e-8)

    def step(some: np.ndarray, weight: np.ndarray, rate: float) -> None:
        nonlocal w, b
        n = length[some]
        where = np.repeat(np.arange(len(some)), n)
        word = flat[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        m = size[word]
        at = bucket[np.repeat(first[word] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        share = np.repeat(1.0 / (m * n[where]), m)
        whose = np.repeat(where, m)
        h = np.stack([np.bincount(whose, e[d, at] * share, minlength=len(some)) for d in range(dim)])
        z = w @ h + b[:, None]
        p = np.exp(z - z.max(axis=0))
        p /= p.sum(axis=0)
        p[y[doc_of[some]], np.arange(len(some))] -= 1
        p *= weight
        back = w.T @ p
        gw, gb = p @ h.T, p.sum(axis=1)
        w_seen[:] += gw**2
        b_seen[:] += gb**2
        w = w - rate * gw / np.sqrt(w_seen)
        b = b - rate * gb / np.sqrt(b_seen)
        used, slot = np.unique(at, return_inverse=True)
        for d in range(dim):
            g = np.bincount(slot, back[d][whose] * share)
            e_seen[d, used] += g**2
            e[d, used] -= rate * g / np.sqrt(e_seen[d, used])

    def margins() -> np.ndarray:
        return (w[1] - w[0]) @ e

    def pass_over(some: np.ndarray, rate: float, counts: np.ndarray | float = 1.0) -> None:
        toxic = y[doc_of[some]] == 1
        weight = np.where(toxic, len(some) / max(1, toxic.sum()), len(some) / max(1, (~toxic).sum())) / 2 * counts
        turn = rng.permutation(len(some))
        for at in range(0, len(turn), 512):
            pick = turn[at : at + 512]
            step(some[pick], weight[pick] / 512, rate)

    pass_over(np.arange(len(begin)), 0.1)
    for _ in range(rounds):
        values = np.concatenate([[0.0], np.cumsum(_word_values(margins(), bucket, size)[flat])])
        mean = (values[begin + length] - values[begin]) / length
        # The highest window of each text, and for clean texts the next ones too. A toxic text whose highest window is
        # as low as those of clean texts may be marked by mistake, so it counts less.
        rank = np.empty(len(mean), np.int64)
        best = np.lexsort((-mean, doc_of))
        rank[best] = np.arange(len(best)) - np.repeat(np.searchsorted(doc_of, np.arange(len(words))), np.bincount(doc_of))
        toxic = y[doc_of] == 1
        usual = np.quantile(mean[~toxic & (rank == 0)], 0.9)
        some = np.flatnonzero(rank < np.where(toxic, 1, 4))
        counts = np.where(toxic[some] & (mean[some] <= usual), DOUBTFUL, 1.0)
        pass_over(some, 0.15, counts)
        pass_over(some, 0.1, counts)
    return margins(), float(b[1] - b[0])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, turns: int = 60) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by Newton steps with a little shrinkage."""
    mean, spread = x.mean(), x.std() + 1e-9
    u, t = (x - mean) / spread, np.zeros(2)
    rows = np.stack([u, np.ones_like(u)])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(t @ rows, -30, 30)))
        grad = rows @ (weight * (p - y)) + np.array([1e-2 * t[0], 0])
        hess = (rows * (weight * p * (1 - p) + 1e-6)) @ rows.T + np.diag([1e-2, 1e-9])
        t = t - np.clip(np.linalg.solve(hess, grad), -3, 3)
    slope = max(0.0, t[0] / spread)
    return float(slope), float(t[1] - slope * mean)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 1500, clean_share: int = 3) -> ToxicityModel:
    """A model from rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks, where ``learn`` holds.

    Rows without doc_id, text or label teach nothing; a doc_id with several labels is toxic if any says so; of rows
    that share a doc_id the smallest text teaches, so rows that repeat teach once.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    found = dict(marked.groupBy("y").count().collect())
    # The smallest hashes of each class, found from ids alone; then only these texts are read to the driver.
    some = []
    for value, most in ((1, per_class), (0, per_class * clean_share)):
        some.append(marked.where(F.col("y") == value).orderBy(order, "doc_id").limit(most))
    picked = some[0].unionByName(some[1])
    rows = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = sorted((r["doc_id"], r["text"], r["y"]) for r in rows.collect())
    marks = np.array([v for _, _, v in sample], np.int64)
    return train([t for _, t, _ in sample], marks, (found.get(0, 0), found.get(1, 0)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) for every row; columns so named are replaced.

    A text without words (null, empty, marks only) scores 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    @F.pandas_udf("double")
    def rated(texts: pd.Series) -> pd.Series:
        model = held.value
        table = state.get("table")
        if table is None:
            table = state["table"] = WordTable(lambda words: word_margins(words, model.margins))
        out = []
        for at in range(0, len(texts), 200):
            docs = [chunks_of(t) for t in texts.iloc[at : at + 200]]
            for numbers in table.lookup(docs):
                values = table.rows[numbers, 0] if len(numbers) else np.zeros(0)
                values = values[~np.isnan(values)]
                if not len(values):
                    out.append(0.0)
                    continue
                x = model.slope * (highest(values) + model.bias) + model.offset
                out.append(float(1 / (1 + np.exp(-np.clip(x, -500, 500)))))
        return pd.Series(out, dtype="float64")

    rows = docs.drop("score", "predicted").withColumn("score", rated(whole_text()))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
