"""Language identification in two steps: the family first, then the languages of that family.

A text is the mean of its words' character n-grams (1 to 3, ends marked), hashed into buckets. Linear support vector
machines (squared hinge), trained in numpy, tell one family from the rest; within a family, one machine for each pair of
languages votes. Families are those of ``FAMILIES``; a language that isn't there joins the family whose mean profile is
closest to its own.

Training uses at most ``per_language`` texts of each language, those whose hashed doc_id is smallest; all texts are
predicted from every word they have.
"""

from __future__ import annotations

import dataclasses
import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.llm.common import whole_text
from platewise.llm.word_grams import WordTable, grams, plain

SIZES = (1, 2, 3)
BUCKETS = 1 << 13
SCALE = 20.0
#: Letters, and numerals that are none.
_LETTER_LIKE = re.compile(r"[^\W\d_]")
#: Hash classes of doc_ids: each class of a language gives its first texts, then the classes together.
CLASSES = 256
#: Public facts: families of common languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu", "ne"),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
}


@dataclasses.dataclass(frozen=True)
class LanguageModel:
    """weights: buckets x machines. The first machines are the families', then the pairs' of each family."""

    weights: np.ndarray
    bias: np.ndarray
    families: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[int, str, str], ...]


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER_LIKE.finditer(text))


class Profiles:
    """Rows of bucket shares, the zeros left out: a text holds far fewer n-grams than there are buckets."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = rows
        self.bucket = np.concatenate([b for b, _ in rows])
        self.share = np.concatenate([v for _, v in rows])
        self.owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])

    @classmethod
    def of(cls, texts: list[list[str]]) -> Profiles:
        rows = []
        for words in texts:
            found, count = np.unique(grams(words, SIZES, BUCKETS, whole=False)[0], return_counts=True)
            rows.append((found, count / max(1, count.sum()) * SCALE))
        return cls(rows)

    def at(self, chosen: np.ndarray) -> Profiles:
        return Profiles([self.rows[i] for i in np.flatnonzero(chosen)])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.share * w[self.bucket], len(self.rows))

    def summed(self, factor: np.ndarray) -> np.ndarray:
        return np.bincount(self.bucket, self.share * factor[self.owner], BUCKETS)


def svm(x: Profiles, sign: np.ndarray, c: float = 10.0, turns: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps, classes balanced."""
    plus, minus = (sign > 0).sum(), (sign < 0).sum()
    cost = c * np.where(sign > 0, len(sign) / (2 * max(1, plus)), len(sign) / (2 * max(1, minus))) / len(sign)
    v = np.random.default_rng(3).standard_normal(BUCKETS)
    for _ in range(8):
        v = x.summed(x.times(v / np.linalg.norm(v)))
    rate = 1 / (1e-3 + 2 * cost.max() * (np.linalg.norm(v) + len(sign)))
    w, old, b, old_b = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(turns):
        k = t / (t + 3)
        u, ub = w + k * (w - old), b + k * (b - old_b)
        slack = np.maximum(0, 1 - sign * (x.times(u) + ub)) * cost * sign
        old, old_b = w, b
        w, b = u - rate * (1e-3 * u - 2 * x.summed(slack)), ub + rate * 2 * slack.sum()
    return w, float(b)


def _grouped(languages: list[str], means: dict[str, np.ndarray]) -> list[tuple[str, ...]]:
    groups = {f: [x for x in languages if x in names] for f, names in FAMILIES.items()}
    groups = {f: g for f, g in groups.items() if g}
    known = {x for g in groups.values() for x in g}
    centres = {f: np.mean([means[x] for x in g], axis=0) for f, g in groups.items()}
    for x in sorted(set(languages) - known):
        near = {f: means[x] @ m / (np.linalg.norm(means[x]) * np.linalg.norm(m) + 1e-12) for f, m in centres.items()}
        groups.setdefault(max(near, key=near.get) if near else x, []).append(x)
    return [tuple(sorted(g)) for g in groups.values()]


def train(texts: list[str], languages: list[str]) -> LanguageModel | None:
    rows = [([w for w in map(plain, t.lower().split()) if w], x) for t, x in zip(texts, languages)]
    rows = [(d, x) for d, x in rows if d]
    if not rows:
        return None
    x = Profiles.of([d for d, _ in rows])
    names = np.array([n for _, n in rows])
    means = {n: x.summed((names == n) / (names == n).sum()) for n in sorted(set(names.tolist()))}
    families = _grouped(sorted(means), means)
    machines, pairs = [], []
    for family in families:
        inside = np.isin(names, family)
        machines.append(svm(x, np.where(inside, 1.0, -1.0)) if not inside.all() else (np.zeros(BUCKETS), 1.0))
    for f, family in enumerate(families):
        for a, b in combinations(family, 2):
            rows_ab = np.isin(names, (a, b))
            machines.append(svm(x.at(rows_ab), np.where(names[rows_ab] == a, 1.0, -1.0)))
            pairs.append((f, a, b))
    return LanguageModel(np.stack([w for w, _ in machines], axis=1) * SCALE, np.array([b for _, b in machines]), tuple(families), tuple(pairs))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(4 * x, -500, 500))))


def decide(margins: np.ndarray, model: LanguageModel) -> tuple[str, float]:
    """The language and a score: how clear the family is, times how clear the closest pair that the language won."""
    f = int(np.argmax(margins[: len(model.families)]))
    rest = np.delete(margins[: len(model.families)], f)
    clear = _sigmoid((margins[f] - rest.max()) / 2) if len(rest) else 1.0
    family = model.families[f]
    votes, lead = dict.fromkeys(family, 0), dict.fromkeys(family, 0.0)
    duels = []
    for (g, a, b), m in zip(model.pairs, margins[len(model.families) :].tolist()):
        if g == f:
            duels.append((a, b, m))
            votes[a if m >= 0 else b] += 1
            lead[a] += m
            lead[b] -= m
    best = max(family, key=lambda n: (votes[n], lead[n]))
    own = [abs(m) if (m >= 0) == (a == best) else -abs(m) for a, b, m in duels if best in (a, b)]
    return best, clear * (_sigmoid(min(own)) if own else 1.0)


def fit(docs: DataFrame, learn: Column, per_language: int = 700) -> LanguageModel | None:
    """A model from rows of ``docs`` (doc_id, text, lang) with a language, where ``learn`` holds; None without any.

    Of rows that share a doc_id and language, the smallest text teaches. Equal votes go to the larger lead, then to the
    language that comes first in its family.
    """
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (F.length("text") > 0) & learn)
    marked = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CLASSES)).alias("c"))
    order = ["h", "doc_id"]
    some = marked.withColumn("_r", F.row_number().over(W.partitionBy("lang", "c").orderBy(*order))).where(F.col("_r") <= per_language)
    picked = some.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("_r") <= per_language)
    # At most per_language ids of each language.
    picked = F.broadcast(picked.select("doc_id", "lang").distinct())
    rows = usable.join(picked, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = sorted((r["doc_id"], r["lang"], r["text"] or "") for r in rows.collect())
    return train([t for _, _, t in sample], [n for _, n, _ in sample])


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` for every row; columns so named are replaced.

    A text that is null or has no letter is ``und`` with score 0, as all are without a model.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    @F.pandas_udf("lang_pred string, score double")
    def named(texts: pd.Series) -> pd.DataFrame:
        model = held.value
        table = state.get("table")
        if table is None and model is not None:

            def make(words: list[str]) -> np.ndarray:
                bucket, owner = grams(words, SIZES, BUCKETS, whole=False)
                cells = [np.bincount(owner, model.weights[bucket, k], minlength=len(words)) for k in range(len(model.bias))]
                count = np.bincount(owner, minlength=len(words)).astype(float)
                out = np.stack([*cells, count], axis=1)
                out[[not w for w in words]] = 0
                return out

            table = state["table"] = WordTable(make)
        out = []
        for at in range(0, len(texts), 200):
            some = texts.iloc[at : at + 200].tolist()
            if model is None:
                out += [("und", 0.0)] * len(some)
                continue
            for text, numbers in zip(some, table.lookup([t.lower().split() for t in some])):
                if not has_letter(text):
                    out.append(("und", 0.0))
                    continue
                sums = table.rows[numbers].sum(axis=0)
                out.append(decide(sums[:-1] / max(1.0, sums[-1]) + model.bias, model))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    rows = docs.drop("lang_pred", "score").withColumn("_named", named(whole_text()))
    return rows.select("*", "_named.lang_pred", "_named.score").drop("_named")
