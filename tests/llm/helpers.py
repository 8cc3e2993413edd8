"""Documents for small tests, with every kind of odd row."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

ODD = [
    (None, "a row without id"),
    (900, None),
    (901, ""),
    (902, " \t\x0b \n"),
    (903, "one"),
    (904, "a b c d e"),
    (905, "a b c d e"),
    (905, "a b c d e"),
    (906, "***"),
    (907, "Ünïcödé ΣΊΣΥΦΟΣ 数学 \x85 <|endoftext|> <|ENDOFTEXT|> it's 12,5%%% x..y ﬁ"),
]


def prose(seed: int, n: int, words: int = 60) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    syllables = ["an", "der", "tion", "ou", "li", "pre", "sto", "ma", "ki", "the", "re", "un"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(2000)]
    out = []
    for i in range(n):
        text = rng.choices(vocabulary, k=rng.randint(words // 2, words * 2))
        for at in range(9, len(text), 10):
            text[at] += rng.choice([".", ",", ".\n", "!\n"])
        out.append((i, " ".join(text)))
    return out


def frame(spark, rows, clash: bool = True):
    """doc_id, text and columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        for name in ("ids", "key", "h", "n", "score", "part", "length", "start", "n_lines", "kept", "set_key", "node", "host", "run", "text_key"):
            df = df.withColumn(name, F.lit("x"))
    return df
