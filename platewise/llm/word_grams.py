"""Character n-grams of words as hash buckets, and a bounded table of word scores for linear models over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Words a table holds at most; it then starts anew. It never changes a result.
TABLE_WORDS = 200_000
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def plain(chunk: str) -> str:
    """A chunk between blanks without marks at its edges."""
    return chunk.strip(_EDGES)


def grams(words: list[str], sizes: Iterable[int], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """bucket and word number of every n-gram of ``<word>``, and of the whole word if asked for; a gram counts each time.

    ``buckets`` is a power of two.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(chars))
    hashes, owners = [], []
    code = np.zeros(len(chars), np.uint64)
    # A few short words can be shorter together than the longest n-gram.
    for n in range(1, min(max(sizes), len(chars)) + 1):
        code[: len(chars) - n + 1] = _step(code[: len(chars) - n + 1], chars[n - 1 :])
        if n in sizes:
            ok = at + n <= ends
            hashes.append(code[ok] ^ np.uint64(n))
            owners.append(owner[ok])
    if whole:
        starts = np.cumsum(lengths) - lengths
        power = np.uint64(0x9E3779B97F4A7C15)
        terms = _step(chars, np.uint64(7)) * _powers(power, int(lengths.max()))[at - np.repeat(starts, lengths)]
        hashes.append(np.add.reduceat(terms, starts))
        owners.append(np.arange(len(words)))
    out = np.concatenate(hashes)
    out = _step(out, np.uint64(1)) >> np.uint64(64 - (buckets.bit_length() - 1))
    return out.astype(np.int64), np.concatenate(owners)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _step(code: np.ndarray, char) -> np.ndarray:
    x = (code ^ (code >> np.uint64(29)) ^ char) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordTable:
    """Rows of numbers for words, made in batches by ``make`` (words to an array of one row each)."""

    def __init__(self, make: Callable[[list[str]], np.ndarray]):
        self.make, self.number, self.rows = make, {}, None

    def lookup(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of chunks its rows' numbers in ``rows``."""
        if len(self.number) > TABLE_WORDS:
            self.number, self.rows = {}, None
        new = list(set().union(*texts).difference(self.number)) if texts else []
        if new:
            made = self.make([plain(w) for w in new])
            first = len(self.number)
            self.number.update(zip(new, range(first, first + len(new))))
            self.rows = made if self.rows is None else np.concatenate([self.rows, made])
        get = self.number.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]
