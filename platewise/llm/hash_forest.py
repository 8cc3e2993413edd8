"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt by a hash of their id into shards of bounded size. A shard holds ``trees`` trees, each a sorted array
of 64-bit hash strings (signs against random hyperplanes through the origin). A query descends every tree by binary
search to its longest matching prefix, and then ascends all trees together, one bit at a time, until the ranges of rows
that share the prefix hold enough different candidates. Candidates are scored exactly on the original vectors.

Every row is indexed. Queries go in blocks, each block meets each shard once, and a shard gives back only its best k.
The share of a shard that must be looked at depends on how close true neighbours are: vectors in no particular order
(cosines of 0.4 to 0.5 in 64 dimensions) need half of it and more for a recall above 0.9. ``share`` states it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.session import stage

BITS = 64
INDEX = "dim int, shard int, ids binary, vectors binary, keys binary, order binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (double): one usable vector per id, the least if an id has several. Rows without id drop out."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def hyperplanes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(dim * 1_000_003 + trees).standard_normal((dim, trees * BITS))


def hash_strings(vectors: np.ndarray, trees: int) -> np.ndarray:
    """Each row's string per tree, as unsigned integers whose order is that of the strings (trees x rows)."""
    out = np.empty((trees, len(vectors)), np.uint64)
    planes = hyperplanes(vectors.shape[1], trees)
    for at in range(0, len(vectors), 1024):
        bits = vectors[at : at + 1024] @ planes > 0
        packed = np.packbits(bits.reshape(-1, trees, BITS), axis=2)
        out[:, at : at + 1024] = packed.view(">u8")[:, :, 0].T
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows; cosines stay the same to the last bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _dealt(df: DataFrame, id_col: str, size: int, name: str) -> DataFrame:
    count = max(1, -(-df.count() // size))
    dealt = df.withColumn("dim", F.size("vector")).withColumn(name, F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int"))
    return dealt


def build_index(vectors: DataFrame, trees: int = 32, shard_rows: int = 4096) -> DataFrame:
    """The forest of ``vectors`` (vec_id, vector), one row per shard and dimension, as a stored table."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        x = scaled(np.stack(group["vector"].to_numpy()).astype(np.float64))
        keys = hash_strings(x, trees)
        order = np.argsort(keys, axis=1, kind="stable")
        sorted_keys = np.take_along_axis(keys, order, axis=1)
        ids = group["vec_id"].to_numpy(np.int64)
        row = (group["dim"].iloc[0], group["shard"].iloc[0], ids.tobytes(), x.tobytes(), sorted_keys.tobytes(), order.astype(np.int32).tobytes())
        return pd.DataFrame([row], columns=["dim", "shard", "ids", "vectors", "keys", "order"])

    return stage(_dealt(vectors, "vec_id", shard_rows, "shard").groupBy("dim", "shard").applyInPandas(build, INDEX), "forest")


def _ranges(keys: np.ndarray, own: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the rows of a sorted array that share its first ``level`` bits."""
    mask = np.uint64((((1 << level) - 1) << (BITS - level)) & (2**64 - 1))
    return np.searchsorted(keys, own & mask), np.searchsorted(keys, own | ~mask, side="right")


def candidates(keys: np.ndarray, order: np.ndarray, own: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
    """For each query the rows it finds: descend to the longest prefixes, ascend together until ``wanted`` are found.

    keys, order: trees x rows. own: trees x queries.
    """
    trees, rows = keys.shape
    deepest = min(BITS, 2 * max(1, rows).bit_length() + 8)
    # Levels below ``deepest`` hold only rows whose strings agree in almost all bits; they come in with it.
    spans = [[_ranges(keys[t], own[t], level) for t in range(trees)] for level in range(deepest + 1)]
    totals = np.array([[hi - lo for lo, hi in level] for level in spans]).sum(axis=1)
    for q in range(own.shape[1]):
        level = int(np.flatnonzero(totals[:, q] >= min(wanted, trees * rows)).max(initial=0))
        while True:
            seen = np.zeros(rows, bool)
            for t in range(trees):
                lo, hi = spans[level][t]
                seen[order[t, lo[q] : hi[q]]] = True
            found = np.flatnonzero(seen)
            if len(found) >= wanted or level == 0:
                yield found
                break
            level -= 1


def _best(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, rows: np.ndarray, k: int):
    rows = rows[ids[rows] != query_id]
    norm = np.sqrt((query * query).sum())
    rough = (x[rows] @ query) / (norms[rows] * norm)
    if len(rows) > k:
        rows = rows[rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-9]
    # Row sums of products don't depend on what stands around a row, so equal vectors get equal scores.
    exact = (x[rows] * query).sum(axis=1) / (norms[rows] * norm)
    best = np.lexsort((ids[rows], -exact))[:k]
    return zip(ids[rows[best]].tolist(), exact[best].tolist())


def search(index: DataFrame, queries: DataFrame, k: int = 5, trees: int = 32, share: float = 0.6, least: int = 1536, block_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query (vec_id, vector), by cosine.

    A row is no candidate of a query with the same id or of another dimension. Ties go to the smaller vec_id. Fewer
    candidates than k give fewer rows. share, least: candidates wanted in a shard, as a part of its rows and at least.
    """

    def block(group: pd.DataFrame) -> pd.DataFrame:
        x = scaled(np.stack(group["vector"].to_numpy()).astype(np.float64))
        row = (group["dim"].iloc[0], group["vec_id"].to_numpy(np.int64).tobytes(), x.tobytes())
        return pd.DataFrame([row], columns=["dim", "query_ids", "query_vectors"])

    shards = index.select("dim", "shard")
    blocks = _dealt(queries, "vec_id", block_rows, "block").groupBy("dim", "block").applyInPandas(block, "dim int, query_ids binary, query_vectors binary")
    # Every block goes to every shard of its dimension; a block is a few hundred vectors.
    sent = blocks.join(shards.groupBy("dim").agg(F.collect_list("shard").alias("_to")), "dim").withColumn("shard", F.explode("_to")).drop("_to")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                dim, ids = row["dim"], np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["vectors"]).reshape(-1, dim)
                norms = np.sqrt((x * x).sum(axis=1))
                keys = np.frombuffer(row["keys"], np.uint64).reshape(trees, -1)
                order = np.frombuffer(row["order"], np.int32).reshape(trees, -1)
                query_ids = np.frombuffer(row["query_ids"], np.int64).tolist()
                y = np.frombuffer(row["query_vectors"]).reshape(-1, dim)
                wanted = min(len(ids), max(least, int(np.ceil(share * len(ids)))))
                out = [
                    (q, vec, score)
                    for q, vector, rows in zip(query_ids, y, candidates(keys, order, hash_strings(y, trees), wanted))
                    for vec, score in _best(x, norms, ids, vector, q, rows, k)
                ]
                q, vec, score = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    met = index.join(sent, ["dim", "shard"])
    found = met.mapInArrow(find, "query_id long, vec_id long, score double")
    nearest = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
