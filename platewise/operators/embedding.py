"""Low-dimensional coordinates, neighbour graph and density curves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.numeric import finite
from platewise.operators.ordered import table_quantiles
from platewise.operators.scaling import clip_scale, impute_median, quantile_uniform, replace_columns
from platewise.session import stage

NEIGHBOURS = 15
GRID_POINTS = 200
CUT = 3
#: Bandwidths beyond which a Gaussian kernel (e^-40.5 of its top) is below what a sum of doubles can show.
REACH = 9.0
#: Rows per block: two blocks that meet are copied to one task, so larger ones are copied less often.
BLOCK_ROWS = 8192
#: Rows that are compared with a block at a time, and pairs whose distances are taken at a time.
COMPARED_ROWS = 256
EXACT_PAIRS = 1 << 16
#: Share of the squared lengths by which a distance from inner products may be off; rounding is far below it.
ROUNDING = 1e-10
#: Reference vectors of the neighbour search, and the rows of the sample that each is picked from.
PIVOTS = 16
PIVOT_SAMPLE = 64


def ready_features(
    df: DataFrame, features: Sequence[str], scale: bool = True
) -> tuple[DataFrame, list[str]]:
    """Infinite values as missing, median imputation, and the quantile transform if ``scale``."""
    clean = replace_columns(df, {f: finite(F.col(f"`{f}`").cast("double")) for f in features})
    filled, known = impute_median(clean, features)
    return (quantile_uniform(filled, known) if scale else filled), known


def embed(
    df: DataFrame, id_col: str, features: Sequence[str], k: int = 2, scale: bool = True
) -> DataFrame:
    """``id, dim1..dimk``: principal components of the prepared features, keyed by id.

    Each axis points so that its largest loading is positive. The prepared features are written to
    the shared folder once: the fit takes several passes over them.
    """
    ready, used = ready_features(df, features, scale)
    ready = stage(ready.select(id_col, *[F.col(f"`{f}`") for f in used]), "embedding-input")
    vectors = ready.select(id_col, array_to_vector(F.array(*[F.col(f"`{f}`") for f in used])).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0 for j in range(k)]
    got = model.transform(vectors).withColumn("_a", vector_to_array("_p"))
    return got.select(id_col, *[(F.get("_a", F.lit(j)) * s).alias(f"dim{j + 1}") for j, s in enumerate(signs)])


def _closest_rows():
    """The search of one batch, as a function that is sent to the tasks whole."""

    def closest(a: np.ndarray, b: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``b`` and distances of the ``keep`` nearest of each row of ``a``; equal distances keep the earlier place.

        Inner products leave out what can't be among them, by more than their rounding; distances are taken of the rest.
        """
        with np.errstate(all="ignore"):
            la, lb = (a * a).sum(axis=1), (b * b).sum(axis=1)
            rough = la[:, None] + lb[None, :] - 2 * (a @ b.T)
            rough[np.isnan(rough)] = np.inf
            bound = np.partition(rough, keep - 1, axis=1)[:, keep - 1] + ROUNDING * (la + lb.max())
            bound[np.isnan(bound)] = np.inf
            row, place = np.nonzero(rough <= bound[:, None])
            exact = np.empty(len(row))
            for at in range(0, len(row), EXACT_PAIRS):
                r, p = row[at : at + EXACT_PAIRS], place[at : at + EXACT_PAIRS]
                exact[at : at + EXACT_PAIRS] = np.sqrt(((a[r] - b[p]) ** 2).sum(axis=1))
        order = np.lexsort((place, exact, row))
        starts = np.searchsorted(row, np.arange(len(a)))
        first = order[starts[:, None] + np.arange(keep)]
        return place[first], exact[first]

    return closest


def _nearest(id_col: str, k: int):
    closest = _closest_rows()

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, there = pdf[pdf.side != 2], pdf[pdf.side != 1]
        if not len(ask) or not len(there):
            return pd.DataFrame({id_col: [], "neighbour": [], "distance": [], "block": []})
        b, ids = np.stack(there.v.to_numpy()), there[id_col].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        b, ids = b[by_id], ids[by_id]
        a, own = np.stack(ask.v.to_numpy()), ask[id_col].to_numpy()
        keep = min(k, len(ids))
        near, far = np.empty((len(a), keep), np.int64), np.empty((len(a), keep))
        for at in range(0, len(a), COMPARED_ROWS):
            near[at : at + COMPARED_ROWS], far[at : at + COMPARED_ROWS] = closest(a[at : at + COMPARED_ROWS], b, keep)
        found = pd.DataFrame({id_col: np.repeat(own, keep), "neighbour": ids[near.ravel()], "distance": far.ravel()})
        found["block"] = ask.block.iloc[0]
        # Nothing beyond what the block's rows already have can be among a row's nearest.
        return found[found.distance <= ask.reach.iloc[0]]

    return search


def _pivots(rows: DataFrame, id_col: str, count: int) -> np.ndarray:
    """Vectors far from each other, picked one by one from a sample of ``PIVOT_SAMPLE`` rows per pivot."""
    drawn = rows.orderBy(F.xxhash64(id_col), id_col).limit(count * PIVOT_SAMPLE).select("v").collect()
    sample = np.asarray([r["v"] for r in drawn], dtype=float)
    chosen = [0]
    far = np.sqrt(((sample - sample[0]) ** 2).sum(axis=1))
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, np.sqrt(((sample - sample[chosen[-1]]) ** 2).sum(axis=1)))
    return sample[chosen]


def neighbour_blocks(df: DataFrame, id_col: str, vec: str, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """``id, v, far, block``: rows in blocks of at most ``block_rows`` near each other, with their distances to the pivots.

    Rows are put in order by nearest pivot and distance to it; a block is a run of that order.
    """
    rows = df.select(id_col, F.col(vec).cast("array<double>").alias("v"))
    base = _pivots(rows, id_col, pivots)
    kind = df.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf.v.to_numpy())
                d = np.sqrt(np.stack([((v - p) ** 2).sum(axis=1) for p in base], axis=1))
                yield pdf.assign(far=list(d), cell=d.argmin(axis=1), near=d.min(axis=1))

    placed = rows.mapInPandas(place, f"{id_col} {kind}, v array<double>, far array<double>, cell int, near double")
    order = ["cell", "near", id_col]
    runs = placed.repartitionByRange(max(1, -(-df.count() // block_rows)), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    inside = at.bitwiseAND(F.lit((1 << 33) - 1))
    return stage(runs.select(id_col, "v", "far", (at - inside % block_rows).alias("block")), "neighbour-blocks")


def block_pairs(blocks: DataFrame, reach: DataFrame) -> DataFrame | None:
    """``asks, holds, reach``: the blocks whose rows can hold neighbours of another block's rows; None if there is one block.

    By the triangle inequality two rows lie at least as far apart as their distances to any pivot differ. A block is left
    out if that bound, over all pivots, exceeds ``reach``: how far the k-th neighbours found so far lie from the asking
    block's rows. The table of pairs has one row per two blocks, no vectors.
    """
    ends = blocks.select("block", F.posexplode("far").alias("p", "d")).groupBy("block", "p").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    ends = ends.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("ends")).join(reach, "block")
    # One row per block.
    ends = stage(ends.withColumn("no", F.row_number().over(W.orderBy("block"))), "block-ends")
    count = ends.count()
    if count <= 1:
        return None
    asks = ends.select(F.col("block").alias("asks"), "reach", F.col("ends").alias("_a"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("no"))
    both = asks.join(ends.select("no", F.col("block").alias("holds"), F.col("ends").alias("_b")), "no").where("asks != holds")
    apart = F.array_max(F.zip_with("_a", "_b", lambda a, b: F.greatest(a["lo"] - b["hi"], b["lo"] - a["hi"])))
    return both.where(apart <= F.col("reach")).select("asks", "holds", "reach")


def knn(
    df: DataFrame, id_col: str, vec: str, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """``id, neighbour, distance, rank``: the exact k nearest rows, the row itself included.

    Rows near each other share a block. Every block is searched for its own rows first; how far those neighbours lie
    bounds the other blocks that a block has to meet (``block_pairs``), so on clustered rows most pairs are skipped. Each
    meeting yields at most k candidates per row, ranked together in the end. Ties go to the smaller id.
    """
    blocks = neighbour_blocks(df, id_col, vec, block_rows, pivots)
    kind = df.schema[id_col].dataType.simpleString()
    typed = f"{id_col} {kind}, neighbour {kind}, distance double, block long"
    endless = F.lit(float("inf"))
    alone = blocks.select(id_col, "v", "block", endless.alias("reach"), F.lit(0).alias("side"))
    first = stage(alone.groupBy("block").applyInPandas(_nearest(id_col, k), typed), "neighbours")
    kth = first.groupBy("block", id_col).agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(endless).alias("d"))
    # A little more than the bound, for rounding.
    reach = kth.groupBy("block").agg((F.max("d") * (1 + 1e-9)).alias("reach"))
    best = F.row_number().over(W.partitionBy(id_col).orderBy("distance", "neighbour"))
    pairs = block_pairs(blocks, reach)
    if pairs is None:
        return first.select(id_col, "neighbour", "distance").withColumn("rank", best)
    pairs = stage(pairs, "block-pairs")
    asking = blocks.join(pairs, F.col("block") == F.col("asks")).withColumn("side", F.lit(1))
    holding = blocks.join(pairs, F.col("block") == F.col("holds")).withColumn("side", F.lit(2))
    others = asking.unionByName(holding).drop("far").groupBy("asks", "holds").applyInPandas(_nearest(id_col, k), typed)
    found = first.unionByName(others).select(id_col, "neighbour", "distance")
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def density(
    df: DataFrame,
    features: Sequence[str],
    lower: float = 5,
    upper: float = 95,
    points: int = GRID_POINTS,
) -> DataFrame:
    """``feature, point, x, density``: Gaussian kernel density of each feature clipped to percentiles.

    Scott's bandwidth sd * n^(-1/5); the grid reaches three bandwidths past the clipped range. A
    feature without spread has density 0. The bandwidth shrinks as rows grow, and with it the share of the
    grid that a value adds to.
    """
    clean = replace_columns(df, {f: finite(F.col(f"`{f}`").cast("double")) for f in features})
    bounds = table_quantiles(clean, features, [lower / 100, upper / 100]).first()
    known = [f for f in features if bounds[f]]
    clipped = {
        f: F.when(F.col(f"`{f}`").isNotNull(),
                  F.least(F.greatest(F.col(f"`{f}`"), F.lit(bounds[f][0])), F.lit(bounds[f][1])))
        for f in known
    }
    # Equal values share one kernel; clipping piles many up at the two ends.
    values = (
        clean.select(*[clipped[f].alias(f) for f in known])
        .unpivot([], known, "feature", "value")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row per feature.
    n, v = F.col("n").cast("double"), F.col("value")
    shape = values.groupBy("feature").agg(
        F.sum("n").alias("size"), (F.sum(n * v) / F.sum(n)).alias("_mean"),
        F.min("value").alias("_min"), F.max("value").alias("_max"),
    )
    centred = values.join(F.broadcast(shape), "feature")
    spread = centred.groupBy("feature").agg(
        F.sqrt(F.try_divide(F.sum(n * F.pow(v - F.col("_mean"), F.lit(2.0))), F.first("size") - 1)).alias("_sd")
    )
    shape = shape.join(spread, "feature")
    width = F.col("_sd") * F.pow(F.col("size").cast("double"), F.lit(-0.2))
    shape = shape.withColumn("bandwidth", width)
    low = F.col("_min") - CUT * F.col("bandwidth")
    high = F.col("_max") + CUT * F.col("bandwidth")
    grid = shape.select(
        "feature", "size", "bandwidth", low.alias("_low"), high.alias("_high"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    ).select(
        "feature", "size", "bandwidth", "point",
        (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("point") / F.lit(float(points - 1))).alias("x"),
    )
    kernels = kernel_rows(values, shape.select("feature", "bandwidth", low.alias("_low"), high.alias("_high")), points)
    curve = kernels.groupBy("feature", "point").agg(F.sum("height").alias("_sum"))
    norm = F.col("size") * F.col("bandwidth") * F.sqrt(F.lit(2.0) * F.pi())
    # A point that no value reaches has density 0, and so has a feature without spread.
    height = F.when(F.col("bandwidth") > 0, F.col("_sum") / norm)
    return grid.join(curve, ["feature", "point"], "left").select(
        "feature", "point", "x", F.coalesce(height, F.lit(0.0)).alias("density")
    )


def kernel_rows(values: DataFrame, shape: DataFrame, points: int = GRID_POINTS) -> DataFrame:
    """``feature, point, height``: a row per distinct value and grid point that its kernel reaches.

    A band join of values and points: the grid is evenly spaced, so the points within ``REACH`` bandwidths of a value
    are a run of numbers that follows from the value. ``shape`` has one row per feature.
    """
    low, width = F.col("_low"), F.col("bandwidth")
    step = (F.col("_high") - low) / F.lit(float(points - 1))
    first = F.greatest(F.ceil((F.col("value") - REACH * width - low) / step), F.lit(0))
    last = F.least(F.floor((F.col("value") + REACH * width - low) / step), F.lit(points - 1))
    near = values.join(F.broadcast(shape.where(width > 0)), "feature")
    near = near.select("feature", "value", "n", "bandwidth", "_low", "_high", F.explode(F.when(first <= last, F.sequence(first, last))).alias("point"))
    x = low + (F.col("_high") - low) * F.col("point") / F.lit(float(points - 1))
    z = (x - F.col("value")) / width
    return near.select("feature", F.col("point").cast("int").alias("point"), (F.col("n") * F.exp(F.lit(-0.5) * z * z)).alias("height"))


def embedding_features(
    embedding: DataFrame, df: DataFrame, id_col: str, features: Sequence[str]
) -> DataFrame:
    """Coordinates with each feature clipped and rescaled, one row per id and feature.

    ``missing`` flags ids without a value.
    """
    scaled = clip_scale(df.select(id_col, *[F.col(f"`{f}`").cast("double").alias(f) for f in features]), features)
    joined = embedding.join(scaled, id_col, "left")
    coords = [c for c in embedding.columns]
    out = joined.unpivot(coords, list(features), "feature", "value")
    return out.withColumn("missing", F.col("value").isNull())
