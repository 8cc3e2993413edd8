"""Merkle manifest of a dataset: nodes labelled with the leaf-rank intervals they cover.

Every row is a leaf, the SHA-256 of its length-prefixed fields. A group's leaves, in order of their key, form a tree of
``ARITY``; the groups' subroots, in order of the group, form the tree above them. A node at level l covers the ranks
[lo, hi), hi - lo <= ARITY^l, and a node's parent is the one interval of the next level that contains it. Levels are
bucketed: ``BAND`` levels at a time, an interval of ARITY^BAND ranks is one bucket of bounded size, so that

* growing takes one shuffle per band, not per level;
* ancestors are attached bucket by bucket from the top: nodes of a bucket meet the path that leads from the bucket's
  own top to the root (a containment join whose keys are tree, band and interval), and inside a parent's interval the
  siblings of a node are what is left when its own interval is taken out.

Ranks come from one range shuffle: rows are put in order inside each range, and a row per range and group carries the
counts before it, so a group that holds most rows is spread like any other. No digest but the root passes the driver.

A null field is ``-``; a null group is a group of its own and comes first, as does a null key. Rows with equal keys are
put in order by their digest; rows that repeat are leaves of their own, each with its own proof. A group of one row has
its leaf as subroot. An empty table has no leaves, no nodes and no root. Long texts are hashed in place and never leave
the scan. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.session import stage

ARITY = 3
#: Levels in a bucket: ARITY^BAND nodes at its lowest level.
BAND = 6
_PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_NODE = "tree string, height int, level int, lo long, hi long, digest string"
_STEP_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, height, lo (rank), digest, payload. ``nodes``: tree, height, level, lo, hi, digest, from level 1 up.

    ``tree`` is the empty text for the null group, else ``=`` and the group. ``top`` holds the tree over the subroots, whose
    payload is the tree they are of; it is None there. ``root`` is None if there are no rows.
    """

    leaves: DataFrame
    nodes: DataFrame
    bands: int
    top: Manifest | None
    root: str | None


def field(c: Column) -> Column:
    """A value with its length in bytes before it; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _height(size: Column) -> Column:
    """Levels above the leaves: the smallest l with ARITY^l >= size."""
    out = F.lit(0)
    level = 0
    while ARITY**level < 1 << 62:
        out = out + (size > ARITY**level).cast("int")
        level += 1
    return out


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``lo``, the rank within ``tree`` in the order given (from 0), and the tree's height."""
    cols = ["tree", *order]
    dealt = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    dealt = stage(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "merkle_order")
    per_part = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    along = W.partitionBy("tree").orderBy("_part")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = per_part.select(
        "tree", "_part", "_first", before.alias("_before"), _height(F.sum("_n").over(W.partitionBy("tree"))).alias("height")
    )
    out = dealt.join(stage(starts, "merkle_starts"), ["tree", "_part"])
    return out.withColumn("lo", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _bucket(band: int) -> Column:
    return F.floor(F.col("lo") / F.lit(ARITY ** (BAND * (band + 1)))).cast("long")


def _grow(band: int):
    schema = pa.schema([("tree", pa.string()), ("height", pa.int32()), ("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("digest", pa.string())])

    def grow(bucket: pa.Table) -> pa.Table:
        """The nodes that the bucket's lowest level gives rise to, up to the bucket's top or the tree's root."""
        bucket = bucket.sort_by("lo")
        tree, height = bucket.column("tree")[0].as_py(), bucket.column("height")[0].as_py()
        row = list(zip(*(bucket.column(c).to_pylist() for c in ("lo", "hi", "digest"))))
        out = []
        for level in range(BAND * band + 1, min(height, BAND * (band + 1)) + 1):
            row = [(run[0][0], run[-1][1], _hash(*(d for _, _, d in run))) for run in (row[i : i + ARITY] for i in range(0, len(row), ARITY))]
            out += [(tree, height, level, lo, hi, d) for lo, hi, d in row]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else schema.empty_table()

    return grow


def _tree(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """Leaves and nodes of every tree of ``rows`` (tree, digest, payload), and how many bands there are."""
    leaves = stage(_ranked(rows, order).select("tree", "height", "lo", "digest", "payload"), "merkle_leaves")
    tallest = leaves.agg(F.max("height")).first()[0] or 0
    bands = max(1, -(-tallest // BAND))
    low = leaves.select("tree", "height", F.lit(0).alias("level"), "lo", (F.col("lo") + 1).alias("hi"), "digest")
    nodes = None
    for band in range(bands):
        here = low.where(F.col("height") > BAND * band).groupBy("tree", _bucket(band).alias("_bucket"))
        grown = stage(here.applyInArrow(_grow(band), _NODE), "merkle_nodes")
        nodes = grown if nodes is None else nodes.unionByName(grown)
        low = grown.where(F.col("level") == BAND * (band + 1))
    return leaves, nodes, bands


def _roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    lone = leaves.where("height = 0").select("tree", "digest")
    return nodes.where("level = height").select("tree", "digest").unionByName(lone)


def build(docs: DataFrame, fields: Sequence[str], group: str = "source", key: str = "doc_id", payload: Column | None = None) -> Manifest:
    """The manifest of ``docs``. ``payload`` is carried along with the leaves; it is the key unless given."""
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaf = digest(*[field(F.col(c)) for c in fields])
    rows = docs.select(named.alias("tree"), F.col(key).alias("_key"), leaf.alias("digest"), (F.col(key) if payload is None else payload).alias("payload"))
    leaves, nodes, bands = _tree(stage(rows, "merkle_rows"), ["_key", "digest"])
    subroots = stage(_roots(leaves, nodes).select(F.lit("").alias("tree"), "digest", F.col("tree").alias("payload")), "merkle_subroots")
    top_leaves, top_nodes, top_bands = _tree(subroots, ["payload"])
    root = _roots(top_leaves, top_nodes).first()
    root = root["digest"] if root else None
    return Manifest(leaves, nodes, bands, Manifest(top_leaves, top_nodes, top_bands, None, root), root)


def _attach(band: int, held: Sequence[str]):
    bottom = BAND * band

    def attach(bucket: pa.Table, above: pa.Table) -> pa.Table:
        """For the bucket's lowest nodes: the siblings level by level, and what leads on from the bucket's top."""
        schema = pa.schema([*(bucket.schema.field(c) for c in held), ("path", _STEP_TYPE), ("subroot", pa.string())])
        if not len(bucket) or not len(above):
            return schema.empty_table()
        level = bucket.column("level").to_pylist()
        lo = bucket.column("lo").to_pylist()
        text = bucket.column("digest").to_pylist()
        digests = [{} for _ in range(BAND)]
        for a, b, c in zip(level, lo, text):
            digests[a - bottom][b] = c
        steps = min(bucket.column("height")[0].as_py() - bottom, BAND)
        onward = above.column("path")[0].as_py()
        children = [i for i, a in enumerate(level) if a == bottom]
        paths = []
        for i in children:
            path = []
            for step in range(steps):
                width = ARITY ** (bottom + step)
                own = lo[i] - lo[i] % width
                parent = lo[i] - lo[i] % (width * ARITY)
                # The parent's interval without the node's own.
                inside = digests[step]
                left = "".join(inside[s] for s in range(parent, own, width))
                right = "".join(inside[s] for s in range(own + width, parent + width * ARITY, width) if s in inside)
                path.append({"left": left, "right": right})
            paths.append(path + onward)
        rows = bucket.take(pa.array(children, pa.int64()))
        subroots = pa.array([above.column("subroot")[0].as_py()] * len(rows), pa.string())
        return pa.table([*(rows.column(c) for c in held), pa.array(paths, _STEP_TYPE), subroots], schema=schema)

    return attach


def _paths(m: Manifest, seeds: DataFrame) -> DataFrame:
    """tree, lo, digest, payload, path, subroot of every leaf; ``seeds`` has the path above each tree's root (tree, path, subroot)."""
    heights = m.leaves.where("lo = 0").select(F.col("tree").alias("_tree"), "height")
    seeds = seeds.join(heights, F.col("tree") == F.col("_tree")).select("tree", "path", "subroot", F.greatest(F.lit(0), F.ceil(F.col("height") / BAND) - 1).alias("_band"))
    seeds = stage(seeds, "merkle_seeds")
    plain = m.leaves.select("tree", "height", F.lit(0).alias("level"), "lo", "digest", "payload")
    kind = m.leaves.schema["payload"].dataType
    upper = m.nodes.select("tree", "height", "level", "lo", "digest", F.lit(None).cast(kind).alias("payload"))
    everything, lower = plain.unionByName(upper), None
    for band in reversed(range(m.bands)):
        top = seeds.where(F.col("_band") == band).select("tree", F.lit(0).cast("long").alias("_bucket"), "path", "subroot")
        if lower is not None:
            top = top.unionByName(lower.select("tree", F.floor(F.col("lo") / F.lit(ARITY ** (BAND * (band + 1)))).cast("long").alias("_bucket"), "path", "subroot"))
        level = F.col("level")
        levels = everything.where((level >= BAND * band) & (level < BAND * (band + 1)) & ((level < F.col("height")) | (level == 0)))
        # A band above the leaves carries no payload; its root is no one's sibling.
        levels = levels if band == 0 else levels.drop("payload")
        held = [c for c in ("tree", "lo", "digest", "payload") if c in levels.columns]
        names = T.StructType([*(levels.schema[c] for c in held), T.StructField("path", _PATH), T.StructField("subroot", T.StringType())])
        keyed = levels.withColumn("_bucket", _bucket(band))
        lower = keyed.groupBy("tree", "_bucket").cogroup(top.groupBy("tree", "_bucket")).applyInArrow(_attach(band, held), names)
        if band:
            lower = stage(lower, "merkle_paths")
    return lower


def proofs(m: Manifest) -> DataFrame:
    """tree, lo, digest (the leaf), payload, path (left and right siblings per level, leaf to root) and subroot of every leaf."""
    none = F.array().cast(_PATH)
    top_seed = m.top.leaves.where("lo = 0").select("tree", none.alias("path"), F.lit("").alias("subroot"))
    above = _paths(m.top, top_seed).select(F.col("payload").alias("tree"), "path", F.col("digest").alias("subroot"))
    return _paths(m, stage(above, "merkle_tops"))


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(F.col(path), leaf, lambda d, s: digest(s["left"], d, s["right"]))


def proof_digest(path: str = "path") -> Column:
    """One digest over all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(F.col(path), lambda s: F.concat(s["left"], s["right"])), ""))


def verify(m: Manifest, leaf: Column) -> DataFrame:
    """What ``proofs`` returns, with ``folded_root`` of ``leaf`` (of the payload, say) and whether it is the root."""
    folded = proofs(m).withColumn("folded_root", fold(leaf)).withColumn("root", F.lit(m.root).cast("string"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
