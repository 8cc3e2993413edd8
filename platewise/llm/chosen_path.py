"""Near-duplicate documents by a chosen-path similarity join on sets of five-word shingles.

Words are cut at blanks, A-Z is lower-cased, a document's set holds its distinct runs of five words (one run if it has
fewer). Documents with equal sets form one class, and only classes go on, so copies cost nothing.

A class is embedded as ``COORDINATES`` minwise values. Each of ``trees`` independent trees starts from one coordinate:
classes with the same value there share a node. Nodes above ``node_limit`` branch on, by ``children_at`` coordinates
(chosen by a hash of the node): at least 1.6 / threshold of them, so that pairs at the threshold stay together in more
than one child on average and parting the others loses few of them, however deep it goes. In the small nodes all
embeddings are compared, and those that agree four standard deviations below the threshold or better are joined.
``missed`` is the probability that all trees miss a pair at the threshold; ``trees_for`` takes as many as hold it at
``MISSED`` in nodes that branch ``depth`` times. Nodes whose children would take as many comparisons as they do
themselves (large families of near copies) and those still large at the end are cut into blocks, and each pair of blocks
is compared.

The joined classes form candidate groups. Each group's full sets are compared exactly, one document against all that
aren't reached yet; a link needs 100 * intersection >= percent * union. Groups above ``group_limit`` are compared block
by block. So every link is confirmed on full sets, and no link between candidates is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import pieces_of, whole_text
from platewise.operators.components import connected_components
from platewise.session import stage

COORDINATES = 128
#: All trees may miss a pair at the threshold with this probability.
MISSED = 1e-6
_SEED = 0x5EED

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """On bytes, lower() changes A-Z alone and split() cuts at space and \\t to \\r alone."""
    return text.encode().lower().split()


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        # A short sequence is one shingle; its length goes in, so that it differs from all others.
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = _mix(out) + h[k : k + n]
    return np.unique(_mix(out))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 31, COORDINATES, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, COORDINATES, np.uint32)


_ODD, _FLIP = _coefficients()


def embed(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values of non-empty sets, one row each and one column per coordinate (32 bits)."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    at = 0
    while at < len(sets):
        # As many sets at once as stay in a core's cache, or one long one.
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(sets[to]) <= 1 << 15):
            total += len(sets[to])
            to += 1
        flat = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at : to - 1]])
        work = np.empty_like(flat)
        for c in range(COORDINATES):
            np.bitwise_xor(flat, _FLIP[c], out=work)
            np.multiply(work, _ODD[c], out=work)
            out[at:to, c] = np.minimum.reduceat(work, starts)
        at = to
    return out


def _sets_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, set_key (null without words), sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, size) for text in pieces_of(batch, "text")]
            full = [i for i, s in enumerate(sets) if len(s)]
            n, key, sketch = [len(s) for s in sets], [None] * len(sets), [None] * len(sets)
            for i, row in zip(full, embed([sets[i] for i in full])):
                key[i], sketch[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary())],
                ["doc_id", "h", "n_shingles", "set_key", "sketch"],
            )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("h"), whole_text().alias("text"))
    return read.mapInArrow(rows, "doc_id long, h long, n_shingles long, set_key binary, sketch binary")


def children_at(percent: int) -> int:
    """The coordinates a large node branches on."""
    return min(COORDINATES, -(-160 // percent))


def missed(percent: int, trees: int, depth: int) -> float:
    """The probability that no tree keeps a pair at the threshold together, if its nodes branch ``depth`` times."""
    same, lost = percent / 100, 0.0
    for _ in range(depth):
        lost = (1 - same * (1 - lost)) ** children_at(percent)
    return (1 - same * (1 - lost)) ** trees


def trees_for(percent: int, depth: int) -> int:
    """The fewest trees that hold ``missed`` at MISSED; all coordinates if they don't suffice (below 14 percent)."""
    return next((t for t in range(1, COORDINATES) if missed(percent, t, depth) <= MISSED), COORDINATES)


def _pick(node: np.ndarray, salt: int, children: int, among: np.ndarray) -> list[np.ndarray]:
    """For each node the different coordinates it branches on: a hashed first one and the others at hashed steps."""
    a, n = _mix(node.astype(np.uint64) + np.uint64(salt)), len(among)
    stride = np.uint64(1) + (a >> np.uint64(32)) % np.uint64((n - 1) // (children - 1))
    return [among[((a % np.uint64(n) + np.uint64(k) * stride) % np.uint64(n)).astype(np.int64)] for k in range(children)]


def _children(df: DataFrame, level: int, trees: int, children: int, depth: int) -> DataFrame:
    """parent, node, set_key of the next level. Level 0: one node per tree, from its own coordinate."""
    order = np.random.default_rng(_SEED + 1).permutation(COORDINATES)
    roots, rest = order[:trees], np.array_split(order[trees:], max(1, depth))
    # Each level has its own coordinates, as one that was met before parts nothing; with too few left, all of them.
    among = rest[level - 1] if len(rest[-1]) >= children else order

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.frombuffer(b"".join(pieces_of(batch, "sketch")), np.uint32).reshape(n, COORDINATES).astype(np.uint64)
            keys = batch.column(batch.schema.get_field_index("set_key"))
            if level == 0:
                steps = [(np.full(n, c), np.full(n, t, np.uint64)) for t, c in enumerate(roots)]
            else:
                node = batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False).view(np.uint64)
                steps = [(c, node) for c in _pick(node, level, children, among)]
            for at, parent in steps:
                child = _mix(_mix(parent * np.uint64(1000003) + at.astype(np.uint64)) ^ values[np.arange(n), at])
                columns = [pa.array(parent.view(np.int64)), pa.array(child.view(np.int64)), keys]
                yield pa.RecordBatch.from_arrays(columns, ["parent", "node", "set_key"])

    return df.mapInArrow(rows, "parent long, node long, set_key binary")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each cell, from batches in order of their first column. One cell is held at a time."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != last and held:
                yield held
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield held


def _edge_batches(edges: Iterator[list[tuple[bytes, bytes]]]) -> Iterator[pa.RecordBatch]:
    held: list = []
    for some in edges:
        held += some
        if len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held)], ["a", "b"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held)], ["a", "b"])


def _join_similar(sketches: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs with ``least`` equal coordinates connect: what is reached is held against the rest."""
    n = len(sketches)
    if n <= 24:
        same = (sketches[:, None, :] == sketches[None, :, :]).sum(axis=2)
        return [(int(i), int(j)) for i, j in zip(*np.nonzero(same >= least)) if i < j]
    columns = np.ascontiguousarray(sketches.T)
    free = np.ones(n, bool)
    edges = []
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        wave = np.array([start])
        while len(wave):
            reached = []
            for at in range(0, len(wave), 64):
                rest = np.flatnonzero(free)
                if not len(rest):
                    break
                some = wave[at : at + 64]
                own, others = columns[:, some], columns[:, rest]
                same = np.zeros((len(some), len(rest)), np.uint8)
                for a, b in zip(own, others):
                    same += a[:, None] == b[None, :]
                hit = same >= least
                found = hit.any(axis=0)
                edges += zip(some[hit.argmax(axis=0)[found]].tolist(), rest[found].tolist())
                free[rest[found]] = False
                reached.append(rest[found])
            wave = np.concatenate(reached) if reached else np.zeros(0, int)
    return edges


def _exact_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect what exact links connect: each reached set is held against those not reached yet."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(ids, kind="stable")
    posting, first = owner[order], np.searchsorted(ids[order], np.arange(ids.max() + 2))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    free = np.ones(n, bool)
    edges = []
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        wave = [start]
        while wave:
            i = wave.pop()
            if not free.any():
                break
            own = ids[starts[i] : starts[i + 1]]
            lengths = first[own + 1] - first[own]
            flat = np.repeat(first[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            both = np.bincount(posting[flat], minlength=n)
            hit = np.flatnonzero(free & (100 * both >= percent * (sizes[i] + sizes - both)))
            free[hit] = False
            edges += [(i, int(j)) for j in hit]
            wave += hit.tolist()
    return edges


def _blocks(df: DataFrame, group: str, limit: int) -> DataFrame:
    """Rows of groups above ``limit`` (column ``_n``) once for each pair of blocks that their block is in (``_cell``)."""
    blocks = F.ceil(F.col("_n") * 2 / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64("set_key"), blocks).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, own).alias("x"), F.greatest(x, own).alias("y"))))
    return df.withColumn("_pair", pair).withColumn("_cell", F.xxhash64(group, "_pair.x", "_pair.y")).drop("_pair")


def candidate_edges(classes: DataFrame, percent: int, trees: int, node_limit: int, depth: int) -> DataFrame:
    """a, b (set_key): edges that connect all classes which share a node and look similar there."""
    level = stage(_children(classes.select("set_key", "sketch"), 0, trees, 1, depth).drop("parent"), "nodes")
    small = []
    for step in range(depth + 1):
        counts = level.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        full = stage(level.join(counts, "node"), "nodes")
        small.append(full.where(F.col("_n") <= node_limit).select(F.col("node").alias("_cell"), "set_key"))
        large = full.where(F.col("_n") > node_limit)
        if not large.limit(1).count():
            break
        if step == depth:
            small.append(_blocks(large, "node", node_limit).select("_cell", "set_key"))
        else:
            below = stage(_children(large.join(classes.select("set_key", "sketch"), "set_key"), step + 1, trees, children_at(percent), depth), "nodes")
            # One row for each large node: whether its children take fewer comparisons than it does itself.
            square = (F.col("_k") * F.col("_k").cast("double")).alias("_s")
            parts = below.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("_k")).groupBy("parent").agg(F.sum(square).alias("_s"))
            sizes = counts.where(F.col("_n") > node_limit).select(F.col("node").alias("parent"), "_n")
            parts = stage(parts.join(sizes, "parent").select("parent", (F.col("_s") < F.col("_n") * F.col("_n").cast("double")).alias("_on")), "nodes")
            whole = large.join(parts.where(~F.col("_on")).select(F.col("parent").alias("node")), "node", "left_semi")
            small.append(_blocks(whole, "node", node_limit).select("_cell", "set_key"))
            level = below.join(parts.where("_on"), "parent", "left_semi").select("node", "set_key")
    cells = small[0]
    for s in small[1:]:
        cells = cells.unionByName(s)
    p = percent / 100
    least = int(np.floor(COORDINATES * p - 4 * np.sqrt(COORDINATES * p * (1 - p))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges():
            for rows in _by_cell(batches):
                keys = [r[1] for r in rows]
                sketches = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).reshape(-1, COORDINATES)
                # 16 bits of each value tell them apart well enough.
                yield [(keys[i], keys[j]) for i, j in _join_similar((sketches & 0xFFFF).astype(np.uint16), least)]

        yield from _edge_batches(edges())

    shipped = cells.join(classes.select("set_key", "sketch"), "set_key").select("_cell", "set_key", "sketch")
    return shipped.repartition("_cell").sortWithinPartitions("_cell").mapInArrow(compare, "a binary, b binary")


def confirmed_edges(docs: DataFrame, classes: DataFrame, groups: DataFrame, percent: int, group_limit: int, size: int) -> DataFrame:
    """a, b (set_key): edges that connect what exact links within each candidate group (node, component) connect."""
    homes = groups.join(classes.select(F.col("set_key").alias("node"), "home.*"), "node")
    homes = homes.select(F.col("node").alias("set_key"), F.col("component").alias("group"), F.col("doc_id").alias("_d"), F.col("h").alias("_h"))
    counts = homes.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    homes = homes.join(counts, "group")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("h"), whole_text().alias("text"))
    # Rows with the same doc_id and text are one; any of them will do.
    texts = homes.join(read, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in pieces_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sets, pa.binary())], ["group", "set_key", "_n", "set"])

    sets = texts.select("group", "set_key", "_n", "text").mapInArrow(shingles, "group binary, set_key binary, _n long, set binary")
    sets = stage(sets, "sets")
    cells = sets.where(F.col("_n") <= group_limit).withColumn("_cell", F.xxhash64("group"))
    cells = cells.unionByName(_blocks(sets.where(F.col("_n") > group_limit), "group", group_limit))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges():
            for rows in _by_cell(batches):
                own = {r[1]: r[2] for r in rows}
                keys = list(own)
                yield [(keys[i], keys[j]) for i, j in _exact_links([np.frombuffer(s, np.uint64) for s in own.values()], percent)]

        yield from _edge_batches(edges())

    shipped = cells.select("_cell", "set_key", "set").repartition("_cell").sortWithinPartitions("_cell")
    return shipped.mapInArrow(confirm, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, percent: int = 85, size: int = 5, trees: int | None = None, node_limit: int = 2048, depth: int = 4, group_limit: int = 4096,
    with_text_hash: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    ``docs`` needs doc_id and text; other columns are ignored. Texts without words (null, empty, blank) have no
    shingles and are linked with nothing: their component is their own doc_id. Rows that repeat are linked with each
    other and all have the same answer. A row without doc_id takes part, but never names a component; in a component
    without any doc_id, component_id is null and every row is kept. An empty table gives no rows. ``trees``: as many as
    ``MISSED`` needs, if not given.
    """
    rows = stage(_sets_table(docs, size), "sets")
    home = F.struct("doc_id", "h")
    classes = rows.where(F.col("n_shingles") > 0).groupBy("set_key").agg(
        F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"), F.min(home).alias("home")
    )
    classes = stage(classes, "classes")
    groups = connected_components(candidate_edges(classes, percent, trees or trees_for(percent, depth), node_limit, depth))
    linked = connected_components(confirmed_edges(docs, classes, groups, percent, group_limit, size))
    named = linked.join(classes.select(F.col("set_key").alias("node"), "least"), "node")
    smallest = named.groupBy("component").agg(F.min("least").alias("_c"))
    found = named.join(smallest, "component").select(F.col("node").alias("set_key"), "_c")
    # Every class has one row here, so copies of one text meet no crowd.
    answers = classes.select("set_key", "least").join(found, "set_key", "left").select("set_key", F.coalesce("_c", "least").alias("_c"))
    out = rows.select("doc_id", "h", "n_shingles", "set_key").join(answers, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("_c"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    more = ["h"] if with_text_hash else []
    return out.select("doc_id", *more, "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of each near-duplicate component of ``docs``: the one with the smallest doc_id; columns as they are.

    Rows that repeat a doc_id and its text are one. What has no words stays, as do components without any doc_id.
    """
    kept = near_duplicates(docs, with_text_hash=True, **how).where("kept").select("doc_id", "h").distinct()
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64(whole_text()).alias("_t"))
    some = rows.join(kept, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h")), "left_semi")
    named = some.where(F.col("_d").isNotNull()).dropDuplicates(["_d", "_t"])
    return named.unionByName(some.where(F.col("_d").isNull())).select("_row.*")
