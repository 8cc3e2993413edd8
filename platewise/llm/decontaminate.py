"""Benchmark decontamination with SimHash windows, multi-index Hamming blocks and exact verification.

Words are runs of letters and digits, lower-cased. A document's windows have the word count of a benchmark item. Only a
window that shares a five-word run with the benchmark can reach the similarity asked for, so windows are laid where such
a run lines up with an item (clipped at the document's ends), and their SimHash is taken over all their words. A 64-bit
fingerprint is four blocks of 16 bits. If a window's and an item's fingerprints differ in at most 19 bits, some block
differs in at most four, so joining items of the window's own size, with up to three bits of a block changed, and
windows, with up to one, finds all such pairs. What is left is verified on the multisets of five-word runs: the sum of
the smaller counts over the sum of the larger ones must reach ``similarity``.

Everything is DataFrame expressions. Equal texts are looked at once per text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import whole_text
from platewise.session import stage

RUN = 5
#: Benchmark runs and their places in items up to which they are sent to every task; beyond it the join is shuffled.
SENT_RUNS = 1_000_000
#: Fingerprints are cut into blocks of so many bits; items are looked up with so many bits of a block changed, windows too.
BLOCK_BITS, ITEM_FLIPS, WINDOW_FLIPS = 16, 3, 1
#: Distances up to which that finds every pair: one more bit in each of the four blocks would be needed to miss one.
RADIUS = 4 * (ITEM_FLIPS + WINDOW_FLIPS) + 3
#: Groups that the copies of a text are first brought together in.
COPIES = 64


def word_hashes(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+")
    # A text that ends in a mark leaves one empty word at the end.
    words = F.filter(words, lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def runs(hashes: Column) -> Column:
    """A hash per run of five words; a shorter sequence is one run."""
    n = F.size(hashes)
    long = F.transform(F.sequence(F.lit(0), n - RUN), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(RUN)]))
    short = F.array(F.xxhash64(F.concat_ws(" ", F.transform(hashes, lambda h: h.cast("string")))))
    return F.when(n >= RUN, long).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def windows_of(hashes: Column, m: int) -> Column:
    """A hash per run of ``m`` words, less than five; it is that of a text of just these words."""
    at = F.sequence(F.lit(1), F.size(hashes) - (m - 1))
    every = F.transform(at, lambda i: F.xxhash64(F.concat_ws(" ", F.transform(F.slice(hashes, i, m), lambda h: h.cast("string")))))
    return F.when(F.size(hashes) >= m, every).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the words' hashes have it set."""
    def bit(b: int) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > F.size(hashes), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    bits = [bit(b) for b in range(64)]
    out = bits[0]
    for other in bits[1:]:
        out = out.bitwiseOR(other)
    return out


def _masks(least: int, most: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(least, most + 1) for bits in combinations(range(BLOCK_BITS), n)]


def blocks(fingerprint: Column, changes: list[tuple[int, int]]) -> Column:
    """The fingerprint's four blocks of 16 bits, each with its number, changed by every (tag, mask) of ``changes``."""
    masks = F.expr("array(" + ", ".join(f"struct({tag} AS tag, {mask}L AS mask)" for tag, mask in changes) + ")")

    def near(no: int) -> Column:
        value = F.shiftrightunsigned(fingerprint, no * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))
        return F.transform(masks, lambda m: F.struct(F.lit(no).alias("no"), m["tag"].alias("tag"), value.bitwiseXOR(m["mask"]).alias("value")))

    return F.concat(*[near(no) for no in range(64 // BLOCK_BITS)])


#: A block that differs in up to three bits is met once, as it stands (tag 0); one that differs in four, with one bit
#: changed on the window's side and three on the item's (tag 1).
WINDOW_CHANGES = [(0, 0), *[(1, m) for m in _masks(1, WINDOW_FLIPS)]]
ITEM_CHANGES = [*[(0, m) for m in _masks(0, ITEM_FLIPS)], *[(1, m) for m in _masks(ITEM_FLIPS, ITEM_FLIPS)]]


def near_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows and items of the same size that agree in a block up to ``ITEM_FLIPS + WINDOW_FLIPS`` bits, and their distance.

    ``windows``: text_key, start, m, print. ``items``: item_id, m, print. Two fingerprints that differ in at most ``RADIUS``
    bits differ in at most a quarter of them in some block, so all such pairs are found.
    """
    left = windows.select("text_key", "start", "m", "print", F.explode(blocks(F.col("print"), WINDOW_CHANGES)).alias("block"))
    right = items.select("item_id", "m", F.col("print").alias("item_print"), F.explode(blocks(F.col("print"), ITEM_CHANGES)).alias("block"))
    # Shuffled by the hash of the block: the items' table, some 5,000 rows an item, is not for the driver to hand out.
    near = left.join(right.hint("shuffle_merge"), ["m", "block"])
    return near.withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))


def _weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger ones, of the values in two arrays."""
    def times(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda y: y == x))

    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (word number), n_words, hamming, similarity: the best window per document and item.

    Of equally similar windows the one with the nearer fingerprint, then the earlier one is given. ``docs`` needs doc_id
    and text, ``benchmark`` item_id and text; other columns are ignored. Null and empty texts have no windows and match
    nothing. Rows that repeat the same doc_id and text give one row per item; a null doc_id is kept as it is. Empty tables
    give no rows. An item shorter than five words is found where its words stand in a row. A text is looked at whole.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the blocks find distances up to {RADIUS}")
    texts = docs.select(F.col("doc_id"), whole_text().alias("text")).withColumn("text_key", F.md5("text"))
    items = benchmark.select("item_id", word_hashes(whole_text()).alias("hashes")).where(F.size("hashes") > 0)
    items = items.withColumn("runs", runs(F.col("hashes"))).withColumn("m", F.size("hashes"))
    items = stage(items.withColumn("print", simhash(F.col("hashes"))), "benchmark_items")
    # At most the four lengths below five.
    short = sorted(r["m"] for r in items.where(F.col("m") < RUN).select("m").distinct().collect())
    item_runs = items.select("m", F.posexplode("runs").alias("_at", "run")).distinct()
    item_runs = stage(item_runs.groupBy("run").agg(F.collect_set(F.struct("_at", "m")).alias("places")), "benchmark_runs")
    size = item_runs.agg(F.count("*") + F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    known = F.broadcast(item_runs) if size <= SENT_RUNS else item_runs
    hashed = texts.select("text_key", word_hashes(F.col("text")).alias("hashes"))
    own_runs = [runs(F.col("hashes")), *[windows_of(F.col("hashes"), m) for m in short]]
    positions = hashed.select("text_key", F.posexplode(own_runs[0]).alias("pos", "run"))
    for extra in own_runs[1:]:
        positions = positions.unionByName(hashed.select("text_key", F.posexplode(extra).alias("pos", "run")))
    laid = positions.join(known, "run").select("text_key", "pos", F.explode("places").alias("place"))
    laid = laid.select("text_key", (F.col("pos") - F.col("place._at")).alias("start"), F.col("place.m").alias("m")).distinct()
    laid = stage(laid.groupBy("text_key").agg(F.collect_set(F.struct("start", "m")).alias("windows")), "windows")
    # One row per text again, so that copies are not looked at twice; they are brought together in two steps.
    own = texts.join(laid.select("text_key"), "text_key", "left_semi")
    own = own.groupBy("text_key", F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)).alias("_c")).agg(F.first("text").alias("text"))
    own = own.groupBy("text_key").agg(F.first("text").alias("text")).join(laid, "text_key")
    own = own.select("text_key", word_hashes(F.col("text")).alias("hashes"), "windows")
    windows = own.select("text_key", "hashes", F.explode("windows").alias("w")).select(
        "text_key", F.greatest("w.start", F.lit(0)).alias("start"), "w.m",
        F.expr("slice(hashes, greatest(w.start, 0) + 1, w.m + least(w.start, 0))").alias("part"),
    )
    windows = windows.distinct().withColumn("print", simhash(F.col("part"))).withColumn("part_runs", runs(F.col("part")))
    windows = stage(windows, "windows")
    near = near_pairs(windows, items).where(F.col("hamming") <= radius)
    near = near.select("text_key", "start", "m", F.col("print").alias("_print"), "item_id", "hamming").distinct()
    # Windows of one start and size can still differ in length where they are cut at the document's front.
    same = ["text_key", "start", "m"]
    checked = near.join(windows, same).where(F.col("print") == F.col("_print"))
    checked = checked.select("text_key", "start", F.size("part").alias("n_words"), "item_id", "hamming", "part_runs")
    checked = checked.join(items.select("item_id", F.col("runs").alias("item_runs")), "item_id")
    checked = checked.withColumn("similarity", _weighted_similarity(F.col("part_runs"), F.col("item_runs")))
    found = checked.where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", -F.col("hamming"), -F.col("start"), "n_words", "start", "hamming")).alias("w")
    found = found.groupBy("text_key", "item_id").agg(best).select("text_key", "item_id", "w.start", "w.n_words", "w.hamming", "w.similarity")
    named = texts.select("doc_id", "text_key").distinct()
    return named.join(found, "text_key").drop("text_key").select("doc_id", "item_id", "start", "n_words", "hamming", "similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; columns as they are."""
    leaked = find_leaks(docs.select(F.md5(whole_text()).alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, F.md5(whole_text()) == F.col("_leaked"), "left_anti")
