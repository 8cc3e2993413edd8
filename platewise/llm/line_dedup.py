"""Line deduplication that can be undone: exact reference counts of lines, behind sharded cuckoo filters.

A line's key is the line without blanks at both ends and with A-Z lower-cased, as a 128-bit hash. The store counts for
each key the documents that hold it. Keys found in at least ``min_docs`` documents lose their lines. For those keys each
shard (a hash range of keys) has a cuckoo filter: a compact first test for the lines of a document; what passes is
confirmed against the exact counts, so filters never change a result. Inserting documents raises counts and puts keys
that reach the threshold into the filters; deleting documents lowers counts and takes keys out again, which a Bloom
filter could not do.

Every row is a document: rows that repeat, also with the same doc_id, count as often as they come. A null text is one
empty line. Lines are short or long as they come; a document's lines meet in one task, a line's documents never do
(they are counted map-side first).
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import BLANK_BYTES, pieces_of, whole_text
from platewise.session import stage

#: Keys a filter shard should hold.
SHARD_KEYS = 1 << 20
#: Texts a task remembers, so as to deal with their copies once.
SEEN_TEXTS = 1 << 16
SLOTS = 4


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK_BYTES).lower()  # bytes.lower() changes A-Z alone


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode())


def hashed_keys(text: str, min_chars: int) -> list[bytes | None]:
    """The hash of each line's key; None for keys that are too short to count."""
    out = []
    for line in text.encode().split(b"\n"):
        key = line_key(line)
        long_enough = len(key) >= min_chars and (min_chars <= 1 or code_points(key) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each key has two buckets. Insertions and deletions come in batches."""

    def __init__(self, table: np.ndarray):
        self.table = table  # buckets x SLOTS, 0 is free; the number of buckets is a power of two

    @classmethod
    def for_keys(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter that holds ``hashes`` (64-bit), grown until all of them fit."""
        buckets = 1 << max(1, int(np.ceil(len(hashes) / SLOTS / 0.8)) - 1).bit_length()
        while True:
            out = cls(np.zeros((buckets, SLOTS), np.uint16))
            if out.insert(hashes):
                return out
            buckets *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum((hashes >> np.uint64(48)).astype(np.uint16), 1)
        first = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        spread = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return bucket ^ (spread & np.uint64(len(self.table) - 1)).astype(np.int64)

    def insert(self, hashes: np.ndarray, rounds: int = 400) -> bool:
        """Put in one entry per hash; False (with the filter spoilt) if they don't fit."""
        if len(hashes) > SLOTS * len(self.table):
            return False
        mark, bucket, other = self._places(hashes)
        rng = np.random.default_rng(len(hashes))
        for turn in range(rounds):
            for slot in range(SLOTS):
                free = np.flatnonzero(self.table[bucket, slot] == 0)
                where, first = np.unique(bucket[free], return_index=True)
                self.table[where, slot] = mark[free[first]]
                rest = np.ones(len(mark), bool)
                rest[free[first]] = False
                mark, bucket, other = mark[rest], bucket[rest], other[rest]
                if not len(mark):
                    return True
            if turn == 0:
                bucket, other = other, bucket
                continue
            # Each waiting entry throws one out of its bucket, one at a time per bucket; that one moves to its other.
            _, first = np.unique(bucket, return_index=True)
            slot = rng.integers(0, SLOTS, len(first))
            out = self.table[bucket[first], slot]
            self.table[bucket[first], slot] = mark[first]
            mark[first] = out
            bucket[first] = self._other(bucket[first], out)
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Take out one entry per hash; each must have been put in."""
        for mark, first, other in zip(*self._places(hashes)):
            for bucket in (first, other):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        mark, first, other = self._places(hashes)
        return ((self.table[first] == mark[:, None]) | (self.table[other] == mark[:, None])).any(axis=1)


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


@dataclasses.dataclass(frozen=True)
class LineStore:
    """A version of the store. refs: key, n (documents, or texts, that hold it). filters: shard, body. Both are stored tables."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int
    by_text: bool = False

    @property
    def frequent(self) -> DataFrame:
        return self.refs.where(F.col("n") >= self.min_docs).select("key")


def _shard(shards: int):
    """From the first bytes of the key, which the filters' own hash (the last eight) doesn't use."""
    return F.pmod(F.crc32(F.substring(F.col("key"), 1, 8)), F.lit(shards)).cast("int")


def count_lines(docs: DataFrame, min_chars: int = 1, by_text: bool = False) -> DataFrame:
    """key, n: how many rows of ``docs`` hold a line with this key; by_text: how many different texts do."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, owners = [], []
            for text in pieces_of(batch, "text"):
                own = [k for k in {*hashed_keys(text, min_chars)} if k]
                out += own
                owners += [xxhash.xxh3_64_intdigest(text) >> 1 if by_text else 0] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(owners, pa.int64())], ["key", "owner"])

    lines = docs.select(whole_text().alias("text")).mapInArrow(keys, "key binary, owner long")
    return (lines.distinct() if by_text else lines).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        body = CuckooFilter.for_keys(_halves(group["key"].tolist())[1]).to_bytes()
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "body": [body]})

    return frequent.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, body binary")


def _shards_for(keys: int) -> int:
    return 1 << max(0, -(-keys // SHARD_KEYS) - 1).bit_length()


def build_store(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, by_text: bool = False) -> LineStore:
    """A store that holds all rows of ``docs``.

    by_text: copies of a text count once. Such a store doesn't know which texts it has counted, so it takes no insertions
    and no deletions.
    """
    store = _with_filters(stage(count_lines(docs, min_chars, by_text), "line_refs"), min_docs, min_chars)
    return dataclasses.replace(store, by_text=by_text)


def _with_filters(refs: DataFrame, min_docs: int, min_chars: int) -> LineStore:
    frequent = refs.where(F.col("n") >= min_docs).select("key")
    shards = _shards_for(frequent.count())
    return LineStore(refs, stage(_build_filters(frequent, shards), "line_filters"), shards, min_docs, min_chars)


def insert(store: LineStore, docs: DataFrame) -> LineStore:
    """The store with the rows of ``docs`` added."""
    return _changed(store, docs, 1)


def delete(store: LineStore, docs: DataFrame) -> LineStore:
    """The store without the rows of ``docs``, which must have been inserted with the same texts."""
    return _changed(store, docs, -1)


def _changed(store: LineStore, docs: DataFrame, sign: int) -> LineStore:
    if store.by_text:
        raise ValueError("a store that counts texts can't tell which of them are new; build it anew")
    change = count_lines(docs, store.min_chars).select("key", F.lit(0).cast("long").alias("was"), (sign * F.col("n")).alias("n"))
    now = store.refs.select("key", F.col("n").alias("was"), "n").unionByName(change)
    now = stage(now.groupBy("key").agg(F.sum("was").alias("was"), F.sum("n").alias("n")), "line_changes")
    refs = stage(now.where(F.col("n") > 0).select("key", "n"), "line_refs")
    crossed = now.where((F.col("was") >= store.min_docs) != (F.col("n") >= store.min_docs))
    frequent = now.where(F.col("n") >= store.min_docs)
    if _shards_for(frequent.count()) > 2 * store.shards:
        return _with_filters(refs, store.min_docs, store.min_chars)

    min_docs = store.min_docs

    def update(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        """``keys``: the frequent keys and those that have just ceased to be."""
        shard = (keys if len(keys) else old)["shard"].iloc[0]
        stay, came = keys["n"] >= min_docs, keys["was"] < min_docs
        if len(old):
            out = CuckooFilter.from_bytes(old["body"].iloc[0])
            out.delete(_halves(keys["key"][~stay].tolist())[1])
            if out.insert(_halves(keys["key"][stay & came].tolist())[1]):
                return pd.DataFrame({"shard": [shard], "body": [out.to_bytes()]})
        return pd.DataFrame({"shard": [shard], "body": [CuckooFilter.for_keys(_halves(keys["key"][stay].tolist())[1]).to_bytes()]})

    known = frequent.unionByName(crossed.where(F.col("n") < store.min_docs)).withColumn("shard", _shard(store.shards))
    filters = known.groupBy("shard").cogroup(store.filters.groupBy("shard")).applyInPandas(update, "shard int, body binary")
    return LineStore(refs, stage(filters, "line_filters"), store.shards, store.min_docs, store.min_chars)


def _first_slots(store: LineStore, slots: int) -> np.ndarray:
    """Where each shard's slots begin, and their number at the end: about ``slots`` in all, at least one to a shard.

    A shard has slots in proportion to the lines with its keys, so that a very common line's shard is shared by many. One
    number per shard, that is per million frequent keys, comes to the driver.
    """
    load = np.zeros(store.shards)
    for r in store.refs.groupBy(_shard(store.shards).alias("shard")).agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    share = np.maximum(np.ceil(load * slots / max(load.sum(), 1)), 1).astype(np.int64)
    return np.concatenate([[0], np.cumsum(share)])


def _candidates(texts: DataFrame, store: LineStore) -> DataFrame:
    """text_key, key: the distinct line keys of each text that pass their shard's filter.

    Keys go to the slots of their shard, where a copy of its filter comes first and the keys stream past it: a task holds
    one filter at a time. A task deals with copies of a text once.
    """
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = _first_slots(store, tasks)
    shards, min_chars = store.shards, store.min_chars

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            names, keys, spread = [], [], []
            for name, text in zip(pieces_of(batch, "text_key"), pieces_of(batch, "text")):
                if name in seen:
                    continue
                if len(seen) >= SEEN_TEXTS:
                    seen.clear()
                seen.add(name)
                own = [k for k in {*hashed_keys(text, min_chars)} if k]
                names += [name] * len(own)
                keys += own
                spread += [int(name[:15], 16)] * len(own)
            slot = np.zeros(0, np.int64)
            if keys:
                shard = np.array([zlib.crc32(k[:8]) % shards for k in keys]) if shards > 1 else np.zeros(len(keys), np.int64)
                mixed = _halves(keys)[1] ^ np.array(spread, np.uint64)
                slot = first[shard] + (mixed % (first[shard + 1] - first[shard]).astype(np.uint64)).astype(np.int64)
            cells = [pa.array(slot, pa.int64()), pa.array(names, pa.string()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["slot", "text_key", "key"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_for = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            slot = batch.column(0).to_numpy()
            body, names, keys = batch.column(1), batch.column(2), batch.column(3)
            hits = [np.zeros(0, np.int64)]
            starts = np.flatnonzero(np.diff(slot, prepend=-1))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(slot)]):
                if body[at].is_valid:
                    held, held_for = CuckooFilter.from_bytes(body[at].as_py()), slot[at]
                    at += 1
                if at < end and held_for == slot[at]:
                    low = _halves(keys.slice(at, end - at).to_pylist())[1]
                    hits.append(at + np.flatnonzero(held.holds(low)))
            kept = pa.array(np.concatenate(hits))
            yield pa.RecordBatch.from_arrays([names.take(kept), keys.take(kept)], ["text_key", "key"])

    dealt = texts.select("text_key", "text").mapInArrow(deal, "slot long, text_key string, key binary")
    dealt = dealt.select("slot", F.lit(None).cast("binary").alias("body"), "text_key", "key")
    ends = spark.createDataFrame([(s, int(first[s]), int(first[s + 1]) - 1) for s in range(shards)], "shard int, low long, high long")
    copies = store.filters.join(ends, "shard").select(
        F.explode(F.sequence("low", "high")).alias("slot"), "body", F.lit(None).cast("string").alias("text_key"), F.lit(None).cast("binary").alias("key")
    )
    met = copies.unionByName(dealt).repartitionById(tasks, F.pmod("slot", F.lit(tasks)).cast("int"))
    return met.sortWithinPartitions("slot", F.col("body").isNull()).mapInArrow(probe, "text_key string, key binary")


def drop_lines(docs: DataFrame, store: LineStore) -> DataFrame:
    """``docs`` with ``text`` without the lines whose key is frequent in ``store``, and n_lines, n_dropped added.

    The other lines stay in order, joined by a line feed; a text that loses all lines becomes empty. Other columns stay
    as they are; columns named n_lines or n_dropped are replaced.
    """
    plain = docs.drop("n_lines", "n_dropped")
    names = plain.columns
    # Copies of a text share one entry, whatever their doc_id.
    keyed = plain.select(F.struct(*names).alias("_row"), whole_text().alias("text"), F.md5(whole_text()).alias("text_key"))
    hits = _candidates(keyed, store).join(store.frequent, "key", "left_semi")
    dropped = hits.groupBy("text_key").agg(F.collect_set("key").alias("_dropped"))
    min_chars = store.min_chars

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def keep(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, keys):
            lines = text.split("\n")
            if gone is None:
                out.append((text, len(lines), 0))
                continue
            gone = {bytes(k) for k in gone}
            kept = [x for x, k in zip(lines, hashed_keys(text, min_chars)) if k not in gone]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    joined = keyed.join(dropped, "text_key", "left").select("_row", keep("text", "_dropped").alias("_kept"))
    cells = [F.col("_kept.text" if n == "text" else f"_row.`{n}`").alias(n) for n in names]
    return joined.select(*cells, F.col("_kept.n_lines").alias("n_lines"), F.col("_kept.n_dropped").alias("n_dropped"))
