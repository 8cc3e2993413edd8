"""Source divergence audit: how far the sources of a language lie apart in their words.

Terms are runs of ASCII letters and non-ASCII characters, with A-Z alone lower-cased. Inside ``mapInArrow`` every batch
goes through Arrow's compute kernels (ascii_lower, split_pattern_regex, dictionary_encode, hash group_by) and leaves as
partial counts per language, source and term, already merged over the batches of a task. Spark merges the partial counts.
Each language keeps the terms found in at least ``min_docs`` of its documents; its kept terms are dealt by hash into
columnar shards of bounded size. A shard holds all sources' shares of its terms, so the distances of all pairs of sources
and the most overrepresented terms come from sums and short lists per shard.

Shares are whole numbers: ``p = 1 + floor(10^9 * (count + smoothing) / (N + smoothing * V))`` in decimal arithmetic, so
sums don't depend on their order. Null text, language and source are read as the empty text. Every row is a document:
rows that repeat count as often as they come. A group (language, source) without terms has counts of 0; a language
without kept terms has pairs at distance 0 and no terms. Equal values are ranked by the item's UTF-8 bytes. A very long
text is one row of a batch of its own; memory follows the longest text and ``HELD_BYTES``. An empty table gives no rows.
Only the three columns are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.llm.common import whole_text
from platewise.session import stage

#: Everything in ASCII but letters parts terms.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that go through the kernels at once, and bytes of partial counts that a task holds before it sends them.
TEXT_BYTES = 8 << 20
HELD_BYTES = 48 << 20
#: Shares (terms x sources) in a shard: from the first bound to the second, and in between enough terms that the sums of
#: all pairs of sources, which every shard sends on, stay an eighth of its shares.
SHARD_CELLS = (1 << 15, 1 << 22)
_KEYS = ["lang", "source", "term"]
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``TEXT_BYTES`` of text; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def _merged(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(_COUNTS.names)


def count_portion(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents per language, source and term; the empty term marks that the group occurs."""
    batch = pa.RecordBatch.from_arrays([batch.column(c).cast(pa.string()) for c in ("lang", "source", "text")], ["lang", "source", "text"])
    split = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=_BETWEEN)
    terms = pc.list_flatten(split)
    real = pc.not_equal(terms, "")
    coded = terms.filter(real).dictionary_encode()
    said = pa.table({"row": pc.list_parent_indices(split).filter(real), "code": coded.indices})
    per_doc = said.group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    rows = per_doc.column("row")
    spelled = coded.dictionary.cast(pa.string()).take(per_doc.column("code").combine_chunks())
    one = pa.array(np.ones(len(per_doc), np.int64))
    found = pa.table([batch.column("lang").take(rows), batch.column("source").take(rows), spelled, per_doc.column("count_all"), one], schema=_COUNTS)
    zero = pa.array(np.zeros(len(batch), np.int64))
    marks = pa.table([batch.column("lang"), batch.column("source"), pa.array([""] * len(batch)), zero, zero], schema=_COUNTS)
    return _merged([found, marks])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        for portion in _portions(batch):
            held.append(count_portion(portion))
            if sum(t.nbytes for t in held) > HELD_BYTES:
                held = [_merged(held)]
                if held[0].nbytes > HELD_BYTES // 2:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
    if held:
        yield from _merged(held).to_batches(max_chunksize=1 << 16)


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); the term '' with 0 stands for the group itself."""
    read = docs.select(whole_text(text).alias("text"), *[whole_text(F.col(c).cast("string")).alias(n) for c, n in ((lang, "lang"), (source, "source"))])
    partial = read.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return partial.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str, smoothing: int) -> Column:
    """Exact at any size: decimals are divided as whole numbers."""
    above = f"cast(1000000000 as decimal(12,0)) * cast({count} + {smoothing} as decimal(20,0))"
    return F.expr(f"1 + ({above}) div cast({total} + {smoothing} * {terms} as decimal(20,0))")


def _measure_shard(top: int):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def measure(shares: pa.Table, groups: pa.Table) -> pa.Table:
        """Sums of distances for all pairs of the language's sources over the shard's terms, and its leading terms by source."""
        if not len(shares) or not len(groups):
            return schema.empty_table()
        sources = groups.column("source").combine_chunks()
        coded = shares.column("term").combine_chunks().dictionary_encode()
        terms = coded.dictionary.to_pylist()
        order = sorted(range(len(terms)), key=lambda i: terms[i].encode())
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        row = place[coded.indices.to_numpy()]
        column = pc.index_in(shares.column("source").combine_chunks(), value_set=sources).to_numpy()
        p = np.repeat(groups.column("p").to_numpy()[None, :], len(terms), 0)
        p[row, column] = shares.column("p").to_numpy()
        q = np.empty(len(terms), np.int64)
        q[row] = shares.column("q").to_numpy()
        said = np.zeros(p.shape, bool)
        said[row, column] = True
        names, by_order = sources.to_pylist(), [terms[i] for i in order]
        lang = groups.column("lang")[0].as_py()
        out: list[tuple] = []
        for s, name in enumerate(names):
            far = np.abs(p - p[:, s : s + 1]).sum(0)
            out += [(lang, name, "pair", other, int(far[o])) for o, other in enumerate(names) if o != s]
            more = np.flatnonzero(said[:, s] & (p[:, s] > q))
            gain = p[more, s] - q[more]
            # Stable, so that equal values keep the terms' order.
            out += [(lang, name, "term", by_order[more[i]], int(gain[i])) for i in np.argsort(-gain, kind="stable")[:top]]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else schema.empty_table()

    return measure


def audit(
    docs: DataFrame, min_docs: int = 30, smoothing: int = 5, top: int = 50,
    text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the language's other sources and the leading terms of each group.

    ``pair``: item is another source, value the sum over kept terms of the difference of shares. ``term``: item is a term
    that the group uses more than its language does, value by how much; the ``top`` largest. Ranks start at 1.
    """
    counts = stage(count_terms(docs, text, lang, source), "term_counts")
    words = counts.where(F.col("term") != "")
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("lang_n"))
    kept = stage(kept.where(F.col("_docs") >= min_docs).select(F.col("lang").alias("_lang"), F.col("term").alias("_term"), "lang_n"), "kept_terms")
    same = (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term"))
    shares = stage(words.join(kept, same).select("lang", "source", "term", "n", "lang_n"), "kept_counts")

    # One row per language and per group.
    langs = kept.groupBy("_lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = shares.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term") == "").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = groups.join(langs, F.col("lang") == F.col("_lang"), "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")])
    width = F.count("*").over(W.partitionBy("lang"))
    size = F.least(F.lit(SHARD_CELLS[1]), F.greatest(F.lit(SHARD_CELLS[0]), 8 * width * width))
    groups = stage(groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("terms") * width / size)).cast("int")), "term_groups")

    shares = shares.join(groups, ["lang", "source"])
    shares = shares.select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term",
        _share("n", "total", "terms", smoothing).alias("p"), _share("lang_n", "lang_total", "terms", smoothing).alias("q"),
    )
    unused = groups.where("terms > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source",
        _share("cast(0 as bigint)", "total", "terms", smoothing).alias("p"),
    )
    keys = ["lang", "shard"]
    measured = shares.groupBy(*keys).cogroup(unused.groupBy(*keys)).applyInArrow(
        _measure_shard(top), "lang string, source string, part string, item string, value long"
    )
    # Languages that keep no term: every pair of sources at 0.
    bare = groups.where("terms = 0").select("lang", "source")
    other = bare.select(F.col("lang").alias("_lang"), F.col("source").alias("item"))
    apart = bare.join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item")))
    apart = apart.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    parts = measured.unionByName(apart).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
