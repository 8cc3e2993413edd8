"""Packing by power-of-two decomposition: each document is cut into pieces whose lengths are powers of two.

A document of n ids becomes n // limit pieces of ``limit`` ids and one piece for each set bit of the remainder,
longest first. A piece is a sequence of its own: sequences hold one document only and need no padding. Equal
lengths are bucketed: sequence ids run without gaps, bucket after bucket from the shortest, so a batch of one length
is a range of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.llm.common import chunked, pieces_of, whole_text
from platewise.llm.word_encoder import encoder
from platewise.session import new_folder

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, ids binary, part long, bucket_row long"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
     ("ids", pa.binary()), ("part", pa.int64()), ("bucket_row", pa.int64())]
)


def piece_lengths(n: int, limit: int) -> list[int]:
    """``n`` as pieces of ``limit`` (a power of two) and then falling powers of two."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, doc_tokens (ids of the document
    with its end id), ids (little-endian unsigned 32-bit), sequence_id, offset (always 0), bucket (its length).

    ``docs`` needs doc_id and text; other columns are ignored. A null text is empty and gives the end id alone. A null
    doc_id stays null. Rows that repeat are packed as often as they come. An empty table gives no rows. The pieces are
    stored once; per task and length only counts are gathered. Nothing is shuffled by document or length, so no
    document, source or length is hot.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), {}

        def rows():
            for batch in batches:
                for doc, text in zip(pieces_of(batch, "doc_id"), pieces_of(batch, "text")):
                    ids = enc.encode(text) + end
                    n, at = len(ids) // 4, 0
                    for size in piece_lengths(n, limit):
                        seen[size] = row = seen.get(size, -1) + 1
                        yield doc, at, size, n, ids[4 * at : 4 * (at + size)], part, row
                        at += size

        yield from chunked(rows(), _ARROW)

    spark = docs.sparkSession
    path = new_folder(spark, "pieces")
    read = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    read.mapInArrow(cut, SCHEMA).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(SCHEMA).parquet(path)
    # One row per task and length: at most 13 x tasks rows.
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("length", "part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return pieces.join(bases, ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", "ids",
        (F.col("_base") + F.col("bucket_row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"),
    )
