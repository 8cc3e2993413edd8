"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space as the word and line rules define it: space and \t to \r.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_BYTES = BLANKS.encode()


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; splits learning rows from held-out rows."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


def pieces_of(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def chunked(rows: Iterator[tuple], schema: pa.Schema, sizes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about ``sizes`` bytes from rows whose binary or text cells can be long."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str, list)))
        if weight >= sizes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def with_running_base(df: DataFrame, part: str, within: Sequence[str], amount: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows before this one in order of ``part``, then ``within``.

    ``part`` numbers the tasks that wrote ``df``, so each part is bounded and there are few parts: only one sum
    per part meets in one window. ``df`` should be a stored table, since it is read twice.
    """
    sums = df.groupBy(part).agg(F.sum(amount).alias("_sum"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(F.col(part).alias("_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(part).orderBy(*within).rowsBetween(W.unboundedPreceding, -1)
    here = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    out = here.join(bases, F.col(part) == F.col("_part")).withColumn(name, F.col("_base") + F.col("_inside"))
    return out.drop("_part", "_base", "_inside")
