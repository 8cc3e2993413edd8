"""The corpus pipeline: stages that each apply one operator to all that the stage before kept.

toxicity: texts that the classifier rejects go. line_dedup: lines found in at least 10 different texts go from every
document (copies of a text count once, so that they stay copies for the next stage). near_dup: one document of each
component of near-duplicates stays. decontamination: documents that hold a benchmark passage go. packing: what stays is
encoded and cut into power-of-two sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import chosen_path, decontaminate, line_dedup, packing, toxicity
from platewise.llm.common import crc_remainder, table
from platewise.session import stage

TOKENIZER = "word_bpe_49k.json"
MIN_TEXTS = 10
NEAR_PERCENT = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return toxicity.score(rows, model).where("predicted = 0").select("_row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store = line_dedup.build_store(docs.select("text"), min_docs=MIN_TEXTS, by_text=True)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    kept = line_dedup.drop_lines(rows, store)
    # A text that loses nothing stays as it is, also a null one.
    changed = F.col("n_dropped") > 0
    cells = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    cells["text"] = F.when(changed, F.col("text")).otherwise(cells["text"])
    if "n_chars" in cells:
        kind = docs.schema["n_chars"].dataType
        cells["n_chars"] = F.when(changed, F.char_length("text").cast(kind)).otherwise(cells["n_chars"])
    return kept.select(*[v.alias(c) for c, v in cells.items()])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_one(docs, percent=NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Training, cuckoo filters, minwise trees and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
