"""The queries of the numbered operators, each over its whole table, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import (
    chosen_path,
    decontaminate,
    divergence,
    hash_forest,
    language,
    line_dedup,
    merkle,
    packing,
    quality_rules,
    sql,
    token_counts,
    toxicity,
    url_templates,
    wavelet,
)
from platewise.llm.common import crc_remainder, table
from platewise.session import new_folder

TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def op1_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hash_forest.distinct_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = hash_forest.build_index(vectors)
    return hash_forest.search(index, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "wavelet")
    wavelet.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return wavelet.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = token_counts.record_with_sections(table(spark, sf_dir, "documents"), ["source", "lang", "text"])
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    return token_counts.attribute_tokens(records, "record", "sections", path, pattern, rule="most")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_remainder("doc_id", 4) == 2
    model = language.fit(docs, ~held_out)
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_lines(docs, line_dedup.build_store(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, smoothing=5, top=50)


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = merkle.digest(*[merkle.field(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c)) for c in MANIFEST_FIELDS])
    payload = F.struct("doc_id", F.when(crc_remainder("doc_id", 2) == 0, altered).alias("altered"))
    manifest = merkle.build(docs, MANIFEST_FIELDS, payload=payload)
    checked = merkle.verify(manifest, F.coalesce("payload.altered", "digest"))
    return checked.select(
        F.col("payload.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        merkle.proof_digest().alias("proof_sha256"), "folded_root", "verified",
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*columns, F.array_join("failed", ",").alias("failed"))


QUERIES = {
    "op1_hash_forest": op1_hash_forest,
    "op2_wavelet_tokens": op2_wavelet_tokens,
    "op3_toxicity": op3_toxicity,
    "op4_token_attribution": op4_token_attribution,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_url_templates": op7_url_templates,
    "op8_line_dedup": op8_line_dedup,
    "op9_chosen_path": op9_chosen_path,
    "op10_language": op10_language,
    "op11_divergence": op11_divergence,
    "op12_merkle": op12_merkle,
    "op13_quality_rules": op13_quality_rules,
}
ORACLE = {
    "op8_line_dedup": sql.LINE_DEDUP,
    "op11_divergence": sql.DIVERGENCE,
    "op12_merkle": sql.MERKLE,
    "op13_quality_rules": sql.QUALITY_RULES,
}
