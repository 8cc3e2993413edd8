"""The pipeline: each stage against brute force on its own input, and the registered queries on the smallest tables."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from platewise.llm import registry
from platewise.session import new_folder, stage
from tests.llm.helpers import ODD, prose
from tests.llm.test_dedup import brute_components, brute_leaks, brute_lines, shingles

BAD = ["scoundrel", "nitwit", "blockhead"]


@pytest.fixture(scope="module")
def inputs(spark):
    """A small corpus of each kind of document, as tables in a folder."""
    rows, labels = [], []
    for i, text in prose(20, 160, 80):
        words = text.split(" ")
        if i % 5 == 0:
            words[3:3] = [BAD[i % 3], BAD[(i + 1) % 3]]
            words[20:20] = [BAD[(i + 2) % 3]]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    clean = [t for i, t in rows if i % 5]
    items = [(i, t) for i, t in prose(21, 4, 40)]
    for k in range(12):
        rows.append((2000 + k, clean[k] + "\nthe very same line of some words\n" + clean[k + 20]))
    rows += [(3000 + k, clean[40]) for k in range(15)] + [(3100 + k, clean[41].replace(" the", " THE", k)) for k in range(3)]
    rows += [(4000 + k, clean[50 + k] + "\n" + items[k][1] + "\n" + clean[60 + k]) for k in range(4)]
    rows += ODD
    folder = new_folder(spark, "corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long"), "score": F.lit("x"), "n_lines": F.lit(7)})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, inputs):
    folder, items = inputs
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [rows_of(docs)]
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, folder), f"test_{name}")
        assert docs.columns == columns
        seen.append(rows_of(docs))
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)
    start, harmless, cut, single, clean = seen
    gone = {r for r in start if r not in harmless}
    assert gone == {r for r in start if r[1] and any(w in r[1].split() for w in BAD)}
    texts = sorted({t for _, t in harmless if t is not None})
    want = [(d, k) if n else (d, t) for (d, t), (_, k, _, n) in zip(harmless, (brute_lines([r], 10, counted=[(0, t) for t in texts])[0] for r in harmless))]
    assert cut == sorted(want, key=str) and cut != harmless
    stays = {(d, n): k for d, n, _, k in brute_components(cut, 80)}
    assert single == sorted({r for r in cut if stays[r[0], len(shingles(r[1]))]}, key=str)
    assert sum(d in range(3000, 3015) for d, _ in single) == 0, "their original has a smaller id"
    leaked = {d for d, _ in brute_leaks(single, items)}
    assert clean == [r for r in single if r[0] not in leaked] and leaked == {4000, 4001, 4002, 4003}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    by_doc: dict = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        by_doc.setdefault(r["doc_id"], []).append((r["start"], list(np.frombuffer(r["ids"], "<u4"))))
    assert {d: [i for _, ids in sorted(v) for i in ids] for d, v in by_doc.items()} == {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in clean}


def test_stages_of_nothing(spark, inputs):
    folder, _ = inputs
    empty = new_folder(spark, "corpus")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_registered_names():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES}) == list(range(1, 14))
    assert registry.ORACLE.keys() <= registry.QUERIES.keys()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "decontamination", "packing"]


@pytest.mark.parametrize("name", ["op1_hash_forest", "op7_url_templates", "op4_token_attribution"])
def test_queries_run(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


CONTRACT = {
    "op1_hash_forest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_wavelet_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_url_templates": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op8_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op9_chosen_path": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_decontamination": {"doc_id": "bigint", "item_id": "bigint", "similarity": "double"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_of_the_registered_queries(spark, name):
    folder = "/root/testdata/sf0.001"
    got = registry.QUERIES[name](spark, folder)
    kinds = dict(got.dtypes)
    assert {c: kinds[c] for c in CONTRACT[name]} == CONTRACT[name]
    rows = got.collect()
    table = {"op1_hash_forest": ("embeddings", "vec_id"), "op7_url_templates": ("pages", "page_id")}.get(name, ("documents", "doc_id"))
    ids = [r[0] for r in spark.read.parquet(f"{folder}/{table[0]}.parquet").select(table[1]).collect()]
    if name == "op1_hash_forest":
        asked = [i for i in ids if i % 50 == 0]
        assert sorted((r["query_id"], r["rank"]) for r in rows) == sorted((i, k) for i in asked for k in range(1, 6))
    elif name == "op5_packing":
        held: dict = {}
        for r in rows:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert 0 < r["length"] <= 4096
        for pieces in held.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:])) and min(pieces)[0] == 0
        assert {r["doc_id"] for r in rows} == set(ids) and sorted(held) == list(range(len(held)))
    elif name != "op6_decontamination":
        assert sorted(r[table[1]] for r in rows) == sorted(ids)
    if name in ("op3_toxicity", "op10_language"):
        modulus, rest = (5, 0) if name == "op3_toxicity" else (4, 2)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) and 0 <= r["score"] <= 1 for r in rows)
