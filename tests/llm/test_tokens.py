"""Encoding, wavelet shards, packing and token attribution against the libraries themselves."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from platewise.llm import packing, token_counts, wavelet
from platewise.llm.word_encoder import WordEncoder
from platewise.session import new_folder
from tests.llm.helpers import ODD, frame, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = [(950, " ".join(t for _, t in prose(5, 60)) + " " + "x" * 3000)]


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_words_put_together_are_the_text(reference):
    enc = WordEncoder(PATH)
    assert enc.by_word
    rng = random.Random(1)
    letters = "aAbeéÉßöĀſˇª×1९ .,;'’\"\n\t\r\x0b\x1c  ́İΣςs't<|>%*-_数"
    texts = [t for _, t in ODD + LONG] + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["don't it's I'LL we'd", "<|endoftext|>a <|startoftext|> <|EndOfText|>", "é É, É."]
    for text in texts:
        assert list(np.frombuffer(enc.encode(text or ""), "<u4")) == reference(text)[:-1], repr(text)


@pytest.mark.parametrize("top", [1, 2, 700, 49408, 70000])
def test_wavelet_matrix(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, top, n).astype("<u4")
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
        assert (m.decode() == ids).all()
        for i in rng.integers(0, n, min(n, 20)).tolist():
            assert m.access(i) == ids[i]
            t, lo = int(ids[i]), i // 2
            assert m.count(t, lo, i) == (ids[lo:i] == t).sum()
            where = np.flatnonzero(ids == t)
            assert [m.select(t, k) for k in range(len(where))][:50] == where[:50].tolist()
            assert m.select(t, len(where)) == -1
        assert m.count(top + 5) == 0 and m.select(1 << 20, 0) == -1


def test_shards_round_trip(spark, reference):
    rows = ODD + LONG + prose(2, 40)
    path = new_folder(spark, "test_wavelet")
    wavelet.write_tokens(frame(spark, rows).repartition(3), path, PATH, shard_ids=300)
    got = [(r["doc_id"], r["start"], r["n_tokens"], list(np.frombuffer(r["ids"], "<u4"))) for r in wavelet.read_tokens(spark, path).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r[0] for r in rows], key=lambda d: (d is not None, d))
    at = 0
    for _, start, n, ids in got:
        assert start == at and n == len(ids)
        at += n
    want = sorted((str(d), reference(t)) for d, t in rows)
    assert sorted((str(d), ids) for d, _, _, ids in got) == want
    stream = [i for r in got for i in r[3]]
    token = max(set(stream), key=stream.count)
    found = wavelet.occurrences(spark, path, token).collect()
    assert len(found) > 1
    assert sorted(p for r in found for p in r["positions"]) == [i for i, t in enumerate(stream) if t == token]


def test_shards_of_nothing(spark):
    path = new_folder(spark, "test_wavelet")
    wavelet.write_tokens(frame(spark, []), path, PATH)
    assert wavelet.read_tokens(spark, path).count() == 0


def test_piece_lengths():
    for n in range(1, 400):
        pieces = packing.piece_lengths(n, 64)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 64 for p in pieces) and pieces == sorted(pieces, reverse=True)
        assert len(set(p for p in pieces if p < 64)) == sum(p < 64 for p in pieces)


def test_packing(spark, reference):
    rows = ODD + LONG + prose(3, 40)
    got = packing.pack(frame(spark, rows).repartition(3), PATH, limit=256).withColumn("crc", F.crc32("ids")).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths), "equal lengths stand together"
    by_doc: dict = {}
    for r in got:
        ids = list(np.frombuffer(r["ids"], "<u4"))
        assert r["offset"] == 0 and r["length"] == len(ids) == r["bucket"] and r["length"] & (r["length"] - 1) == 0
        assert r["crc"] == zlib.crc32(bytes(r["ids"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    repeated = {905}
    for doc, text in rows:
        parts = sorted(by_doc[doc])
        want = reference(text)
        if doc in repeated:
            parts = parts[::2]
        assert [i for _, ids, _ in parts for i in ids] == want and all(n == len(want) for *_, n in parts)
        assert [s for s, *_ in parts] == [sum(len(ids) for _, ids, _ in parts[:k]) for k in range(len(parts))]
    assert packing.pack(frame(spark, []), PATH).count() == 0


BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_against_library_offsets(spark, rule):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = [(i, t) for i, t in ODD + prose(4, 20) + [(960, "数学 😀😀 naïve\n\n\n  x ")]]
    rng = random.Random(2)
    cut = {}
    data = []
    for k, (doc, text) in enumerate(rows):
        n = len(text or "")
        at = sorted(rng.sample(range(n + 1), min(n + 1, 6)))
        cut[k] = [(f"s{j % 4}", a, b) for j, (a, b) in enumerate(zip(at[::2], at[1::2]))]
        data.append((k, text, cut[k]))
    df = spark.createDataFrame(data, "doc_id long, text string, sections array<struct<name:string,begin:int,end:int>>")
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"], r["n_chars"]) for r in token_counts.attribute_tokens(df, "text", "sections", BYTES, public_tokenizers.PATTERN, rule).collect()}
    for k, text, parts in data:
        text = text or ""
        owner = [None] * len(text)
        number = [-1] * len(text)
        edges = {x for _, a, b in parts for x in (a, b)}
        for j, (name, a, b) in enumerate(parts):
            for i in range(a, b):
                owner[i], number[i] = name, j
        want: dict = {}
        for name, a, b in parts:
            want.setdefault(name, [0, 0, 0])[2] += b - a
        if None in owner:
            want.setdefault(None, [0, 0, 0])[2] += owner.count(None)
        for a, b in library.encode(text, add_special_tokens=False).offsets:
            b = max(b, a + 1)
            inside = range(a, b)
            if rule == "most":
                best = max(inside, key=lambda i: (sum(number[x] == number[i] for x in inside), -i))
            else:
                best = a if rule == "first" else b - 1
            cell = want.setdefault(owner[best], [0, 0, 0])
            cell[0] += 1
            cell[1] += any(x in edges for x in range(a + 1, b))
        assert {n: tuple(v) for n, v in want.items()} == {n: v for (d, n), v in got.items() if d == k}, (k, text)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_of_nested_sections(spark, rule):
    """A character belongs to the section that begins last of those around it; what follows goes back to the outer one."""
    rng = random.Random(7)
    data = [(0, "some text that is 24 long", [("outer", 0, 24), ("inner", 5, 9)])]
    for k, (_, text) in enumerate([*prose(6, 12, 20), (0, ""), (0, None)], 1):
        n = len(text or "")
        spans = [sorted(rng.choices(range(n + 1), k=2)) for _ in range(rng.randint(0, 6))]
        data.append((k, text, [(f"s{j}", a, b) for j, (a, b) in enumerate(spans)]))
    df = spark.createDataFrame(data, "doc_id long, text string, sections array<struct<name:string,begin:int,end:int>>").withColumn("section", F.lit(1))
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_chars"]) for r in token_counts.attribute_tokens(df, "text", "sections", BYTES, public_tokenizers.PATTERN, rule).collect()}
    assert got[0, "outer"][1] == 20 and got[0, "inner"][1] == 4
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    for k, text, spans in data:
        text = text or ""
        around = [[s for s in spans if s[1] <= i < s[2]] for i in range(len(text))]
        owner = [max(a, key=lambda s: (s[1], -s[2], s[0]))[0] if a else None for a in around]
        want = {name: [0, owner.count(name)] for name, _, _ in spans}
        if None in owner:
            want[None] = [0, owner.count(None)]
        for a, b in encode(text, add_special_tokens=False).offsets:
            inside = owner[a : max(b, a + 1)]
            own = max(inside, key=inside.count) if rule == "most" else inside[0 if rule == "first" else -1]
            want.setdefault(own, [0, 0])[0] += 1
        assert {n: v for (d, n), v in got.items() if d == k} == {n: tuple(v) for n, v in want.items()}, (k, text, spans)


def test_attribution_of_odd_tables(spark):
    kind = "doc_id long, text string, sections array<struct<name:string,begin:int,end:int>>"
    how = ("text", "sections", BYTES, public_tokenizers.PATTERN)
    assert token_counts.attribute_tokens(spark.createDataFrame([], kind), *how).count() == 0
    long = LONG[0][1] * 5
    rows = [(1, long, [("all", 0, len(long))]), (1, long, None), (None, "x", [("none", 0, None), ("late", 50, 60)])]
    got = token_counts.attribute_tokens(spark.createDataFrame(rows, kind).withColumn("n_tokens", F.lit("x")), *how).collect()
    n = {(r["doc_id"], r["section"]): r["n_tokens"] for r in got}
    assert n[1, "all"] == n[1, None] > 1000 and n[None, None] == 1 and n[None, "late"] == 0


def test_attribution_of_fields(spark):
    df = spark.createDataFrame([(1, "src0", None, "Hello there"), (2, None, "en", None)], "doc_id long, source string, lang string, text string")
    records = token_counts.record_with_sections(df, ["source", "lang", "text"])
    assert [r["record"] for r in records.orderBy("doc_id").collect()] == ["src0  Hello there", " en "]
    got = token_counts.attribute_tokens(records, "record", "sections", BYTES, public_tokenizers.PATTERN)
    sums = {r["doc_id"]: r["c"] for r in got.groupBy("doc_id").agg(F.sum("n_chars").alias("c")).collect()}
    assert sums == {1: 17, 2: 4}
    with pytest.raises(ValueError):
        token_counts.attribute_tokens(records, "record", "sections", BYTES, public_tokenizers.PATTERN, "half")
