"""Source divergence, Merkle manifest and quality rules against brute force over odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from platewise.llm import divergence, merkle, quality_rules, registry
from platewise.session import new_folder

from .helpers import ODD, prose

LONG = "word " * 30_000 + "\n" + "Öder straße " * 5_000 + "***" * 1000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("term", "n", "docs", "part", "item", "value", "rank", "shard", "tree", "lo", "hi", "level", "digest", "path", "payload", "height", "_key", "_words", "_text", "n_words", "failed", "kept", "_row", "_body", "root", "leaf")


def corpus():
    """Several languages and sources, null ones too, repeated rows, shared ids, odd texts and a very long one."""
    rows = []
    for i, text in prose(3, 160, 40):
        lang = ("en", "de", "", None)[i % 4]
        rows.append((i, text, lang, (None, "", "a", "B", "ß", "=x")[(i // 2) % 6], len(text)))
    for i, text in ODD:
        rows.append((i, text, "en", "odd", None))
    rows += [(2000, LONG, "en", "a", 7), (2001, "x\x00y A\x00b", None, None, 0), (2002, "Zürich zürich ZÜRICH É é", "fr", "only", -1)]
    return rows + rows[:5] + [(7, "another text of a known id", "en", "a", 3)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(5).cache()


def folder_of(spark, docs) -> str:
    folder = new_folder(spark, "audit")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    return folder


# --- divergence ---------------------------------------------------------------------------------------------------


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_audit(rows, min_docs, smoothing, top):
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t or "")) for _, t, *_ in rows]
    place = [(g or "", s or "") for _, _, g, s, _ in rows]
    found, counts = defaultdict(Counter), defaultdict(Counter)
    for (lang, source), said in zip(place, terms):
        found[lang].update(set(said))
        counts[lang, source].update(said)
    out = []
    for lang in {g for g, _ in place}:
        kept = {t for t, n in found[lang].items() if n >= min_docs}
        groups = sorted({p for p in place if p[0] == lang})
        whole = sum((counts[g] for g in groups), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + smoothing) // (total + smoothing * len(kept)) for t in kept}

        p, q = {g: shares(counts[g]) for g in groups}, shares(whole)
        for g in groups:
            pairs = [(sum(abs(p[g][t] - p[h][t]) for t in kept), h[1]) for h in groups if h != g]
            over = [(p[g][t] - q[t], t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found_items, last in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(found_items, key=lambda x: (-x[0], x[1].encode()))[:last]
                out += [(*g, part, item, value, r) for r, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs,top", [(3, 50), (1, 4), (10_000, 5)])
def test_divergence(docs, min_docs, top):
    got = divergence.audit(docs, min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(corpus(), min_docs, 5, top)


def test_divergence_in_many_shards_and_batches(spark, docs, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_CELLS", (64, 64))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(tuple, divergence.audit(docs, min_docs=2).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_audit(corpus(), 2, 5, 50)


def test_partial_counts_are_sent_in_portions(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "TEXT_BYTES", 100)
    monkeypatch.setattr(divergence, "HELD_BYTES", 2000)
    rows = [(g or "", s or "", t or "") for _, t, g, s, _ in corpus()]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "source", "text"])
    sent = list(divergence._partial_counts(iter([batch, batch.slice(0, 0), batch])))
    assert len(sent) > 3
    totals = Counter()
    for b in sent:
        for r in b.to_pylist():
            totals[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter()
    for g, s, t in rows * 2:
        want.update((g, s, x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t)))
    assert +totals == want


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("9000000000000000 as n", "9000000000000001 as total", "40000000 as terms")
    got = row.select(divergence._share("n", "total", "terms", 5)).first()[0]
    assert got == 1 + 10**9 * (9000000000000000 + 5) // (9000000000000001 + 200000000)


# --- Merkle manifest ----------------------------------------------------------------------------------------------


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, cut=False):
    d, t, g, s, n = row
    t = t.replace("\n", "") if cut and t is not None else t
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, g, n, t)])


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h(*row[i : i + 3]) for i in range(0, len(row), 3)])
    return levels


def brute_path(levels, i):
    out = []
    for row in levels[:-1]:
        first = i // 3 * 3
        out.append(("".join(row[first:i]), "".join(row[i + 1 : first + 3])))
        i //= 3
    return out


def brute_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r, leaf_of(r), leaf_of(r, True)))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: brute_tree([x[1] for x in by_source[s]]) for s in names}
    top = brute_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (r, leaf, altered) in enumerate(by_source[s]):
            path = brute_path(trees[s], i) + brute_path(top, k)
            d = altered if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else leaf
            for left, right in path:
                d = h(left, d, right)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], h(*[a + b for a, b in path]), d, d == top[-1][0]))
    return sorted(out, key=str)


def test_merkle_query(spark, docs):
    got = registry.op12_merkle(spark, folder_of(spark, docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute_manifest(corpus())
    assert {r[-1] for r in rows} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (4, 27, 28), (730, 729, 1, 2)])
def test_merkle_shapes(spark, sizes):
    rows = [(i, f"t\n{i}", "en", f"s{k}", i) for k, size in enumerate(sizes) for i in range(size)]
    docs = frame(spark, rows).repartition(3)
    m = merkle.build(docs, registry.MANIFEST_FIELDS)
    checked = merkle.verify(m, F.col("digest"))
    got = {(r["tree"], r["payload"]): r for r in checked.collect()}
    assert len(got) == len(rows) and all(r["verified"] for r in got.values())
    want = {(d, leaf): proof for d, leaf, _, _, proof, _, _ in brute_manifest(rows)}
    proofs = merkle.proofs(m).select("payload", "digest", merkle.proof_digest().alias("p")).collect()
    assert {(r["payload"], r["digest"]): r["p"] for r in proofs} == want


def test_merkle_intervals(spark):
    rows = [(i, str(i), "en", "s", i) for i in range(2500)]
    m = merkle.build(spark.createDataFrame(rows, SCHEMA), ["doc_id", "text"])
    nodes = m.nodes.collect()
    for r in nodes:
        assert r["lo"] % 3 ** r["level"] == 0 and r["hi"] == min(2500, r["lo"] + 3 ** r["level"])
    assert Counter(r["level"] for r in nodes) == {k: -(-2500 // 3**k) for k in range(1, 9)}
    assert m.bands == 2


# --- quality rules ------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    n, rep = len(words), len(repeated)
    chars, symbols, dup = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    stops = sum(w.strip(".,;:!?\"'()").lower() in quality_rules.STOP_WORDS for w in words)
    blank = " \t\n\x0b\x0c\r"
    bullets = sum(x.strip(blank)[0] in "-*•" for x in lines)
    cut = sum(x.strip(blank).endswith(("...", "…")) for x in lines)
    failed = [
        name
        for name, bad in (
            ("few_words", n < 10),
            ("repeated_words", 100 * rep > 20 * n),
            ("short_words", 100 * chars < 200 * n),
            ("long_words", 100 * chars > 1400 * n),
            ("symbols", 100 * symbols > 10 * n),
            ("few_stop_words", n >= 100 and 100 * stops < n),
            ("repeated_lines", 100 * dup > 40 * len(lines)),
            ("bullet_lines", n >= 50 and 100 * bullets > 90 * len(lines)),
            ("cut_lines", n >= 50 and 100 * cut > 30 * len(lines)),
        )
        if bad
    ]
    base = bool({"few_words", "repeated_words"} & set(failed))
    return n, chars, symbols, dup, rep, base, not failed, ",".join(failed)


SHAPES = [
    (3000, "a b c d e f g h i j k l"),
    (3001, "one two three four five six seven eight nine ten one two three four five"),
    (3002, "\n".join(["- a line with some words in it and more"] * 3 + [f"- the {i} th of it" for i in range(20)])),
    (3003, "\n".join(f"it is the {i} th line of this ..." for i in range(20))),
    (3004, "\n".join(f"it is the {i} th line of this…\t" for i in range(20))),
    (3005, "pneumonoultramicroscopic " * 3 + "of the " + " ".join(f"uncharacteristically{i}" for i in range(12))),
    (3006, "\r\n".join(["same line here", "same line here ", "same line here", "x" * 40] + [f"the {i} of a" for i in range(3)])),
    (3007, "a a a a a a a a a a a a"),
    (3008, "w1 w2 w3 w4 w5 " + " ".join(f"u{i}" for i in range(100)) + " w1 w2 w3 w4 w5 w6 w2 w3 w4 w5 w6"),
    (3009, "\x85 \xa0   x y \U0001f600\U0001f600 | < > # the of and to"),
]


def test_quality_query(spark, docs):
    rows = corpus() + [(i, t, "en", "q", 1) for i, t in SHAPES]
    got = registry.op13_quality_rules(spark, folder_of(spark, frame(spark, rows)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"]
    assert got.columns == names
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 6 + ["boolean"] * 2 + ["string"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((d, *brute_quality(t)) for d, t, *_ in rows), key=str)


def test_quality_windows_with_equal_hashes(spark, monkeypatch):
    """Windows that share a hash by chance are told apart by their words."""
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.size(c[0]).cast("long"))
    rows = [(i, t, "en", "q", 1) for i, t in SHAPES]
    got = quality_rules.judge(frame(spark, rows)).select("doc_id", "n_repeat_words").collect()
    assert {r[0]: r[1] for r in got} == {d: brute_quality(t)[4] for d, t, *_ in rows}


def test_quality_keeps_rows_and_runs_without_python(spark, docs):
    rules = (quality_rules.Rule("short", "n_words", below=500),)
    kept = quality_rules.keep_good(docs, rules)
    assert kept.columns == docs.columns
    want = sorted((r for r in corpus() if len((r[1] or "").split()) >= 5 or r[0] == 907), key=str)
    assert sorted(map(tuple, kept.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str) == want
    plain = spark.range(3).selectExpr("id as doc_id", "'a text' as text")
    plan = quality_rules.judge(plain)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Exchange", "Arrow"))


def test_no_rows(spark, docs):
    empty = folder_of(spark, docs.limit(0))
    for name in ("op11_divergence", "op12_merkle", "op13_quality_rules"):
        assert registry.QUERIES[name](spark, empty).count() == 0
