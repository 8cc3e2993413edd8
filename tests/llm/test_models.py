"""Search, URL templates, toxicity and language against brute force and held-out rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import hash_forest, language, toxicity, url_templates, word_grams
from platewise.llm.common import crc_remainder
from platewise.llm.word_grams import grams
from tests.llm.helpers import ODD, frame


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x")).withColumn("dim", F.lit(1))


def search(df, every=10, **how):
    clean = hash_forest.distinct_vectors(df, "vec_id", "embedding")
    found = hash_forest.search(hash_forest.build_index(clean, trees=8, shard_rows=100), clean.where(F.col("vec_id") % every == 0), trees=8, **how)
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def brute(rows, every=10, k=5):
    keep = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q, x in keep.items():
        if q % every == 0:
            scores = [(-(x @ y) / np.linalg.norm(x) / np.linalg.norm(y), i) for i, y in keep.items() if i != q and len(y) == len(x)]
            best = sorted((round(s, 12), i) for s, i in scores)[:k]
            if best:
                out[q] = [(i, -s) for s, i in best]
    return out


def vector_rows(n=400):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[10][1]) for i in range(30)] + [(2000, [1.0, 2.0]), (2010, [2.0, 1.0]), (2020, [1.0])]
    odd = [(3000, None), (3010, []), (3020, [0.0] * 12), (3030, [1.0] * 11 + [None]), (3040, [float("nan")] * 12), (3050, [float("inf")] * 12), (None, [1.0] * 12)]
    return rows + odd + rows[:3] + [(4000, [1e200] * 12), (4010, [1e-200] * 11 + [2e-200])]


def test_forest_is_exact_when_it_looks_at_all(spark):
    rows = vector_rows()
    got, want = search(vectors(spark, rows), share=1.0), brute([r for r in rows if r[0] not in (4000, 4010)])
    want_ids = {q: [i for i, _ in v] for q, v in want.items()}
    far = {4000, 4010}
    for q in want_ids:
        ids = [i for i, _ in got[q]]
        if not far & set(ids):
            assert ids == want_ids[q], q
            assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    assert got.keys() == want.keys() | far
    assert got[4000][0][0] == 4010 and got[2000] == [(2010, pytest.approx(0.8))] and 2020 not in got
    assert [i for i, _ in got[10]] == [1000, 1001, 1002, 1003, 1004]


def test_forest_recall_and_nothing(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16)) * 2
    rows = [(i, (centres[i % 40] + rng.standard_normal(16)).tolist()) for i in range(2000)]
    got, want = search(vectors(spark, rows), share=0.3, least=10), brute(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    assert search(vectors(spark, [])) == {}


def test_candidates_descend_and_ascend():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (3, 200), np.uint64)
    order = np.argsort(keys, axis=1)
    own = rng.integers(0, 1 << 63, (3, 20), np.uint64)
    shared = lambda a, b: 64 - (int(a) ^ int(b)).bit_length()
    for q, found in enumerate(hash_forest.candidates(np.take_along_axis(keys, order, 1), order, own, 30)):
        best = [max(shared(own[t, q], keys[t, i]) for t in range(3)) for i in range(200)]
        level = max(x for x in range(65) if sum(b >= x for b in best) >= 30)
        assert found.tolist() == [i for i, b in enumerate(best) if b >= level]


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def url_rows():
    rng = random.Random(3)
    hosts = ["a.example.org", "Example.ORG", "shop.com", "x.shop.com", "news.net", "com", "notexample.org"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/'])}{rng.choice(['fr', 'de', 'en', 'es'])}/{rng.choice(['tag', str(rng.randrange(500))])}{rng.choice(['', '/', '?q=/de/', '#x'])}" for _ in range(600)]
    odd = [None, "", "no scheme/de/", "http://", "http://org", "://org/", "http://A.ORG?x=://com/de/", "x\n://com/de/\n", "http://u@shop.com:80/de/1", "http://com/fr", "http://com/" + "/".join("abcdefghijkl")]
    return list(enumerate(urls + odd + odd))


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for v, r in RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def brute_templates(rows, min_pages, z, weight, depth, block_at=0.5):
    pages = [(*brute_rule(u), i) for i, u in rows]
    paths: dict = {}
    for host, path, _, verdict, _ in pages:
        c = paths.setdefault((host, path), [0, 0, 0])
        c[0] += 1
        c[1] += verdict is not None
        c[2] += verdict == "block"
    segments = {k: re.sub("^/", "", k[1]).split("/", depth - 1 if depth else -1) for k in paths}
    total = [sum(c[j] for c in paths.values()) for j in range(3)]
    base = total[2] / total[1] if total[1] else 0.0

    def smoothed(group_of, parent):
        sums: dict = {}
        for k, c in paths.items():
            s = sums.setdefault(group_of(k), [0, 0, parent(k)])
            s[0] += c[1]
            s[1] += c[2]
        return {g: (b + weight * p) / (n + weight) for g, (n, b, p) in sums.items()}

    zone = smoothed(lambda k: k[0].split(".")[-1], lambda k: base)
    purity = smoothed(lambda k: k[0], lambda k: zone[k[0].split(".")[-1]])
    purity = {k: purity[k[0]] for k in paths}
    template = dict.fromkeys(paths, "")
    for level in range(max(map(len, segments.values()))):
        here = [k for k in paths if len(segments[k]) > level]
        child: dict = {}
        node: dict = {}
        for k in here:
            for table, key in ((child, (k[0], template[k], segments[k][level])), (node, (k[0], template[k]))):
                c = table.setdefault(key, [0, 0, 0])
                for j in range(3):
                    c[j] += paths[k][j]
        kept = set()
        for key, (n, la, b) in child.items():
            _, nl, nb = node[key[:2]]
            p, q, pool = (b + 1) / (la + 2), (nb - b + 1) / (nl - la + 2), (nb + 2) / (nl + 4)
            if n >= min_pages and abs(p - q) > z * (pool * (1 - pool) * (1 / (la + 2) + 1 / (nl - la + 2))) ** 0.5:
                kept.add(key)
        for k in here:
            template[k] += "/" + (segments[k][level] if (k[0], template[k], segments[k][level]) in kept else "*")
        sums: dict = {}
        for k in here:
            s = sums.setdefault((k[0], template[k]), [0, 0, purity[k]])
            s[0] += paths[k][1]
            s[1] += paths[k][2]
        for k in here:
            n, b, p = sums[k[0], template[k]]
            purity[k] = (b + weight * p) / (n + weight)
    return {i: (h, p, r, v or ("block" if purity[h, p] >= block_at else "allow"), template[h, p], round(purity[h, p], 9)) for h, p, r, v, i in pages}


@pytest.mark.parametrize("depth", [None, 8, 2])
def test_url_templates(spark, depth):
    rows = url_rows()
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("template", F.lit("y")).withColumn("n", F.lit(1))
    got = url_templates.judge_urls(df, RULES, min_pages=10, z=1.0, weight=2.0, depth=depth).collect()
    mine = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["template"], round(r["purity"], 9)) for r in got}
    assert len(got) == len(rows)
    assert mine == brute_templates(rows, 10, 1.0, 2.0, depth)
    assert any("*" not in t[4] and t[4] for t in mine.values()) and any("*" in t[4] for t in mine.values())
    assert url_templates.judge_urls(df.limit(0), RULES).count() == 0
    assert url_templates.judge_urls(df, ()).where("rule is not null or verdict = 'block'").count() == 0


def test_url_templates_of_long_paths(spark):
    """Labels that differ far down are told apart, and one endless path doesn't stop the others."""
    rows = [f"https://deep.net/a/b/c/d/e/f/g/h/{k}/{i}" for k in ("good", "bad") for i in range(60)]
    rows = [*rows, "https://deep.net/" + "x/" * 3000, *[f"https://few.net/p/q/r/s/t/u/v/w/{i}" for i in range(5)]]
    rules = (("allow", "deep.net/a/b/c/d/e/f/g/h/good/1"), ("block", "deep.net/a/b/c/d/e/f/g/h/bad/1"))
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_templates.judge_urls(df, rules).collect()}
    unruled = {k: {got[i]["verdict"] for i, u in enumerate(rows) if f"/{k}/" in u and got[i]["rule"] is None} for k in ("good", "bad")}
    assert unruled == {"good": {"allow"}, "bad": {"block"}}
    assert got[120]["template"].count("/*") >= 2990 and len(got) == len(rows)


def test_grams_are_all_grams():
    words = ["idiot", "", "ü", "straße"]
    bucket, owner = grams(words, (1, 2, 3), 1 << 10, whole=True)
    for i, w in enumerate(words):
        assert (owner == i).sum() == sum(max(0, len(w) + 2 - n + 1) for n in (1, 2, 3)) + 1
    again, _ = grams(["idiot"], (1, 2, 3), 1 << 10, whole=True)
    assert sorted(bucket[owner == 0]) == sorted(again)


def toxic_rows(n=400):
    rng = random.Random(1)
    syllables = ["an", "der", "tion", "ou", "li", "pre", "sto", "ma"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.choice([20, 60, 300]))
        bad = i % 4 == 0
        if bad:
            for at in rng.sample(range(len(text)), 3):
                text[at] = rng.choice(["scoundrel", "Nitwit,", "blockhead"])
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_rows()
    extra = [(5000, "an der nitwiit tion li"), (5001, "ou li blokhead pre sto ma an der tion"), (5002, "an der tion ou li pre")] + ODD
    marked = spark.createDataFrame([*labels, (1, None), (None, 1), (9999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    all_docs = frame(spark, docs + extra)
    held_out = crc_remainder("doc_id", 5) == 0
    model = toxicity.fit(all_docs, marked, ~held_out)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(all_docs, model).collect()}
    right = [got[i][1] == (i % 4 == 0) for i, _ in docs]
    assert np.mean(right) > 0.98
    # Unseen misspellings share n-grams with the words they stand for: they score above all clean texts as short as they are.
    clean = [got[i][0] for i, t in docs if i % 4 and len(t.split()) == 20]
    assert min(got[5000][0], got[5001][0]) > max(clean) > 0 and got[5002][1] == 0
    assert all(0 <= s <= 1 for s, _ in got.values())
    assert got[900] == got[901] == got[902] == got[906] == (0.0, 0)
    again = toxicity.fit(all_docs.repartition(5), marked, ~held_out)
    assert np.array_equal(model.margins, again.margins) and model.offset == again.offset


def test_toxicity_keeps_rare_toxic_words():
    # A word in a few toxic texts only, beside a common one that is also found in texts marked clean.
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abdegiklmnorstu", k=rng.randint(3, 8))) for _ in range(1500)]

    def text(*more):
        words = rng.choices(vocabulary, k=60)
        for word in more:
            words.insert(rng.randrange(len(words)), word)
        return " ".join(words)

    texts = [text() for _ in range(300)] + [text("grolbex") for _ in range(60)] + [text("zunnik") for _ in range(12)] + [text("grolbex") for _ in range(60)]
    labels = np.repeat([0, 1, 0], [300, 72, 60])
    rare, clean = [text("zunnik") for _ in range(40)], [text() for _ in range(200)]
    model = toxicity.train(texts, labels, (360, 72))

    def rejected(some):
        tops = [toxicity.highest(toxicity.word_margins(t.split(), model.margins)[:, 0]) for t in some]
        return sum(model.slope * (x + model.bias) + model.offset >= 0 for x in tops)

    assert rejected(rare) >= 20 and rejected(clean) <= 4


def test_toxicity_without_labels(spark):
    docs, labels = toxic_rows(20)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    scored = toxicity.score(frame(spark, docs), toxicity.fit(frame(spark, docs), empty, F.lit(True)))
    assert scored.where("predicted = 1").count() == 0
    one = spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, toxic int")
    assert toxicity.score(frame(spark, docs), toxicity.fit(frame(spark, docs), one, F.lit(True))).where("predicted = 0").count() == 0
    assert toxicity.score(frame(spark, []), toxicity.fit(frame(spark, []), empty, F.lit(True))).count() == 0


def language_rows():
    rng = random.Random(2)
    kinds = {"en": ["th", "ing", "wh", "ow", "ea"], "de": ["sch", "ei", "ung", "ß", "ch"], "fr": ["eau", "é", "que", "oi", "ç"], "es": ["ción", "ñ", "rr", "ll", "os"], "xx": ["zhk", "vrk", "qj", "xk", "kv"]}
    rows = []
    for i in range(500):
        lang = list(kinds)[i % 5]
        rows.append((i, " ".join("".join(rng.choices(kinds[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return rows


def test_language(spark):
    rows = language_rows()
    odd = [(d, t, None) for d, t in ODD] + [(1000, "12 34 !!", "en"), (1001, None, "en"), (1002, rows[1][1], None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    held_out = crc_remainder("doc_id", 4) == 2
    model = language.fit(df, ~held_out)
    assert {x for f in model.families for x in f} == {"en", "de", "fr", "es", "xx"}
    assert {("de", "en"), ("es", "fr")} <= {tuple(sorted(set(f) & {"en", "de"})) for f in model.families} | {tuple(sorted(set(f) & {"fr", "es"})) for f in model.families}
    rated = language.predict(df, model).withColumn("held_out", held_out).collect()
    own = {i: x for i, _, x in rows}
    tested = [r["lang_pred"] == own[r["doc_id"]] for r in rated if r["held_out"] and r["doc_id"] in own]
    assert len(tested) > 80 and np.mean(tested) > 0.98
    by = {r["doc_id"]: r for r in rated}
    for d in (900, 901, 902, 906, 1000, 1001):
        assert (by[d]["lang_pred"], by[d]["score"]) == ("und", 0.0)
    assert by[1002]["lang_pred"] == rows[1][2] and all(0 <= r["score"] <= 1 for r in rated)
    assert {r["lang_pred"] for r in rated} <= {"und", *own.values()}


def test_language_without_examples(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert language.fit(df, F.lit(True)) is None
    assert language.predict(df, None).first()["lang_pred"] == "und"
    one = spark.createDataFrame([(1, "some words", "en"), (2, "others", "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.predict(one, language.fit(one, F.lit(True))).collect()} == {"en"}
    assert language.predict(df.limit(0), language.fit(df.limit(0), F.lit(True))).count() == 0


def naive_grams(word, sizes, buckets):
    """Buckets of a word's n-grams, one word at a time."""
    return word_grams.grams([word], sizes, buckets, whole=False)[0].tolist()


def test_letters_and_numerals(spark):
    texts = ["½ ² ①", "Ⅷ ⅳ", "12 3_4 --", "", None, "ß", "①a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = language.train(["the cat and the dog", "der hund und die katze"], ["en", "de"])
    got = [r["lang_pred"] for r in language.predict(df, model).orderBy("doc_id").collect()]
    assert got[:5] == ["und"] * 5 and "und" not in got[5:]


@pytest.fixture(scope="module")
def some_docs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(260).collect()
    rows = [tuple(r) for r in rows] + [(9001, " ".join(r["text"] for r in rows[:120]), "en"), (9002, None, None), (9003, "", "fr"), (9004, "...", "fr")]
    return rows + rows[:3]


def test_language_scores_equal_a_naive_scorer(spark, some_docs):
    model = language.train([t or "" for _, t, _ in some_docs], [n or "en" for _, _, n in some_docs])
    df = spark.createDataFrame(some_docs, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    for r in language.predict(df, model).collect():
        sums, count = np.zeros(len(model.bias)), 0
        for chunk in (r["text"] or "").lower().split():
            for b in naive_grams(word_grams.plain(chunk), language.SIZES, language.BUCKETS) if word_grams.plain(chunk) else []:
                sums += model.weights[b]
                count += 1
        want = language.decide(sums / max(1, count) + model.bias, model) if any(c.isalpha() for c in r["text"] or "") else ("und", 0.0)
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], rel=1e-9)


def test_machines_reach_the_least_loss():
    """Against plain gradient descent on the same loss, dense and with many steps."""
    rng = np.random.default_rng(2)
    dense = (rng.random((60, language.BUCKETS)) < 0.01) * rng.random((60, language.BUCKETS))
    sign = np.where(rng.random(60) < 0.3, 1.0, -1.0)
    x = language.Profiles([(np.flatnonzero(r), r[r > 0]) for r in dense])
    w = rng.standard_normal(language.BUCKETS)
    np.testing.assert_allclose(x.times(w), dense @ w)
    np.testing.assert_allclose(x.summed(sign), dense.T @ sign)
    cost = 10.0 * np.where(sign > 0, 60 / (2 * (sign > 0).sum()), 60 / (2 * (sign < 0).sum())) / 60

    def loss(w, b):
        return 5e-4 * w @ w + (cost * np.maximum(0, 1 - sign * (dense @ w + b)) ** 2).sum()

    best, b = np.zeros(language.BUCKETS), 0.0
    rate = 1 / (1e-3 + 2 * cost.max() * (np.linalg.norm(dense @ dense.T, 2) + 60))
    for _ in range(20_000):
        slack = np.maximum(0, 1 - sign * (dense @ best + b)) * cost * sign
        best, b = best - rate * (1e-3 * best - 2 * dense.T @ slack), b + rate * 2 * slack.sum()
    assert loss(*language.svm(x, sign, turns=4000)) <= loss(best, b) * 1.001
    assert loss(*language.svm(x, sign)) <= 0.2 * loss(np.zeros(language.BUCKETS), 0.0)


def test_repeated_ids_teach_one_fixed_text(spark):
    rows = [(1, "zebra the", "en"), (1, "apple the", "en"), (1, "", "en"), (2, "der hund", "de")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        model = language.fit(df, F.lit(True))
        want = language.train(["apple the", "der hund"], ["en", "de"])
        np.testing.assert_array_equal(model.weights, want.weights)


def test_language_sample_follows_the_hash(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "concat('word', id) as text", "if(id % 3 = 0, 'en', 'de') as lang")
    taught = []
    real = language.train
    language.train = lambda texts, names: taught.extend(zip(texts, names))
    try:
        language.fit(df, F.lit(True), per_language=40)
    finally:
        language.train = real
    rows = df.select("text", "lang", F.xxhash64("doc_id").alias("h")).collect()
    want = [(r["text"], r["lang"]) for n in ("en", "de") for r in sorted((r for r in rows if r["lang"] == n), key=lambda r: r["h"])[:40]]
    assert sorted(taught) == sorted(want)


def test_toxicity_scores_equal_a_naive_scorer(spark, some_docs):
    rng = np.random.default_rng(1)
    texts = [t or "" for _, t, _ in some_docs]
    model = toxicity.train(texts, (rng.random(len(texts)) < 0.4).astype(int))
    df = spark.createDataFrame([r[:2] for r in some_docs], "doc_id long, text string")
    for r in toxicity.score(df, model).collect():
        values = []
        for chunk in (r["text"] or "").lower().split():
            word = word_grams.plain(chunk)
            if word:
                values.append(np.mean([model.margins[b] for b in naive_grams(word, toxicity.SIZES, toxicity.BUCKETS)]))
        if not values:
            assert r["score"] == 0
            continue
        n = toxicity.WINDOW
        top = max(np.mean(values[i : i + n]) for i in range(max(1, len(values) - n + 1)))
        want = 1 / (1 + np.exp(-(model.slope * (top + model.bias) + model.offset)))
        assert r["score"] == pytest.approx(want, rel=1e-6, abs=1e-9) and r["predicted"] == (r["score"] >= 0.5)
