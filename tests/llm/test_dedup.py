"""Line dedup, near-duplicates and decontamination against brute force."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import chosen_path, decontaminate, line_dedup
from platewise.operators.components import connected_components
from tests.llm.helpers import ODD, frame, prose


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_lines(rows, min_docs, min_chars=1, counted=None):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    n = collections.Counter()
    for _, text in counted if counted is not None else rows:
        n.update({key(x) for x in (text or "").split("\n") if len(key(x)) >= min_chars})
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or n[key(x)] < min_docs]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def line_rows(seed=1, n=60):
    rng = random.Random(seed)
    pool = ["Common Line", " common line\t", "ÄB", "äb", "", "　", "x", "longer line " * 40, "once\x85", "A\x1cB"]
    rows = [(i, "\n".join(rng.choice([*pool, f"own {i} {k}"]) for k in range(rng.randint(1, 6)))) for i in range(n)]
    return rows + ODD + [(990, "Common Line"), (990, "Common Line")]


def dropped(docs, store):
    rows = line_dedup.drop_lines(docs, store).select("doc_id", "text", "n_lines", "n_dropped").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (3, 1), (10, 1), (3, 5), (2, 0)])
def test_line_dedup(spark, min_docs, min_chars):
    rows = line_rows()
    docs = frame(spark, rows).repartition(3)
    store = line_dedup.build_store(docs, min_docs, min_chars)
    assert dropped(docs, store) == brute_lines(rows, min_docs, min_chars)
    assert "key" in line_dedup.drop_lines(docs, store).columns


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_line_dedup_whatever_the_partitions(spark, partitions):
    rows = line_rows(2)
    docs = frame(spark, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert dropped(docs, line_dedup.build_store(docs, 3)) == brute_lines(rows, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_line_dedup_can_be_undone(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    a, b = line_rows(3, 40), [(i + 1000, t) for i, t in line_rows(4, 40)[:40]]
    left, right = frame(spark, a), frame(spark, b)
    one = line_dedup.build_store(left, 3)
    assert one.shards > 1
    both = line_dedup.insert(one, right)
    assert dropped(right, both) == brute_lines(b, 3, counted=a + b)
    back = line_dedup.delete(both, right)
    assert dropped(left, back) == brute_lines(a, 3)
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, one.refs.collect()))
    frequent = {bytes(r["key"]) for r in back.frequent.collect()}
    held = sum(int(np.count_nonzero(line_dedup.CuckooFilter.from_bytes(bytes(r["body"])).table)) for r in back.filters.collect())
    assert held == len(frequent)


def test_line_dedup_by_text(spark):
    rows = [(i, "same\nwords") for i in range(20)] + [(20 + i, f"same\n{i}") for i in range(3)]
    store = line_dedup.build_store(frame(spark, rows), 4, by_text=True)
    assert {r[3] for r in dropped(frame(spark, rows), store)} == {1}
    assert sum(r[3] for r in dropped(frame(spark, rows), line_dedup.build_store(frame(spark, rows), 5, by_text=True))) == 0


def test_line_dedup_of_nothing(spark):
    docs = frame(spark, [])
    assert dropped(docs, line_dedup.build_store(docs, 2)) == []


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 50_000, np.uint64)
    f = line_dedup.CuckooFilter.for_keys(hashes)
    assert f.holds(hashes).all()
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.holds(rng.integers(0, 1 << 63, 50_000, np.uint64)).mean() < 1e-3
    f.delete(hashes[:40_000])
    assert f.holds(hashes[40_000:]).all() and f.holds(hashes[:40_000]).mean() < 1e-3
    assert not line_dedup.CuckooFilter(np.zeros((2, 4), np.uint16)).insert(hashes[:9])


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if root(k) == root(i) and d is not None]
        own = min(ids) if ids else None
        out.append((doc, len(sets[i]), own, own is None or doc == own))
    return sorted(out, key=str)


def copies(seed=1, groups=6, each=12):
    rng = random.Random(seed)
    base = prose(seed, groups)
    rows = list(prose(seed + 50, 30))
    for g, text in base:
        words = text.split(" ")
        for k in range(each):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(["NEW", "word", "x."])
            rows.append((1000 * (g + 1) + k, rng.choice([" ", "\n", " \t"]).join(own)))
    return rows + ODD + [(5000, "Tiny text"), (5001, "tiny TEXT"), (5002, "tiny text more")]


@pytest.mark.parametrize("how", [{}, {"node_limit": 8, "group_limit": 6}, {"node_limit": 3, "depth": 1, "group_limit": 4}])
@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, how, percent):
    rows = copies()
    got = chosen_path.near_duplicates(frame(spark, rows).repartition(4), percent=percent, trees=16, **how)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows, percent)


@pytest.mark.parametrize("percent,same,own", [(80, 80, 10), (85, 85, 15)])
def test_pairs_at_the_threshold_survive_branching(spark, percent, same, own):
    # Pairs of sets with just the threshold in common (80/100 and 85/100 shingles), in nodes that branch to the end.
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(2000):
        both, left = rng.integers(0, 1 << 63, same, np.uint64), rng.integers(0, 1 << 63, 100 - same, np.uint64)
        sets += [np.concatenate([both, left[:own]]), np.concatenate([both, left[own:]])]
    sketches = chosen_path.embed(sets)
    least = int(np.floor(128 * percent / 100 - 4 * np.sqrt(128 * percent / 100 * (1 - percent / 100))))
    seen = {i for i in range(0, len(sets), 2) if (sketches[i] == sketches[i + 1]).sum() >= least}
    rows = [(i.to_bytes(4, "big"), s.tobytes()) for i, s in enumerate(sketches)]
    classes = spark.createDataFrame(rows, "set_key binary, sketch binary")
    trees = chosen_path.trees_for(percent, 4)
    edges = chosen_path.candidate_edges(classes, percent, trees, 1, 4).collect()
    found = {int.from_bytes(min(r["a"], r["b"]), "big") for r in edges}
    assert found == seen and len(seen) >= 1998


@pytest.mark.parametrize("percent", [80, 85])
def test_branching_misses_as_few_as_stated(percent):
    # Walks pairs at the threshold through the coordinates that are really picked.
    rng = np.random.default_rng(1)
    order = np.random.default_rng(chosen_path._SEED + 1).permutation(chosen_path.COORDINATES)
    trees, children, pairs = chosen_path.trees_for(percent, 4), chosen_path.children_at(percent), 20_000
    levels = np.array_split(order[trees:], 4)
    agree = rng.random((pairs, chosen_path.COORDINATES)) < percent / 100
    pair, node = np.arange(pairs), rng.integers(0, 1 << 63, pairs, np.uint64)
    for level, among in enumerate(levels, 1):
        kept = []
        for at in chosen_path._pick(node, level, children, among):
            ok = agree[pair, at]
            kept.append((pair[ok], chosen_path._mix(node[ok] * np.uint64(1000003) + at[ok].astype(np.uint64))))
        pair, node = (np.concatenate(x) for x in zip(*kept))
        lost = 1 - len(np.unique(pair)) / pairs
        one = 1 - percent / 100 * (1 - lost)
        assert one == pytest.approx(chosen_path.missed(percent, 1, level), abs=0.006)
    assert chosen_path.missed(percent, trees, 4) <= 1e-6


def test_a_node_that_does_not_shrink_is_compared_at_once(spark):
    # One family of near copies in nodes far above the limit: nothing is parted and all are linked.
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = [np.concatenate([base[4:], rng.integers(0, 1 << 63, 4, np.uint64)]) for _ in range(300)]
    rows = [(i.to_bytes(4, "big"), s.tobytes()) for i, s in enumerate(chosen_path.embed(sets))]
    edges = chosen_path.candidate_edges(spark.createDataFrame(rows, "set_key binary, sketch binary"), 85, 8, 20, 4)
    assert len({r["component"] for r in connected_components(edges).collect()}) == 1
    assert connected_components(edges).count() == 300


def test_keep_one(spark):
    rows = copies(3)
    docs = frame(spark, rows)
    want = sorted({(d, t) for (d, t), k in zip(rows, [None] * len(rows)) if _kept(rows, d, t)}, key=str)
    got = chosen_path.keep_one(docs, percent=80, trees=16)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == want
    assert chosen_path.keep_one(frame(spark, [])).count() == 0


def _kept(rows, doc, text):
    if not hasattr(_kept, "found") or _kept.rows is not rows:
        _kept.rows, _kept.found = rows, {(d, n): k for d, n, _, k in brute_components(rows, 80)}
    return _kept.found[doc, len(shingles(text))]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (50, 51), (51, 50)]
    edges += [tuple(rng.sample(range(300, 360), 2)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent if x != 200}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_leaks(rows, items, at_least=0.8):
    """(doc, item) pairs whose best window is similar enough, and that window's similarity."""
    out = {}
    for doc, text in rows:
        words = words_of(text)
        for item, body in items:
            own = words_of(body)
            m = len(own)
            runs = lambda ws: collections.Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else collections.Counter()
            want = runs(own)
            best = 0.0
            for s in range(-m, len(words)):
                have = runs(words[max(0, s) : max(0, s + m)])
                both = sum((want & have).values())
                best = max(best, both / max(1, sum(want.values()) + sum(have.values()) - both))
            if best >= at_least:
                out[doc, item] = max(best, out.get((doc, item), 0))
    return out


def leak_rows():
    items = [(i, t) for i, t in prose(9, 8, 40)] + [(100, None), (101, ""), (102, "short item"), (103, "a b c d e"), (104, "Zebra")]
    rng = random.Random(1)
    rows = []
    for i, (doc, text) in enumerate(prose(10, 40)):
        words = text.split(" ")
        if i % 2:
            passage = items[i % 8][1].split(" ")
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                passage[rng.choice([0, 1, -1, -2])] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + rng.choice(["", ",", "!\n"]) for w in passage]
        rows.append((doc, " ".join(words)))
    rows += [(700, items[0][1]), (700, items[0][1]), (701, " ".join(items[1][1].split(" ")[2:]))]
    rows += [(720, "here is a Short, ITEM of text"), (721, "short item"), (722, "zebra"), (723, "a short other item")]
    long = " ".join(t for _, t in prose(12, 60))
    return rows + ODD + [(724, f"{long} {items[2][1]} {long}")], items


def test_leaks(spark):
    rows, items = leak_rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("runs", F.lit(1))
    got = decontaminate.find_leaks(frame(spark, rows), benchmark).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in got}) == len(got)
    want, found = brute_leaks(rows, items), {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    # Windows that the document's end cuts short are laid in line with the item only.
    assert found.keys() == want.keys() and all(v <= want[k] + 1e-9 for k, v in found.items())
    assert {(720, 102), (721, 102), (722, 104), (724, 2)} <= found.keys() and (723, 102) not in found
    assert all(r["hamming"] <= decontaminate.RADIUS and 0.8 <= r["similarity"] <= 1 for r in got)
    clean = decontaminate.without_leaks(frame(spark, rows), benchmark)
    leaked = {t for d, t in rows if any(d == x for x, _ in found)}
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted((r for r in rows if r[1] not in leaked), key=str)


def test_leaks_shuffled_and_empty(spark, monkeypatch):
    rows, items = leak_rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_leaks(frame(spark, []), benchmark).count() == 0
    assert decontaminate.find_leaks(frame(spark, rows), benchmark.limit(0)).count() == 0
    monkeypatch.setattr(decontaminate, "SENT_RUNS", 0)
    shuffled = decontaminate.find_leaks(frame(spark, rows), benchmark).collect()
    monkeypatch.undo()
    assert sorted(shuffled) == sorted(decontaminate.find_leaks(frame(spark, rows), benchmark).collect()) and shuffled


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def test_blocks_find_all_within_radius(spark):
    rng = random.Random(4)
    windows, items = [], []
    for i in range(200):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS) if i % 2 else decontaminate.RADIUS):
            b ^= 1 << bit
        windows.append((f"t{i}", 0, 30 + i % 2, signed(a)))
        items.append((i, 30 + i % 2, signed(b)))
    near = decontaminate.near_pairs(
        spark.createDataFrame(windows, "text_key string, start int, m int, print long"), spark.createDataFrame(items, "item_id long, m int, print long")
    )
    rows = near.collect()
    own = {r["item_id"]: r["hamming"] for r in rows if r["text_key"] == f"t{r['item_id']}"}
    assert own == {i: bin((w[3] ^ x[2]) & (2**64 - 1)).count("1") for i, (w, x) in enumerate(zip(windows, items))}
    strangers = {(r["text_key"], r["item_id"]) for r in rows if r["text_key"] != f"t{r['item_id']}"}
    assert all(int(t[1:]) % 2 == i % 2 for t, i in strangers) and len(strangers) < 0.2 * 200 * 100


def test_block_join_of_the_tables_is_far_smaller_than_the_cross_product(spark, monkeypatch):
    seen = []
    real = decontaminate.near_pairs

    def counted(windows, items):
        near = real(windows, items)
        seen.append((near.count(), windows.count() * items.count()))
        return near

    monkeypatch.setattr(decontaminate, "near_pairs", counted)
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    found = decontaminate.find_leaks(table("documents"), table("benchmark")).count()
    joined, cross = seen[0]
    print(f"{joined} joined rows of {cross} pairs, {found} leaks")
    assert found and joined < 0.1 * cross


def test_no_similar_window_is_beyond_the_radius(spark):
    """Items of every length, changed at their ends and inside, as long as they stay similar enough."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    items, rows = [], []
    for i in range(300):
        own = rng.choices(words, k=rng.choice([6, 9, 15, 20, 40, 80, 120]))
        items.append((i, " ".join(own)))
        changed = list(own)
        for _ in range(rng.randint(0, max(1, len(own) // 8))):
            changed[rng.choice([0, 1, 2, 3, -1, -2, -3]) if rng.random() < 0.8 else rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join([*rng.choices(words, k=30), *changed, *rng.choices(words, k=30)])))
    got = decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for doc, text in rows:
        want |= brute_leaks([(doc, text)], [items[doc]])
    assert {(r["doc_id"], r["item_id"]) for r in got} == want.keys() and len(want) > 100


def test_simhash(spark):
    hashes = [[random.Random(i).getrandbits(63) for _ in range(i)] for i in range(1, 9)]
    got = [r["p"] & (2**64 - 1) for r in spark.createDataFrame([(h,) for h in hashes], "h array<long>").select(decontaminate.simhash(F.col("h")).alias("p")).collect()]
    want = [sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) for h in hashes]
    assert got == want


def test_a_store_of_texts_takes_no_changes(spark):
    store = line_dedup.build_store(frame(spark, [(1, "a\nb"), (2, "a\nb"), (3, "a")]), min_docs=2, by_text=True)
    assert store.by_text and {r["n"] for r in store.refs.collect()} == {1, 2}
    for change in (line_dedup.insert, line_dedup.delete):
        with pytest.raises(ValueError):
            change(store, frame(spark, [(1, "a\nb")]))


def test_filters_by_shard(spark, monkeypatch):
    """Keys meet the filter of their shard alone; a common line's shard has most slots; copies count as rows."""
    rng = random.Random(6)
    rows = [(i, "\n".join(["common", *rng.choices([f"line {k}" for k in range(300)], k=20)])) for i in range(150)] + ODD
    rows += [(1000 + i, "common\nonly in copies\nline 7") for i in range(200)]
    docs = frame(spark, rows)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 32)
    store = line_dedup.build_store(docs, min_docs=8)
    assert store.shards > 1
    assert dropped(docs, store) == brute_lines(rows, 8)
    first = line_dedup._first_slots(store, 100)
    shares = first[1:] - first[:-1]
    assert len(first) == store.shards + 1 and shares.min() >= 1 and 100 <= first[-1] <= 100 + store.shards
    monkeypatch.setattr(line_dedup, "SEEN_TEXTS", 2)
    assert dropped(docs, store) == brute_lines(rows, 8)
    passed = line_dedup._candidates(docs.selectExpr("coalesce(text, '') AS text", "md5(coalesce(text, '')) AS text_key"), store)
    frequent = {bytes(r["key"]) for r in store.frequent.collect()}
    assert frequent <= {bytes(r["key"]) for r in passed.collect()}
    empty = line_dedup.build_store(docs, min_docs=10_000)
    assert line_dedup.drop_lines(docs, empty).where("n_dropped > 0").count() == 0
