import random

import numpy as np
import pytest

from logweave.llm import minhash, ngram_join

from test_dedup import DOCS, brute_components, corpus


@pytest.mark.parametrize("lists", ["short", "long"])
def test_components_equal_brute_force(spark, monkeypatch, lists):
    if lists == "long":
        monkeypatch.setattr(ngram_join, "LIST_ROWS", 3)
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
        monkeypatch.setattr(minhash, "FEW", 1)
    made, real_write = [], ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name: made.append(name) or real_write(df, name))
    rows = corpus()
    rng = random.Random(8)
    for size in (2, 5, 6, 10, 40, 300):  # chains of copies, each one word on from the one before
        own = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(15):
            own[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in rows], DOCS).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_components(docs).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_components(rows, 2, 80).items()}
    assert ("hot-lists" in made) == (lists == "long")


def test_edge_rows(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text + " k"), (None, None), (3, " \n"), (4, "one"), (2, "ONE")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.minhash_components(docs).collect())
    assert got == [("2", 1, "2", True), ("3", 0, "3", True), ("4", 1, "2", False), ("7", 9, "7", True), ("7", 9, "7", True), ("9", 10, "7", False), ("None", 0, "None", True), ("None", 9, "7", False)]
    assert minhash.minhash_components(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    words = [f"w{k * 7919 % 1_000_003}" for k in range(150_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:140_000])), (3, " ".join(words[:90_000]))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.minhash_components(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for size, kept in ((50, 45), (400, 360), (5000, 4500)):
        agreed = []
        for _ in range(60):
            a = rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64)
            b = np.concatenate((a[:kept], rng.integers(0, 1 << 63, size - kept, np.int64).astype(np.uint64)))
            agreed.append((minhash.signature(a) == minhash.signature(b)).sum())
        j = kept / (2 * size - kept)
        spread = (minhash.COORDINATES * j * (1 - j)) ** 0.5
        assert abs(np.mean(agreed) - minhash.COORDINATES * j) < 5 * spread / 60**0.5 and np.std(agreed) < 1.5 * spread
        assert min(agreed) >= minhash.MATCHES
    one, two = (np.array([minhash.mark(minhash.signature(x))], np.int64) for x in (a, b))
    assert np.bitwise_count(one ^ two)[0] <= minhash.DIFFERING
    cut = minhash.lanes(minhash.signature(a)).view(np.uint8)
    assert (cut == minhash.lanes(minhash.signature(b)).view(np.uint8)).sum() >= agreed[-1]


def test_parities_bound_what_sets_lack():
    rng = np.random.default_rng(2)
    for size, lost, gained in ((5, 1, 1), (60, 20, 3), (130, 0, 20), (700, 90, 70), (5000, 0, 0)):
        a = rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64)
        b = np.concatenate((a[lost:], rng.integers(0, 1 << 63, gained, np.int64).astype(np.uint64)))
        bits = [np.concatenate((minhash.lanes(minhash.signature(x)), minhash.parity(x))).view(np.uint64) for x in (a, b)]
        words = np.array([len(x) for x in bits])
        flat, at = np.concatenate(bits), np.array([0, words[0]])
        w = min(words) - minhash.LANES
        one, two = (minhash._folded(flat, at, words, np.array([k]), w) for k in (0, 1))
        differ = int(np.bitwise_count(one ^ two).sum())
        assert differ <= lost + gained and (differ + lost + gained) % 2 == 0
        assert size < 100 or differ >= 0.6 * (lost + gained)


@pytest.mark.parametrize("rows_at_once", [200_000, 3])
def test_pruning_keeps_what_may_be_like(monkeypatch, rows_at_once):
    import pyarrow as pa

    monkeypatch.setattr(minhash, "_POSTINGS_AT_ONCE", rows_at_once)
    rng = random.Random(3)
    rows = []
    for sig in range(60):
        base = rng.getrandbits(63)
        size = rng.choice((1, 2, 3, 9, 300))
        for node in range(size):
            own = rng.getrandbits(63) if rng.random() < 0.5 else base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 11)))
            rows += [(sig, 0 if sig % 9 else 1 + node % 2, node, own)] * rng.choice((1, 1, 2))
    rows.sort()
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["sig", "part", "node", "mark"])
    got = [(p["sig"], p["part"], p["node"]) for out in minhash._prune(batch.slice(k, 7) for k in range(0, len(rows), 7)) for p in out.to_pylist()]
    want = []
    for s, p, n, m in sorted(set(rows)):
        others = [m2 for s2, p2, n2, m2 in set(rows) if (s2, p2) == (s, p) and n2 != n]
        if p or (len(others) >= minhash.PRUNED) or any((m ^ m2).bit_count() <= minhash.DIFFERING for m2 in others):
            want.append((s, p, n))
    assert got == want and len(got) < len(set(rows))


def test_only_sizes_that_can_link_are_posted():
    for n in range(1, 40):
        other = any(100 * shared >= 80 * (n + m - shared) for m in range(1, 80) for shared in range(min(n, m) + 1) if not shared == n == m)
        assert minhash.can_link(n, 80) == other


def test_sets_of_one_vocabulary_hardly_meet_by_chance(spark):
    # Any two sets have about a fortieth of their tokens in common.
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 1 << 63, 3000, np.int64).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, 150, replace=False)) for _ in range(1200)]
    sets += [np.unique(np.concatenate((s[8:], rng.integers(0, 1 << 63, 8, np.int64).astype(np.uint64)))) for s in sets[:20]]
    join = minhash.MinHashJoin()
    rows, counts = [], np.zeros(ngram_join.COUNTERS, np.uint32)
    for node, s in enumerate(sets):
        _, values, counted = join.sketch(s)
        rows.append((node, len(s), values.tolist()))
        np.add.at(counts, ngram_join._counter(counted), 1)
    scanned = spark.createDataFrame(rows, "node long, n long, signature array<int>")
    posted = join.postings(None, scanned, counts, frozenset())
    assert posted.count() <= 40 * len(sets)
    kept = {r.node for r in join.pruned(posted).select("node").distinct().collect()}
    assert {*range(20), *range(1200, 1220)} <= kept and len(kept) < 100


def test_links_share_a_combination():
    rng = np.random.default_rng(12)
    counts = rng.choice(np.array([0, 5, 500], np.uint32), ngram_join.COUNTERS)
    kept = minhash.COMBINATIONS - minhash.SHARED + 1
    for k in range(400):
        size = int(rng.choice((20, 90, 400)))
        a = rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64)
        b = np.concatenate((a[size // 9 :], rng.integers(0, 1 << 63, size // 9, np.int64).astype(np.uint64)))  # 0.80
        names = [minhash.combinations_of(minhash.signature(x)) for x in (a, b)]
        assert len(names[0]) == minhash.COMBINATIONS and (names[0] == names[1]).sum() >= minhash.SHARED
        first = [set(x[np.lexsort((x, counts[ngram_join._counter(x)]))[:kept]].tolist()) for x in names]
        assert first[0] & first[1]
