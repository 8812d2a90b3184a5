import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from logweave.llm import exact_dedup, ngram_join, substring

DOCS = "doc_id long, text string, digest string, n long"


def brute_components(rows, words=5, percent=75):
    sets, places = {}, defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        for x in sets[i]:
            places[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b, n in Counter(b for x in sets[a] for b in places[x] if b < a).items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    rows = []
    for size in (3, 5, 6, 9, 30, 80, 200):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(12):
                own = list(base)
                for _ in range(rng.choice((0, 0, 1, 2, 4, 9))):
                    own[rng.randrange(len(own))] = word()
                rows.append(" ".join(own).upper() if rng.random() < 0.2 else rng.choice((" ", "\n\t ")).join(own))
    shared = " ".join(word() for _ in range(40))
    rows += [f"{shared} {' '.join(word() for _ in range(rng.randint(1, 60)))}" for _ in range(60)]
    rows += [None, "", " \n", "one", "one", "É é"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("classes", ["usual", "all_frequent"])
def test_components_equal_brute_force(spark, monkeypatch, classes):
    if classes == "all_frequent":
        real = ngram_join.token_classes
        monkeypatch.setattr(ngram_join, "token_classes", lambda counts: np.minimum(real(counts) + (counts > 3) + (counts > 30), 3).astype(np.uint8))
        monkeypatch.setattr(ngram_join, "LIST_ROWS", 3)
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
        monkeypatch.setattr(ngram_join, "BEST", 1)
    made, real_write = [], ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name: made.append(name) or real_write(df, name))
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in rows], DOCS).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(docs).collect()}
    assert got == brute_components(rows)
    assert ("hot-lists" in made) == (classes == "all_frequent")


def test_sets_that_share_a_name(spark, monkeypatch):
    # In tasks too, for they get the function by value.
    real = ngram_join.set_names
    monkeypatch.setattr(ngram_join, "set_names", lambda tokens: (real(tokens)[0] % 40, real(tokens)[1]))
    monkeypatch.setattr(ngram_join, "set_node", lambda tokens, clashing=frozenset(): (lambda a, b: b if a in clashing else a)(real(tokens)[0] % 40, real(tokens)[1]))
    rows = corpus()[:150]
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in rows], DOCS).repartition(3)
    scanned = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 7)], "node long, second long")
    assert ngram_join._clashing(scanned) == {2}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(docs).collect()}
    assert got == brute_components(rows)


def test_components_edge_rows(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text + " h"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_jaccard_components(docs).collect())
    assert got == [("7", 3, "7"), ("7", 3, "7"), ("9", 4, "7"), ("None", 0, "None"), ("None", 3, "7")]
    assert ngram_join.ngram_jaccard_components(docs.limit(0)).count() == 0


def test_signatures_are_shared():
    rng = random.Random(5)
    counts = np.array([rng.choice((0, 0, 500, 5000)) for _ in range(ngram_join.COUNTERS)], np.uint32)
    classes = ngram_join.token_classes(counts)
    for _ in range(300):
        n = rng.choice((1, 2, 3, 5, 8, 13, 16, 20, 31, 33, 50, 100, 400))
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(n // rng.choice((4, 6, 8, 20))):
            if rng.random() < 0.5:
                b.discard(rng.choice(sorted(b)))
            b.add(rng.getrandbits(64)) if rng.random() < 0.5 else None
        if b and 100 * len(a & b) >= 75 * len(a | b):
            one, two = (ngram_join.signatures(np.array(sorted(x), np.uint64), counts, classes)[0] for x in (a, b))
            assert set(one.tolist()) & set(two.tolist()), n


def test_possible_pairs_keep_every_link(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "_PAIRS_AT_ONCE", 500)
    monkeypatch.setattr(ngram_join, "_WORDS_AT_ONCE", 64)
    rng = random.Random(6)
    sets, rows = [], []
    for unit in range(30):
        size = rng.choice((20, 60, 64, 65, 130, 500))
        base = [rng.getrandbits(64) for _ in range(size)]
        for k in range(rng.randint(2, 25)):
            own = {t for t in base if rng.random() > rng.choice((0.02, 0.1, 0.2))} | {rng.getrandbits(64) for _ in range(rng.randint(0, size // 6))}
            node = len(sets)
            sets.append(own)
            for level in ngram_join.levels(len(own)):
                rows.append((unit * 100 + level, level, rng.choice((-1, -1, 0, 1)), node, len(own), node // 2))
    rows.sort()
    bits = [ngram_join.bitmap(np.array(sorted(sets[r[3]]), np.uint64)) for r in rows]
    columns = [pa.array([r[k] for r in rows]) for k in range(6)] + [pa.array(bits, pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["unit", "level", "side", "node", "n", "label", "bits"])
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 20_000)
    got = {(p["a"], p["b"]) for out in ngram_join._compare(ngram_join.NgramJoin(), None)(batch.slice(i, 7) for i in range(0, len(rows), 7)) for p in out.to_pylist()}
    top = lambda a, b: max(len(sets[a]), len(sets[b])).bit_length() - 1
    met = {(min(x[3], y[3]), max(x[3], y[3])) for x in rows for y in rows if x[0] == y[0] and x[5] != y[5] and (x[2] < 0 or x[2] != y[2]) and x[1] == top(x[3], y[3])}
    links = {(a, b) for a, b in met if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    some = {(p["a"], p["b"]) for out in ngram_join._compare(ngram_join.NgramJoin(), 1)(batch.slice(i, 7) for i in range(0, len(rows), 7)) for p in out.to_pylist()}
    assert (None, None) in some and some - {(None, None)} < got and {x for p in got for x in p} == {x for p in some for x in p if x is not None}
    assert links <= got <= met and len(links) > 300 and len(got) < 0.8 * len(met)


def exact_expected(rows):
    first, size = {}, Counter()
    for i, t in rows:
        x = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        first[x] = min(first.get(x, i), i)
        size[x] += 1
    return sorted((i, first[x], size[x], first[x] == i, hashlib.sha256(x.encode()).hexdigest()) for i, t in rows for x in [re.sub(r"[\x20\x09-\x0D]+", " ", t or "")])


@pytest.mark.parametrize("bits", [1 << 25, 1 << 15])
def test_exact_groups(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
    long = "x" * 200
    texts = ["a b", "a  b", "a\n\tb", "ab", None, "", long + "1", long + "2", long + "1", " ", "a b", "é", "É", long * 50, long + "3" * 7, "y" * 1_000_000, "y" * 1_000_000]
    rows = list(enumerate(texts))[::-1]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, full string, n long")
    out = exact_dedup.exact_groups(docs, digest=True)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()) == exact_expected(rows)
    kept = sorted(r.doc_id for r in exact_dedup.drop_exact(docs).collect())
    assert kept == sorted({x[1] for x in exact_expected(rows)})
    assert exact_dedup.drop_exact(docs).columns == docs.columns
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.drop_exact(docs.limit(0)).count() == 0


def test_exact_refinements_leave_what_they_should(spark):
    prefix = "p" * exact_dedup.PREFIX_CHARS
    texts = ["one", "other length", "same", "size", prefix + "a", prefix + "b", prefix + "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full = {r.doc_id: r.full for r in exact_dedup._refined(docs, False, "doc_id", "text").collect()}
    assert {i for i, x in full.items() if x} == {4, 5, 6}


def test_exact_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c")], "doc_id long, text string")
    out = exact_dedup.exact_groups(docs)
    assert out.where("kept").count() == 3
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_exact(docs).collect()) == [("1", "a"), ("1", "b"), ("None", "c")]


CLASHING = "doc_id long, text string, lost_id long, lw_sha string, lw_key long, kept boolean, component long, node long, full string, LW_Of long"


def test_drops_accept_any_columns_and_ids(spark):
    a = " ".join(f"w{i}" for i in range(60))
    near = a + " more"
    rest = (7, "x", 8, True, 9, 10, "f", 11)
    rows = [(1, a), (5, near), (5, "a text that nothing is like at all"), (None, near + " words"), (None, "alone without an id"), (None, None), (6, ""), (1, a), (None, "alone without an id")]
    docs = spark.createDataFrame([(i, t, *rest) for i, t in rows], CLASHING).repartition(3)
    out = ngram_join.drop_near(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted([("1", a), ("5", "a text that nothing is like at all"), ("None", "alone without an id"), ("None", "None"), ("6", "")])
    out = exact_dedup.drop_exact(docs)
    assert out.columns == docs.columns and out.count() == 6
    assert ngram_join.drop_near(docs.limit(0)).count() == 0


def test_components_of_very_long_texts(spark):
    rng = random.Random(8)
    base = [str(rng.getrandbits(40)) for _ in range(120_000)]
    other = list(base)
    for k in rng.sample(range(len(base)), 2000):
        other[k] = "z"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, "q" * 3_000_000), (4, " ".join(base[:60_000]))]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_repeated_passages(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(5)]
    line = text(9)
    rows = [(i, f"{line}\n{text(80)}\n{text(30)}") for i in range(30)]
    rows += [(100 + i, f"{text(20 + i)} {passages[i % 5]} {text(15)}") for i in range(20)]
    rows += [(200, None), (201, ""), (None, f"{text(3)} {passages[0]}")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, seq int").repartition(4)
    got = substring.repeated_passages(docs).collect()
    texts = dict(rows)
    assert {r.doc_id for r in got} == {100 + i for i in range(20)} | {None}
    for r in got:
        assert texts[r.doc_id][r.start : r.end] in passages[r.first_doc_id % 5] + " " or texts[r.doc_id][r.start : r.end].strip() in passages[r.first_doc_id % 5]
        assert r.first_doc_id == 100 + (r.doc_id % 5 if r.doc_id is not None else 0)
        assert r.n_words >= substring.RUN_WORDS
    assert substring.repeated_passages(docs.limit(0)).count() == 0


def windows_expected(rows, n):
    """Brute force: stretches of words in which every n in a row are another row's too."""
    split = [[(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    holders = defaultdict(set)
    for i, ws in enumerate(split):
        for k in range(len(ws) - n + 1):
            holders[tuple(w for *_, w in ws[k : k + n])].add(i)
    out = []
    for i, ws in enumerate(split):
        run = []
        for k in range(len(ws) - n + 2):
            found = holders[tuple(w for *_, w in ws[k : k + n])] if k <= len(ws) - n else ()
            if len(found) > 1:
                run.append((k, min((rows[r][0] for r in found if rows[r][0] is not None), default=None)))
            elif run:
                ids = [f for _, f in run if f is not None]
                out.append((rows[i][0], ws[run[0][0]][0], ws[run[-1][0] + n - 1][1], len(run) + n - 1, min(ids) if ids else None))
                run = []
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "variants"), [(20_000, 50_000), (1, 50_000), (1, 0)])
def test_repeated_passages_whole(spark, monkeypatch, hot, variants):
    monkeypatch.setattr(substring, "HOT_ROWS", hot)
    monkeypatch.setattr(substring, "MOST_VARIANTS", variants)
    monkeypatch.setattr(substring, "SAMPLED", 1)
    rng = random.Random(12)
    text = lambda n, most: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, most))) for _ in range(n))
    rows = []
    for i in range(150):  # short words, and lengths from just below the threshold on
        passage = text((51, 21, 22, 23, 30, 40)[i % 6], 3)
        rows += [(2 * i + k, f"{text(rng.randint(0, 40), 9)} {passage}\n{text(rng.randint(0, 40), 9)}") for k in range(2)]
    rows += [(1000, "a " * 300), (1001, "b a " + "a " * 200), (1002, text(30, 90_000)), (1003, rows[0][1] + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in substring.repeated_passages(docs).collect()), key=str)
    assert got == windows_expected(rows, substring.RUN_WORDS)
    assert len(got) > 250


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_passages_rows_without_own_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_ROWS", hot)
    monkeypatch.setattr(substring, "SAMPLED", 1)
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    a, b, c, whole = text(60), text(60), text(60), text(40)
    rows = [(None, f"{text(9)} {a} {text(5)}"), (None, f"{text(30)} {a}"), (7, f"{b} {text(8)}"), (7, f"{text(12)} {b}")]
    rows += [(None, f"{text(20 + i)} {c} {text(9)}") for i in range(20)] + [(9, f"{c} {text(3)}"), (None, whole), (None, whole), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in substring.repeated_passages(docs).collect()), key=str)
    assert got == windows_expected(rows, substring.RUN_WORDS)
    assert len(got) == 27


def test_repeated_passages_one_anchor_over_slabs(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substring, "SLAB", 4)
    rng = random.Random(14)
    passage = " ".join(str(rng.random()) for _ in range(30))
    texts = [f"{i} {passage} {i}".encode() for i in range(9)]
    at, digest, packed = substring._anchors(texts, 22)
    rows = sorted(zip(digest.tolist(), at.tolist(), packed, strict=True))
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows[k : k + 2]]), pa.array([x[1] for x in rows[k : k + 2]]), pa.array([x[1] for x in rows[k : k + 2]]), pa.array([x[2] for x in rows[k : k + 2]], pa.binary())], names=["digest", "row", "doc_id", "windows"]) for k in range(0, len(rows), 2)]
    found = [r for b in substring._meet(iter(batches)) for r in b.to_pylist()]
    assert {r["row"]: sum(x["n"] for x in found if x["row"] == r["row"]) for r in found} == dict.fromkeys(range(9), 9)


def test_copies_of_whole_texts_are_found_hot(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(10)]
    docs = spark.createDataFrame([(t.encode(), k) for t in texts for k in range(2000)], "text binary, doc_id long").repartition(4)
    monkeypatch.setattr(substring, "HOT_ROWS", 1000)
    hot = substring.hot_anchors(docs.select("doc_id", "text"), 22)
    anchors = {d for t in texts for d in substring._anchors([t.encode()], 22)[1].tolist()}
    assert len(hot & anchors) > 0.7 * len(anchors) and hot <= anchors


def test_chunks_cover_any_text():
    rng = random.Random(2)
    for n in (0, 1, 7, 96, 5000):
        t = bytes(rng.getrandbits(8) for _ in range(n))
        ends = substring.chunk_ends(t).tolist()
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == n
        assert all(b - a <= substring.MOST for a, b in zip([0, *ends], ends, strict=False))


def test_shared_windows_of_an_occurrence_come_as_stretches():
    import pyarrow as pa

    text = " ".join(f"w{k * k % 97}" for k in range(60)).encode()
    _, _, packed = substring._anchors([text], 22)
    windows = pa.array(packed, pa.binary())
    n = substring._Opened(windows).n.tolist()
    kind = pa.list_(pa.struct([("j", pa.int32()), ("least", pa.int64())]))
    schema = ["row", "doc_id", "windows", "shared"]

    def placed(shared):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int64()), pa.array([5] * len(n), pa.int64()), windows, pa.array(shared, kind)], names=schema)
        return [r for b in substring._placed(iter([batch])) for r in b.to_pylist()]

    # All windows of an occurrence, in any order, are one stretch; a gap makes two.
    rows = placed([[{"j": j, "least": 9 - j % 3} for j in reversed(range(k))] for k in n])
    assert [r["n"] for r in rows] == n and sum(n) > len(n) == len(rows)
    big = max(range(len(n)), key=n.__getitem__)
    assert n[big] >= 3
    cut = placed([[{"j": 0, "least": 4}, {"j": 2, "least": 3}] if k == big else [] for k in range(len(n))])
    alone = placed([[{"j": j, "least": 7} for j in range(n[k])] if k == big else [] for k in range(len(n))])
    assert [(r["row"], r["first"] - alone[0]["first"], r["n"], r["lo"]) for r in cut] == [(big, 0, 1, 4), (big, 2, 1, 3)]
    assert cut[0]["start"] == alone[0]["start"] and cut[0]["start"] < cut[1]["start"] and cut[1]["end"] <= alone[0]["end"]


def test_stretches_go_on_from_one_occurrence_to_the_next():
    import pyarrow as pa

    text = " ".join(f"w{k * k % 97}" for k in range(60)).encode()
    _, _, packed = substring._anchors([text], 22)
    windows = pa.array(packed, pa.binary())
    n = substring._Opened(windows).n.tolist()
    shared = pa.array([[{"j": j, "least": 8 + (k + j) % 2} for j in range(m)] for k, m in enumerate(n)], pa.list_(pa.struct([("j", pa.int32()), ("least", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([3] * len(n), pa.int64()), pa.array([5] * len(n), pa.int64()), windows, shared], names=["row", "doc_id", "windows", "shared"])
    rows = [r for b in substring._placed(iter([batch])) for r in b.to_pylist()]
    assert len(n) > 1 and [(r["row"], r["n"], r["start"], r["end"], r["lo"]) for r in rows] == [(3, 39, 0, len(text), 8)]


def test_sets_of_left_out_pairs_are_named():
    import pyarrow as pa

    rng = random.Random(7)
    rows, bits = [], []
    for unit in range(12):
        base = [rng.getrandbits(64) for _ in range(100)]
        for _ in range(2 if unit % 2 else 9):  # two sets of a unit leave nothing out
            bits.append(ngram_join.bitmap(np.array(sorted([*base[: rng.randint(90, 99)], rng.getrandbits(64)]), np.uint64)))
            rows.append((unit, 6, -1, len(rows), 100, len(rows)))
    columns = [pa.array([r[k] for r in rows]) for k in range(6)] + [pa.array(bits, pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["unit", "level", "side", "node", "n", "label", "bits"])
    every, best = ([p for out in ngram_join._compare(ngram_join.NgramJoin(), k)(iter([batch])) for p in out.to_pylist()] for k in (None, 1))
    left = {(p["a"], p["b"]) for p in every} - {(p["a"], p["b"]) for p in best if p["a"] is not None}
    assert left and all(p["open"] is None for p in every)
    assert {p["open"] for p in best if p["a"] is None} == {x for pair in left for x in pair}
    assert all(rows[x][0] % 2 == 0 for pair in left for x in pair)
