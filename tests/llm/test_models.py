import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from logweave.llm import mixing, quality, spm, toxicity

SF = "/root/testdata/sf0.01"


def held(i):
    return crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_the_held_out_fold(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    fold = [i for i in truth if held(i)]
    assert np.mean([got[i].predicted == truth[i] for i in fold]) > 0.9


def test_toxicity_on_the_held_out_fold(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    fold = [i for i in truth if held(i)]
    assert np.mean([got[i].predicted == truth[i] for i in fold]) > 0.9
    assert not any(got[i].predicted for i in fold if not truth[i])


def test_toxicity_learns_from_ten_thousand_rows(spark, monkeypatch):
    ids = spark.range(13_000).withColumnRenamed("id", "doc_id")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, terms: seen.append(len(texts)))
    toxicity.train(ids.selectExpr("doc_id", "'a' AS text"), ids.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))
    assert seen == [10_000]


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_edge_rows(spark, score):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "word " * 50, 0.5), (3, "word " * 50, 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        out = score(docs, labels).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert score(docs.limit(0), none).count() == 0


def test_swaps_and_penalty():
    assert toxicity.swaps("Some women came. No one else.") == [("Some women came.", "Some men came.")]
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(8)) for _ in range(300)]
    texts = [f"{t} women" if i % 3 else f"{t} men" for i, t in enumerate(base)]
    labels = np.array([i % 3 > 0 for i in range(300)], float)
    spread = []
    for weight in (0.0, 5.0):
        toxicity.PENALTY, kept = weight, toxicity.PENALTY
        model = toxicity.fit(texts, labels)
        toxicity.PENALTY = kept
        spread.append(abs(model.score("aaa women") - model.score("aaa men")))
    assert spread[1] < 0.5 * spread[0]


def test_pooling_is_bounded_and_equal(monkeypatch):
    vectors = quality.index_vectors()
    texts = [b"", b"a b c", b"One two !! $$$ THREE " * 400, b"x" * 5000]
    one = quality.pooled(texts, vectors)
    monkeypatch.setattr(quality, "PIECE_BYTES", 800)
    assert np.allclose(one, quality.pooled(texts, vectors), atol=1e-6)


def mixed_docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "big" if i < 600 else f"s{i % 3}") for i in range(800)] + [(900, "a b c", None), (901, None, "empty")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), rows


def test_mixing_keeps_limit_and_budget(spark):
    docs, rows = mixed_docs(spark)
    out = mixing.mix_sources(docs, max_repetition=3.0).collect()
    times = Counter(r.doc_id for r in out)
    assert set(times) == {r[0] for r in rows} and max(times.values()) <= 3
    tokens, read, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        n = len((t or "").split())
        tokens[s] += n
        read[s] += n * times[i]
        longest[s] = max(longest[s], n)
    full = {s: n for s, n in tokens.items() if n}
    ratio = max(full.values()) / min(full.values())
    exponent = 1 - math.log(3.0) / math.log(ratio)
    for s, n in full.items():
        wanted = n * (max(full.values()) / n) ** (1 - exponent)
        assert wanted - 1e-3 <= read[s] <= wanted + longest[s], s


def test_mixing_cuts_block_permutations(spark):
    docs, _ = mixed_docs(spark)
    plan = {r.source: r for r in mixing.mixing_plan(docs, max_repetition=2.5).collect()}
    placed = docs.select("doc_id", "source", mixing.tokens_of(docs.text).alias("tokens"), *mixing._places(0)).collect()
    out = mixing.mix_sources(docs, max_repetition=2.5).collect()
    times = Counter(r.doc_id for r in out)
    for source, p in plan.items():
        own = sorted((r for r in placed if r.source == source), key=lambda r: (r.b1, r.b2, r.b3))
        whole = int(p.repetition) if p.tokens else 1
        left = (p.repetition - whole) * p.tokens if p.tokens else 0
        again, read = set(), 0
        for r in own:
            if left > 1e-6 and read < left - 1e-6:
                again.add(r.doc_id)
                read += r.tokens
        assert {r.doc_id: times[r.doc_id] for r in own if r.tokens} == {r.doc_id: whole + (r.doc_id in again) for r in own if r.tokens}, source
    block = {r.doc_id: (r.b1, r.b2) for r in placed}
    for epoch in {r.mix_epoch for r in out}:
        order = [block[r.doc_id] for r in sorted((r for r in out if r.mix_epoch == epoch), key=lambda r: r.mix_order)]
        # Blocks follow each other whole, and not by number.
        assert len([b for k, b in enumerate(order) if k == 0 or order[k - 1] != b]) == len(set(order)) and (len(order) < 20 or order != sorted(order))


def test_mixing_limit_holds_under_any_budget(spark):
    docs, rows = mixed_docs(spark)
    words = sum(len((t or "").split()) for _, t, _ in rows)
    assert max(Counter(r.doc_id for r in mixing.mix_sources(docs, budget_tokens=10 * words).collect()).values()) <= 2


def test_sample_of_repeated_ids_is_settled(spark, monkeypatch):
    from logweave.llm import common

    free = [i for i in range(50) if not held(i)][:3]
    docs = spark.createDataFrame([(free[0], "b"), (free[0], "a"), (free[1], None), (free[2], "c" * 100), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(free[0], 0), (free[0], 1), (free[1], 0), (free[2], 1), (None, 1)], "doc_id long, quality int")
    assert common.labelled_sample(docs.repartition(4), labels, "quality", 10) == [(b"a", 1), (b"", 0), (b"c" * 100, 1)]
    assert b"c" * 100 not in [t for t, _ in common.labelled_sample(docs, labels, "quality", 10, fit_bytes=50)]


def test_a_long_text_does_not_end_the_sample(spark):
    from logweave.llm import common

    free = [i for i in range(100) if not held(i)]
    for long in free[::10]:  # wherever it stands in the order
        docs = spark.createDataFrame([(i, "x" * (2000 if i == long else 10)) for i in free], "doc_id long, text string").coalesce(1)
        labels = spark.createDataFrame([(i, i % 2) for i in free], "doc_id long, quality int").coalesce(1)
        found = common.labelled_sample(docs, labels, "quality", 1000, fit_bytes=1500, text_bytes=1000)
        assert len(found) == len(free) - 1
    with pytest.warns(UserWarning, match="nothing is learned"):
        assert common.labelled_sample(docs, labels, "quality", 1000, text_bytes=5) == []


def test_any_column_names(spark, tables):
    docs, labels = tables
    odd = docs.limit(40).selectExpr("*", "1 as lw_b1", "2 as lw_source", "3 as lw_text", "4 as `a.b`", "5 as lw_score", "6 as lw_bytes", "7 as lw_cut1")
    added = ("lw_b1", "lw_source", "lw_text", "a.b", "lw_score", "lw_bytes", "lw_cut1")
    for out in (mixing.mix_sources(odd), spm.encode_documents(odd), quality.keep_good(odd, labels), spm.decode_documents(spm.encode_documents(odd))):
        rows = out.collect()
        assert rows and all([r[c] for c in added] == [1, 2, 3, 4, 5, 6, 7] for r in rows)


def test_mixing_meets_entropy(spark):
    docs, _ = mixed_docs(spark)
    plan = mixing.mixing_plan(docs.where("source is not null and source <> 'empty'"), max_repetition=None, target_entropy=1.2).collect()
    assert abs(mixing.entropy([r.weight for r in plan]) - 1.2) < 1e-3
    assert abs(sum(r.weight for r in plan) - 1) < 1e-9


def test_mixing_budget_and_edges(spark):
    docs, rows = mixed_docs(spark)
    plan = {r.source: r for r in mixing.mixing_plan(docs, budget_tokens=2000).collect()}
    out = mixing.mix_sources(docs, budget_tokens=2000).join(docs.select("doc_id", mixing.tokens_of(docs.text).alias("n")), "doc_id").groupBy("source").sum("n").collect()
    for r in out:
        if plan[r.source].tokens:
            assert r["sum(n)"] <= plan[r.source].weight * 2000 + 41
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a", "s"), (1, "a", "s")], "doc_id long, text string, source string")
    assert mixing.mix_sources(again).count() == 2
