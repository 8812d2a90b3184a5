import hashlib
import re
from collections import Counter

import corpus_pipeline
from logweave.llm import quality
from logweave.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    from test_dedup import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(materialise(stage(spark, made[-1], SF), name))
    rows = [[r.asDict() for r in d.collect()] for d in made]
    assert all(d.columns == corpus_pipeline.COLUMNS for d in made[:-1])

    scores = {r.doc_id: r.score for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in rows[1]} == {i for i, s in scores.items() if s >= quality.THRESHOLD}

    first = {}
    for r in sorted(rows[1], key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(first.values())

    components = brute_components([(r["doc_id"], r["text"]) for r in sorted(rows[2], key=lambda r: r["doc_id"])])
    assert {r["doc_id"] for r in rows[3]} == {i for i, (_, c) in components.items() if i == c}

    times = Counter(r["doc_id"] for r in rows[4])
    assert set(times) == {r["doc_id"] for r in rows[3]} and max(times.values()) <= 2

    texts = {r["doc_id"]: r["text"] or "" for r in rows[4]}
    assert Counter(r["doc_id"] for r in rows[5]) == times
    assert all(r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_ids"] for r in rows[5])


def test_stages_on_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, text + " end", None, None, None), (None, None, None, None, None), (None, "", "en", "b", 0), (3, "alone here", "en", "b", 10), (3, "of one id", "en", "b", 9)]
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, lw_score int, kept boolean")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == (corpus_pipeline.COLUMNS if name != "tokens" else ["doc_id", "source", "ids", "n_ids", "text_sha256"])
        counts.append(out.count())
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert counts[0] <= len(rows) and counts[1:3] == [5, 5] and counts[3] >= len(rows) and counts[4] == len(rows)
