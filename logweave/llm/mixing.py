"""Mixing sources to target weights by temperature, realised as block permutations; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import WORD, free_name, materialise, quoted

#: Most times that a document may be read.
MAX_REPETITION = 1.5
#: Blocks that a source's documents fall into, and again each block's.
BLOCKS = 4096
#: Exponents that one pass over the source table tries; each pass narrows the interval by so many.
TRIED = 32
PASSES = 5
#: Most sources, each some 100 bytes, that are broadcast to the documents.
BROADCAST_SOURCES = 50_000


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def solve_exponent(sources: DataFrame, max_repetition: float | None, target_entropy: float | None) -> float:
    """The largest exponent in [0, 1] that keeps to the limits, where weights are token shares to that power.

    `sources` has a row per source with its `tokens` (> 0). The most repeated source is read (largest share / its
    share) ** (1 - exponent) times as often as the least repeated one, and entropy falls as the exponent grows, so
    both conditions hold up to some exponent; the interval is cut until it is narrow. max_repetition wants exponents
    from some value up; target_entropy (nats) up to some value. With both, the repetition limit prevails.
    """
    low, high = 0.0, 1.0
    total = sources.agg(F.sum("tokens").alias("t"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi"), F.count("*").alias("n")).first()
    if not total.n or total.lo == total.hi:
        return 1.0
    if target_entropy is not None:
        shares = sources.select((F.col("tokens") / F.lit(float(total.t))).alias("p"))
        for _ in range(PASSES):
            tries = [low + (high - low) * i / TRIED for i in range(TRIED + 1)]
            powered = shares.select("p", F.explode(F.array(*map(F.lit, tries))).alias("x")).withColumn("w", F.pow("p", "x"))
            found = powered.groupBy("x").agg((F.log(F.sum("w")) - F.sum(F.col("w") * F.col("x") * F.log("p")) / F.sum("w")).alias("h")).collect()
            enough = [r.x for r in found if r.h >= target_entropy]
            if not enough:
                high = low = 0.0
                break
            low = max(enough)
            high = min([r.x for r in found if r.x > low], default=low)
            if low == high:
                break
        exponent = low
    else:
        exponent = 0.0
    if max_repetition is not None:
        low, high = 0.0, 1.0
        ratio = total.hi / total.lo
        if ratio ** (1 - low) <= max_repetition:
            high = 0.0
        while high - low > 1e-9:
            middle = (low + high) / 2
            low, high = (low, middle) if ratio ** (1 - middle) <= max_repetition else (middle, high)
        exponent = max(exponent, high)
    return exponent


def mixing_plan(docs: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """One row per source: source, docs, tokens, share, weight, repetition and where its last permutation ends.

    Without a budget, it is the least by which no source is cut below one full reading. No document is read more often
    than max_repetition, rounded up; a budget that would need it is cut to what the limit allows. `epochs` counts full
    readings; `cut1`, `cut2`, `cut3` say up to which block, block within it and document (by hash) the next, partial
    one goes, null where there is none. A partial reading takes documents until their tokens reach what is left of
    the source's budget, so it goes beyond it by less than one document.
    """
    spark = docs.sparkSession
    narrow = materialise(_keyed(docs, seed), "mixing-docs")
    sources = narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    sources = materialise(sources, "mixing-sources")
    filled = sources.where("tokens > 0")
    exponent = solve_exponent(filled, max_repetition, target_entropy)
    total = filled.agg(F.sum("tokens").alias("t"), F.sum(F.pow(F.col("tokens"), F.lit(exponent))).alias("w"), F.max(F.pow(F.col("tokens"), F.lit(1 - exponent))).alias("least"), F.max(F.pow(F.col("tokens"), F.lit(exponent - 1))).alias("most")).first()
    whole, scale = float(total.t or 1), float(total.w or 1)
    budget = float(budget_tokens) if budget_tokens is not None else scale * float(total.least or 1)
    if max_repetition is not None and total.most:
        budget = min(budget, max_repetition * scale / float(total.most))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens"), F.lit(exponent)) / scale).otherwise(0.0)
    plan = sources.select("source", "docs", "tokens", (F.col("tokens") / whole).alias("share"), weight.alias("weight"))
    # Rounded, so that a source that is due once isn't read 0.9999999 times.
    plan = plan.withColumn("repetition", F.when(F.col("tokens") > 0, F.round(F.col("weight") * budget / F.col("tokens"), 9)).otherwise(1.0))
    plan = plan.withColumn("epochs", F.floor("repetition").cast("int"))
    plan = plan.withColumn("left", (F.col("repetition") - F.col("epochs")) * F.col("tokens"))
    cuts = narrow.join(_small(spark, plan.where("left > 0").select(F.col("source").alias("of"), "left")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    for k, key in ((1, "b1"), (2, "b2")):
        cut = _cut(cuts.groupBy("source", key).agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left")), key)
        cut = materialise(cut.select("source", F.col(key).alias(f"cut{k}"), F.col("rest").alias(f"rest{k}")), f"mixing-cut{k}")
        plan = plan.join(cut.select(F.col("source").alias("of"), f"cut{k}"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        cuts = cuts.drop("left").join(
            _small(spark, cut.select(F.col("source").alias("of"), f"cut{k}", F.col(f"rest{k}").alias("left"))), F.col("source").eqNullSafe(F.col("of")) & (F.col(key) == F.col(f"cut{k}"))
        ).drop("of", f"cut{k}")
    last = _cut(cuts.groupBy("source", "b3").agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left")), "b3").select(F.col("source").alias("of"), F.col("b3").alias("cut3"))
    return materialise(plan.join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "left"), "mixing-plan")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("source", tokens_of(F.col("text")).alias("tokens"), *_places(seed))


def _places(seed: int) -> list[Column]:
    """Where a document stands in its source's permutation: block, block within the block, and its own hash."""
    h = [F.xxhash64(F.lit(seed), F.lit(k), "source", "doc_id", "text") for k in range(2)]
    return [F.pmod(h[0], F.lit(BLOCKS)).alias("b1"), F.pmod(F.shiftright(h[0], 20), F.lit(BLOCKS)).alias("b2"), h[1].alias("b3")]


def _cut(sums: DataFrame, key: str) -> DataFrame:
    """For each source the block in which the running sum of tokens reaches `left`, and what is left within it."""
    order = Window.partitionBy("source").orderBy(key)
    running = sums.withColumn("upto", F.sum("tokens").over(order))
    reached = running.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("tokens") < F.col("left")))
    return reached.select("source", key, (F.col("left") - F.col("upto") + F.col("tokens")).alias("rest"))


def _small(spark, table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else table


def mix_sources(docs: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """docs with a row for each time that a document is read, and mix_epoch, mix_order; other columns unchanged.

    Weights are token shares (words of `text`) to a power found from a repetition limit or a target entropy; see
    `mixing_plan`. Each source's documents form a permutation of blocks by hash, cut by its budget; mix_epoch is the
    number of the reading, and ascending (mix_epoch, mix_order) goes through the blocks, each of which holds its part of
    every source, in an order that differs by epoch, and so do the blocks within them and the documents. With the default budget every document is read at least once.

    A source may hold any share of all rows: sums are taken per block before the shuffle, and only one block of a
    block, about one document in 16 million of a source, is put in order document by document. A null source is a
    source; documents without words belong to no budget and are read with every full reading, or once if their
    source has no words at all; equal rows (doc_id, text) of a source stand at one place; an empty table gives an
    empty result. Existing columns mix_epoch and mix_order are replaced.
    """
    spark = docs.sparkSession
    plan = mixing_plan(docs, max_repetition, target_entropy, budget_tokens, seed)
    own = {c: free_name(docs, f"lw_{c}") for c in ("source", "epochs", "cut1", "cut2", "cut3", "b1", "b2", "b3")}
    plan = plan.select(*(F.col(c).alias(own[c]) for c in ("source", "epochs", "cut1", "cut2", "cut3")))
    given = docs.drop("mix_epoch", "mix_order")
    placed = given.withColumns({own[f"b{k + 1}"]: x for k, x in enumerate(_places(seed))}).join(_small(spark, plan), F.col("source").eqNullSafe(F.col(own["source"])))
    here, cut = ([F.col(own[f"{x}{k}"]) for k in (1, 2, 3)] for x in ("b", "cut"))
    # Compared one by one, for what names them differs.
    again = cut[0].isNotNull() & ((here[0] < cut[0]) | ((here[0] == cut[0]) & ((here[1] < cut[1]) | ((here[1] == cut[1]) & (here[2] <= cut[2])))))
    readings = F.col(own["epochs"]) + F.coalesce(again, F.lit(False)).cast("int")
    read = placed.withColumn("mix_epoch", F.explode(F.when(readings > 0, F.sequence(F.lit(0), readings - 1)).otherwise(F.array().cast("array<int>"))))
    return read.select(*map(quoted, given.columns), "mix_epoch", _order(*here).alias("mix_order"))


def _order(*blocks: Column) -> Column:
    """A permutation of the blocks by epoch, then of the blocks within a block, then of documents: 20, 20 and 23 bits."""
    parts = [F.xxhash64("mix_epoch", *blocks[:k]) for k in (1, 2, 3)]
    one, two, three = (F.pmod(h, F.lit(1 << bits)) for h, bits in zip(parts, (20, 20, 23), strict=True))
    return F.shiftleft(one, 43).bitwiseOR(F.shiftleft(two, 23)).bitwiseOR(three)


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)
