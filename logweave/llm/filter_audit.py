"""How five filters interact in every order, from one histogram of failure masks per part, with DataFrame functions only."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import WORD, materialise

#: The filters by their letters; the bit of a filter in a mask is that of its place here.
FILTERS = "ABCDE"
#: A: fewest words. B: least share of distinct words, in hundredths. C: largest share of capitals, in hundredths.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
#: D: characters that a text must not hold.
SYMBOLS = r"[#$%&*|]"


def own_failures(text: Column) -> Column:
    """The bits of the filters that look at one text alone, A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * F.size(words).cast("long"),
        100 * capitals.cast("long") > MAX_CAPITALS * F.char_length(text).cast("long"),
        text.rlike(SYMBOLS),
    )
    return sum((F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask): for each row the filters that it fails, as bits in the order of FILTERS.

    One pass over the texts leaves a narrow table of ids, parts, masks and digests. Equal texts are known by length and
    SHA-256; the smallest id of each is a minimum that is combined before the shuffle, and it reaches its row by a join
    on digest and id, so a text that a third of all rows hold is dealt over all tasks. Null texts count as empty, null
    parts as the empty string. Rows that share the smallest id of a text all pass E; a null id is larger than any other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    own = rows.select("doc_id", "part", own_failures(F.col("text")).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"), F.char_length("text").alias("chars"))
    own = materialise(own, "audit-rows")
    first = own.groupBy("digest", "chars").agg(F.min("doc_id").alias("of"))
    first = first.select(F.col("digest").alias("first_digest"), F.col("chars").alias("first_chars"), "of", F.lit(True).alias("is_first"))
    found = own.join(first, (F.col("digest") == F.col("first_digest")) & (F.col("chars") == F.col("first_chars")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return found.select("doc_id", "part", (F.col("own") + F.when(F.col("is_first"), 0).otherwise(16)).alias("mask"))


def mask_histogram(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of the rows (doc_id, part, mask): 32 cells per part at most.

    good and toxic count rows whose id has a label quality = 1 or toxic = 1; of several labels of one id the largest
    counts. Only rows with labels are joined by id, so rows without an id never meet.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")).where("good = 1 or toxic = 1")
    marked = masks.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("label_id"))
    marked = marked.groupBy("part", "mask").agg(F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    zero = F.lit(0).cast("long")
    counted = masks.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    cells = counted.unionByName(marked.select("part", "mask", zero.alias("n"), "good", "toxic"))
    return cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def _bit(letter: Column) -> Column:
    """The bit of the filter of that letter."""
    return F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(FILTERS), letter) - 1)


def every_order(cells: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from a mask histogram.

    All orders follow from a part's 32 cells, without looking at rows again. A cell whose mask has k bits loses its
    rows to each of its k filters in 5! / k orders, which gives `shapley` in whole numbers.
    """
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.split(F.lit(" ".join("".join(x) for x in permutations(FILTERS))), " ")
    steps = packed.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    earlier = F.left("filter_order", F.col("step") - 1)
    gone = sum((F.when(F.contains(earlier, F.lit(x)), F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.select("*", _bit(F.substring("filter_order", F.col("step"), F.lit(1))).alias("own"), gone.alias("before"))

    def total(value: str, wanted) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + F.when(wanted(c["mask"]), c[value]).otherwise(F.lit(0).cast("long")))

    own, before = F.col("own"), F.col("before")
    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)
    share = lambda t, c: t + F.when(c["mask"].bitwiseAND(own) != 0, c["n"] * (F.lit(factorial(len(FILTERS))) / F.bit_count(c["mask"])).cast("long")).otherwise(F.lit(0).cast("long"))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), F.aggregate("cells", F.lit(0).cast("long"), share).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with counts of rows; zeros included.

    A text fails A with fewer than MIN_WORDS words, B when fewer than MIN_DISTINCT hundredths of its words are
    distinct, C when more than MAX_CAPITALS hundredths of its characters are A-Z, D when it holds one of SYMBOLS, E when
    a smaller id has the identical text, anywhere in the table. Parts are the values of `source`.

    Repeated rows each count; an empty table gives an empty result; texts are read whole, each inside its own row, and
    never shuffled; columns other than doc_id, text and source (and doc_id, quality and toxic of the labels) aren't
    read. See failure_masks and mask_histogram for nulls and ties.
    """
    masks = materialise(failure_masks(docs), "audit-masks")
    return every_order(materialise(mask_histogram(masks, labels), "audit-cells"))


#: The audit in DuckDB's SQL, from the rows themselves rather than from cells.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), w AS (
  SELECT *, string_split_regex(trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS ws FROM d
), c AS (
  SELECT doc_id, part, t, first_id, CASE WHEN ws = [''] THEN 0 ELSE len(ws) END AS words, CASE WHEN ws = [''] THEN 0 ELSE len(list_distinct(ws)) END AS distinct_words FROM w
), f AS (
  SELECT c.doc_id, part, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, MAP {
    'A': words < 50, 'B': 100 * distinct_words < 65 * words, 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': c.doc_id > first_id} AS fails
  FROM c LEFT JOIN labels USING (doc_id)
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic,
         len(list_filter(map_values(fails), lambda x: x)) AS failed FROM f GROUP BY part, fails
), l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o
), r AS (
  SELECT part, filter_order, step, n, good, toxic, failed, fails[filter_order[step]] AS own,
         len(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: coalesce(fails[x], false))) > 0 AS gone FROM s, g
)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (own AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (own AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (own AND failed = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (own AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(sum(n) FILTER (own AND NOT gone), 0)) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step
"""
