"""Exact duplicates by progressive refinement, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import SPACE, free_name, materialise, small

#: Characters of the normalised text that the second refinement hashes.
PREFIX_CHARS = 96
#: Bits of a filter that tells which keys survived a refinement, in pieces of PIECE bits; 4 MB whatever the corpus.
FILTER_BITS, PIECE = 1 << 25, 1 << 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def _filter_of(keys: DataFrame, key: str) -> DataFrame:
    """(piece, map): a bitmap over hashed keys, of FILTER_BITS / PIECE rows of 4 KB at most."""
    pieces = keys.select(F.bitmap_bucket_number(_bit(key) + 1).alias("piece"), F.bitmap_bit_position(_bit(key) + 1).alias("bit"))
    return materialise(pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map")), "dedup-filter")


def _passing(rows: DataFrame, key: str, survivors: DataFrame) -> DataFrame:
    """rows with `passes`, true where the key isn't null and survived, and for the few others that share its bit.

    What passes wrongly costs a hash and is told apart by the counts that follow.
    """
    at = F.pmod(_bit(key), F.lit(PIECE)).cast("int")
    byte = F.conv(F.hex(F.substring("map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(survivors), F.bitmap_bucket_number(_bit(key) + 1) == F.col("piece"), "left")
    return found.withColumn("passes", F.col(key).isNotNull() & F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))).drop("piece", "map")


def _refined(docs: DataFrame, digest: bool, id_col: str, text_col: str) -> DataFrame:
    """exact_groups with `full`, the hash of the whole text for rows that earlier refinements leave, null for others."""
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("len", F.char_length("norm"))
    lengths = _filter_of(rows.groupBy("len").agg(F.count("*").alias("n")).where("n > 1"), "len")
    prefixed = _passing(rows, "len", lengths).withColumn("prefix", F.when(F.col("passes"), F.xxhash64("len", F.left("norm", F.lit(PREFIX_CHARS))))).drop("passes")
    prefixes = _filter_of(prefixed.where("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "prefix")
    hashed = _passing(prefixed, "prefix", prefixes).select(
        "doc_id", "len", F.when(F.col("passes"), F.sha2("norm", 256)).alias("full"), *([F.sha2("norm", 256).alias("text_sha256")] if digest else []),
        F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row")).alias("at"),
    )
    hashed = materialise(hashed, "dedup-rows")
    groups = hashed.where("full is not null").groupBy("full").agg(F.min("at").alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialise(groups.withColumnRenamed("full", "group_full"), "dedup-groups")
    # Rows without a whole hash are alone and don't travel.
    alone = hashed.where("full is null").withColumns({"first": F.lit(None).cast(groups.schema["first"].dataType), "group_size": F.lit(1).cast("long")})
    met = hashed.where("full is not null").join(groups, F.col("full") == F.col("group_full"), "left").drop("group_full")
    return alone.unionByName(met).select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first") == F.col("at"))).alias("kept"),
        *(["text_sha256"] if digest else []),
        "full",
    )


def exact_groups(docs: DataFrame, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and, with `digest`, text_sha256.

    Texts are equal when they are identical after each run of white space became one space; null counts as empty.
    Three refinements, each a pass that shuffles counts and no texts: rows are counted by normalised length; those
    whose length others share by length and a hash of the first PREFIX_CHARS characters; and only those that others
    share this with get a hash of the whole text, by which groups are formed. What a pass leaves reaches the next one
    as a bitmap of fixed size over hashed keys. The fuller it is, the more rows are hashed in vain; results don't
    depend on it.

    Of equal texts the row with the smallest id stays (null ids last; of rows that share that id, the first in scan
    order), and `kept` is true for exactly one row per group. Copies are counted before the shuffle, so a group may
    hold any share of all rows. A text of any length is hashed in place. An empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    return _refined(docs, digest, id_col, text_col).drop("full")


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows of which an equal text stays: one row of each group, all columns unchanged.

    Rows that share doc_id and text count as one document, of which one row stays; null ids are an id. Texts are not
    shuffled while the rows to drop are few enough to broadcast; beyond that size they are joined by doc_id. Only
    rows whose id is one to drop are hashed again. Any column names are accepted.
    """
    groups = _refined(docs, False, "doc_id", "text").where("full is not null")
    groups = groups.groupBy("doc_id", "full").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1")
    groups = materialise(groups, "dedup-lost")
    of, full, sha = (free_name(docs, x) for x in ("lw_of", "lw_full", "lw_sha"))
    lost, again = (small(groups.where(x).select(F.col("doc_id").alias(of), F.col("full").alias(full))) for x in ("not kept", "kept"))
    text = F.sha2(normalised(F.col("text")), 256)
    on = F.col("doc_id").eqNullSafe(F.col(of)) & (text == F.col(full))
    out = docs.join(lost, on, "left_anti")
    if groups.where("kept").isEmpty():
        return out
    repeated = out.join(again, on, "left_semi").withColumn(sha, text).dropDuplicates(["doc_id", sha]).drop(sha)
    return out.join(again, on, "left_anti").unionByName(repeated)
