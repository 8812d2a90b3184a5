"""Log files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value, ok) of the lines of text files, numbered from 0 in each file.

    Files are split as Spark splits them: lines are ranked within a split, and a window over one row per split adds
    the lines before it, so a file of any size is numbered in parallel. A carriage return before the line feed is
    dropped; lines that are no UTF-8 have ok false and a null value.
    """
    return number_lines(marked_lines(spark.read.option("lineSep", "\n").text(path)))


def marked_lines(raw: DataFrame) -> DataFrame:
    """Rows (path, block, value, ok) of lines as the text source gives them, at rest or as a stream."""
    ok = F.is_valid_utf8("value")
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.when(ok, F.regexp_replace("value", r"\r\z", "")).alias("value"), ok.alias("ok"),
    )


def number_lines(rows: DataFrame) -> DataFrame:
    """Rows (path, block, ...), read in order within blocks, with line_no in that order within each path."""
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("path", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inner = rows.withColumn("inner", F.row_number().over(Window.partitionBy("path", "block").orderBy("at")))
    return inner.join(offsets, ["path", "block"]).withColumn("line_no", F.col("before") + F.col("inner") - 1).drop("inner", "before", "block", "at")


def split_lines(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, line_no, value) of texts held in a column; a trailing line feed ends the last line."""
    text = F.regexp_replace(F.col(text_col), r"\n\z", "")
    parts = docs.where(F.length(text_col) > 0).select(F.col(path_col).alias("path"), F.posexplode(F.split(text, "\n")).alias("line_no", "value"))
    return parts.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
