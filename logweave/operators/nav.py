"""Moving through a log by lines and breakpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg(F.count("*").alias("n_lines"))


def set_breakpoints(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, ord, line) with `verified`, whether the line lies inside the log."""
    return wanted.join(counts, "path", "left").select("path", "ord", "line", ((F.col("line") > 0) & (F.col("line") < F.coalesce("n_lines", F.lit(2**31 - 1)))).alias("verified"))


def has_breakpoints(logs: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """(path, has_breakpoints) of the logs, whether any breakpoint is set in them."""
    some = breakpoints.groupBy("path").agg(F.count("*").alias("n"))
    return logs.select("path").distinct().join(some, "path", "left").select("path", F.col("n").isNotNull().alias("has_breakpoints"))


def step(line: Column, n_lines: Column, by: int) -> Column:
    """The line `by` lines on or back, within the log."""
    return F.greatest(F.lit(1), F.least(n_lines, line + by))


def continue_to(cursors: DataFrame, breakpoints: DataFrame, back: bool = False) -> DataFrame:
    """(path, line, n_lines) with `next_line`: the first breakpoint in insertion order beyond the line, else the log's end.

    Backwards it is the last in insertion order before the line, else 1.
    """
    stops = breakpoints.select("path", F.col("line").alias("stop"), "ord")
    passed = (F.col("stop") < F.col("line")) if back else (F.col("stop") > F.col("line"))
    found = cursors.join(stops, "path", "left").groupBy("path", "line", "n_lines")
    stop = F.when(passed, F.col("stop"))
    order = F.when(passed, F.col("ord"))
    at = F.max_by(stop, order) if back else F.min_by(stop, order)
    return found.agg(F.coalesce(at, F.lit(1) if back else F.first("n_lines")).alias("next_line"))


def frames(matched: DataFrame) -> DataFrame:
    """The stack frame of each record: name, line and path of its statement, or ??? and -1."""
    return matched.select("path", "first_line", F.coalesce("stmt.name", F.lit("???")).alias("name"), F.coalesce("stmt.line_no", F.lit(-1)).alias("line"), F.coalesce("stmt.source_path", F.lit("???")).alias("source_path"))


def locals_of(mapped: DataFrame) -> DataFrame:
    """(path, first_line, name, value) of the recovered variables."""
    return mapped.select("path", "first_line", F.explode("variables").alias("v")).select("path", "first_line", F.col("v.expr").alias("name"), F.col("v.value").alias("value"))
