"""From log lines to records: assembly, parsing and splitting off stack traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.formats import LogFormat

#: Lines of a file that are ordered together; records may cross these bounds.
BLOCK_LINES = 65_536

# Stack traces. The loop over Java frames is possessive, so that traces of any length need no deep stack.
_PYTHON_TRACE = r"(?:^Traceback\s+\(most\s+recent\s+call\s+last\):\s*$\n?(?:^\s{2}File\s+\"[^\"]*\",\s+line\s+\d+,\s+in\s+\S+\s*$\n?(?:^\s{4}[^\n]*$\n?)?)+^[a-zA-Z_][a-zA-Z0-9_.]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*:[^\n]*$)"
_JAVA_TRACE = r"(?:(?:^\S*?(?:Exception|Error)(?::\s*[^\n]*?)?$\n?)+(?:(?:^\s*at\s+(?:[a-zA-Z_$][a-zA-Z0-9_$]*\.)*[a-zA-Z_$][a-zA-Z0-9_$]*(?:\.[a-zA-Z_$][a-zA-Z0-9_$]*)?(?:\([^)]*\))?(?:\s*~\[[^\]]+\])?(?:\s*@[a-fA-F0-9]+)?$\n?)|(?:^\s*\.{3}\s*\d+\s+(?:more|common\s+frames?\s+omitted)$\n?)|(?:^\s*Caused\s+by:\s*[a-zA-Z_$][a-zA-Z0-9_$.]*(?::\s*[^\n]*?)?$\n?)|(?:^\s*Suppressed:\s*[a-zA-Z_$][a-zA-Z0-9_$.]*(?::\s*[^\n]*?)?$\n?))*+)"
TRACE = f"(?m)({_PYTHON_TRACE})|({_JAVA_TRACE})"
#: White space that is trimmed from the end of a body.
_TRIMMED = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+\z"


def assemble(lines: DataFrame, fmt: LogFormat, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(path, rec_id, first_line, content) of the records that begin with lines of the format.

    Other lines are appended to the record before them; those before the first record are dropped. rec_id counts from
    1 in each file. Beginnings are counted within blocks of lines, then over blocks, so no file has to be ordered in
    one task; a record's own lines meet by (path, rec_id).
    """
    marked = lines.select("path", "line_no", "value", F.floor(F.col("line_no") / block_lines).alias("block"), fmt.matches(F.col("value")).cast("int").alias("begins"))
    totals = marked.groupBy("path", "block").agg(F.sum("begins").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("path", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inner = marked.withColumn("inner", F.sum("begins").over(Window.partitionBy("path", "block").orderBy("line_no")))
    numbered = inner.join(offsets, ["path", "block"]).select("path", "line_no", "value", (F.col("before") + F.col("inner")).alias("rec_id")).where("rec_id > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x.value), "\n")
    return numbered.groupBy("path", "rec_id").agg(F.min("line_no").alias("first_line"), joined.alias("content"))


def bare_records(lines: DataFrame) -> DataFrame:
    """Without a format each line is a record."""
    return lines.select("path", (F.col("line_no") + 1).alias("rec_id"), F.col("line_no").alias("first_line"), F.col("value").alias("content"))


def start_at(lines: DataFrame, start: int) -> DataFrame:
    """Lines from the start-th on, before records are assembled."""
    return lines.where(F.col("line_no") >= start)


def first_records(records: DataFrame, count: int) -> DataFrame:
    """The first `count` assembled records of each file."""
    return records.where(F.col("rec_id") <= count)


def parse(records: DataFrame, fmt: LogFormat | None) -> DataFrame:
    """records with file, lineno, thread, body, trace_language and trace.

    The body ends where a stack trace begins, without white space at its end; what follows the trace is dropped.
    """
    content = F.col("content")
    parsed = records.select("*", *(fmt.details(content) if fmt else [F.lit(None).cast(t).alias(n) for n, t in (("file", "string"), ("lineno", "int"), ("thread", "string"))] + [content.alias("body")]))
    return split_trace(parsed)


def split_trace(rows: DataFrame) -> DataFrame:
    """Rows whose `body` may end in a trace, with body, trace_language and trace told apart."""
    body = F.col("body")
    may_be = body.rlike(r"(?:Exception|Error|Traceback)")
    trace = F.when(may_be, F.nullif(F.regexp_substr(body, F.lit(TRACE)), F.lit("")))
    rows = rows.withColumn("trace", trace)
    cut = F.regexp_replace(F.substring(body, F.lit(1), F.expr("locate(trace, body) - 1")), _TRIMMED, "")
    language = F.when(F.col("trace").startswith("Traceback"), "Python").when(F.col("trace").isNotNull(), "Java")
    return rows.withColumns({"body": F.when(F.col("trace").isNotNull(), cut).otherwise(body), "trace_language": language})


def full_body(body: Column, line: Column) -> Column:
    """The text that a record logs: its body, or the whole line where no format gave one."""
    return F.coalesce(body, line)
