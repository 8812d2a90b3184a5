"""Mappings as JSON lines in the wire shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    """A JSON string, null for null."""
    return F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("v"))), r'^\{"v":(.*)\}$', 1)


def _object(*fields: tuple[str, Column]) -> Column:
    """An object of the fields whose JSON isn't null, in order."""
    parts = F.filter(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in fields]), lambda x: x.isNotNull())
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _some(value: Column) -> Column:
    return F.when(value.isNotNull(), _text(value))


def _number(value: Column) -> Column:
    return value.cast("string")


def argument(arg: Column) -> Column:
    return F.when(arg["kind"] == "Named", _object(("Named", _text(arg["name"])))).when(arg["kind"] == "Positional", _object(("Positional", _number(arg["pos"])))).otherwise('"Placeholder"')


def mapping_json(mapped: DataFrame) -> Column:
    """One JSON object per mapping: logRef, srcRef or null, exceptionTrace if any, variables."""
    stmt = F.col("stmt")
    trace = F.when(F.col("trace").isNotNull(), _object(("language", _text(F.col("trace_language"))), ("content", _text(F.col("trace")))))
    details = _object(("thread", _some(F.col("thread"))), ("file", _some(F.col("file"))), ("lineno", _number(F.col("lineno"))), ("trace", trace))
    source = _object(
        ("sourcePath", _text(stmt["source_path"])), ("language", _text(stmt["language"])), ("lineNumber", _number(stmt["line_no"])), ("endLineNumber", _number(stmt["end_line_no"])),
        ("column", _number(stmt["column"])), ("name", _text(stmt["name"])), ("text", _text(stmt["text"])), ("quality", _number(stmt["quality"])), ("pattern", _text(stmt["pattern"])),
        ("args", _list(F.transform(stmt["args"], argument))), ("vars", _list(F.transform(stmt["vars"], _text))),
    )
    sites = _list(F.transform("exception_trace", lambda c: _object(("name", _text(c["name"])), ("sourcePath", _text(c["source_path"])), ("language", _text(c["language"])), ("lineNumber", _number(c["line_no"])))))
    values = _list(F.transform("variables", lambda v: _object(("expr", _text(v["expr"])), ("value", _text(v["value"])))))
    return _object(
        ("logRef", _object(("details", F.when(details != "{}", details)))), ("srcRef", F.when(stmt.isNull(), F.lit("null")).otherwise(source)),
        ("exceptionTrace", F.when(F.size("exception_trace") > 0, sites)), ("variables", values),
    )


def error_json(line_no: Column) -> Column:
    """The row that stands for a line that is no UTF-8."""
    return _object(("error", _object(("message", _text(F.concat(F.lit("unable to read line "), line_no.cast("string")))), ("source", F.lit('"stream did not contain valid UTF-8"')))))
