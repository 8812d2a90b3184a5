"""Log formats: validation, dialect and the columns that a format captures."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.errors import InvalidFormat, MissingCapture, UnknownCapture

# The groups that a format may have.
CAPTURES = ("timestamp", "thread", "method", "file", "line", "body", "level")
_GROUP = re.compile(r"\(\?P?<([a-zA-Z_]\w*)>")


@dataclass(frozen=True)
class LogFormat:
    """A validated format. `pattern` has dot match line feeds and plain groups, so that Spark and RE2 read it alike."""

    source: str
    pattern: str
    groups: dict[str, int]

    @classmethod
    def parse(cls, source: str) -> LogFormat:
        try:
            compiled = re.compile(_GROUP.sub(r"(?P<\1>", source), re.S)
        except re.error as e:
            raise InvalidFormat(f"invalid log format: {e}") from e
        for name in compiled.groupindex:
            if name not in CAPTURES:
                raise UnknownCapture(f"unknown capture group {name}")
        if "body" not in compiled.groupindex:
            raise MissingCapture("the log format has no capture group body")
        return cls(source, "(?s)" + _GROUP.sub("(", source), dict(compiled.groupindex))

    @property
    def has_source_hint(self) -> bool:
        return {"file", "line"} <= self.groups.keys()

    def matches(self, line: Column) -> Column:
        """Whether the format occurs anywhere in the line."""
        return line.rlike(self.pattern)

    def capture(self, name: str, line: Column) -> Column:
        """The text of a group in the first match, null if the format lacks the group."""
        if name not in self.groups:
            return F.lit(None).cast("string")
        return F.regexp_extract(line, self.pattern, self.groups[name])

    def details(self, line: Column) -> list[Column]:
        """file, lineno (0 where it isn't a number), thread and body."""
        number = F.coalesce(self.capture("line", line).try_cast("int"), F.lit(0)) if "line" in self.groups else F.lit(None).cast("int")
        return [self.capture("file", line).alias("file"), number.alias("lineno"), self.capture("thread", line).alias("thread"), self.capture("body", line).alias("body")]
