"""Structured Streaming: records assembled with state per file, then mapped batch by batch."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from logweave.engine import Engine
from logweave.functions.formats import LogFormat
from logweave.operators import derive, match, records
from logweave.sources import lines as numbered

RECORD = "path string, rec_id long, first_line long, content string, part int"
_OPEN, _LINE = "rec_id long, first_line long, part int", "value string"
#: The state store that lists and timers need.
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Assembler(StatefulProcessor):
    """Of each file: the record that is open, its lines as a list that is only added to, and a timer that ends it."""

    def __init__(self, pattern: str, flush_ms: int) -> None:
        self.pattern, self.flush_ms = pattern, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begins = re.compile(self.pattern, re.A).search
        self.open, self.lines = handle.getValueState("open", _OPEN), handle.getListState("lines", _LINE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rec_id, first, part = self.open.get() if self.open.exists() else (0, None, 0)
        fresh: list[str] = []
        # One micro-batch's lines of one file; the source's limits per trigger bound them.
        given = pd.concat(list(rows)).sort_values("line_no")
        for number, value in zip(given["line_no"].tolist(), given["value"].tolist(), strict=True):
            if self.begins(value):
                yield from self._closed(key, rec_id, first, part, fresh)
                rec_id, first, part, fresh = rec_id + 1, number, 0, [value]
            elif rec_id:
                if first is None:  # its record went out before
                    first, part = number, part + 1
                fresh.append(value)
        if fresh:
            self.lines.appendList([(x,) for x in fresh])
        self.open.update((rec_id, first, part))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if first is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            rec_id, first, part = self.open.get()
            yield from self._closed(key, rec_id, first, part, [])
            self.open.update((rec_id, None, part))

    def _closed(self, key: tuple, rec_id: int, first: int | None, part: int, fresh: list[str]) -> Iterator[pd.DataFrame]:
        if first is not None:
            held = [x[0] for x in self.lines.get()] if self.lines.exists() else []
            self.lines.clear()
            yield pd.DataFrame({"path": [key[0]], "rec_id": [rec_id], "first_line": [first], "content": ["\n".join(held + fresh)], "part": pd.array([part], "int32")})

    def close(self) -> None:
        pass


def assemble_stream(lines: DataFrame, fmt: LogFormat, flush_ms: int = 10_000) -> DataFrame:
    """Records (path, rec_id, first_line, content, part) of a stream of lines (path, line_no, value).

    Each file's state is its unfinished record alone: where it began, and its lines, to which later ones are added
    without writing the others again. A record goes out when the next one begins or, by a timer, when its file has
    been silent for flush_ms, in place of the end of a file. No line is lost by that: lines that come for a record
    that went out follow as rows of its rec_id with part 1 and on, which begin at the first of them. Lines of one
    file must come in order across batches; within a batch they are ordered by line_no. Lines before a file's first
    record are dropped. Lists and timers need the session's state store to be the RocksDB one, which is set here for
    the session; queries that began with another one keep it.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return lines.groupBy("path").transformWithStateInPandas(_Assembler(fmt.pattern, flush_ms), RECORD, "Append", "ProcessingTime")


def map_stream(
    lines: DataFrame, fmt: LogFormat, statements: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, flush_ms: int = 10_000, every: str = "1 second"
) -> StreamingQuery:
    """Starts a query that hands the mappings of each batch's records to `sink`, with variables and exception_trace.

    For lines without an end of file, as of a socket or a queue; see assemble_stream. Matching a batch is the same plan
    as for a log at rest, against the catalogue as it was given.
    """
    made = assemble_stream(lines, fmt, flush_ms)
    files = statements.select("root_ord", "source_path").distinct()

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()  # records leave the state once
        try:
            if not batch.isEmpty():
                matched = match.match(records.parse(batch, fmt), statements)
                traced = derive.with_call_sites(matched, files, ["path", "rec_id", "part"])
                sink(traced.withColumn("variables", derive.variables(F.col("body"), F.col("stmt"), F.col("captured"))), number)
        finally:
            batch.unpersist()

    return made.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def map_log_files(
    engine: Engine, folder: str, fmt: LogFormat | None, sink: Callable[[DataFrame, int], None], checkpoint: str, start: int = 0, count: int | None = None, files_per_trigger: int = 1000, every: str | None = None
) -> StreamingQuery:
    """Starts a query over the log files that arrive in a folder; `sink` gets rows (path, first_line, json, failed).

    A file is whole when it arrives, so each batch is numbered, assembled and mapped as logs at rest are, in parallel
    within files of any size, and a record ends with its file. Without `every` the query ends when all files that are
    there have been mapped. start and count count per file.
    """
    raw = engine.spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)

    def each(batch: DataFrame, number: int) -> None:
        sink(engine.map_found(numbered.number_lines(batch), fmt, start, count), number)

    out = numbered.marked_lines(raw).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
