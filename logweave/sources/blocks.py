"""Log files in blocks of bytes: an index from lines to places, and lines or records read where they lie, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.formats import LogFormat

#: Bytes of a block, which one task reads at once.
BLOCK_BYTES = 16 << 20
#: Blocks that are dealt one to a task; more share tasks.
MOST_TASKS = 100_000
#: Bytes that are read at a time behind a block, for what began in it.
_ON = 1 << 16
#: Rows of a batch.
_ROWS = 5000
#: Endings of files that have no place to begin reading but their start.
_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")

_BLOCK = "path string, start long, end long, size long"
INDEX = f"{_BLOCK}, lines long, begins long, first_begin long, first_line long, first_rec long"


def list_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame | None:
    """(path, start, end, size) of the blocks of the files at a path, a folder or a pattern, dealt over tasks.

    Spark lists them. None if some file can't be read from the middle: a packed one, or one in a store that only Spark reads.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).where("size > 0")
    seen = files.agg(F.sum(F.ceil(F.col("size") / block_bytes)).alias("n"), F.max(F.lower("path").rlike("(" + "|".join(map(re.escape, _PACKED)) + ")$")).alias("packed"), F.min("path").alias("one")).first()
    if seen.packed or not (seen.one is None or _reads(seen.one)):
        return None
    starts = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))))
    blocks = starts.select("path", "start", F.least(F.col("start") + block_bytes, F.col("size")).alias("end"), "size")
    return blocks.repartition(max(1, min(seen.n or 0, MOST_TASKS)))


def _reads(path: str) -> bool:
    try:
        where, at = fs.FileSystem.from_uri(path)
        return where.get_file_info(at).type == fs.FileType.File
    except (OSError, pa.ArrowException):
        return False


class _Source:
    """A file from which ranges are read; it counts the bytes."""

    def __init__(self, path: str) -> None:
        where, at = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(at)
        self.taken = 0

    def bytes(self, start: int, end: int) -> bytes:
        out = self.file.read_at(max(0, end - start), start)
        self.taken += len(out)
        return out

    def lines(self, start: int, end: int, size: int) -> Iterator[tuple[bool, bytes]]:
        """The lines from the first that begins in [start, end) to the end of the file, each with whether it begins there; read as they are asked for."""
        data = self.bytes(max(0, start - 1), end)
        place = 0
        if start:
            place = data.find(b"\n") + 1
            if not place:
                return
        begins = max(0, start - 1) + place  # where the next line begins in the file
        at, on = end, end - begins
        data = data[place:]
        while begins < size:
            cut = data.find(b"\n")
            while cut < 0 and at < size:
                more = self.bytes(at, min(at + _ON, size))
                at += len(more)
                cut = len(data) + more.find(b"\n") if b"\n" in more else -1
                data += more
            if on and cut >= 0 and begins + cut < end:
                # All lines that end in the block, at once.
                last = data.rfind(b"\n", 0, on)
                for line in data[:last].split(b"\n"):
                    yield True, line
                begins, data, on = begins + last + 1, data[last + 1 :], 0
                continue
            line = data if cut < 0 else data[:cut]
            yield begins < end, line
            begins += len(line) + 1
            data, on = data[len(line) + 1 :], 0


def _text(line: bytes) -> str | None:
    """A line without the carriage return at its end, None if it is no UTF-8."""
    try:
        return line.removesuffix(b"\r").decode()
    except UnicodeDecodeError:
        return None


def _begins(fmt: LogFormat):
    """Tells whether a record begins with a line; classes of characters are ASCII's, as in Spark's patterns."""
    return re.compile(fmt.pattern, re.A).search


def _count(fmt: LogFormat | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = _begins(fmt) if fmt else None
        for batch in batches:
            lines, heads, firsts = [], [], []
            for path, start, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source = _Source(path)
                n, k, first = 0, 0, None
                if begins:
                    for inside, line in source.lines(start, end, size):
                        if not inside:
                            break
                        if (text := _text(line)) is not None and begins(text):
                            k, first = k + 1, n if first is None else first
                        n += 1
                else:
                    # A line begins after each line feed but the file's last byte.
                    data = np.frombuffer(source.bytes(max(0, start - 1), end - 1), np.uint8)
                    n = int(np.count_nonzero(data == 10)) + (start == 0)
                    k, first = n, 0 if n else None
                lines.append(n)
                heads.append(k)
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (lines, heads, firsts))], names=[*batch.schema.names, "lines", "begins", "first_begin"])

    return run


def index_log(spark: SparkSession, path: str, fmt: LogFormat | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame | None:
    """A row (see INDEX) for each block: its bytes, how many lines and records begin in it, and their numbers in the file.

    first_begin is the line of the block's first record. Without a format each line is a record. This is one pass over
    the log; written as a table it is the log's sidecar, with which any line or record is found by reading its block.
    None where the files have no blocks (see list_blocks).
    """
    blocks = list_blocks(spark, path, block_bytes)
    if blocks is None:
        return None
    counted = blocks.mapInArrow(_count(fmt), f"{_BLOCK}, lines long, begins long, first_begin long")
    # One row per block, so a file of any size is numbered here.
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumns({"first_line": F.coalesce(F.sum("lines").over(before), F.lit(0)), "first_rec": F.coalesce(F.sum("begins").over(before), F.lit(0)) + 1})
    return numbered.withColumn("first_begin", F.col("first_line") + F.col("first_begin")).select(*(c.split()[0] for c in INDEX.split(", ")))


def _dealt(index: DataFrame) -> DataFrame:
    """The rows of an index dealt to tasks of their own, as far as there are."""
    return index.repartition(max(1, min(index.count(), MOST_TASKS)))


_LINE = "path string, line_no long, value string, ok boolean"


def read_lines(index: DataFrame) -> DataFrame:
    """(path, line_no, value, ok) of the lines that begin in the blocks of an index, numbered from 0 in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows: list[str | None] = []
                number = r["first_line"]

                def flush(rows: list[str | None], number: int, path: str = r["path"]) -> pa.RecordBatch:
                    value = pa.array(rows, pa.string())
                    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(np.arange(number, number + len(rows))), value, value.is_valid()], names=["path", "line_no", "value", "ok"])

                for inside, line in _Source(r["path"]).lines(r["start"], r["end"], r["size"]):
                    if not inside:
                        break
                    rows.append(_text(line))
                    if len(rows) >= _ROWS:
                        yield flush(rows, number)
                        number += len(rows)
                        rows = []
                if rows:
                    yield flush(rows, number)

    return _dealt(index).mapInArrow(run, _LINE)


_RECORD = "path string, rec_id long, first_line long, content string, ok boolean"


def read_records(index: DataFrame, fmt: LogFormat | None) -> DataFrame:
    """(path, rec_id, first_line, content, ok) of the records that begin in the blocks of an index made with this format.

    A record is read to its end, wherever that lies, by the task in whose block it begins; so lines are neither
    shuffled nor joined, and what a task holds is a block and one record. Lines that are no UTF-8 belong to no record;
    they come as rows of their own with ok false, without rec_id and content. Lines before a file's first record are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = _begins(fmt) if fmt else None
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "rec_id", "first_line", "content", "ok"])

        for batch in batches:
            for r in batch.to_pylist():
                path, number, rec = r["path"], r["first_line"], r["first_rec"] - 1
                record: list[str] = []
                first = number
                for inside, line in _Source(path).lines(r["start"], r["end"], r["size"]):
                    text = _text(line)
                    if text is None:
                        if inside:
                            rows.append((path, None, number, None, False))
                    elif begins is None or begins(text):
                        if record:
                            rows.append((path, rec, first, "\n".join(record), True))
                        record = [text] if inside else []
                        rec, first = rec + 1, number
                    elif record:
                        record.append(text)
                    number += 1
                    if not inside and not record:
                        break
                    if len(rows) >= _ROWS:
                        yield flush()
                        rows = []
                if record:
                    rows.append((path, rec, first, "\n".join(record), True))
        if rows:
            yield flush()

    return _dealt(index).mapInArrow(run, _RECORD)


def block_of_line(index: DataFrame, path: str, line_no: int) -> DataFrame:
    """The one row of an index whose block the line begins in."""
    return index.where((F.col("path") == path) & (F.col("first_line") <= line_no) & (F.col("first_line") + F.col("lines") > line_no))


def record_at(index: DataFrame, fmt: LogFormat | None, path: str, line_no: int) -> DataFrame:
    """The record that a line belongs to, if it belongs to one, found by reading the block in which it begins."""
    held = index.where((F.col("path") == path) & (F.col("first_begin") <= line_no))
    block = held.orderBy(F.desc("first_line")).limit(1)
    return read_records(block, fmt).where(F.col("ok") & (F.col("first_line") <= line_no)).orderBy(F.desc("first_line")).limit(1)
