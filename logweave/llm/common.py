"""What the corpus operators share: shared-folder tables, null handling and byte-level word hashing."""

from __future__ import annotations

import ctypes
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweave.tables import materialise, new_folder, shared_dir  # noqa: F401

#: White space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes hashed at once; bounds the memory of a task whatever the length of a text.
PIECE_BYTES = 1 << 19


#: Most rows, each of a few numbers, that are broadcast.
BROADCAST_ROWS = 250_000


def small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """The table, to be broadcast if it has no more than so many (narrow) rows; it is counted first."""
    most = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def release_memory() -> None:
    """Gives memory that is no longer used back to the system, where it can be: a worker stays when its task has ended."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run):
    """A pass over batches that leaves its worker with little memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def map_batches(df: DataFrame, run, schema: StructType) -> DataFrame:
    """mapInArrow for columns of any names, which `run` gets by their places."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(tidy(run), schema)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


#: Bytes of all texts that a model is fitted on, and of one of them, at most.
FIT_BYTES, TEXT_BYTES = 64 << 20, 256 << 10


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, fit_bytes: int = FIT_BYTES, text_bytes: int = TEXT_BYTES) -> list[tuple[bytes, int]]:
    """Texts (UTF-8) and labels of at most `rows` training rows and `fit_bytes` bytes, chosen by a hash of doc_id.

    Only rows outside the held-out fold are taken. A text of more than `text_bytes` bytes is left out by itself, so no
    single text takes the others' place; of the rest, rows are taken in the order of the hash until the bytes are
    spent. Of several labels of one id the largest counts, of several texts the first by bytes. The bounds make both
    the broadcast of the chosen ids and what the driver receives independent of the corpus. It warns when there are
    labelled rows but none that can be learned from.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(*order).limit(rows).withColumnRenamed("doc_id", "label_id")
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    texts = materialise(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "labelled")
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(*order))
    # At most `rows` narrow rows are ordered.
    fitting = texts.where(F.octet_length("text") <= text_bytes).select("doc_id", upto.alias("upto")).where(F.col("upto") <= fit_bytes).select(F.col("doc_id").alias("label_id"))
    found = texts.join(F.broadcast(fitting), F.col("doc_id") == F.col("label_id")).collect()
    if not found and not texts.isEmpty():
        warnings.warn(f"all labelled texts are longer than {text_bytes} bytes: nothing is learned of {label}", stacklevel=2)
    return [(bytes(r.text), r.label) for r in sorted(found, key=lambda r: r.doc_id)]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits of a uint64 array."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers modulo 2**64 of an odd base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[0][:n], _powers[1][:n]


def segment_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for each pair, from one running sum."""
    n = len(symbols)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    edge = np.diff(np.concatenate(([True], _IS_SPACE[buf], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """A text as buffers of about PIECE_BYTES that end at white space, so that no word is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            buf = np.frombuffer(text, np.uint8, min(len(text) - end, PIECE_BYTES), end)
            while not len(gap := np.flatnonzero(_IS_SPACE[buf])):
                end += len(buf)
                if end >= len(text):
                    break
                buf = np.frombuffer(text, np.uint8, min(len(text) - end, PIECE_BYTES), end)
            end += int(gap[0]) if len(gap) else 0
        end = min(end, len(text))
        yield np.frombuffer(text, np.uint8, end - at, at)
        at = end


def word_hashes(texts: list[bytes], lower: bool = True) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, A-Z in lower case. Short texts are hashed together."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    block: list[int] = []
    size = 0

    def hashed(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = word_bounds(buf)
        return starts, segment_hashes(_LOWER[buf] if lower else buf, starts, ends)

    def flush() -> None:
        nonlocal block, size
        if block:
            starts, h = hashed(np.frombuffer(b"\n".join(texts[i] for i in block), np.uint8))
            cuts = np.searchsorted(starts, np.cumsum([len(texts[i]) + 1 for i in block]))
            for i, part in zip(block, np.split(h, cuts[:-1]), strict=True):
                out[i] = part
        block, size = [], 0

    for i, t in enumerate(texts):
        if len(t) > PIECE_BYTES:
            out[i] = np.concatenate([hashed(b)[1] for b in pieces(t)])
            continue
        if size + len(t) > PIECE_BYTES:
            flush()
        block.append(i)
        size += len(t) + 1
    flush()
    return out
