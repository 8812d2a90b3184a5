"""Document fingerprints by locally consistent parsing: phrases whose ends depend on nearby symbols alone."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import PIECE_BYTES, mix64, new_folder, segment_hashes

#: Rounds of parsing; a phrase of the last is some 25 bytes long, and one of the round before some 8.
ROUNDS = 3
#: Smallest phrase names that a fingerprint's string keeps.
KEPT = 48
#: Rounds of coin tossing that bring 64-bit names down to labels below six.
TOSSES = 4


def _low_bit(x: np.ndarray) -> np.ndarray:
    """Position of the lowest set bit of each non-zero uint64."""
    return (np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1).astype(np.uint64)


def _labels(s: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels of symbols by coin tossing; what stands before a head doesn't count."""
    label = s
    for _ in range(TOSSES):
        before = np.concatenate((label[:1], label[:-1]))
        before[head] = ~label[head]
        differ = label ^ before
        differ[differ == 0] = 1
        bit = _low_bit(differ)
        label = (bit << np.uint64(1)) | ((label >> bit) & np.uint64(1))
    return label.astype(np.int16)


def parse_long(symbols: np.ndarray, named: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """The names that parse_round gives to the phrases of a single document, worked out in pieces.

    Whether a phrase begins at a symbol depends on few runs to either side, so pieces see that many of their
    neighbours'. Besides the symbols and the names, which may be given as narrow ones with `named` to widen them, it
    takes some nine bytes a symbol.
    """
    runs = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    m, around = len(runs), TOSSES + 2

    def merged(low: int, high: int) -> np.ndarray:
        """The runs from low to high as symbols."""
        length = np.diff(np.append(runs[low:high], runs[high] if high < m else len(symbols)))
        s = named(symbols[runs[low:high]])
        long = length > 1
        if long.any():
            with np.errstate(over="ignore"):
                s[long] = mix64(s[long] ^ mix64(length[long].astype(np.uint64)))
        return s

    starts = [np.zeros(1, np.int64)]
    for low in range(0, m, PIECE_BYTES):
        high = min(low + PIECE_BYTES, m)
        first, end = max(0, low - around), min(m, high + around)
        s = merged(first, end)
        head = np.zeros(len(s), bool)
        head[0] = True  # only at the document's own beginning does it reach the piece
        label = _labels(s, head)
        top = (label > np.concatenate(([-1], label[:-1]))) & (label >= np.concatenate((label[1:], [-1])))
        at = np.flatnonzero(top[low - first : high - first]) + low
        starts.append(at[(at > 1) & (at < m - 1)])
    at = np.concatenate(starts)
    ends = np.append(at[1:], m)
    out = []
    for k in range(0, len(at), PIECE_BYTES // 4):
        a, b = at[k : k + PIECE_BYTES // 4], ends[k : k + PIECE_BYTES // 4]
        out.append(segment_hashes(merged(int(a[0]), int(b[-1])), a - a[0], b - a[0]))
    return np.concatenate(out)


def parse_round(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one round and the document of each.

    Runs of one symbol become one named by symbol and length. Deterministic coin tossing then labels each symbol by
    the lowest bit in which it differs from the one before it, and again on the labels, until labels are below six;
    a phrase begins at each local maximum. So where a phrase begins depends on a few symbols to either side, and
    equal substrings have equal phrases but near their ends.
    """
    if not len(symbols):
        return symbols, doc
    new = np.concatenate(([True], (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])))
    at = np.flatnonzero(new)
    length = np.diff(np.concatenate((at, [len(symbols)])))
    s, d = symbols[at], doc[at]
    long = length > 1
    if long.any():
        with np.errstate(over="ignore"):
            s[long] = mix64(s[long] ^ mix64(length[long].astype(np.uint64)))
    head = np.concatenate(([True], d[1:] != d[:-1]))
    label = _labels(s, head)
    prev, after = np.concatenate(([-1], label[:-1])), np.concatenate((label[1:], [-1]))
    last = np.concatenate((head[1:], [True]))
    top = (label > prev) & (label >= after) & ~last
    # The symbol after a document's head begins no phrase, so that none is of one symbol there.
    top[1:] &= ~head[:-1]
    starts = np.flatnonzero(top | head)
    ends = np.concatenate((starts[1:], [len(s)]))
    return segment_hashes(s, starts, ends), d[starts]


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text all 64-bit phrase names of the last two rounds, sorted; none for an empty text."""
    out: list[np.ndarray] = []
    block: list[bytes] = []

    def flush() -> None:
        if not block:
            return
        sizes = np.array([len(t) for t in block])
        doc = np.repeat(np.arange(len(block)), sizes)
        symbols = mix64(np.frombuffer(b"".join(block), np.uint8).astype(np.uint64))
        found = []
        for k in range(ROUNDS):
            symbols, doc = parse_round(symbols, doc)
            if k >= ROUNDS - 2:
                found.append((mix64(symbols + np.uint64(k)), np.searchsorted(doc, np.arange(len(block) + 1))))
        for i in range(len(block)):
            out.append(np.unique(np.concatenate([names[cuts[i] : cuts[i + 1]] for names, cuts in found])))
        block.clear()

    size = 0
    for t in texts:
        if len(t) > PIECE_BYTES:
            flush()
            size = 0
            symbols, found = parse_long(np.frombuffer(t, np.uint8), lambda x: mix64(x.astype(np.uint64))), []
            for k in range(ROUNDS):
                symbols = parse_long(symbols) if k else symbols
                if k >= ROUNDS - 2:
                    found.append(mix64(symbols + np.uint64(k)))
            out.append(np.unique(np.concatenate(found)))
            continue
        if size + len(t) > PIECE_BYTES // 2 and block:
            flush()
            size = 0
        block.append(t)
        size += len(t)
    flush()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of phrases that two texts have in common (Dice), from all their names; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return 2 * len(np.intersect1d(a, b, True)) / (len(a) + len(b))


def encode(names: np.ndarray) -> str:
    """The compact string: the upper halves of the KEPT smallest names."""
    return np.unique(names[: 2 * KEPT] >> np.uint64(32))[:KEPT].astype(">u4").tobytes().hex()


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_ROWS = "part int, edge int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_SCHEMA = pa.schema(
    [("part", pa.int32()), ("edge", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
)


def _measured(rows: list[tuple[int | None, str]], following: list[str], part: int | None) -> pa.RecordBatch:
    """Result rows of documents and the texts that follow them."""
    edited = [edit(t, f).encode() for (_, t), f in zip(rows, following, strict=True)]
    own = fingerprints([t.encode() for _, t in rows] + [f.encode() for f in following[-1:]])
    after = fingerprints(edited)
    # Where the text that follows is the next row's, its fingerprint is at hand.
    values = []
    for i, (doc_id, t) in enumerate(rows):
        near_next = likeness(own[i], own[i + 1])
        values.append((part, 0, doc_id, len(t), hashlib.sha256(edited[i]).hexdigest(), encode(own[i]), encode(after[i]), likeness(own[i], after[i]), near_next, None))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measures the sorted rows of a task against their followers; its first row and last row also go out as they are."""
    part = TaskContext.get().partitionId()
    edges: list[tuple[int, int | None, str]] = []
    rows: list[tuple[int | None, str]] = []
    size = 0
    last = None
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                if last is None:
                    edges.append((1, doc_id, text))
                last = (doc_id, text)
                if size > PIECE_BYTES // 4 and rows:
                    yield _measured(rows, [t for _, t in rows[1:]] + [text], part)
                    rows, size = [], 0
                rows.append(last)
                size += len(text)
    if last is None:
        return
    if len(rows) > 1:
        yield _measured(rows[:-1], [t for _, t in rows[1:]], part)
    edges.append((2, *last))
    values = [(part, kind, doc_id, len(text), None, None, None, None, None, text) for kind, doc_id, text in edges]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield _measured([(doc_id, text)], [following], None)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    near_edited and near_next are shares of all phrases; the two strings keep the KEPT smallest names each.
    The edited text ends with the beginning of the next document by descending doc_id, after the last of the first.
    Rows are dealt by ranges of doc_id, so a text is shuffled once and its follower mostly lies in the same task;
    for the last row of each task a small join brings the first row of the next. Null texts are empty, null ids come
    last, rows that share an id follow each other by a hash of their text. A text's work takes memory in proportion
    to its length, some 15 bytes a character. A table of one row follows itself; an empty one gives no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows without an id, or of one id, are many ranges too, and so are equal ones, whose order is all the same.
    keyed = texts.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("row")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash", "row")
    at = new_folder(spark, "fingerprints")
    dealt.mapInArrow(_walk, _ROWS).write.option("compression", "zstd").parquet(at)
    rows = spark.read.schema(_ROWS).parquet(at)
    result = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    heads = rows.where("edge = 1").select(F.col("part").alias("head_part"), F.col("text").alias("following"))
    # One number per task: which task's first row follows its last.
    order = Window.orderBy("part")
    parts = rows.where("edge = 1").select("part").withColumns({"after": F.lead("part").over(order), "first": F.min("part").over(order)})
    tails = rows.where("edge = 2").select("part", "doc_id", "text").join(parts.select("part", F.coalesce("after", "first").alias("after")), "part")
    closed = tails.join(heads, F.col("after") == F.col("head_part")).select("doc_id", "text", "following").mapInArrow(_close, _ROWS)
    return rows.where("edge = 0").select(*result).union(closed.select(*result))
