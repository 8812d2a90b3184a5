"""Statements of a catalogue of any size met with records, by joins on the literal text that tells a statement best."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.literal import Matcher, literals
from logweave.tables import materialise

#: Characters of an anchor: the first if a statement has as much literal text, else the second.
WIDTHS = (12, 6)
#: Statements from which it is learnt which text is rare, and records from which it is learnt which anchors are common.
SAMPLE_STATEMENTS, SAMPLE_RECORDS = 50_000, 100_000
#: An anchor that more of the sampled records hold than this share is common.
COMMON = 0.001
#: Bits of the filter of anchors, at least and at most (64 MB); a fuller filter lets more windows through, which then meet nothing.
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 29
_PIECE_BITS = 32768
#: Characters of bodies that are hashed at a time.
_STEP = 1 << 19
#: Matchers that a task remembers.
_MATCHERS = 20_000

ID = "lw_record"


def _hashes(text: str, width: int) -> np.ndarray:
    """A hash of each window of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(points) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


class _Rarity:
    """How surprising text is, by runs of four characters of sampled statements."""

    def __init__(self, texts: list[str]) -> None:
        self.fours = Counter(t[k : k + 4] for t in texts for k in range(len(t) - 3))
        self.threes: Counter = Counter()
        for run, n in self.fours.items():
            self.threes[run[:3]] += n
        self.total = sum(self.threes.values()) + 1

    def best(self, texts: list[str]) -> str | None:
        """The most surprising window of a statement's literal texts, None if they are too short."""
        longest = max(map(len, texts), default=0)
        width = next((w for w in WIDTHS if w <= longest), None)
        if width is None:
            return None
        found = None
        for t in texts:
            if len(t) < width:
                continue
            sums = [0.0, 0.0, 0.0, 0.0]
            for k in range(len(t) - 3):
                run = t[k : k + 4]
                sums.append(sums[-1] + log((self.threes.get(run[:3], 0) + 1) / (self.fours.get(run, 0) + 0.1)))
            for k in range(len(t) - width + 1):
                rare = sums[k + width] - sums[k + 3] + log(self.total / (self.threes.get(t[k : k + 3], 0) + 1))
                if found is None or rare > found[0]:
                    found = (rare, t[k : k + width])
        return found[1]


def _anchoring(shared: Broadcast, at: int):
    """A pass that adds to each statement the hash of its anchor, null if it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.best(literals(x)) for x in batch.column(at).to_pylist()]
            anchors = np.zeros(len(texts), np.uint64)
            for width in WIDTHS:
                of = [k for k, t in enumerate(texts) if t is not None and len(t) == width]
                if of:
                    anchors[of] = _hashes("".join(texts[k] for k in of), width)[::width]
            column = pa.array(anchors.view(np.int64), mask=np.array([t is None for t in texts], bool))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "anchor"])

    return run


def _meeting(shared: Broadcast):
    """A pass from (ID, body) to (ID, anchor): the windows of bodies that the filter of anchors knows, each once in a piece of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            bodies = [b or "" for b in batch.column(1).to_pylist()]
            ends = np.cumsum([len(b) for b in bodies])
            text = "".join(bodies)
            for begin in range(0, len(text), _STEP):
                rows, keys = [], []
                for width in WIDTHS:
                    hashes = _hashes(text[begin : begin + _STEP + width - 1], width)
                    places = np.arange(len(hashes))
                    for slots in _slots(hashes, len(filled) * 8):
                        slots = slots[places]
                        places = places[((filled[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                    owners = np.searchsorted(ends, places + begin, "right")
                    inside = places + begin + width <= ends[owners]
                    rows.append(owners[inside])
                    keys.append(hashes[places[inside]])
                rows, keys = np.concatenate(rows), np.concatenate(keys)
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order]
                first = np.ones(len(rows), bool)
                first[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[first])), pa.array(keys[first].view(np.int64))], names=[ID, "anchor"])

    return run


def _filter(anchors: DataFrame, n: int) -> Broadcast:
    """The anchors' two bits each in a bitmap of bounded size, made in tasks; the driver receives MOST_BITS / 8 bytes at most."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (8 * n - 1).bit_length()))
    low, high = (x.bitwiseAND(F.lit(bits - 1)) for x in (F.col("anchor"), F.shiftrightunsigned("anchor", 32)))
    slots = anchors.where("anchor is not null").select(F.explode(F.array(low, high)).alias("slot"))
    pieces = slots.select(F.bitmap_bucket_number(F.col("slot") + 1).alias("piece"), F.bitmap_bit_position(F.col("slot") + 1).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for row in pieces.toLocalIterator():
        at = (row.piece - 1) * _PIECE_BITS // 8
        out[at : at + _PIECE_BITS // 8] = np.frombuffer(row.map, np.uint8)[: len(out) - at]
    return anchors.sparkSession.sparkContext.broadcast(out)


def anchored(statements: DataFrame, n: int) -> DataFrame:
    """n statements with `anchor`, written once: the hash of that window of their literal text which a sample of them makes look rarest.

    The sample only decides how many statements a record is compared with in vain.
    """
    step = max(1, n // SAMPLE_STATEMENTS)
    sample = statements.where(F.pmod(F.xxhash64("executable"), F.lit(step)) == 0).limit(2 * SAMPLE_STATEMENTS).select("executable").toArrow()
    shared = statements.sparkSession.sparkContext.broadcast(_Rarity([t for x in sample.column(0).to_pylist() for t in literals(x)]))
    schema = statements.withColumn("anchor", F.lit(None).cast("long")).schema
    return materialise(statements.mapInArrow(_anchoring(shared, statements.columns.index("executable")), schema), "statements")


def hint_allows(hint: Column, known_in: Column) -> Column:
    """Whether a record's file hint leaves a statement."""
    named = F.coalesce(F.array_contains(known_in, F.col("root_ord")), F.lit(False))
    return hint.isNull() | F.when(named, F.col("file_name").eqNullSafe(hint)).otherwise(F.contains("source_path", hint))


def _values(executables: pa.Array, bodies: pa.Array) -> pa.Array:
    known: dict[str, Matcher] = {}
    out = []
    for executable, body in zip(executables.to_pylist(), bodies.to_pylist(), strict=True):
        if (matcher := known.get(executable)) is None:
            if len(known) >= _MATCHERS:
                known.clear()
            matcher = known[executable] = Matcher(executable)
        out.append(matcher.values(body))
    return pa.array(out, pa.list_(pa.string()))


def meet(records: DataFrame, statements: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(ID, stmt, captured) of all fits of records (ID, body, file, known_in) with n statements that an anchor finds, and the other statements.

    Records give the windows of their bodies that may be anchors; these meet the anchors in a join on equal hashes, and
    what meets is matched. Statements with little literal text, and those whose anchors are so common in a sample of the
    records that one key would hold much of the log, are left to the caller.
    """
    found = anchored(statements, n)
    shared = _filter(found, n)
    windows = lambda rows: rows.select(ID, "body").mapInArrow(_meeting(shared), f"{ID} long, anchor long")
    step = max(1, records.count() // SAMPLE_RECORDS)
    sample = records.where(F.pmod(F.xxhash64(ID), F.lit(step)) == 0)
    common = windows(sample).join(found.select("anchor").distinct(), "anchor", "left_semi").groupBy("anchor").count().where(F.col("count") > COMMON * SAMPLE_RECORDS)
    rare = F.col("anchor").isNotNull() & ~F.col("anchor").isin([r.anchor for r in common.collect()])
    columns = [F.col(c) for c in statements.columns if c != "file_name"]
    keyed = found.where(rare).select("anchor", "root_ord", "source_path", "file_name", F.struct(*columns).alias("stmt"))
    pairs = windows(records).join(keyed, "anchor").drop("anchor")
    met = pairs.join(records.select(ID, "body", "file", "known_in"), ID).where(F.col("body").isNotNull() & hint_allows(F.col("file"), F.col("known_in")))
    values = F.arrow_udf(_values, "array<string>").asNondeterministic()  # else the optimizer runs it for the condition and again for the column
    fits = met.select(ID, "stmt", values(F.col("stmt.executable"), F.col("body")).alias("captured")).where("captured is not null")
    return fits, found.where(~rare).drop("anchor")
