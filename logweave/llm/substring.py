"""Passages that repeat across documents, by windows of words gathered at content-defined anchors of a gear rolling hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import PIECE_BYTES, materialise, mix64, segment_hashes, word_bounds

#: Bytes that the rolling hash looks back on.
LOOK_BACK = 16
#: A byte ends a chunk with odds of one in so many.
EVERY = 20
#: No chunk ends where another could have ended fewer bytes before; none has more bytes than MOST.
APART, MOST = 8, 128
#: Words in a row that another document must have too.
RUN_WORDS = 22
#: Words that the hash of an anchor looks back on.
ANCHOR_WORDS = 8
#: Bytes of a window's hash besides the 64 bits of its anchor.
HASH_BYTES = 6
#: Occurrences of anchors that are compared at once; one anchor's are never parted.
SLAB = 200_000
#: An anchor with more occurrences than this, as one document in SAMPLED suggests, is hot and has its windows dealt singly.
HOT_ROWS, SAMPLED = 20_000, 64
#: Most anchors that are treated as hot, the most frequent ones; the list goes to all tasks. Beyond so many, those with
#: fewer occurrences than all of these meet in one task each, as anchors that aren't hot do.
HOT_ANCHORS = 100_000

#: Variants of hot anchors, of some tens of numbers each, that travel to all tasks.
MOST_VARIANTS = 50_000

NO_ID = (1 << 63) - 1

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the LOOK_BACK bytes up to it: h = 2 h + G[byte], in doubling steps."""
    return _rolled(_GEAR[buf], LOOK_BACK)


def _rolled(h: np.ndarray, look_back: int) -> np.ndarray:
    """Gear hashes of symbols whose own numbers are h; look_back is a power of two."""
    step = 1
    while step < look_back:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << h.dtype.type(step)
        h = h + shifted
        step *= 2
    return h


def chunk_ends(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text. Which bytes end a chunk depends on LOOK_BACK + APART bytes alone, but for MOST."""
    ends: list[int] = []
    last, before = 0, -APART
    for at in range(0, len(text), PIECE_BYTES):
        first = max(0, at - LOOK_BACK - MOST)
        stop = min(at + PIECE_BYTES, len(text))
        h = mix64(gear(np.frombuffer(text, np.uint8, stop - first, first)).astype(np.uint64))
        could = np.flatnonzero(h[at - first :] < np.uint64((1 << 64) // EVERY)) + at + 1
        cuts = could[np.diff(could, prepend=before) >= APART]
        before = int(could[-1]) if len(could) else before
        for cut in [*cuts.tolist(), stop]:
            while cut - last > MOST:  # as in runs of one word: the least hash within reach, wherever the run began
                low = last + APART
                last = low + 1 + int(np.argmin(h[low - first : last + MOST - first]))
                ends.append(last)
            if cut < stop or cut in cuts[-1:]:
                ends.append(cut)
                last = cut
    if last < len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


_ANCHORS = "digest long, row long, doc_id long, windows binary, variant long"
_SHARED = "row long, doc_id long, first int, n int, start int, end int, lo long"
#: How the windows of an anchor are packed: this head, then the windows' hashes, then the steps of starts and of ends.
_HEAD = np.dtype([("first", "<i4"), ("start", "<i4"), ("end", "<i4"), ("n", "u1"), ("width", "u1")])


def _anchors(texts: list[bytes], run_words: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For each anchor of the texts: its text's place in the list, its digest and the windows that it gathers.

    A window is `run_words` words in a row. Its anchor is the place in it where the gear hash of ANCHOR_WORDS words is
    least, which its words alone decide, so equal windows have equal anchors. Consecutive windows mostly share one.
    """
    look = 1 << (min(ANCHOR_WORDS, run_words).bit_length() - 1)
    span = run_words - look + 1
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_bounds(buf)
    cuts = np.concatenate(([0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))))
    sizes = np.diff(cuts)
    n = len(starts) - run_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    words = np.concatenate([segment_hashes(buf[a[0] : b[-1]], a - a[0], b - a[0]) for a, b in _groups(starts, ends)])
    with np.errstate(over="ignore"):
        digest = mix64(_rolled(words, look)[look - 1 :])
    # The least of `span` hashes in doubling steps; the first of equal ones.
    least = (digest & ~np.uint64(0xFFFFFFFF)) | np.arange(len(digest), dtype=np.uint64)
    width = 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    text = np.repeat(np.arange(len(texts)), sizes)
    whole = np.flatnonzero(text[:n] == text[run_words - 1 :])
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    anchor = (least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.arange(n)
    hashes = segment_hashes(words, at, at + run_words)[whole].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    # Offsets in code points of the text.
    chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    base = chars[np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]][text[whole]]
    start, end = chars[starts[whole]] - base, chars[ends[whole + run_words - 1]] - base
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[whole[1:]] != text[whole[:-1]])))
    lows = np.flatnonzero(new)
    counts = np.diff(np.concatenate((lows, [len(whole)])))
    steps = np.stack([np.diff(x, prepend=0) for x in (start, end)])
    steps[:, lows] = 0
    most = np.maximum.reduceat(steps.max(0), lows)
    widths = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    heads = np.zeros(len(lows), _HEAD)
    heads["first"], heads["start"], heads["end"] = whole[lows] - cuts[text[whole[lows]]], start[lows], end[lows]
    heads["n"], heads["width"] = counts, widths
    head_bytes, hash_bytes = heads.tobytes(), hashes.tobytes()
    step_bytes = {w: [x.astype(f"<u{w}").tobytes() for x in steps] for w in np.unique(widths).tolist()}
    packed = []
    for k, (low, count, w) in enumerate(zip(lows.tolist(), counts.tolist(), widths.tolist(), strict=True)):
        a, b = step_bytes[w]
        high = low + count
        packed.append(head_bytes[k * _HEAD.itemsize : (k + 1) * _HEAD.itemsize] + hash_bytes[low * HASH_BYTES : high * HASH_BYTES] + a[low * w : high * w] + b[low * w : high * w])
    return text[whole[lows]], digest[anchor[lows]].view(np.int64), packed


def _gather(run_words: int, hot: frozenset[int] = frozenset()):
    """A pass over texts that gives their anchors, each input row known by a key of its own; of hot ones the variant is named by the hashes of its windows."""
    hot_ones = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[bytes, int] = {}

        def key(doc_id: int | None, text: bytes) -> int:
            # By content and not by place, so that a task that runs again gives equal keys in whatever order.
            name = hashlib.blake2b(repr((part, doc_id)).encode() + text, digest_size=8).digest()
            n = seen[name] = seen.get(name, -1) + 1
            return int.from_bytes(hashlib.blake2b(name + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)

        def variants(digest: np.ndarray, packed: list[bytes]) -> list[int | None]:
            out: list[int | None] = [None] * len(packed)
            for k in np.flatnonzero(np.isin(digest, hot_ones)).tolist():
                n = packed[k][_HEAD.fields["n"][1]]
                hashes = packed[k][_HEAD.itemsize : _HEAD.itemsize + n * HASH_BYTES]
                out[k] = int.from_bytes(hashlib.blake2b(hashes, digest_size=8).digest(), "little", signed=True)
            return out

        def flush(rows: list[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
            text, digest, packed = _anchors([t for _, t in rows], run_words)
            if packed:
                keys = pa.array([key(*r) for r in rows], pa.int64())
                ids = pa.array([d for d, _ in rows], pa.int64())
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(digest), keys.take(at), ids.take(at), pa.array(packed, pa.binary()), pa.array(variants(digest, packed), pa.int64())], names=["digest", "row", "doc_id", "windows", "variant"])

        for batch in batches:
            rows: list[tuple[int | None, bytes]] = []
            size = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if (text := text.as_py()) is None:
                    continue
                if rows and size + len(text) > PIECE_BYTES:
                    yield from flush(rows)
                    rows, size = [], 0
                rows.append((doc_id.as_py(), text))
                size += len(text)
            yield from flush(rows)

    return run


def _groups(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words in groups of about PIECE_BYTES, so that hashing takes bounded memory."""
    cuts = np.flatnonzero(np.diff(starts // PIECE_BYTES)) + 1
    yield from zip(np.split(starts, cuts), np.split(ends, cuts), strict=True)


def _spread(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number from low to low + count: whose it is, and the number."""
    owner = np.repeat(np.arange(len(low)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]


class _Opened:
    """The windows that packed occurrences hold, in order: whose each is and its place there."""

    def __init__(self, windows: pa.Array | pa.ChunkedArray) -> None:
        windows = windows.chunk(0) if isinstance(windows, pa.ChunkedArray) else windows
        _, offsets, data = windows.buffers()
        at = np.frombuffer(offsets, np.int32)[windows.offset : windows.offset + len(windows) + 1][:-1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8)
        self.heads = self.data[at[:, None] + np.arange(_HEAD.itemsize)].reshape(-1).view(_HEAD)
        self.n, self.width = self.heads["n"].astype(np.int64), self.heads["width"].astype(np.int64)
        self.owner, self.j = _spread(np.zeros(len(self.n), np.int64), self.n)
        self.body = at + _HEAD.itemsize

    def hashes(self) -> np.ndarray:
        where = self.body[self.owner] + self.j * HASH_BYTES
        out = np.zeros((len(self.owner), 8), np.uint8)
        for b in range(HASH_BYTES):
            out[:, b] = self.data[where + b]
        return out.reshape(-1).view("<u8")

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, which are sums of steps within an occurrence."""
        owner, w = self.owner, self.width[self.owner]
        step = np.zeros((2, len(owner)), np.int64)
        for side in range(2):
            place = self.body[owner] + self.n[owner] * (HASH_BYTES + side * w) + self.j * w
            for b in range(4):
                held = w > b
                step[side][held] += self.data[place[held] + b].astype(np.int64) << (8 * b)
        total = np.cumsum(step, axis=1)
        edge = total[:, np.cumsum(self.n) - self.n][:, owner]
        return self.heads["start"][owner] + total[0] - edge[0], self.heads["end"][owner] + total[1] - edge[1]


_WINDOWS = "digest long, variant long, a long, z long, lo long, hash long, j int"


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the variants (digest, variant, a, z, lo, windows)."""
    for batch in batches:
        for low in range(0, batch.num_rows, 5000):
            part = batch.slice(low, 5000)
            opened = _Opened(part.column(5))
            of = pa.array(opened.owner)
            columns = [*(part.column(k).take(of) for k in range(5)), pa.array(opened.hashes().view(np.int64)), pa.array(opened.j.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "variant", "a", "z", "lo", "hash", "j"])


def _looked_up(known: Broadcast):
    """_placed for occurrences (row, doc_id, windows, digest, variant), with what their variants share at hand."""
    kind = pa.list_(pa.struct([("j", pa.int32()), ("least", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shared = [known.value.get(key) for key in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
                lists = pa.array([s and [{"j": j, "least": x} for j, x in s] for s in shared], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["row", "doc_id", "windows", "shared"]).filter(lists.is_valid())

        yield from _placed(found())

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of consecutive shared windows of rows, from occurrences (row, doc_id, windows, shared); `shared` has places and smallest ids."""
    for batch in batches:
        for low in range(0, batch.num_rows, 5000):
            part = batch.slice(low, 5000)
            opened = _Opened(part.column(2))
            start, end = opened.edges()
            begins = np.cumsum(opened.n) - opened.n
            lists = part.column(3)
            of = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
            found = lists.flatten()
            j, least = found.field(0).to_numpy().astype(np.int64), found.field(1).to_numpy()
            # By number in the row, so that stretches go on from one occurrence to the next.
            at, first, row = begins[of] + j, opened.heads["first"][of] + j, part.column(0).to_numpy()[of]
            order = np.lexsort((first, row))
            of, at, first, row, least = of[order], at[order], first[order], row[order], least[order]
            low_at = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), (np.diff(first) != 1) | (row[1:] != row[:-1]))))
            n = np.diff(np.append(low_at, len(of)))
            whose = pa.array(of[low_at])
            columns = [part.column(0).take(whose), part.column(1).take(whose), *(pa.array(x.astype(np.int32)) for x in (first[low_at], n, start[at[low_at]], end[at[low_at + n - 1]])), pa.array(np.minimum.reduceat(least, low_at) if len(low_at) else least)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "first", "n", "start", "end", "lo"])


def _hot_shared(anchors: DataFrame) -> DataFrame:
    """Shared windows of hot anchors, whose occurrences never meet in one task.

    Occurrences whose windows are the same words, as in copies, are one variant, known by a count that is combined
    before the shuffle. Variants are compared window by window. What they share goes to the pass over the occurrences
    if there are at most MOST_VARIANTS of them, so no occurrence is shuffled, and is joined with them otherwise.
    """
    hot = anchors.where("variant is not null")
    doc = F.coalesce("doc_id", F.lit(NO_ID))
    variants = hot.groupBy("digest", "variant").agg(F.min("row").alias("a"), F.max("row").alias("z"), F.min(doc).alias("lo"), F.first("windows").alias("windows"))
    windows = materialise(materialise(variants, "hot-variants").mapInArrow(_unpack, _WINDOWS), "hot-windows")
    several = windows.groupBy("digest", "hash").agg(F.min("a").alias("first_row"), F.max("z").alias("last_row"), F.min("lo").alias("least")).where("first_row < last_row")
    met = windows.join(several.select("digest", "hash", "least"), ["digest", "hash"])
    # A variant has no more windows than an anchor gathers, some tens.
    shared = met.groupBy("digest", "variant").agg(F.collect_list(F.struct("j", "least")).alias("shared"))
    shared = materialise(shared, "hot-shared")
    if shared.limit(MOST_VARIANTS + 1).count() <= MOST_VARIANTS:
        known = {(r.digest, r.variant): [tuple(x) for x in r.shared] for r in shared.collect()}
        known = hot.sparkSession.sparkContext.broadcast(known)
        return hot.select("row", "doc_id", "windows", "digest", "variant").mapInArrow(_looked_up(known), _SHARED)
    return hot.join(shared, ["digest", "variant"]).select("row", "doc_id", "windows", "shared").mapInArrow(_placed, _SHARED)


def _compare(table: pa.Table) -> pa.RecordBatch | None:
    """Stretches of consecutive windows that another row has, from all occurrences of some anchors sorted by digest."""
    digest, row = table.column(0).to_numpy(), table.column(1).to_numpy()
    new = np.flatnonzero(np.concatenate(([True], digest[1:] != digest[:-1])))
    several = np.minimum.reduceat(row, new) < np.maximum.reduceat(row, new)
    several = np.repeat(several, np.diff(np.concatenate((new, [len(row)]))))
    if not several.any():
        return None
    table = table.filter(pa.array(several))
    digest, row = table.column(0).to_numpy(), table.column(1).to_numpy()
    ids = table.column(2).combine_chunks()
    doc_id = ids.fill_null(NO_ID).to_numpy()
    opened = _Opened(table.column(3).combine_chunks())
    owner, j, h = opened.owner, opened.j, opened.hashes()
    group = np.cumsum(np.concatenate(([0], digest[1:] != digest[:-1])))[owner]
    order = np.lexsort((h, group))
    first = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (group[order][1:] != group[order][:-1]))))
    sizes = np.diff(np.concatenate((first, [len(order)])))
    rows = row[owner][order]
    shared, lo = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    shared[order] = np.repeat(np.minimum.reduceat(rows, first) < np.maximum.reduceat(rows, first), sizes)
    lo[order] = np.repeat(np.minimum.reduceat(doc_id[owner][order], first), sizes)
    hit = np.flatnonzero(shared)
    if not len(hit):
        return None
    start, end = opened.edges()
    low = np.flatnonzero(np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0))))
    high = np.concatenate((low[1:], [len(hit)])) - 1
    a, z = hit[low], hit[high]
    of = owner[a]
    columns = [pa.array(row[of]), ids.take(pa.array(of)), pa.array((opened.heads["first"][of] + j[a]).astype(np.int32)), pa.array((z - a + 1).astype(np.int32)), pa.array(start[a].astype(np.int32)), pa.array(end[z].astype(np.int32)), pa.array(np.minimum.reduceat(lo[hit], low))]
    return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "first", "n", "start", "end", "lo"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the anchors of a task, sorted by digest, in slabs that keep each digest together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        digest = batch.column(0).to_numpy()
        # Up to here digests are complete, when this batch begins or holds another than its last.
        cut = int(np.searchsorted(digest, digest[-1])) if len(digest) else 0
        if size + cut >= SLAB and (cut or held[-1].column(0)[-1].as_py() != digest[0]):
            if (out := _compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))) is not None:
                yield out
            held, size, batch = [], 0, batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held and (out := _compare(pa.Table.from_batches(held))) is not None:
        yield out


def hot_anchors(texts: DataFrame, run_words: int) -> frozenset[int]:
    """Digests of the anchors that have more than HOT_ROWS occurrences by a sample of rows; HOT_ANCHORS at most.

    Rows are drawn whatever they hold, so of many copies of a text some share is in the sample.
    """
    some = texts.where(F.rand(SAMPLED) * SAMPLED < 1).mapInArrow(_gather(run_words), _ANCHORS)
    counts = some.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS / SAMPLED)
    return frozenset(r.digest for r in counts.orderBy(F.desc("n"), "digest").limit(HOT_ANCHORS).collect())


def repeated_passages(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id) of each passage that another document has too.

    A passage is a longest stretch of words in which every `run_words` words in a row occur in another document as
    well; words are what white space separates. start and end are code points into the whole text, from the first
    word's beginning to the last one's end; first_doc_id is the smallest id of a document that has `run_words` words
    of the passage, which may be the document itself. No passage is missed: every window of `run_words` words is
    compared, by a hash of 48 bits besides its anchor's 64.

    Windows travel packed by their anchor, the place in them with the least gear hash of ANCHOR_WORDS words, which
    equal windows share. All occurrences of an anchor meet in one task, which holds
    them at once: about a kilobyte for each while it compares them. Anchors that a sample shows to be hot, as in a
    passage that a third of all documents hold, don't meet so: see _hot_shared. The sample decides on the way, not on
    the result.

    Every input row is a document of its own, known by a key of its content and its count in its partition, so rows
    without an id, rows that share an id and repeated rows are told apart; null ids come last in first_doc_id. Null
    and empty texts and texts of fewer words have no passages; empty tables give no rows; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    hot = hot_anchors(texts, run_words)
    anchors = texts.mapInArrow(_gather(run_words, hot), _ANCHORS)
    usual = anchors.where("variant is null") if hot else anchors
    shared = usual.drop("variant").repartition("digest").sortWithinPartitions("digest").mapInArrow(_meet, _SHARED)
    if hot:
        shared = shared.union(_hot_shared(anchors))
    # Stretches of windows of one row that follow each other have one difference of last window and windows so far.
    order = Window.partitionBy("row").orderBy("first")
    runs = shared.withColumn("run", F.col("first") + F.col("n") - F.sum("n").over(order))
    passages = runs.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.sum("n") + run_words - 1).alias("n_words"), F.min("lo").alias("first_doc_id")
    )
    return passages.select("doc_id", "start", "end", "n_words", F.nullif("first_doc_id", F.lit(NO_ID)).alias("first_doc_id"))
