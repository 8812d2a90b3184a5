"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logweave.llm.common import FIT_BYTES, PIECE_BYTES, free_name, held_out, labelled_sample, map_batches, mix64, pieces, segment_hashes, word_bounds

#: Labelled rows that are fitted on, at most; FIT_BYTES and TEXT_BYTES bound their texts.
SAMPLE_ROWS = 4000
#: Score from which a document counts as good.
THRESHOLD = 0.3
#: Vectors of words and of word shapes; names beyond these share one by hash.
WORD_SLOTS, SHAPE_SLOTS = 1 << 14, 1 << 12
DIMENSIONS = 32
#: Non-zero entries of an index vector.
SPARSE = 4
HIDDEN = 24
#: Words whose vectors are gathered at once.
GATHERED = 1 << 15

_KIND = np.full(256, ord("a"), np.uint8)
_KIND[0x21:0x7F] = np.arange(0x21, 0x7F)
_KIND[ord("0") : ord("9") + 1] = ord("0")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("a") : ord("z") + 1] = ord("a")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def slots(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of a byte buffer: where they begin, the slot of the word and the slot of its shape.

    A shape is the word's kinds of bytes (capital, other letter, digit, each mark) with runs as one.
    """
    starts, ends = word_bounds(buf)
    words = segment_hashes(_LOWER[buf], starts, ends) % np.uint64(WORD_SLOTS)
    kind = _KIND[buf]
    keep = np.concatenate(([True], kind[1:] != kind[:-1])) if len(buf) else np.zeros(0, bool)
    keep[starts] = True
    before = np.concatenate(([0], np.cumsum(keep)))
    shapes = segment_hashes(kind[keep], before[starts], before[ends]) % np.uint64(SHAPE_SLOTS)
    return starts, words.astype(np.int64), shapes.astype(np.int64) + WORD_SLOTS


def index_vectors() -> np.ndarray:
    """A sparse random vector of +1 and -1 for each slot, the same in every run."""
    slot = np.arange(WORD_SLOTS + SHAPE_SLOTS, dtype=np.uint64)
    out = np.zeros((len(slot), DIMENSIONS), np.float32)
    for k in range(SPARSE):
        h = mix64(slot * np.uint64(SPARSE) + np.uint64(k + 1))
        out[np.arange(len(slot)), (h % np.uint64(DIMENSIONS)).astype(np.int64)] += np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32)
    return out / np.sqrt(SPARSE).astype(np.float32)


def context_vectors(texts: list[bytes], index: np.ndarray) -> np.ndarray:
    """Index vectors plus the mean index vector of the shapes and words beside each slot in the texts."""
    total = np.zeros_like(index)
    count = np.zeros(len(index), np.float32)
    for t in texts:
        for buf in pieces(t):
            _, w, s = slots(buf)
            for a, b in ((w[1:], s[:-1]), (w[:-1], s[1:]), (s[1:], s[:-1]), (s[:-1], s[1:])):
                np.add.at(total, a, index[b])
                np.add.at(count, a, 1)
    return index + 0.5 * total / np.maximum(count, 1)[:, None]


#: Of a document: pooled word and shape vectors, then how the words repeat and how many there are.
WIDTH = 2 * DIMENSIONS + 5


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of WIDTH for each text; the memory is bounded whatever the texts' lengths."""
    sums = np.zeros((len(texts), WIDTH))
    block: list[int] = []
    size = 0

    def take(buf: np.ndarray, owners: np.ndarray, cuts: np.ndarray) -> None:
        starts, w, s = slots(buf)
        if not len(starts):
            return
        owner = np.searchsorted(cuts, starts, side="right")
        for at in range(0, len(w), GATHERED):
            part = slice(at, at + GATHERED)
            own, first = np.unique(owner[part], return_index=True)
            sums[owners[own], :DIMENSIONS] += np.add.reduceat(vectors[w[part]], first, axis=0)
            sums[owners[own], DIMENSIONS : 2 * DIMENSIONS] += np.add.reduceat(vectors[s[part]], first, axis=0)
        same = np.concatenate(([False], (w[1:] == w[:-1]) & (owner[1:] == owner[:-1])))
        own, first, n = np.unique(owner, return_index=True, return_counts=True)
        sums[owners[own], -5] += np.add.reduceat(same.astype(float), first)
        names = np.unique(owner.astype(np.int64) * (WORD_SLOTS * 2) + w)
        distinct_of, distinct = np.unique(names // (WORD_SLOTS * 2), return_counts=True)
        sums[owners[distinct_of], -4] += distinct
        sums[owners[own], -3] += n

    def flush() -> None:
        nonlocal block, size
        if block:
            take(np.frombuffer(b"\n".join(texts[i] for i in block), np.uint8), np.array(block), np.cumsum([len(texts[i]) + 1 for i in block])[:-1])
        block, size = [], 0

    for i, t in enumerate(texts):
        if len(t) > PIECE_BYTES // 4:
            for buf in pieces(t):
                take(buf, np.array([i]), np.zeros(0, np.int64))
            continue
        if size + len(t) > PIECE_BYTES // 4:
            flush()
        block.append(i)
        size += len(t) + 1
    flush()
    n = np.maximum(sums[:, -3], 1)
    out = sums / n[:, None]
    out[:, -3] = np.log1p(sums[:, -3]) / 10
    out[:, -2] = np.linalg.norm(out[:, :DIMENSIONS], axis=1)
    out[:, -1] = np.linalg.norm(out[:, DIMENSIONS : 2 * DIMENSIONS], axis=1)
    return out


@dataclass
class Network:
    """Two layers over standardised features; scores are divided by the temperature before the sigmoid."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    def logits(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        return np.tanh(x @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows) / self.temperature, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 400, seed: int = 7) -> Network:
    """Trains by Adam on four fifths of the rows and sets the temperature on the rest.

    Without rows of both labels there is nothing to learn; the score is then the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    vectors = context_vectors(texts, index_vectors())
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(share / (1 - share)))
    net = Network(vectors, np.zeros(WIDTH), np.ones(WIDTH), rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior)
    if len(np.unique(labels)) < 2:
        return net
    rows = pooled(texts, vectors)
    net.mean, net.scale = rows.mean(0), rows.std(0) + 1e-6
    x, y = np.clip((rows - net.mean) / net.scale, -6, 6), labels.astype(float)
    order = rng.permutation(len(y))
    check, train = order[: len(y) // 5], order[len(y) // 5 :]
    net.out = rng.normal(0, 0.1, HIDDEN)
    values = [net.hidden, net.hidden_bias, net.out, np.array(net.out_bias)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        batch = rng.choice(train, min(len(train), 512), replace=False)
        xb, yb = x[batch], y[batch]
        act = np.tanh(xb @ values[0] + values[1])
        miss = (1 / (1 + np.exp(-(act @ values[2] + values[3]))) - yb) / len(yb)
        back = np.outer(miss, values[2]) * (1 - act**2)
        grads = [xb.T @ back + 1e-4 * values[0], back.sum(0), act.T @ miss + 1e-4 * values[2], np.array(miss.sum())]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            values[k] = values[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.hidden, net.hidden_bias, net.out, net.out_bias = values[0], values[1], values[2], float(values[3])
    if len(check):
        logits, truth = net.logits(rows[check]), y[check]

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, logits / t) - truth * logits / t))

        net.temperature = min(np.geomspace(0.5, 8, 33), key=loss)
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fit_bytes: int = FIT_BYTES) -> Network:
    sample = labelled_sample(docs, labels, "quality", rows, fit_bytes)
    return fit([t for t, _ in sample], np.array([y for _, y in sample], float))


def scored(docs: DataFrame, net: Network, name: str) -> DataFrame:
    """docs with a last column of the given name; every row and its whole text is scored, a null text as an empty one."""
    given = docs.columns
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [t or b"" for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(net.scores(pooled(texts, net.vectors)))], names=[*given, name])

    return map_batches(docs.select("*", F.col("text").cast("binary").alias(free_name(docs, "lw_bytes"))), run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (score >= THRESHOLD).

    The network is fitted on at most `rows` labelled rows and `fit_bytes` bytes of texts outside the held-out fold (see labelled_sample); null labels and ids are not
    learned from. Words take a vector by random indexing: a sparse random one plus those of their neighbours in the
    sample; documents pool the vectors of their words and word shapes. Scoring is one pass over the texts without a
    shuffle, in bounded memory. Repeated rows get equal scores, an empty table gives an empty result, without
    labels all scores are 0.5, and columns other than doc_id and text are not read.
    """
    net = train(docs, labels, rows, fit_bytes)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net, "lw_score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lw_score").alias("score"), (F.col("lw_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """docs without those that the classifier rejects; columns unchanged, whatever their names."""
    name = free_name(docs, "lw_score")
    return scored(docs, train(docs, labels, rows, fit_bytes), name).where(F.col(name) >= THRESHOLD).drop(name)
