"""Toxicity classifier with a counterfactual penalty: swapping identity terms must not change scores."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import FIT_BYTES, held_out, labelled_sample

#: Labelled rows that are fitted on, at most; FIT_BYTES and TEXT_BYTES bound their texts.
SAMPLE_ROWS = 10_000
THRESHOLD = 0.5
#: Features that the model keeps, at most, besides those of identity terms.
FEATURES = 3000
#: Leading letters that make features of a word besides the whole word.
STEMS = (4, 5, 6)
#: Weight of the counterfactual penalty against the mean log loss.
PENALTY = 5.0
#: Words whose features a task remembers.
REMEMBERED = 1_000_000

# Identity terms by language; terms of one row are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos"),
)

_EDGES = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "«»„“”‘’…–—¡¿"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> set[str]:
    """The distinct words of a text in lower case, without marks around them."""
    return {w.strip(_EDGES) for w in set(text.lower().split())} - {""}


def features_of(word: str) -> list[str]:
    """A word's features: itself and its stems."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def document_features(text: str) -> set[str]:
    return {f for w in words_of(text) for f in features_of(w)}


def swaps(text: str, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[tuple[str, str]]:
    """The sentences of a text that hold identity terms, each beside itself with those terms swapped within their row."""
    following = {t: row[(i + 1) % len(row)] for row in terms for i, t in enumerate(row)}
    out = []
    for sentence in _SENTENCE.split(text):
        parts = re.split(r"(\w+)", sentence)
        swapped = [following.get(p.lower(), p) for p in parts]
        if swapped != parts:
            out.append((sentence, "".join(swapped)))
    return out


@dataclass
class Model:
    """Weights of features; a document's score is the sigmoid of its bias and the weights of its distinct features."""

    weights: dict[str, float]
    bias: float
    remembered: dict[str, tuple] = field(default_factory=dict, repr=False)

    def logit(self, text: str) -> float:
        found: set[tuple[str, float]] = set()
        known, weights = self.remembered, self.weights
        for w in set(text.lower().split()):
            hits = known.get(w)
            if hits is None:
                hits = tuple((f, weights[f]) for f in features_of(w.strip(_EDGES)) if f in weights)
                if len(known) < REMEMBERED:
                    known[w] = hits
            if hits:
                found.update(hits)
        return self.bias + sum(x for _, x in sorted(found))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))


def fit(texts: list[str], labels: np.ndarray, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, steps: int = 300) -> Model:
    """Logistic regression whose loss adds PENALTY times the mean squared change of log odds under swaps.

    Features are those that tell the labels apart best in the sample, and those of identity terms. The log loss
    weighs both labels alike. Without rows of both labels the score is the smoothed share of label 1.
    """
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(np.unique(labels)) < 2:
        return Model({}, float(np.log(share / (1 - share))))
    toxic: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    for t, y in zip(texts, labels, strict=True):
        if y:
            toxic.update(document_features(t))
    for t, y in zip(texts, labels, strict=True):
        if not y:  # only features of toxic rows can tell, and only these are held
            clean.update(f for f in document_features(t) if f in toxic)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    # Signed square root of the G statistic, which ranks rare and common features on one scale.
    tell: dict[str, float] = {}
    for f, a in toxic.items():
        b = clean[f]
        if a + b < 3:
            continue
        p, q, r = a / n1, b / n0, (a + b) / len(labels)
        g = a * np.log(p / r) + (b * np.log(q / r) if b else 0.0)
        tell[f] = float(g) if p > q else 0.0
    names = sorted(tell, key=lambda f: (-tell[f], f))[:FEATURES]
    identity = sorted({t for row in terms for t in row})
    chosen = list(dict.fromkeys([n for n in names if tell[n] > 3.0] + identity))
    column = {f: i for i, f in enumerate(chosen)}

    def matrix(rows: Iterable[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        at, own = array("q"), array("q")
        for i, fs in enumerate(rows):
            hits = [column[f] for f in fs if f in column]
            own.extend(hits)
            at.extend([i] * len(hits))
        return np.array(at, np.int64), np.array(own, np.int64)

    r, c = matrix(document_features(t) for t in texts)
    before, after = [], []
    for t in texts:
        for own, swapped in swaps(t, terms):
            before.append(document_features(own))
            after.append(document_features(swapped))
    pr, pc = matrix(before)
    qr, qc = matrix(after)
    balance = np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    w, bias = np.zeros(len(chosen)), -1.0
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        logit = bias + np.bincount(r, w[c], minlength=len(labels))
        miss = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * balance
        grad = np.concatenate((np.bincount(c, miss[r], minlength=len(chosen)) + 1e-4 * w, [miss.sum()]))
        if before:
            apart = np.bincount(pr, w[pc], minlength=len(before)) - np.bincount(qr, w[qc], minlength=len(before))
            change = 2 * PENALTY * apart / len(before)
            grad[:-1] += np.bincount(pc, change[pr], minlength=len(chosen)) - np.bincount(qc, change[qr], minlength=len(chosen))
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({f: float(w[i]) for f, i in column.items() if w[i]}, float(bias))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, fit_bytes: int = FIT_BYTES) -> Model:
    sample = labelled_sample(docs, labels, "toxic", rows, fit_bytes)
    return fit([t.decode("utf-8", "replace") for t, _ in sample], np.array([y for _, y in sample], float), terms)


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (score >= THRESHOLD).

    The model is fitted on at most `rows` labelled rows and `fit_bytes` bytes of texts outside the held-out fold (see labelled_sample); rows with null labels or ids are
    not learned from. Scoring is one pass over whole texts without a shuffle; a task remembers the features of a
    bounded number of words. Null and empty texts score as texts without features; repeated rows score alike; an
    empty table gives an empty result; columns other than doc_id and text are not read.
    """
    model = train(docs, labels, rows, terms, fit_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                scores = [model.score(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
