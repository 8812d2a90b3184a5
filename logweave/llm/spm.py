"""SentencePiece encoding by a streaming Viterbi search over a model file's pieces and scores, and decoding."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweave.llm.common import free_name, map_batches, quoted

#: Where the vocabulary file lies on the driver; its bytes go to the tasks with their code.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 of a text while it is encoded; no valid text holds it.
LITERAL = "\ud800"
#: Characters that the search takes in before it looks for a boundary to commit to.
STEP = 256
#: Segments up to KEPT characters are remembered with their ids in two generations of so many each.
KEPT, REMEMBERED = 16, 150_000
#: How far an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Types of pieces in a model file.
_NORMAL, _USER, _BYTE = 1, 4, 6
_NONE = float("-inf")


class Model:
    """Pieces and scores of a model file, with the segments that this process has encoded."""

    def __init__(self, proto: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER)}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte pieces, so it can't encode every text")
        self.longest = max(map(len, self.pieces))
        #: Gives all pieces that end at each character, the longest first.
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.singles = frozenset(p for p in self.pieces if len(p) == 1)
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.surface = [p.piece.replace(SPACE, " ").encode() if p.type in (_NORMAL, _USER) else bytes([int(p.piece[3:-1], 16)]) if p.type == _BYTE else b"" for p in model.pieces]
        # Where every path has a boundary whatever the text: before a space that follows another character, unless a
        # piece goes across, and around line feeds, unless a piece holds one.
        across = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        feed = "" if any("\n" in p for p in self.pieces) else "\n"
        self.segment = None if across else re.compile(f"{SPACE}+[^{SPACE}{feed}]*|[^{SPACE}{feed}]+" + (f"|{feed}" if feed else ""))
        #: What follows of a segment that has other characters than spaces, and of one that hasn't.
        self.rest, self.rest_of_spaces = re.compile(f"[^{SPACE}{feed}]*"), re.compile(f"{SPACE}*[^{SPACE}{feed}]*")
        self.known = _Known(self)

    def encode(self, text: str) -> list[int]:
        """Ids of the best segmentation of the whole text; an empty text has none."""
        return self.packed(text).tolist()

    def packed(self, text: str) -> np.ndarray:
        """`encode` as an array of 32-bit integers."""
        return np.frombuffer(b"".join(self.commits(text)), np.int32)

    def commits(self, text: str) -> Iterator[bytes]:
        """Ids of the text, as bytes of 32-bit integers, as they become certain, in order, while it is taken in STEP characters at a time.

        Where every path has a boundary whatever follows, they all converge, and what lies before it is committed:
        looked up if it was searched before, else searched. A segment that outgrows a step is searched as it comes and
        committed wherever its surviving paths meet, so what is held besides the ids is a step and the longest piece.
        """
        steps = (text[i : i + STEP].replace(SPACE, LITERAL).replace(" ", SPACE) for i in range(0, len(text), STEP))
        first = SPACE if self.dummy_prefix and text else ""
        if self.segment is None:
            yield from (array("i", ids).tobytes() for ids in self.stream(chain([first], steps)))
            return
        left = [first]

        def coming() -> Iterator[str]:
            """The outgrown segment, step by step; what comes after it is left."""
            going_on = self.rest if left[0].strip(SPACE) else self.rest_of_spaces
            yield left.pop()
            for step in steps:
                part = going_on.match(step)[0]
                going_on = self.rest if part.strip(SPACE) else going_on
                if part:
                    yield part
                if len(part) < len(step):
                    left.append(step[len(part) :])
                    return
            left.append("")

        for step in steps:
            *whole, left[0] = self.segment.findall(left[0] + step)
            yield from map(self.known.__getitem__, whole)
            if len(left[0]) >= STEP:
                yield from (array("i", ids).tobytes() for ids in self.stream(coming()))
        if left[0]:
            yield from map(self.known.__getitem__, self.segment.findall(left[0]))

    def stream(self, parts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the text that the parts make up, as far as they are certain, in order.

        Best scores are held for the last `longest` positions only. All paths that can still win go through one of
        these; when their backpointers meet in one boundary, the ids up to it are given out and forgotten.
        """
        longest = self.longest
        text = ""
        best, back, own = [0.0], [0], [None]  # of each position in the window: score, where its last piece begins, its id
        for part in parts:
            old = len(text)
            text += part
            self._extend(text, old, best, back, own)
            if len(text) > longest and (cut := self._settled(back)):
                yield self._path(text, back, own, cut)
                text, offset = text[cut:], best[cut]
                best, back, own = [x - offset for x in best[cut:]], [at - cut for at in back[cut:]], own[cut:]
        if text:
            yield self._path(text, back, own, len(text))

    def search(self, text: str) -> list[int]:
        """Ids of a text that is taken at once."""
        best, back, own = [0.0], [0], [None]
        self._extend(text, 0, best, back, own)
        return self._path(text, back, own, len(text))

    def _extend(self, text: str, old: int, best: list[float], back: list[int], own: list[int | None]) -> None:
        """Adds the positions after old; of equal scores the longest last piece wins."""
        new = len(text) - old
        best += [_NONE] * new
        back += [0] * new
        own += [None] * new
        singles, unknown = self.singles, self.unknown
        without = [k for k in range(old, len(text)) if text[k] not in singles] if not singles.issuperset(text[old:]) else []
        without.reverse()
        first = max(0, old - self.longest + 1)
        for end, (size, piece, score) in self.automaton.iter(text[first:] if first else text):
            end += first + 1
            while without and without[-1] + 1 < end:
                self._unknown(without.pop(), best, back, own)
            if end > old and (score := score + best[end - size]) > best[end]:
                best[end], back[end], own[end] = score, end - size, piece
        while without:
            self._unknown(without.pop(), best, back, own)

    def _unknown(self, at: int, best: list[float], back: list[int], own: list[int | None]) -> None:
        if best[at] + self.unknown > best[at + 1]:
            best[at + 1], back[at + 1], own[at + 1] = best[at] + self.unknown, at, None

    def _settled(self, back: list[int]) -> int:
        """The boundary in which the paths to all live positions meet."""
        live = set(range(max(0, len(back) - self.longest), len(back)))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last])
        return live.pop()

    def _path(self, text: str, back: list[int], own: list[int | None], end: int) -> list[int]:
        """Ids of the best path from the beginning of the window to a position; unknown characters are their bytes."""
        ids: list[int] = []
        while end > 0:
            start = back[end]
            if own[end] is None:
                ids += reversed([self.bytes[b] for b in (SPACE if text[start] == LITERAL else text[start]).encode()])
            else:
                ids.append(own[end])
            end = start
        ids.reverse()
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; for ids of `encode`, the text that it was given."""
        whole = b"".join(map(self.surface.__getitem__, ids))
        return (whole[1:] if self.dummy_prefix and whole.startswith(b" ") else whole).decode("utf-8", "replace")


class _Known(dict):
    """Ids, as bytes of 32-bit integers, of segments between boundaries that every path shares, found by the streaming search when first asked for.

    When a generation is full it becomes the old one, from which only what is asked for again comes back.
    """

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.old: dict[str, bytes] = {}

    def __missing__(self, segment: str) -> bytes:
        ids = self.old.get(segment)
        if ids is None:
            model = self.model
            found = model.search(segment) if len(segment) <= STEP else chain.from_iterable(model.stream(segment[i : i + STEP] for i in range(0, len(segment), STEP)))
            ids = array("i", found).tobytes()
        if len(segment) <= KEPT:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[segment] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}


_models: dict[bytes, Model] = {}


def model_of(proto: bytes) -> Model:
    """The model of a file's bytes, once per process."""
    key = hashlib.sha256(proto).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(proto)
    return _models[key]


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """docs' columns but text, then ids (array of int), n_ids and text_sha256, the digest of the text decoded again.

    Ids are those of the segmentation with the highest sum of the model file's scores, of equal sums the one with the
    longest last piece; characters without a piece become bytes. Decoding gives back every text exactly, for a
    mismatch stops the task. Null texts count as empty and have no ids. One pass, no shuffle; a text takes memory in
    proportion to its ids, the search itself a window of the longest piece. Existing columns ids, n_ids and
    text_sha256 are replaced; repeated rows repeat; an empty table gives an empty result.
    """
    proto = Path(model_path).read_bytes()
    given = docs.drop("ids", "n_ids", "text_sha256", "text").columns
    read = docs.select(*map(quoted, given), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(free_name(docs, "lw_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(proto)
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                lists, digests = [], []
                for text in part.column(len(given)).to_pylist():
                    ids = model.packed(text)
                    if (again := model.decode(ids.tolist())) != text:
                        raise ValueError("a text doesn't survive encoding and decoding")
                    lists.append(ids)
                    digests.append(hashlib.sha256(again.encode()).hexdigest())
                sizes = [len(x) for x in lists]
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], arrays, pa.array(sizes, pa.int64()), pa.array(digests)], names=[*given, "ids", "n_ids", "text_sha256"])

    return map_batches(read, run, StructType([*read.schema.fields[:-1], *StructType.fromDDL("ids array<int>, n_ids long, text_sha256 string").fields]))


def decode_documents(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """Columns but ids, with `text`, the text of the ids; null ids give an empty text."""
    proto = Path(model_path).read_bytes()
    given = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(proto)
        for batch in batches:
            texts = [model.decode(ids or ()) for ids in batch.column(len(given)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*given, "text"])

    read = encoded.select(*map(quoted, given), "ids")
    return map_batches(read, run, StructType([*read.schema.fields[:-1], *StructType.fromDDL("text string").fields]))
