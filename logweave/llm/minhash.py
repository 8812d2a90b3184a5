"""Near copies by MinHash: an inverted join of signature coordinates, exact checks behind it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import ngram_join
from logweave.llm.common import mix64, tidy
from logweave.llm.ngram_join import NgramJoin, _counter, listed_part

#: Words in a shingle, and least similarity in hundredths.
WORDS, PERCENT = 2, 80
#: Coordinates of a signature, and how many of them two documents must agree in to be a candidate.
COORDINATES, MATCHES = 128, 77
#: Coordinates that a posting combines, the combinations of a signature, and how many of them two documents must agree in.
COMBINED = 3
COMBINATIONS, SHARED = COORDINATES // COMBINED, 4
#: Longs of a signature cut to bytes.
LANES = COORDINATES // 8
#: Bits of 64 in which the marks of similar sets differ at most, and the most sets of a list that are told apart by marks.
DIFFERING, PRUNED = 22, 256
#: Partners that a set is given at most in the first round of comparisons.
FEW = 2
#: Words of parities that are gathered at once.
_WORDS_AT_ONCE = 1 << 17
#: Tokens that are hashed by all coordinates at once.
_TOKENS_AT_ONCE = 1024
#: Postings that a task writes at once.
_POSTINGS_AT_ONCE = 200_000

#: Odd multipliers: a coordinate's hash of a token is their product modulo 2**64.
_MULTIPLIERS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(tokens: np.ndarray) -> np.ndarray:
    """For each coordinate the upper 32 bits of the least hash of the set's tokens."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for low in range(0, len(tokens), _TOKENS_AT_ONCE):
            np.minimum(least, np.multiply.outer(_MULTIPLIERS, tokens[low : low + _TOKENS_AT_ONCE]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def lanes(values: np.ndarray) -> np.ndarray:
    """A signature's coordinates cut to a byte each, as longs. Cut coordinates agree where whole ones do."""
    return (mix64(values.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8).view(np.int64)


def mark(values: np.ndarray) -> int:
    """A bit of each of 64 coordinates, as a long."""
    bits = (mix64(values[:64].astype(np.uint64)) >> np.uint64(40)) & np.uint64(1)
    return int(np.packbits(bits.astype(np.uint8)).view(np.int64)[0])


def parity(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens falls on each of two to four bits a token.

    A bit that differs between two sets needs a token that one of them lacks; tokens that both have cancel out.
    """
    words = max(4, 1 << max(0, (len(tokens) - 1).bit_length() - 5))
    at = ((tokens >> np.uint64(8)) & np.uint64(64 * words - 1)).view(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * words) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def combinations_of(values: np.ndarray) -> np.ndarray:
    """The names of the combinations of a signature's coordinate-value pairs, neighbours in the signature."""
    names = mix64(np.arange(COMBINATIONS, dtype=np.uint64))
    for k in range(COMBINED):
        names = mix64((values[k : COMBINED * COMBINATIONS : COMBINED].astype(np.uint64) << np.uint64(20)) ^ names)
    return names


def can_link(n: int, percent: int) -> bool:
    """Whether a set of n tokens can be so similar to another one."""
    return n * 100 // percent > n or 100 * (n - 1) >= percent * (n + 1)


def _post(counts: np.ndarray, percent: int):
    """A pass over (node, n, signature) that posts each set under the rarest combinations of its coordinate-value pairs.

    Two sets that agree in SHARED combinations agree in one of the COMBINATIONS - SHARED + 1 that come first in any
    order of the combinations that all sets keep to; here the rare ones come first, by the counters, then by name. The
    lists of the others, the long ones, are never merged. Sets of one vocabulary share single pairs by chance, each
    with more of the others as the corpus grows; combinations of three hardly.
    """
    kept, list_rows, remembered = COMBINATIONS - SHARED + 1, ngram_join.LIST_ROWS, ngram_join.REMEMBERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        nodes: list[int] = []
        marks: list[int] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(sigs).view(np.int64), np.concatenate(parts), *(np.repeat(np.array(x, np.int64), kept) for x in (nodes, marks))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "part", "node", "mark"])

        for batch in batches:
            signatures = batch.column(2).flatten().to_numpy().view(np.uint32).reshape(-1, COORDINATES)
            for node, n, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), signatures, strict=True):
                if node in seen or not can_link(n, percent):
                    continue
                if len(seen) < remembered:
                    seen.add(node)
                names = combinations_of(values)
                often = counts[_counter(names)]
                first = np.lexsort((names, often))[:kept]
                sigs.append(names[first])
                parts.append(listed_part(often[first], node, list_rows))
                nodes.append(node)
                marks.append(mark(values))
                if len(nodes) * kept >= _POSTINGS_AT_ONCE:
                    yield flush()
                    sigs, parts, nodes, marks = [], [], [], []
        if nodes:
            yield flush()

    return run


def _like(bits: np.ndarray, at: np.ndarray, words: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets at places i and j: whether they may be similar, and how similar at most.

    A sketch has LANES longs of lanes, then those of the parities. Agreements are counted first; sets that agree in
    enough coordinates are then held to what their parities allow.
    """
    lane = at[:, None] + np.arange(LANES)
    may = (bits[lane[i]].view(np.uint8) == bits[lane[j]].view(np.uint8)).sum(axis=1) >= MATCHES
    most = np.zeros(len(i))
    narrow = np.minimum(words[i], words[j]) - LANES
    for w in np.unique(narrow[may]).tolist():
        of = np.flatnonzero(may & (narrow == w))
        for k in range(0, len(of), step := max(1, _WORDS_AT_ONCE // w)):
            a, b = i[of[k : k + step]], j[of[k : k + step]]
            differ = np.bitwise_count(_folded(bits, at, words, a, w) ^ _folded(bits, at, words, b, w)).sum(axis=1, dtype=np.int64)
            both = n[a] + n[b]
            may[of[k : k + step]] = 100 * (both - differ) >= percent * (both + differ)
            most[of[k : k + step]] = (both - differ) / (both + differ)
    return may, most


def _folded(bits: np.ndarray, at: np.ndarray, words: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """The rows' parities as a matrix of w words each; wider ones, of sets that are at most twice as large, are halved."""
    start = at[rows] + LANES
    out = bits[start[:, None] + np.arange(w)]
    wide = np.flatnonzero(words[rows] - LANES > w)
    if len(wide):
        out[wide] ^= bits[start[wide][:, None] + np.arange(w, 2 * w)]
    return out


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longs of a column of sketches, where each begins, and how many it has."""
    words = pc.list_value_length(column).to_numpy().astype(np.int64)
    return column.flatten().to_numpy().view(np.uint64), np.cumsum(words) - words, words


def _agreeing(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pairs (a, b, na, nb, bits_a, bits_b) those that may be similar."""
        for batch in batches:
            one, two = _flat(batch.column(4)), _flat(batch.column(5))
            bits, at, words = np.concatenate((one[0], two[0])), np.concatenate((one[1], two[1] + len(one[0]))), np.concatenate((one[2], two[2]))
            n = np.concatenate([batch.column(k).to_numpy().astype(np.int64) for k in (2, 3)])
            rows = np.arange(batch.num_rows)
            may, _ = _like(bits, at, words, n, rows, rows + batch.num_rows, percent)
            yield batch.select([0, 1]).filter(pa.array(may))

    return run


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, part, node, mark), sorted, those that a list may need: each set once, and with a set that it may be like.

    Sets that met by chance differ in half of their marks; at 0.80 marks differ in more than DIFFERING bits with odds
    of 1 in 10**8. Lists that are dealt over parts, or have more than PRUNED sets, are left as they are.
    """
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        sig, part, node, marks = (table.column(k).to_numpy() for k in range(4))
        new = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1]))))
        sig, part, node, marks = sig[new], part[new], node[new], marks[new].view(np.uint64)
        lists = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (part[1:] != part[:-1]))))
        sizes = np.diff(np.concatenate((lists, [len(sig)])))
        whole = np.repeat(sizes > PRUNED, sizes) | (part > 0)
        keep = whole & np.repeat(sizes > 1, sizes) | (part > 0)
        for k in range(1, PRUNED):  # each set with the one k places on in its list
            at = np.flatnonzero(~whole[:-k] & (sig[:-k] == sig[k:]) & (part[:-k] == part[k:])) if len(sig) > k else []
            if not len(at):
                break
            like = at[np.bitwise_count(marks[at] ^ marks[at + k]) <= DIFFERING]
            keep[like] = keep[like + k] = True
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, part, node)], names=["sig", "part", "node"])

    rows = 0
    for batch in batches:
        sig = batch.column(0).to_numpy()
        # Up to here lists are complete.
        cut = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
        if rows + cut >= _POSTINGS_AT_ONCE and (cut or held[-1].column(0)[-1].as_py() != sig[0]):
            held.append(batch.slice(0, cut))
            yield done()
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield done()


@dataclass(frozen=True)
class MinHashJoin(NgramJoin):
    """Signature coordinates in place of token combinations, and counted agreements in place of bitmaps."""

    words: int = WORDS
    percent: int = PERCENT
    leaders: int | None = 2

    def rounds(self) -> tuple[int | None, ...]:
        # What is similar mostly becomes one component by few links, so that few pairs are left to confirm.
        return (FEW, None)

    def sketch(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        values = signature(tokens)
        return np.concatenate((lanes(values), parity(tokens))), values.view(np.int32), combinations_of(values)

    def sketch_words(self, level: Column) -> Column:
        return LANES + F.pow(F.lit(2.0), F.greatest(level - 4, F.lit(2)))

    def postings(self, texts: DataFrame, scanned: DataFrame, counts: np.ndarray, clashing: frozenset[int]) -> DataFrame:
        return scanned.where("node is not null").select("node", "n", "signature").mapInArrow(tidy(_post(counts, self.percent)), "sig long, part int, node long, mark long")

    def pruned(self, postings: DataFrame) -> DataFrame:
        dealt = postings.repartition("sig", "part").sortWithinPartitions("sig", "part", "node")
        return dealt.mapInArrow(tidy(_prune), "sig long, part int, node long")

    def allowed(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(tidy(_agreeing(self.percent)), "a long, b long")

    def likeness(self, column: pa.ListArray):
        bits, at, words = _flat(column)

        def run(n: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            step = (1 << 21) // COORDINATES
            for k in range(0, len(i), step):
                a, b = i[k : k + step], j[k : k + step]
                yield *_like(bits, at, words, n, a, b, self.percent), a, b

        return run


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (whether that is its own).

    Two documents link when the Jaccard similarity of their sets of distinct 2-word shingles (A-Z in lower case) is
    0.80 or more; a text of one word is one shingle, one without words or null has no set and links with nothing.

    1. One pass over the texts gives each set's size, names and signature of COORDINATES minima, and counts the
       combinations of COMBINED coordinate-value pairs in counters of fixed size. Equal sets become one node.
    2. Each node is posted under the rarest of its combinations, as many as must hold one that any node with SHARED
       of them in common has too (prefix); the long lists of the others are skipped, and so are sizes that can't link.
       A mark of 64 bits travels with each posting; from a list of up to PRUNED sets those whose mark is like no
       other's there are dropped, which met by chance.
    3. In each list nodes meet the list's leader, then, of different components only, each other in blocks. Where two
       nodes meet, agreements are counted over whole signatures, and pairs with fewer than MATCHES are dropped.
       So are those that parities of the sets rule out for sure, which are most pairs below the least similarity.
    4. What is left is confirmed on the full sets; components are formed of the confirmed links.

    A pair at exactly 0.80 agrees in 102 coordinates of 128 on average and in fewer than 77 with odds of 1 in 10**7;
    at 0.85 they are 1 in 10**12. It agrees in 21 combinations of 42 on average and in fewer than 4 with odds of 1 in
    10**9, at 0.85 of 1 in 10**12. Every link is exact, and a component is whole unless a link that nothing
    else bridges is missed by these odds. As in ngram_jaccard_components, lists that may be long are dealt over tasks
    and neither copies nor families of near copies meet in all pairs.

    Repeated rows and ties fall together, null ids take part and give a null component if alone (such a row counts as
    kept where its component is null), empty tables give empty results, and other columns are not read. A text takes
    some 40 bytes for each of its words while its set is made.
    """
    found = ngram_join.components_of(ngram_join._classed(docs, id_col, text_col, MinHashJoin()))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
