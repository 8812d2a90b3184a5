"""Similarity join of documents on word shingles by token-combination prefixes, exact at its threshold."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import free_name, materialise, mix64, small, tidy, word_hashes
from logweave.llm.components import connected_components

#: Words in a shingle.
WORDS = 5
#: Least similarity in hundredths.
PERCENT = 75
#: Counters of the frequency sketch; its size does not depend on the corpus.
COUNTERS = 1 << 20
#: The sketch travels in blocks of so many counters.
BLOCK = 1 << 14
#: Bits that mark which documents a verification needs.
MARKS = 1 << 22
#: Distinct sets that a task remembers, in order not to index repeated ones.
REMEMBERED = 50_000
#: Postings of one signature that meet in one task; more are dealt over several by their set's name.
LIST_ROWS = 50_000
#: Tokens of a set by which it is grouped with its like: those that follow so many points of the ring of hashes.
LIKE_POINTS = 4
#: Sets that one side of a comparison holds, and the bytes of bitmaps that it holds at most.
BLOCK_SETS, BLOCK_BYTES = 2048, 1 << 22
#: Partners of a set that one comparison gives at most before the last one, which gives all.
BEST = 8
#: Sizes below this power of two use single tokens only.
FIRST_COMBINED_LEVEL = 4

NO_ID = (1 << 63) - 1
_NODE = pa.int64()


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; none for a text without words."""
    for h in word_hashes(texts):
        if len(h) > words:
            n = len(h) - words + 1
            with np.errstate(over="ignore"):
                s = np.zeros(n, np.uint64)
                for k in range(words):
                    s = s * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
            yield np.unique(mix64(s))
        elif len(h):
            with np.errstate(over="ignore"):
                s = np.uint64(0)
                for x in h:
                    s = s * np.uint64(0xD6E8FEB86659FD93) + x
            yield mix64(np.array([s + np.uint64(words - len(h))], np.uint64))
        else:
            yield h


def set_names(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set: equal sets have equal names. The second one tells sets apart that share the first."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def set_node(tokens: np.ndarray, clashing: frozenset[int] = frozenset()) -> int:
    """The name by which a set is known: its first, or its second where different sets share the first."""
    first, second = set_names(tokens)
    return second if first in clashing else first


#: Documents that a task works on at once.
SLICE = 500


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def _rows(batch: pa.RecordBatch) -> tuple[list[int], list[bytes]]:
    return batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The tokens' hashes as bits of a few words, four to sixteen bits a token."""
    words = max(4, 1 << max(0, (len(tokens) - 1).bit_length() - 4))
    at = ((tokens >> np.uint64(8)) & np.uint64(64 * words - 1)).view(np.int64)
    out = np.zeros(64 * words, np.uint8)
    out[at] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def _folded(bits: Column, other: Column) -> Column:
    """A bitmap at the width of the other, if that is half as wide."""
    half = (F.size(bits) / 2).cast("int")
    both = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseOR(y))
    return F.when(F.size(bits) > F.size(other), both).otherwise(bits)


def _similar_sizes(a: str, b: str, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def may_link(na: str, nb: str, a: str, b: str, percent: int = PERCENT) -> Column:
    """False only for sets that can't have the least similarity: each bit that differs is a token that one set lacks.

    With d such tokens at least, the similarity is at most (na + nb - d) / (na + nb + d).
    """
    a, b = F.col(a), F.col(b)
    differ = F.aggregate(F.zip_with(_folded(a, b), _folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sizes = F.col(na) + F.col(nb)
    return _similar_sizes(na, nb, percent) & (100 * (sizes - differ) >= percent * (sizes + differ))


_SCANNED = "doc_id long, content long, n long, node long, second long, bits array<long>, signature array<int>, likes array<long>, block int, counts binary"
_POINTS = np.arange(LIKE_POINTS, dtype=np.uint64) << np.uint64(62)


def _scan(join: NgramJoin):
    """A pass that gives document rows (id, hash of the text, set size, both names, sketch, signature, tokens that similar sets share), then the task's counters of tokens in blocks."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([
        ("doc_id", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("node", _NODE), ("second", pa.int64()), ("bits", longs), ("signature", pa.list_(pa.int32())), ("likes", longs),
        ("block", pa.int32()), ("counts", pa.binary()),
    ])

    def rows(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)

        def add(pending: list[np.ndarray]) -> None:
            total[:] += np.bincount(np.concatenate(pending).view(np.int64), minlength=COUNTERS).astype(np.uint32)

        for batch in _slices(batches):
            ids, texts = _rows(batch)
            sizes, names, bits, signed, likes, pending, held = [], [], [], [], [], [], 0
            for s in shingle_sets(texts, join.words):
                sizes.append(len(s))
                names.append(set_names(s) if len(s) else (None, None))
                sketch, signature, counted = join.sketch(s) if len(s) else (None, None, s)
                bits.append(sketch)
                signed.append(signature)
                likes.append(s[np.searchsorted(s, _POINTS) % len(s)].view(np.int64) if len(s) else None)
                pending.append(counted & np.uint64(COUNTERS - 1))
                held += len(counted)
                if held >= COUNTERS:
                    add(pending)
                    pending, held = [], 0
            if held:
                add(pending)
            none = [None] * len(ids)
            yield rows(ids, batch.column(2), sizes, [a for a, _ in names], [b for _, b in names], bits, signed, likes, none, none)
        if total.any():
            parts = total.reshape(-1, BLOCK)
            none = [None] * len(parts)
            yield rows(*[none] * 8, list(range(len(parts))), [zlib.compress(p.tobytes(), 1) for p in parts])

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counters of equal blocks in one task, in 64 bits."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
            sums[k] = sums[k] + c if k in sums else c
    yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])


def token_counts(scanned: DataFrame) -> np.ndarray:
    """The counters of all tasks together; 4 bytes for each of COUNTERS."""
    blocks = scanned.where("block is not null").select("block", "counts")
    summed = blocks.repartition("block").mapInArrow(_sum_blocks, "block int, counts binary")
    counts = np.zeros(COUNTERS, np.uint64)
    for r in summed.collect():
        counts[r.block * BLOCK : (r.block + 1) * BLOCK] += np.frombuffer(r.counts, np.uint64)
    return np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)


def token_classes(counts: np.ndarray) -> np.ndarray:
    """For each counter the class of its tokens: 1 rare, 2 frequent, 3 very frequent.

    A counter is frequent when it stands out from what the other counters hold by chance.
    """
    usual = float(np.median(counts))
    bound = max(32.0, 8 * usual**0.5)
    return (1 + (counts > usual + bound) + (counts > usual + 16 * bound)).astype(np.uint8)


def levels(n: int, percent: int = PERCENT) -> list[int]:
    """The size levels at which a set of n tokens can meet a similar one: that of the larger set of the pair."""
    return list(range(n.bit_length() - 1, (n * 100 // percent).bit_length()))


def signatures(tokens: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that any two sets with the least similarity share at least one of, and how many sets at most hold each.

    Tokens have one order: by their counter, so that rare ones come first, then by hash. A set of n may miss at most t = floor(n / 4) tokens that the other
    lacks. Its prefix runs until removing any t tokens still leaves, in some group, as many shared tokens as that
    group combines: rare tokens are one group that combines one; frequent ones (at each size level) fall by hash
    into groups that combine two or three. The prefix that ends first lies inside the other's, so both hold the
    combination. Groups grow in number with the size, so combinations stay in proportion to it.
    """
    n = len(tokens)
    spare = n - -(-n * PERCENT // 100)
    tokens = tokens[np.lexsort((tokens, counts[_counter(tokens)]))]
    kind = classes[_counter(tokens)]
    rare = tokens[kind == 1]
    if len(rare) > spare:
        return rare[: spare + 1], counts[_counter(rare[: spare + 1])]
    out: list[np.ndarray] = []
    most: list[np.ndarray] = []

    def single(ts: np.ndarray) -> None:
        out.append(ts)
        most.append(counts[_counter(ts)])

    for level in levels(n):
        if level < FIRST_COMBINED_LEVEL:
            single(tokens[: spare + 1])
            continue
        single(rare)
        left = spare + 1 - len(rare)
        made = []
        for k in (2, 3):
            own = tokens[kind == k]
            groups = (1 << level) // (4 if k == 2 else 8)
            group = ((own >> np.uint64(20)) % np.uint64(groups)).view(np.int64)
            # The rank of a token in its group: from the k-th on, each token adds one to what must be removed.
            order = np.argsort(group, kind="stable")
            sorted_group = group[order]
            first = np.searchsorted(sorted_group, sorted_group)
            rank = np.empty(len(own), np.int64)
            rank[order] = np.arange(len(own)) - first
            gained = np.cumsum(rank >= k - 1)
            end = int(np.searchsorted(gained, left)) + 1
            own, group = own[:end], group[:end]
            left -= int(gained[min(end, len(gained)) - 1]) if len(gained) else 0
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            for members in np.split(own[order], cuts):
                made += combinations(sorted(members.tolist()), k) if len(members) >= k else []
            if left <= 0:
                break
        if made:
            by_size: dict[int, list] = {}
            for m in made:
                by_size.setdefault(len(m), []).append(m)
            for k, ms in by_size.items():
                a = np.array(ms, np.uint64)
                with np.errstate(over="ignore"):
                    h = np.full(len(a), np.uint64(level * 8 + k), np.uint64)
                    for i in range(k):
                        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + a[:, i])
                out.append(h)
                most.append(counts[_counter(a)].min(axis=1))
    if not out:
        return rare, counts[_counter(rare)]
    found, at = np.unique(np.concatenate(out), return_index=True)
    return found, np.concatenate(most)[at]


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).view(np.int64)


def listed_part(most: np.ndarray, node: int, rows: int) -> np.ndarray:
    """The part of each list that a set goes to, so that parts have some `rows` sets; 0 where a list is small for sure."""
    return np.where(most > rows, 1 + (node & 0xFFFFFFFF) % (1 + most // rows), 0).astype(np.int32)


def _index(counts: np.ndarray, clashing: frozenset[int]):
    classes = token_classes(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            _, texts = _rows(batch)
            sigs, parts, nodes, held = [], [], [], 0

            def flush() -> pa.RecordBatch:
                lens = [len(s) for s in sigs]
                columns = [np.concatenate(sigs).view(np.int64), np.concatenate(parts), np.repeat(np.array(nodes, np.int64), lens)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "part", "node"])

            for s in shingle_sets(texts):
                if not len(s) or (node := set_node(s, clashing)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(node)
                found, most = signatures(s, counts, classes)
                sigs.append(found)
                parts.append(listed_part(most, node, LIST_ROWS))
                nodes.append(node)
                held += len(found)
                if held > 200_000:
                    yield flush()
                    sigs, parts, nodes, held = [], [], [], 0
            if sigs:
                yield flush()

    return run


def _marked(marks: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """The places of the rows whose mark, the first column, is set."""
    return np.flatnonzero(_is_set(marks, batch.column(0).to_numpy()))


def _is_set(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (marks[at >> 3] & (1 << (at & 7)).astype(np.uint8)) > 0


def _where_marked(marks: np.ndarray):
    """The rows whose mark is set, without it: nearly all others are left out before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(list(range(1, batch.num_columns))).take(pa.array(_marked(marks, batch)))

    return run


def _token_sets(marks: np.ndarray, node_marks: np.ndarray, words: int, clashing: frozenset[int]):
    """Sets of the documents whose mark is set, which is the first column, and whose node's mark is too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).take(pa.array(_marked(marks, batch))).to_pylist()]
            for i in range(0, len(texts), 256):
                sets = [s for s in shingle_sets(texts[i : i + 256], words) if len(s)]
                nodes = np.array([set_node(s, clashing) for s in sets], np.int64)
                chosen = np.flatnonzero(_is_set(node_marks, nodes & (MARKS - 1)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[chosen]), pa.array([sets[k].view(np.int64) for k in chosen], pa.list_(pa.int64()))], names=["node", "tokens"])

    return run


def _mark_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(MARKS)).cast("int")


def _mark_of_node(node: Column) -> Column:
    """Names are hashes already."""
    return F.pmod(node, F.lit(MARKS)).cast("int")


def _marks(keys: DataFrame, mark: Column) -> np.ndarray:
    """A bitmap of MARKS bits over the keys' marks; the driver receives MARKS / 8 bytes at most."""
    bit = mark.cast("long") + 1
    maps = keys.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(MARKS // 8, np.uint8)
    for r in maps.collect():  # bit 1 is the first of bucket 1
        at = (r.bucket - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(r.map, np.uint8)
    return out


class _Verifier:
    """Tells which candidate pairs are similar. Sets are fetched only where the bitmaps don't rule a pair out."""

    def __init__(self, join: NgramJoin, texts: DataFrame, reps: DataFrame, clashing: frozenset[int]) -> None:
        self.join, self.texts, self.clashing = join, texts, clashing
        self.reps, self.bits = reps.select("node", "doc_id"), reps.select("node", "n", "bits")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), each once and without those that the bitmaps rule out."""
        for x in ("b", "a"):  # sizes first, for they rule out most
            pairs = pairs.join(self.bits.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")), x)
        pairs = pairs.where(_similar_sizes("na", "nb", self.join.percent)).distinct()
        for x in ("b", "a"):
            pairs = pairs.join(self.bits.select(F.col("node").alias(x), F.col("bits").alias(f"bits_{x}")), x)
        return self.join.allowed(pairs).select("a", "b")

    def edges(self, possible: DataFrame) -> DataFrame:
        """(a, b) of the pairs (a, b) that are similar."""
        pairs = materialise(possible, "pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        needed = materialise(nodes.join(self.reps, "node").select("node", "doc_id"), "needed")
        marks, node_marks = _marks(needed, _mark_of(F.col("doc_id"))), _marks(needed, _mark_of_node(F.col("node")))
        found = self.texts.select(_mark_of(F.col("doc_id")).alias("mark"), "text").mapInArrow(tidy(_token_sets(marks, node_marks, self.join.words, self.clashing)), "node long, tokens array<long>")
        # Dealt by node once, each node once from a task, for both sides of the pairs; rows of one node have one set.
        sets = found.dropDuplicates(["node"]).join(needed.select("node"), "node")
        left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
        right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
        shared = F.size(F.array_intersect("ta", "tb")).cast("long")
        counted = pairs.join(right, "b").join(left, "a").select("a", "b", shared.alias("shared"), (F.size("ta") + F.size("tb")).cast("long").alias("both"))
        return materialise(counted.where(100 * F.col("shared") >= self.join.percent * (F.col("both") - F.col("shared"))).select("a", "b").distinct(), "links")


def _alike(nodes: DataFrame) -> DataFrame:
    """Rows (leader, node): each set with the first of those that have its token after some point of the ring."""
    keyed = nodes.select("node", F.explode("likes").alias("like"))
    leaders = keyed.groupBy("like").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").drop("last")
    return keyed.join(materialise(leaders, "alike"), "like").select("leader", "node")


def _lists(entries: DataFrame) -> DataFrame:
    """Rows (sig, node, leader, members) of the lists of more than one set; the leader is the list's least name.

    A list that may be long is dealt by its sets' names over parts, which no task needs whole; members then counts
    the part.
    """
    of_list = Window.partitionBy("sig", "part")
    listed = entries.select("*", F.min("node").over(of_list).alias("leader"), F.max("node").over(of_list).alias("last"), F.count("*").over(of_list).alias("members"))
    kept = materialise(listed.where("part > 0 or leader <> last").drop("last"), "postings")
    parted = kept.where("part > 0")
    if not parted.isEmpty():
        whole = parted.groupBy("sig").agg(F.min("leader").alias("first"), F.max("node").alias("last"))
        whole = materialise(whole.where("first <> last").select(F.col("sig").alias("of"), "first"), "hot-lists")
        parted = parted.join(whole, F.col("sig") == F.col("of")).withColumn("leader", F.col("first")).drop("of", "first")
        kept = kept.where("part = 0").unionByName(parted)
    return kept.drop("part")


def _level(n: Column) -> Column:
    """n.bit_length() - 1"""
    return F.length(F.bin(n)) - 1


def _comparisons(join: NgramJoin, listed: DataFrame) -> DataFrame:
    """Deals the rows (key, node, n, label) of lists into units (unit, side, node, n, label) of bounded size.

    Any two sets of one list, with different labels and sizes that allow a link, meet in exactly one unit; they are to be
    compared there if they are of different sides or their side is -1. A list falls by size into levels, a level into
    blocks: those of its largest component and those of the rest. Blocks of the largest component meet blocks of the
    rest only, so pairs that are connected already cost nothing.
    """
    n = F.col("n").cast("long")
    leveled = listed.withColumn("level", F.explode(F.sequence(_level(n), _level(F.floor(n * 100 / join.percent)))))
    by_label = leveled.groupBy("key", "level", "label").agg(F.count("*").alias("k"))
    lists = by_label.groupBy("key", "level").agg(F.max(F.struct("k", "label")).alias("home"), F.sum("k").alias("sets"), F.count("*").alias("labels")).where("labels > 1")
    block = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK_SETS)), F.floor(BLOCK_BYTES / (8 * join.sketch_words(F.col("level"))))))
    lists = lists.select(
        "key", "level", F.col("home.label").alias("home"), (F.col("sets") <= block).alias("whole"),
        F.ceil(F.col("home.k") / block).alias("homes"), F.ceil((F.col("sets") - F.col("home.k")) / block).alias("rests"),
    )
    at_home = F.col("label") == F.col("home")
    dealt = leveled.join(materialise(lists, "lists"), ["key", "level"]).withColumn("own", F.pmod(F.xxhash64("node"), F.when(at_home, F.col("homes")).otherwise(F.col("rests"))))

    def unit(kind: int, one: Column, two: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"), side.cast("long").alias("side"))

    zero, own = F.lit(0).cast("long"), F.col("own")
    meets_rest = F.transform(F.sequence(zero, F.col("rests") - 1), lambda j: unit(1, own, j, F.lit(0)))
    meets_home = F.transform(F.sequence(zero, F.col("homes") - 1), lambda i: unit(1, i, own, F.lit(1)))
    among_rest = F.transform(F.sequence(zero, F.col("rests") - 1), lambda k: unit(2, F.least(own, k), F.greatest(own, k), F.when(own == k, -1).otherwise(own)))
    units = F.when(F.col("whole"), F.array(unit(0, zero, zero, F.lit(-1)))).when(at_home, meets_rest).otherwise(F.concat(meets_home, among_rest))
    out = dealt.withColumn("to", F.explode(units))
    return out.select(F.xxhash64("key", "level", "to.kind", "to.one", "to.two").alias("unit"), "level", F.col("to.side").alias("side"), "node", "n", "label")


#: Words of bitmaps that a comparison gathers at once, and pairs that it lists at once.
_WORDS_AT_ONCE, _PAIRS_AT_ONCE = 1 << 17, 1 << 17


def _within(unit: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of all pairs of one unit that are of different sides or of side -1, some at a time.

    Rows are sorted by unit and side; no unit has more than two sides.
    """
    rows = np.arange(len(unit))
    edge = lambda differs: np.append(np.flatnonzero(differs) + 1, len(unit))
    unit_ends, side_ends = edge(unit[1:] != unit[:-1]), edge((unit[1:] != unit[:-1]) | (side[1:] != side[:-1]))
    group_end = unit_ends[np.searchsorted(unit_ends, rows, "right")]
    first = np.where(side < 0, rows + 1, side_ends[np.searchsorted(side_ends, rows, "right")])
    followers = group_end - first
    low = 0
    upto = np.cumsum(followers)
    while low < len(followers):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + _PAIRS_AT_ONCE, "right")))
        k = followers[low:high]
        i = np.repeat(np.arange(low, high), k)
        yield i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        low = high


def _possible_pairs(join: NgramJoin, table: pa.Table, best: int | None) -> pa.RecordBatch:
    """Pairs of the units' sets that their sketches allow to be similar; rows are sorted by unit and side.

    With `best` only the pairs that are among so many most similar ones of one of their sets, by what the bitmaps
    allow; rows without a pair name in `open` the sets of those that were left out.
    """
    unit, level, side, node, n, label = (table.column(c).to_numpy() for c in ("unit", "level", "side", "node", "n", "label"))
    likeness = join.likeness(table.column("bits").combine_chunks())
    n = n.astype(np.int64)
    own = np.frexp(n)[1] - 1
    found: list[np.ndarray] = []
    allowed: list[np.ndarray] = []
    for i, j in _within(unit, side):
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        asked = (label[i] != label[j]) & (100 * low >= join.percent * high) & (np.maximum(own[i], own[j]) == level[i])
        i, j = i[asked], j[asked]
        for may, like, a, b in likeness(n, i, j):
            x, y = node[a[may]], node[b[may]]
            found.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
            allowed.append(like[may])
    pairs, at = np.unique(np.concatenate(found, axis=1), axis=1, return_index=True) if found else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    columns = [*(pa.array(p, _NODE) for p in pairs), pa.nulls(pairs.shape[1], _NODE)]
    if best is not None and pairs.shape[1]:
        similarity = np.concatenate(allowed)[at]
        kept = np.zeros(len(similarity), bool)
        for side in pairs:
            order = np.lexsort((-similarity, side))
            first = np.searchsorted(side[order], side[order])
            kept[order] |= np.arange(len(order)) - first < best
        if not kept.all():
            left = np.unique(pairs[:, ~kept])
            ends = (pa.nulls(len(left), _NODE), pa.nulls(len(left), _NODE), pa.array(left, _NODE))
            columns = [pa.concat_arrays([c.filter(pa.array(kept)), end]) for c, end in zip(columns, ends, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "open"])


def _narrowed(flat: np.ndarray, at: np.ndarray, words: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """The rows' bitmaps as a matrix of w words each; those of twice as many are folded."""
    out = flat[at[rows][:, None] + np.arange(w)]
    wide = np.flatnonzero(words[rows] > w)
    if len(wide):
        out[wide] |= flat[at[rows[wide]][:, None] + np.arange(w, 2 * w)]
    return out


def _compare(join: NgramJoin, best: int | None):
    """A pass that compares the units of a task, whose rows are sorted by unit and side, some whole units at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            start = 0
            units = batch.column(0).to_numpy()
            ends = np.flatnonzero(np.concatenate((units[1:] != units[:-1], [False]))) + 1
            if held and len(units) and held[-1].column(0)[-1].as_py() != units[0]:
                ends = np.concatenate(([0], ends))
            for end in ends.tolist():
                if end > start:
                    held.append(batch.slice(start, end - start))
                    size += held[-1].nbytes
                start = end
                if size >= BLOCK_BYTES:
                    yield _possible_pairs(join, pa.Table.from_batches(held), best)
                    held, size = [], 0
            if start < batch.num_rows:
                held.append(batch.slice(start))
                size += held[-1].nbytes
        if held:
            yield _possible_pairs(join, pa.Table.from_batches(held), best)

    return run


@dataclass(frozen=True)
class NgramJoin:
    """What a join of sets is made of: words of a shingle, least similarity in hundredths, sketches and lists.

    A sketch is an array of longs that tells cheaply which pairs can't be similar.
    """

    words: int = WORDS
    percent: int = PERCENT

    #: Leaders that a set meets in its first turn, those of most of its lists; all of its lists' if None.
    leaders: int | None = None

    def rounds(self) -> tuple[int | None, ...]:
        """How many best partners a set is given in each round of comparisons; all in the last one."""
        return (BEST, None)

    def sketch(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """A set's sketch, its signature if lists are made of one, and the tokens that are counted."""
        return bitmap(tokens), None, tokens

    def sketch_words(self, level: Column) -> Column:
        """Longs of a sketch of a set of that size level."""
        return F.pow(F.lit(2.0), F.greatest(level - 3, F.lit(2)))

    def postings(self, texts: DataFrame, scanned: DataFrame, counts: np.ndarray, clashing: frozenset[int]) -> DataFrame:
        """(sig, part, node): any two similar sets share a list."""
        return texts.select("doc_id", "text").mapInArrow(tidy(_index(counts, clashing)), "sig long, part int, node long")

    def pruned(self, postings: DataFrame) -> DataFrame:
        """(sig, part, node) of the postings without sets that can't be similar to any of their list, where that is told cheaply."""
        return postings

    def allowed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, na, nb, bits_a, bits_b) that may be similar."""
        return pairs.where(may_link("na", "nb", "bits_a", "bits_b", self.percent))

    def likeness(self, bits: pa.ListArray):
        """A function that gives for sets at places i and j, in pieces: whether they may be similar, how similar at most, and the places."""
        words = pc.list_value_length(bits).to_numpy().astype(np.int64)
        flat = bits.flatten().to_numpy().view(np.uint64)
        at = np.cumsum(words) - words

        def run(n: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            narrow = np.minimum(words[i], words[j])
            for w in np.unique(narrow).tolist():
                of = np.flatnonzero(narrow == w)
                step = max(1, _WORDS_AT_ONCE // w)
                for k in range(0, len(of), step):
                    a, b = i[of[k : k + step]], j[of[k : k + step]]
                    differ = np.bitwise_count(_narrowed(flat, at, words, a, w) ^ _narrowed(flat, at, words, b, w)).sum(axis=1, dtype=np.int64)
                    both = n[a] + n[b]
                    yield 100 * (both - differ) >= self.percent * (both + differ), (both - differ) / (both + differ), a, b

        return run


def _clashing(scanned: DataFrame) -> frozenset[int]:
    """First names that different sets share, which are known by their second names instead.

    Among 10**10 sets fewer than three are expected, so the driver receives next to nothing.
    """
    seconds = scanned.where("node is not null").groupBy("node").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo <> hi")
    return frozenset(r.node for r in seconds.select("node").collect())


def _classed(docs: DataFrame, id_col: str, text_col: str, join: NgramJoin | None = None) -> DataFrame:
    """(doc_id, content, n, component) of each row: a hash of its text, its set's size and a name of its component, null without words."""
    join = join or NgramJoin()
    text = F.col(text_col).cast("binary")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content"))
    scanned = materialise(texts.mapInArrow(tidy(_scan(join)), _SCANNED), "scanned")
    counts = token_counts(scanned)
    clashing = _clashing(scanned)
    if clashing:
        scanned = scanned.withColumn("node", F.when(F.col("node").isin(list(clashing)), F.col("second")).otherwise(F.col("node")))
    sized = scanned.where("n is not null").select("doc_id", "content", "n", "node")

    postings = _lists(join.pruned(join.postings(texts, scanned, counts, clashing)))
    # Many lists of one family of texts have the same least name: they become one list, whose rows are few.
    merged = materialise(postings.groupBy("leader", "node").agg(F.sum("members").alias("members"), F.count("*").alias("lists")), "merged")
    listed = materialise(merged.select("node").distinct(), "listed")
    found = scanned.where("node is not null").select(_mark_of_node(F.col("node")).alias("mark"), "node", "doc_id", "n", "bits", "likes")
    found = found.mapInArrow(tidy(_where_marked(_marks(listed, _mark_of_node(F.col("node"))))), "node long, doc_id long, n long, bits array<long>, likes array<long>").join(listed, "node", "left_semi")
    reps = materialise(found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("bits").alias("bits"), F.first("likes").alias("likes")), "reps")
    verifier = _Verifier(join, texts, reps, clashing)
    leaders = merged.select("leader", "node")
    if join.leaders:
        # No more rows of a set than it has signatures.
        ranked = merged.where("leader <> node").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("lists", "leader")), asc=False).alias("of"))
        leaders = ranked.select(F.explode(F.slice("of", 1, join.leaders)).alias("of"), "node").select("of.leader", "node")
    leaders = leaders.union(_alike(reps.select("node", "likes"))).where("leader <> node")
    links = verifier.edges(verifier.possible(leaders.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))))
    labels = connected_components(links)

    bits = reps.select("node", "n", "bits")
    for best in join.rounds():
        possible = materialise(_compared(join, merged, postings, labels, bits, best), "possible")
        more = verifier.edges(possible.where("a is not null").select("a", "b").distinct())
        if not more.isEmpty():
            links = links.union(more)
            labels = connected_components(links)
        left = possible.where("a is null").select(F.col("open").alias("node")).distinct()
        if left.isEmpty():
            break
        # Both sets of any pair that was left out are among these.
        left = small(materialise(left, "left-out"))
        merged, postings, bits = (x.join(left, "node", "left_semi") for x in (merged, postings, bits))
    return sized.join(labels, "node", "left").select("doc_id", "content", "n", F.coalesce("label", "node").alias("component"))


def _compared(join: NgramJoin, merged: DataFrame, postings: DataFrame, labels: DataFrame, bits: DataFrame, best: int | None) -> DataFrame:
    """Pairs (a, b, open) of sets of one list and of different components that the bitmaps allow, as `_possible_pairs` gives them."""
    # Leaders have met all sets of their lists, unless only the nearest ones had a turn.
    own = "true" if join.leaders else "node <> leader"
    followers = merged.where(own)
    labelled = materialise(followers.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    open_lists = labelled.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("sets"), F.sum("members").alias("apart")).where("lo <> hi")
    # Where the lists of one leader have little in common, they stay apart.
    open_lists = materialise(open_lists.select("leader", (F.col("sets") * F.col("sets") > 4 * F.col("apart")).alias("apart")), "open")
    listed = labelled.join(open_lists.where("not apart"), "leader", "left_semi").select(F.col("leader").alias("key"), "node", "label")
    if not open_lists.where("apart").isEmpty():
        apart = postings.join(open_lists.where("apart"), "leader", "left_semi").where(own).select(F.col("sig").alias("key"), "node")
        listed = listed.union(apart.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    listed = materialise(listed.join(bits.select("node", "n"), "node").select("key", "node", "n", "label"), "compared")
    units = _comparisons(join, listed).join(bits.select("node", "bits"), "node").select("unit", "level", "side", "node", "n", "label", "bits")
    return units.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(tidy(_compare(join, best)), "a long, b long, open long")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    Two documents link when the Jaccard similarity of their sets of distinct 5-word shingles (A-Z in lower case) is
    0.75 or more; a text of 1 to 4 words is one shingle, and one without words or null has no set and links with
    nothing. The result is exact: equal sets are collapsed to one node first; then every pair of nodes that shares a
    signature is compared, or already known to be connected when its turn comes. Comparing begins with bitmaps of
    the sets, which bound what two sets can share; only where that bound allows a link are the sets read.

    1. One pass finds set sizes and names and a sketch of token frequencies of fixed size.
    2. A second pass writes signatures (single rare tokens, combinations of frequent ones); lists of one node vanish.
       A list's leader is its least name; lists with one leader, mostly of one family of texts, are merged.
    3. Nodes meet the leader of their lists, and the first node with the same token at some points of the ring of
       hashes. What is similar is linked, so that families of near copies are components before any pair in them.
    4. Within each merged list, nodes but the leader that are still in different components meet: its largest component the rest,
       and the rest each other, in blocks of bounded size. Only what the bitmaps allow leaves a task, to be verified:
       first a few best partners of each set, so that what is similar becomes one component, then, among the sets of
       the pairs that were left out, all that is left.

    Only the components are exact. Pairs that are already in one component are not compared, so the links
    found are enough to connect each component but not all there are, and neither pairs nor numbers of links are given.

    Repeated rows and ties fall together, null ids take part and give a null component if alone, empty tables give
    empty results, and other columns are not read. A text takes some 40 bytes for each of its words while its set is
    made, and two sets of 8 bytes a shingle meet in a task at a time.
    """
    return components_of(_classed(docs, id_col, text_col))


def components_of(classed: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of classed rows: each component is named by its smallest doc_id."""
    classed = materialise(classed, "classed")
    smallest = classed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    smallest = materialise(smallest.withColumnRenamed("component", "of"), "smallest")
    out = classed.join(smallest, F.col("component") == F.col("of"), "left")
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component_id", "doc_id"), F.lit(NO_ID)).alias("component_id")
    )


def drop_near(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest doc_id; columns unchanged.

    Of rows that share that id, the one with the least hash of its text stays; rows that share id and text are one
    document, of which one row stays. Null ids come last, and such rows are told apart by their texts. Documents
    without words belong to no group and stay as they are. Any column names are accepted, an empty table gives an
    empty result, and very long texts take memory as in `ngram_jaccard_components`.
    """
    classed = materialise(_classed(docs, "doc_id", "text").where("component is not null"), "near-classed")
    keep = classed.groupBy("component").agg(F.min(F.struct("doc_id", "content")).alias("keep")).withColumnRenamed("component", "of")
    keep = materialise(keep, "near-keep")
    rows = classed.join(keep, F.col("component") == F.col("of")).groupBy("doc_id", "content").agg(
        F.max((F.col("doc_id") == F.col("keep.doc_id")) & (F.col("content") == F.col("keep.content"))).alias("kept"), F.count("*").alias("rows")
    )
    rows = materialise(rows.where("not kept or rows > 1"), "near-lost")
    lost_id, lost_content, key, content = (free_name(docs, x) for x in ("lw_lost_id", "lw_lost_content", "lw_key", "lw_content"))
    lost = rows.where("not kept").select(F.col("doc_id").alias(lost_id), F.col("content").alias(lost_content))
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), content: F.xxhash64(F.col("text").cast("binary"))})
    out = keyed.join(small(lost), (F.col(key) == F.col(lost_id)) & (F.col(content) == F.col(lost_content)), "left_anti")
    again = rows.where("kept")
    if not again.isEmpty():
        # Only rows of repeated documents are gathered by document.
        again = small(again.select(F.col("doc_id").alias(lost_id), F.col("content").alias(lost_content)))
        on = (F.col(key) == F.col(lost_id)) & (F.col(content) == F.col(lost_content))
        out = out.join(again, on, "left_anti").unionByName(out.join(again, on, "left_semi").dropDuplicates([key, content]))
    return out.drop(key, content)
