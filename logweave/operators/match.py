"""Matching records to the statements that may have written them, in one pass over the records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from logweave.functions import paths
from logweave.functions.literal import Matcher, literals
from logweave.operators import anchors
from logweave.tables import materialise, small

#: Characters of a statement's literal text by which it is looked up, at most: its rarest ones in the slice.
ANCHOR_CHARS = 12
#: A slice of the catalogue that tasks hold: statements, and bytes of their columns.
SLICE_STATEMENTS, SLICE_BYTES = 150_000, 48 << 20
#: Slices up to which each is a pass over the records; statements of a larger catalogue are joined by their literal text.
MOST_SLICES = 5
#: Files whose paths travel to tasks to resolve call sites; for more, call sites are joined.
MOST_FILES = 250_000
#: Answers that a task remembers.
REMEMBERED = 100_000

#: Columns of a statement that a match carries.
STATEMENT = ("root_ord", "source_path", "stmt_idx", "language", "line_no", "end_line_no", "column", "name", "text", "quality", "pattern", "executable", "args", "vars", "exprs")
_CAPTURED = "captured array<string>"
CALL_SITES = "array<struct<name:string,source_path:string,language:string,line_no:int>>"


class Index:
    """Statements of a slice, found by one walk over a body through an automaton of their anchors.

    A statement's anchor is its longest stretch of literal text, or the ANCHOR_CHARS characters of it that fewest
    stretches of the slice hold. What a body costs is its length and the anchors that it really holds.
    """

    def __init__(self, table: pa.Table) -> None:
        self.executables = table.column("executable").to_pylist()
        same: dict = {}  # one string for all statements of a file
        self.roots, self.paths, self.names = ([same.setdefault(x, x) for x in table.column(c).to_pylist()] for c in ("root_ord", "source_path", "file_name"))
        self.order, self.quality = table.column("stmt_idx").to_pylist(), table.column("quality").to_pylist()
        #: Of statements that were candidates before.
        self.matchers: dict[int, Matcher] = {}
        longest = [max(literals(x), key=len, default="") for x in self.executables]
        windows = lambda text: (text[k : k + ANCHOR_CHARS] for k in range(len(text) - ANCHOR_CHARS + 1))
        counts = Counter(w for text in longest if len(text) > ANCHOR_CHARS for w in set(windows(text)))
        anchors: dict[str, list[int]] = {}
        #: Statements without literal text, which every body meets.
        self.others = [i for i, text in enumerate(longest) if not text]
        for i, text in enumerate(longest):
            if text:
                anchor = text if len(text) <= ANCHOR_CHARS else min(windows(text), key=lambda w: (counts[w], w))
                anchors.setdefault(anchor, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for anchor, found in anchors.items():
            self.automaton.add_word(anchor, (found[0], found))
        if anchors:
            self.automaton.make_automaton()

    def candidates(self, body: str) -> list[int]:
        """Statements whose anchor the body holds, each once."""
        hits = dict(v for _, v in self.automaton.iter(body)) if len(self.automaton) and body else {}
        return [i for found in hits.values() for i in found] + self.others

    def fitting(self, body: str, hint: str | None, known: list[int] | None) -> Iterator[tuple[int, list[str]]]:
        """Statements whose template the body fits, with the values, among those that the file hint leaves.

        `known` has the roots in which the hint is the name of a file.
        """
        for i in self.candidates(body):
            if hint is not None and not (self.names[i] == hint if known and self.roots[i] in known else hint in self.paths[i]):
                continue
            if (matcher := self.matchers.get(i)) is None:
                matcher = self.matchers[i] = Matcher(self.executables[i])
            if (values := matcher.values(body)) is not None:
                yield i, values

    def per_file(self, body: str, hint: str | None, known: list[int] | None, best_in_file: bool) -> list[tuple[tuple, int, list[str]]]:
        """Of each file the first statement that fits, or its best: (place among the files, statement, values)."""
        won: dict[tuple[int, str], tuple[tuple, int, list[str]]] = {}
        for i, values in self.fitting(body, hint, known):
            rank = (-self.quality[i], self.order[i]) if best_in_file else (self.order[i],)
            file = (self.roots[i], self.paths[i])
            if file not in won or rank < won[file][0]:
                won[file] = (rank, i, values)
        return [((root, -self.quality[i], path, self.order[i]), i, values) for (root, path), (_, i, values) in won.items()]


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class _Opening:
    """An Arrow table as it travels to the tasks, where it is opened once in a process."""

    def __init__(self, table: pa.Table) -> None:
        self.data = _packed(table)

    def opened(self):
        if not hasattr(self, "_opened"):
            self._opened = self.made(pa.ipc.open_stream(self.data).read_all().combine_chunks())
        return self._opened

    def __getstate__(self) -> dict:
        return {"data": self.data}


class _Slice(_Opening):
    """A part of the catalogue: the statements of whole files."""

    @staticmethod
    def made(table: pa.Table) -> tuple[pa.StructArray, Index]:
        columns = [table.column(c).chunk(0) if table.num_rows else pa.array([], table.column(c).type) for c in STATEMENT]
        return pa.StructArray.from_arrays(columns, names=list(STATEMENT)), Index(table)


class _Files(_Opening):
    """The source files by their names, to resolve relative paths of call sites."""

    @staticmethod
    def made(table: pa.Table):
        by_name: dict[str, list[tuple]] = {}
        for root, path in zip(table.column("root_ord").to_pylist(), table.column("source_path").to_pylist(), strict=True):
            parts = path.split("/")
            by_name.setdefault(parts[-1], []).append((root, path, parts))
        answers: dict[str, str | None] = {}

        def resolved(wanted: str) -> str | None:
            if wanted not in answers:
                if len(answers) >= REMEMBERED:
                    answers.clear()
                parts = wanted.split("/")
                found = [(root, parts != have[-len(parts) :], path) for root, path, have in by_name.get(parts[-1], ()) if paths.in_order(parts, have)]
                answers[wanted] = min(found)[2] if found else None
            return answers[wanted]

        return resolved


def slices(statements: DataFrame) -> tuple[int, int, Iterator[Broadcast]]:
    """How many statements and slices the catalogue has, and the slices as broadcasts of bounded size; the driver holds one at a time.

    A file's statements lie in one slice. A catalogue grows with the source code, not with the logs.
    """
    columns = [*STATEMENT, "file_name"]
    text = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("source_path", "name", "text", "pattern", "executable")), F.lit(100))
    text = text + F.coalesce(F.aggregate(F.concat("vars", "exprs"), F.lit(0), lambda n, x: n + F.length(x)), F.lit(0))
    measured = statements.agg(F.count("*").alias("n"), F.sum(text).alias("bytes")).first()
    parts = max(1, -(-measured.n // SLICE_STATEMENTS), -(-(measured.bytes or 0) // SLICE_BYTES))

    def made() -> Iterator[Broadcast]:
        for k in range(parts):
            some = statements if parts == 1 else statements.where(F.pmod(F.xxhash64("source_path"), F.lit(parts)) == k)
            yield statements.sparkSession.sparkContext.broadcast(_Slice(some.select(*columns).toArrow()))

    return measured.n, parts, made()


def with_known(records: DataFrame, statements: DataFrame) -> DataFrame:
    """records with `known_in`, the roots in which the hint `file` is the name of a file."""
    names = statements.where("file_name is not null").groupBy(F.col("file_name").alias("known_name")).agg(F.collect_set("root_ord").alias("known_in"))
    return records.join(small(names), F.col("file") == F.col("known_name"), "left").drop("known_name")


def _winners(shared: Broadcast, columns: list[str], first: bool, best_in_file: bool):
    """A pass that adds to each record its best statement of a slice, unless an earlier slice had a better one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statements, index = shared.value.opened()
        for batch in batches:
            n = batch.num_rows
            bodies, hints, known = (batch.column(columns.index(c)).to_pylist() for c in ("body", "file", "known_in"))
            before = [None] * n if first else batch.column(len(columns)).to_pylist()
            places, captured, better = np.full(n, -1, np.int64), [None] * n, np.zeros(n, bool)
            for r, (body, hint, roots) in enumerate(zip(bodies, hints, known, strict=True)):
                if body is None:
                    continue
                won = min(index.per_file(body, hint, roots, best_in_file), default=None, key=lambda w: w[0])
                old = before[r]
                if won and (old is None or won[0] < (old["root_ord"], -old["quality"], old["source_path"], old["stmt_idx"])):
                    places[r], captured[r], better[r] = won[1], won[2], True
            stmt = statements.take(pa.array(places, pa.int64(), mask=places < 0))
            values = pa.array(captured, pa.list_(pa.string()))
            if not first:
                stmt = pc.if_else(pa.array(better), stmt, batch.column(len(columns)).cast(stmt.type))
                values = pc.if_else(pa.array(better), values, batch.column(len(columns) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], stmt, values], names=[*columns, "stmt", "captured"])

    return run


def _numbered(records: DataFrame, statements: DataFrame) -> DataFrame:
    """records with `known_in` and a number, written, so that a row keeps its number."""
    return materialise(with_known(records, statements).withColumn(anchors.ID, F.monotonically_increasing_id()), "records")


def _fits(shared: Broadcast, best_in_file: bool):
    """A pass from (ID, body, file, known_in) to (ID, stmt, captured): each record's statement of each file of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statements, index = shared.value.opened()
        for batch in batches:
            rows, places, captured = [], [], []
            for r, (body, hint, known) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                for _, place, values in index.per_file(body, hint, known, best_in_file) if body is not None else ():
                    rows.append(r)
                    places.append(place)
                    captured.append(values)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), statements.take(pa.array(places, pa.int64())), pa.array(captured, pa.list_(pa.string()))], names=[anchors.ID, "stmt", "captured"])

    return run


def _of_files(rows: DataFrame, statements: DataFrame, n: int, best_in_file: bool) -> DataFrame:
    """(ID, stmt, captured): of each file the first statement that fits a numbered record, or its best.

    Most statements are found by joins; those that no anchor tells come in slices, with their fits written one by one.
    """
    fits, others = anchors.meet(rows, statements.select(*STATEMENT, "file_name"), n)
    given = rows.select(anchors.ID, "body", "file", "known_in")
    if not others.isEmpty():
        for shared in slices(others)[2]:
            fits = fits.unionByName(materialise(given.mapInArrow(_fits(shared, best_in_file), fits.schema), "fits"))
    rank = F.struct(-F.col("stmt.quality"), "stmt.stmt_idx") if best_in_file else F.col("stmt.stmt_idx")
    files = [anchors.ID, F.col("stmt.root_ord").alias("lw_root"), F.col("stmt.source_path").alias("lw_path")]
    # Dealt by record, which serves the statements of a file and then the files of a record.
    return fits.repartition(anchors.ID).groupBy(*files).agg(F.min_by(F.struct("stmt", "captured"), rank).alias("won")).select(anchors.ID, "won.*")


def match(records: DataFrame, statements: DataFrame, best_in_file: bool = False) -> DataFrame:
    """Every record with its statement `stmt`, null where none fits, and `captured`, the values of its template.

    A hint (`file`) that is the name of a known file of a root looks at that root's files of that name alone, whether or
    not one fits; any other hint looks at files whose path contains it; without a hint all files are looked at. Of each
    file the first statement that fits counts (with `best_in_file` the best); of these the best of the first root,
    ties of quality broken by path.

    Records pass through tasks and are not shuffled. A catalogue of up to SLICE_STATEMENTS statements is one pass; a
    larger one comes in slices, with what is found so far written between them, so that a task holds one slice whatever
    the catalogue's size. One of more than MOST_SLICES slices is joined instead, so that the work doesn't grow with
    records times slices. Nothing depends on keys of records, so repeated rows stay as they are.
    """
    n, parts, shares = slices(statements)
    if parts > MOST_SLICES:
        rows = _numbered(records, statements)
        of_file = _of_files(rows, statements, n, best_in_file)
        rank = F.struct("stmt.root_ord", -F.col("stmt.quality"), "stmt.source_path", "stmt.stmt_idx")
        won = of_file.groupBy(anchors.ID).agg(F.min_by(F.struct("stmt", "captured"), rank).alias("won")).select(anchors.ID, "won.*")
        return rows.join(won, anchors.ID, "left").drop(anchors.ID, "known_in")
    out = with_known(records, statements)
    columns = out.columns
    described = statements.select(F.struct(*STATEMENT).alias("stmt")).schema["stmt"].dataType
    schema = StructType([*out.schema.fields, StructField("stmt", described), *StructType.fromDDL(_CAPTURED).fields])
    for k, shared in enumerate(shares):
        out = out.mapInArrow(_winners(shared, columns, k == 0, best_in_file), schema)
        if k + 1 < parts:
            out = materialise(out, "matched-so-far")
    return out.drop("known_in")


def _with_paths(shared: Broadcast, columns: list[str], frames: str):
    """A pass that resolves the frames of each record that has a statement; other records have none."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("source_path", pa.string()), ("language", pa.string()), ("line_no", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolved = shared.value.opened()
        for batch in batches:
            has = batch.column(columns.index("stmt")).is_valid()
            found = pc.if_else(has, batch.column(columns.index(frames)), pa.scalar(None, batch.column(columns.index(frames)).type))
            sites = pa.nulls(batch.num_rows, kind)
            if found.null_count < len(found):
                sites = pa.array([None if fs is None else [s for f in fs if (s := _site(f, resolved))["source_path"]] for fs in found.to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, columns, strict=True) if n != frames), sites], names=[*(n for n in columns if n != frames), "exception_trace"])

    return run


def _site(frame: dict, resolved) -> dict:
    path = frame["at"] if frame["language"] == "Python" else resolved(frame["at"])
    return {"name": frame["name"], "source_path": path, "language": frame["language"], "line_no": frame["line_no"]}


def resolve_in_pass(matched: DataFrame, files: DataFrame, frames: str) -> DataFrame | None:
    """matched with `exception_trace` in place of its column of frames, in the same pass; None if there are too many files.

    Paths of source files travel to the tasks if there are at most MOST_FILES.
    """
    if files.limit(MOST_FILES + 1).count() > MOST_FILES:
        return None
    shared = matched.sparkSession.sparkContext.broadcast(_Files(files.select("root_ord", "source_path").toArrow()))
    schema = StructType([*(f for f in matched.schema.fields if f.name != frames), *StructType.fromDDL(f"exception_trace {CALL_SITES}").fields])
    return matched.mapInArrow(_with_paths(shared, matched.columns, frames), schema)


def first_in_files(records: DataFrame, statements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root_ord, source_path, stmt_idx) of the first statement of each file that fits a record."""
    n, parts, shares = slices(statements)
    if parts > MOST_SLICES:
        rows = _numbered(records.select(*keys, "body", "file"), statements)
        found = _of_files(rows, statements, n, False).select(anchors.ID, "stmt.root_ord", "stmt.source_path", "stmt.stmt_idx")
        return rows.select(anchors.ID, *keys).join(found, anchors.ID).drop(anchors.ID)
    given = with_known(records.select(*keys, "body", "file"), statements)
    schema = StructType([*records.select(*keys).schema.fields, *StructType.fromDDL("root_ord int, source_path string, stmt_idx int").fields])

    def pass_of(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, index = shared.value.opened()
            for batch in batches:
                rows, out = [], []
                for r, (body, hint, known) in enumerate(zip(*(batch.column(len(keys) + k).to_pylist() for k in range(3)), strict=True)):
                    for (root, _, path, order), *_ in index.per_file(body, hint, known, False) if body is not None else ():
                        rows.append(r)
                        out.append((root, path, order))
                found = zip(*out, strict=True) if out else ([], [], [])
                types = (pa.int32(), pa.string(), pa.int32())
                columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(keys)]] + [pa.array(c, t) for c, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "root_ord", "source_path", "stmt_idx"])

        return run

    # A file lies in one slice, so each slice is a branch of its own.
    passes = [given.mapInArrow(pass_of(shared), schema) for shared in shares]
    out = passes[0]
    for more in passes[1:]:
        out = out.union(more)
    return out
