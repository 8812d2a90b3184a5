"""The statement catalogue: built from source files, kept in step with change feeds, and stored as tables."""

from __future__ import annotations

import hashlib
import logging
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import paths
from logweave.sources.extract import statements
from logweave.sources.tree import SNAPSHOT
from logweave.tables import delete_folder

log = logging.getLogger(__name__)

#: Layout of stored catalogues; others are rebuilt.
REVISION = 3
STATEMENTS = (
    "root string, file_id long, source_path string, language string, stmt_idx int, line_no int, end_line_no int, column int, name string, text string, quality int, "
    "pattern string, executable string, prefix string, args array<struct<kind:string,name:string,pos:int>>, vars array<string>, exprs array<string>"
)
_ARG = pa.struct([("kind", pa.string()), ("name", pa.string()), ("pos", pa.int32())])
_TYPES = {
    "stmt_idx": pa.int32(), "line_no": pa.int32(), "end_line_no": pa.int32(), "column": pa.int32(), "name": pa.string(), "text": pa.string(), "quality": pa.int32(), "pattern": pa.string(),
    "executable": pa.string(), "prefix": pa.string(), "args": pa.list_(_ARG), "vars": pa.list_(pa.string()), "exprs": pa.list_(pa.string()),
}


#: Statements, and characters of their texts and functions, that are put out together.
BATCH_STATEMENTS, BATCH_CHARS = 5_000, 8 << 20
#: Files that a task parses, about, where a table of files comes in few parts.
FILES_A_TASK = 20_000


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files, rows, chars = [], [], 0

    def batch_of() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*files, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)]
        columns += [pa.array([tuple_to_dict(r[k]) if k == "args" else r[k] for r in rows], t) for k, t in _TYPES.items()]
        return pa.RecordBatch.from_arrays(columns, names=["root", "file_id", "source_path", "language", *_TYPES])

    for batch in batches:
        for root, file_id, path, language, code in zip(*(batch.column(i) for i in range(5)), strict=True):
            language = language.as_py()
            for row in statements(code.as_py(), language):
                files.append((root.as_py(), file_id.as_py(), path.as_py(), language))
                rows.append(row)
                chars += 3 * len(row["text"]) + len(row["name"])
                if len(rows) >= BATCH_STATEMENTS or chars >= BATCH_CHARS:
                    yield batch_of()
                    files, rows, chars = [], [], 0
    if rows:
        yield batch_of()


def dealt(files: DataFrame, key: str) -> DataFrame:
    """A table of files dealt over tasks by a key: parsing takes long for what a file's row weighs, which readers go by."""
    parts = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES_A_TASK))
    return files.repartition(parts, key)


def tuple_to_dict(args: list[tuple]) -> list[dict]:
    return [dict(zip(("kind", "name", "pos"), a, strict=True)) for a in args]


def extract(sources: DataFrame) -> DataFrame:
    """Statements of source files (root, path, language, file_id, content); source_path is below the root's path."""
    full = F.concat(F.col("root"), F.lit("/"), F.col("path"))
    read = sources.select("root", "file_id", full.alias("path"), "language", "content")
    return read.mapInArrow(_extract, STATEMENTS)


def update(catalogue: DataFrame, feed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalogue without the files that the feed deletes, with the fresh statements."""
    gone = feed.where("event = 'DeletedFile'").select("root", "file_id")
    return catalogue.join(gone, ["root", "file_id"], "left_anti").unionByName(fresh)


def summary(feed: DataFrame) -> DataFrame:
    """deleted, new and changes, the sum of both."""
    out = feed.agg(F.count_if(F.col("event") == "DeletedFile").alias("deleted"), F.count_if(F.col("event") == "NewFile").alias("new"))
    return out.withColumn("changes", F.col("deleted") + F.col("new"))


def root_order(roots: list[str]) -> Column:
    """The place of `root` among the registered ones."""
    return F.create_map(*[x for i, r in enumerate(roots) for x in (F.lit(r), F.lit(i))])[F.col("root")]


def for_matching(catalogue: DataFrame, roots: list[str]) -> DataFrame:
    """Statements with root_ord, the root's place among the registered ones, and file_name."""
    return catalogue.withColumns({"root_ord": root_order(roots), "file_name": paths.file_name(F.col("source_path"))})


def source_files(snapshot: DataFrame, roots: list[str]) -> DataFrame:
    """(root_ord, source_path) of all source files, with or without statements."""
    return snapshot.where("kind = 'File'").select(root_order(roots).alias("root_ord"), F.concat("root", F.lit("/"), "path").alias("source_path"))


#: What makes two statements equal: their place, function, text and values.
IDENTITY = ("line_no", "column", "name", "text", "vars")


def same(one: str, two: str) -> Column:
    """Whether two struct columns of statements are equal, whatever their files and templates."""
    return reduce(Column.__and__, [F.col(f"{one}.{c}").eqNullSafe(F.col(f"{two}.{c}")) for c in IDENTITY])


def display(stmt: str) -> Column:
    """A statement struct in one line: line, column, text, function and values."""
    part = lambda c: F.col(f"{stmt}.{c}")
    quoted = F.concat(F.lit("["), F.array_join(F.transform(part("vars"), lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ", "), F.lit("]"))
    return F.format_string("[Line: %d, Col: %d] source `%s` name `%s` vars=%s", part("line_no"), part("column"), part("text"), part("name"), quoted)


def of_file(catalogue: DataFrame, path: str) -> DataFrame:
    return catalogue.where(F.col("source_path") == path)


def cache_name(root: str) -> str:
    return f"cache.{hashlib.sha256(root.encode()).hexdigest()}"


_HEADER = "revision int, format string, path string, generation long, folder string, next_id long, whole boolean"
_SNAPSHOT = f"{SNAPSHOT}, generation long, gone boolean"
_GONE = "file_id long"
#: Generations that are read together before they are written as one.
MOST_DELTAS = 16


def _headers(spark: SparkSession, base: str) -> list:
    """The store's headers, the newest first; none if there is no store or its headers can't be read."""
    try:
        return spark.read.schema(_HEADER).json(f"{base}/header").where("generation is not null").orderBy(F.desc("generation")).collect()
    except (PySparkException, Py4JJavaError):
        return []


def _chain(headers: list) -> list:
    """The newest whole generation and those after it, the newest first; others are history."""
    whole = next((k for k, h in enumerate(headers) if h.whole), len(headers) - 1)
    return headers[: whole + 1]


def _merged(spark: SparkSession, base: str, chain: list) -> tuple[DataFrame, DataFrame]:
    """Catalogue and snapshot of a chain: statements of files that no generation lists as gone, and each path's last row.

    Ids of files are never used again, so it doesn't matter in which generation a file went.
    """
    at = lambda name: [f"{base}/{h.folder}/{name}" for h in chain]
    statements = spark.read.schema(STATEMENTS).parquet(*at("statements"))
    rows = spark.read.schema(_SNAPSHOT).parquet(*at("snapshot"))
    columns = [c.split()[0] for c in SNAPSHOT.split(", ")]
    if len(chain) == 1:
        return statements, rows.select(*columns)
    gone = spark.read.schema(_GONE).parquet(*at("gone"))
    last = rows.groupBy("path").agg(F.max_by(F.struct(*columns, "gone"), "generation").alias("row")).where("not row.gone")
    return statements.join(gone, "file_id", "left_anti"), last.select(*(f"row.{c}" for c in columns))


def _write(spark: SparkSession, base: str, generation: int, root: str, next_id: int, whole: bool, statements: DataFrame, snapshot: DataFrame, gone: DataFrame | None):
    at = f"generation-{uuid.uuid4().hex}"
    statements.write.parquet(f"{base}/{at}/statements")
    snapshot.withColumn("generation", F.lit(generation).cast("long")).select(*(c.split()[0] for c in _SNAPSHOT.split(", "))).write.parquet(f"{base}/{at}/snapshot")
    if gone is not None:
        gone.write.parquet(f"{base}/{at}/gone")
    else:
        spark.createDataFrame([], _GONE).write.parquet(f"{base}/{at}/gone")
    header = spark.createDataFrame([(REVISION, "parquet", root, generation, at, next_id, whole)], _HEADER)
    header.coalesce(1).write.mode("append").json(f"{base}/header")
    return header.first()


def append(statements: DataFrame, snapshot: DataFrame, gone: DataFrame, folder: str, root: str, next_id: int, anew: bool) -> tuple[DataFrame, DataFrame]:
    """Adds a generation to a root's store and gives its catalogue and snapshot.

    A generation holds what changed alone: statements of new files, snapshot rows that are new, changed or (`gone`)
    vanished, and ids of deleted files; so a changed file costs its own rows whatever the size of the root. Its header
    is added last, by one rename, so a store cut short shows the generation before. `anew` begins with these rows as
    a whole. After MOST_DELTAS generations the merged tables are written as a whole one; folders that only older
    wholes refer to are deleted then, so tables that were read before stay readable until the next time.
    """
    base = f"{folder}/{cache_name(root)}"
    spark = statements.sparkSession
    known = _headers(spark, base)
    number = known[0].generation + 1 if known else 0
    made = _write(spark, base, number, root, next_id, anew, statements, snapshot, gone)
    chain = [made] if anew else [made, *_chain(known)]
    if len(chain) > MOST_DELTAS:
        merged = _merged(spark, base, chain)
        whole = _write(spark, base, number + 1, root, next_id, True, merged[0], merged[1].withColumn("gone", F.lit(False)), None)
        kept = {h.folder for h in chain}
        for old in known:
            if old.folder not in kept:
                delete_folder(spark, f"{base}/{old.folder}")
        chain = [whole]
    return _merged(spark, base, chain)


def load(spark: SparkSession, folder: str, root: str) -> tuple[DataFrame, DataFrame, int] | None:
    """A root's stored catalogue, snapshot and next file id; None if there is none, if it is of another revision or can't be read.

    Only the ends of its files are read to see that they are whole.
    """
    base = f"{folder}/{cache_name(root)}"
    known = _headers(spark, base)
    if not known:
        return None
    if known[0].revision != REVISION:
        log.info("old catalogue entry for %s", root)
        return None
    try:
        chain = _chain(known)
        for name in ("statements", "snapshot", "gone"):
            spark.read.parquet(*(f"{base}/{h.folder}/{name}" for h in chain)).select().count()
        return *_merged(spark, base, chain), known[0].next_id
    except (PySparkException, Py4JJavaError) as e:
        log.warning("failed to read the stored catalogue of %s, building it again: %s", root, str(e)[:200])
        return None
