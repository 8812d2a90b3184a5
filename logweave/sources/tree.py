"""Source trees as snapshots of path rows, and the change feed between two snapshots."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import paths
from logweave.tables import materialise

SNAPSHOT = "root string, path string, kind string, language string, mtime timestamp, file_id long"


@dataclass
class Roots:
    """Registered roots in order. A root below a registered one is left out; one above is kept beside it."""

    paths: list[str] = field(default_factory=list)

    def add(self, root: str) -> bool:
        resolved = str(Path(root).resolve()) if Path(root).exists() else root.rstrip("/") or "/"
        if self.match(resolved) is not None:
            return False
        self.paths.append(resolved)
        return True

    def match(self, path: str) -> str | None:
        """The first root that covers the path."""
        return next((r for r in self.paths if Path(path).is_relative_to(r)), None)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def read_ignore(root: str) -> str | None:
    """The text of a root's own ignore file, in any store that trees are listed in; None if it has none."""
    try:
        where, base = filesystem(root)
        with where.open_input_stream(f"{base}/.gitignore", compression=None) as source:
            return source.read().decode(errors="replace")
    except OSError:
        return None


_ENTRIES = "path string, is_dir boolean, is_file boolean, readable boolean, mtime timestamp"


def _entries(where: fs.FileSystem, base: str, path: str) -> Iterator[tuple]:
    """The entries of one folder, by names below the base. Links are neither files nor folders.

    A folder that can't be listed gives one row for itself, not readable.
    """
    at = f"{base}/{path}" if path else base
    name = lambda x: f"{path}/{x}" if path else x
    try:
        if isinstance(where, fs.LocalFileSystem):
            with os.scandir(at) as found:
                for e in found:
                    try:
                        known = e.stat(follow_symlinks=False)
                        yield name(e.name), e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False), True, datetime.fromtimestamp(known.st_mtime, timezone.utc)
                    except OSError:
                        yield name(e.name), False, False, False, None
        else:
            for e in where.get_file_info(fs.FileSelector(at)):
                yield name(e.base_name), e.type == fs.FileType.Directory, e.type == fs.FileType.File, True, e.mtime
    except OSError:
        yield path, True, False, False, None


def _list_folders(root: str):
    """Lists the folders of a batch, each by itself, in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(_entries(where, base, path))
                types = (pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.timestamp("us", "UTC"))
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "is_dir", "is_file", "readable", "mtime"])

    return run


def list_tree(spark: SparkSession, root: str, ignore: str | None = None) -> DataFrame:
    """(root, path, kind, language, mtime) of all files and folders below a root, paths relative to it.

    Level by level, tasks list the folders of the level before, each folder on its own. Folders of version control
    systems and what the root's own ignore rules (the text of its ignore file) name are left out before they are
    listed. Links are of kind Unknown and not followed; what can't be listed or looked up is of kind Error. A root
    that is no folder has no entries.
    """
    rules = paths.ignore_rules(ignore or "")
    wanted = ~paths.is_vcs(F.col("path")) & ~paths.is_ignored(F.concat("path", F.when(F.col("is_dir"), "/").otherwise("")), rules)
    where, base = filesystem(root)
    there = where.get_file_info(base).type == fs.FileType.Directory
    folders = spark.createDataFrame([("",)] if there else [], "path string")
    levels = [spark.createDataFrame([], _ENTRIES)]
    while not folders.isEmpty():
        level = folders.repartition("path").mapInArrow(_list_folders(root), _ENTRIES).where(wanted)
        levels.append(materialise(level, "tree-level"))
        folders = levels[-1].where("is_dir and readable").select("path")
    rows = reduce(DataFrame.union, levels)
    # A folder that turned out not to be readable counts once, as such.
    return classify(rows.groupBy("path").agg(F.max("is_dir").alias("is_dir"), F.max("is_file").alias("is_file"), F.min("readable").alias("readable"), F.max("mtime").alias("mtime")), F.lit(root))


def classify(rows: DataFrame, root: Column) -> DataFrame:
    """Rows (path, is_dir, is_file, readable, mtime) with kind and language."""
    kind = paths.kind(F.col("path"), F.col("is_dir"), F.col("readable"), F.col("is_file"))
    return rows.select(root.alias("root"), "path", kind.alias("kind"), F.when(kind == "File", paths.language(F.col("path"))).alias("language"), "mtime")


def sync(previous: DataFrame, current: DataFrame, tops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The new snapshot with file ids and the change feed (event, root, path, language, file_id).

    A file is unchanged if its modification time is; otherwise the old id is deleted and the path gets a new one. New
    ids follow the largest id ever used in the root, in the order of path components; deletions come first. `tops`
    (root, top) has those largest ids; without it they are those of the previous snapshot. Ids are
    dealt by ranks within leading path components, so no root has to be ordered in one task.
    """
    old, new = previous.alias("old"), current.alias("new")
    joined = old.join(new, (F.col("old.root") == F.col("new.root")) & (F.col("old.path") == F.col("new.path")), "full_outer")
    same = F.col("old.kind").eqNullSafe(F.col("new.kind")) & (F.col("old.mtime").eqNullSafe(F.col("new.mtime")) | (F.col("new.kind") != "File"))
    pairs = joined.select(
        F.coalesce("new.root", "old.root").alias("root"), F.coalesce("new.path", "old.path").alias("path"),
        F.col("new.kind").alias("kind"), F.col("new.language").alias("language"), F.col("new.mtime").alias("mtime"),
        F.col("old.kind").alias("old_kind"), F.col("old.language").alias("old_language"), F.col("old.file_id").alias("old_id"),
        (F.col("new.path").isNotNull() & F.coalesce(same, F.lit(False))).alias("kept"),
    )
    top = previous.groupBy("root").agg(F.max("file_id").alias("top")) if tops is None else tops
    fresh = pairs.where("kind = 'File' and not kept")
    ids = number(fresh.select("root", "path"), "root", F.split("path", "/"))
    ids = ids.join(top, "root", "left").select("root", "path", (F.coalesce("top", F.lit(-1)) + F.col("rank")).alias("new_id"))
    named = pairs.join(ids, ["root", "path"], "left")
    snapshot = named.where("kind is not null").select("root", "path", "kind", "language", "mtime", F.when(F.col("kept"), F.col("old_id")).otherwise(F.col("new_id")).alias("file_id"))
    deleted = named.where("old_kind = 'File' and not kept").select(F.lit("DeletedFile").alias("event"), "root", "path", F.col("old_language").alias("language"), F.col("old_id").alias("file_id"))
    added = named.where("kind = 'File' and not kept").select(F.lit("NewFile").alias("event"), "root", "path", "language", F.col("new_id").alias("file_id"))
    return snapshot, deleted.unionByName(added)


def delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of a snapshot that the previous one hasn't, with `gone` false, and those of paths that vanished, with `gone` true."""
    old, new = previous.alias("old"), current.alias("new")
    equal = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in current.columns]
    there = (F.col("old.root") == F.col("new.root")) & (F.col("old.path") == F.col("new.path"))
    changed = new.join(old, reduce(Column.__and__, equal, there), "left_anti").withColumn("gone", F.lit(False))
    return changed.unionByName(old.join(new, there, "left_anti").withColumn("gone", F.lit(True)))


def number(rows: DataFrame, group: str, order: Column) -> DataFrame:
    """rows with `rank`, 1 for the first of each group by `order`: ranks within leading components, then offsets.

    Only the counts of leading components meet in one window, not the rows of a group.
    """
    keyed = rows.withColumn("lw_order", order).withColumn("lw_lead", F.slice("lw_order", 1, 2))
    inner = keyed.withColumn("lw_inner", F.row_number().over(Window.partitionBy(group, "lw_lead").orderBy("lw_order")))
    counts = keyed.groupBy(group, "lw_lead").agg(F.count("*").alias("lw_n"))
    before = F.sum("lw_n").over(Window.partitionBy(group).orderBy("lw_lead").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, "lw_lead", F.coalesce(before, F.lit(0)).alias("lw_before"))
    return inner.join(offsets, [group, "lw_lead"]).withColumn("rank", F.col("lw_before") + F.col("lw_inner")).drop("lw_order", "lw_lead", "lw_inner", "lw_before")


def stats(snapshot: DataFrame) -> DataFrame:
    """Per root: files, unsupported_files, directories, errors."""
    return snapshot.groupBy("root").agg(
        F.count_if(F.col("kind") == "File").alias("files"), F.count_if(F.col("kind") == "UnsupportedFile").alias("unsupported_files"),
        F.count_if(F.col("kind") == "Directory").alias("directories"), F.count_if(F.col("kind") == "Error").alias("errors"),
    )


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            where, base = filesystem(row.column(0)[0].as_py())
            try:
                with where.open_input_stream(f"{base}/{row.column(1)[0].as_py()}", compression=None) as source:
                    content = source.read()
            except OSError:
                content = None
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], names=[*row.schema.names, "bytes"])


def read_sources(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contents of the feed's new files, and rows for those that can't be read or aren't UTF-8; each is read once, in tasks."""
    new = feed.where("event = 'NewFile'").select("root", "path", "language", "file_id").repartition("root", "path")
    found = materialise(new.mapInArrow(_read_files, "root string, path string, language string, file_id long, bytes binary"), "sources")
    good = F.col("bytes").isNotNull() & F.is_valid_utf8(F.col("bytes").cast("string"))
    return found.where(good).select("root", "path", "language", "file_id", F.col("bytes").cast("string").alias("content")), found.where(~good).drop("bytes")
