"""Values and call sites that follow from a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import paths
from logweave.operators import match
from logweave.tables import materialise

# Frames of stack traces. A class name has no $, so a frame of an inner class is named from its class on.
JAVA_FRAME = r"(?m)^\s+at\s+((?:[^.\n(]+\.)*)([^.$\n(]+)\.(\S+)\(([^:]+):(\d+)\)\s*$"
PYTHON_FRAME = r"(?m)^\s+File\s+\"([^\"]+)\",\s+line\s+(\d+),\s+in\s+([^\n]+)$"


def variables(body: Column, stmt: Column, captured: Column | None = None) -> Column:
    """array<struct<expr, value>> of the values that the statement's template captures, in order; empty without a match.

    `captured` has the values where matching has found them already.
    """
    n = F.size(stmt["exprs"])
    if captured is None:
        captured = F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("regexp_extract", body, stmt["executable"], i))
    values = F.zip_with(stmt["exprs"], captured, lambda e, v: F.struct(e.alias("expr"), v.alias("value")))
    empty = F.array().cast("array<struct<expr:string,value:string>>")
    return F.when(stmt.isNotNull() & (n > 0), values).otherwise(empty)


def frames(trace: Column, language: Column) -> Column:
    """array<struct<name, at, language, line_no>> of a trace's frames, null if it has none that can be told.

    `at` is the path of the file below some folder (Java, by package and file name) or as stated (Python). Other
    languages have no frames.
    """

    def of(pattern: str, name: int, line: int, at, kind: str) -> Column:
        group = lambda k: F.regexp_extract_all(trace, F.lit(pattern), F.lit(k))
        rows = F.arrays_zip(group(name).alias("name"), at(group).alias("at"), group(line).alias("line"))
        return F.transform(rows, lambda f: F.struct(f["name"].alias("name"), f["at"].alias("at"), F.lit(kind).alias("language"), f["line"].try_cast("int").alias("line_no")))

    java_path = lambda group: F.zip_with(group(1), group(4), lambda pkg, file: F.concat(F.replace(pkg, F.lit("."), F.lit("/")), file))
    java, python = of(JAVA_FRAME, 3, 5, java_path, "Java"), of(PYTHON_FRAME, 3, 2, lambda group: group(1), "Python")
    return F.when(language == "Java", java).when(language == "Python", python)


def suffixes(files: DataFrame) -> DataFrame:
    """(suffix, root_ord, source_path): a row for each run of last components of each file's path, the index of find_file."""
    parts = F.split("source_path", "/")
    lengths = F.sequence(F.lit(1), F.size(parts))
    ends = F.transform(lengths, lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    return files.select(F.explode(ends).alias("suffix"), "root_ord", "source_path")


def find_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(wanted, root_ord, source_path, direct) of all files that the relative paths `wanted` may mean.

    The last component is the file's name, the others are folders above it, in order. Where none lie between them the
    file is found by its suffix; the others by name and first component. Both are joins on equal keys.
    """
    asked = wanted.select("wanted").where("wanted is not null").distinct()
    direct = asked.join(suffixes(files), F.col("wanted") == F.col("suffix")).select("wanted", "root_ord", "source_path", F.lit(True).alias("direct"))
    parts = F.split("source_path", "/")
    folders = files.select("root_ord", "source_path", paths.file_name(F.col("source_path")).alias("file_name"), F.explode(F.array_distinct(F.slice(parts, 1, F.size(parts) - 1))).alias("folder"))
    split = F.split("wanted", "/")
    keyed = asked.where("wanted like '%/%'").select("wanted", F.element_at(split, -1).alias("file_name"), F.element_at(split, 1).alias("folder"))
    apart = keyed.join(folders, ["file_name", "folder"]).where(paths.holds_in_order(parts, F.split("wanted", "/")) & ~paths.find_suffix(F.col("source_path"), F.col("wanted")))
    return direct.unionByName(apart.select("wanted", "root_ord", "source_path", F.lit(False).alias("direct")))


def resolve(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(wanted, source_path): the file that each relative path means, for those that mean one.

    Of several files the first root's counts, of these one without folders between, then the first by path.
    """
    best = F.min(F.struct("root_ord", ~F.col("direct"), "source_path")).alias("best")
    return find_files(wanted, files).groupBy("wanted").agg(best).select("wanted", "best.source_path")


def call_sites(traces: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, name, source_path, language, line_no) of the frames of `trace`, for rows with a trace.

    A Java frame is resolved to a file by its package and file name; frames that no file resolves are left out. Python
    frames state their path.
    """
    listed = traces.where("trace is not null").select(*keys, F.posexplode(frames(F.col("trace"), F.col("trace_language"))).alias("pos", "f")).select(*keys, "pos", "f.*")
    found = resolve(listed.where("language = 'Java'").select(F.col("at").alias("wanted")), files)
    path = F.when(F.col("language") == "Python", F.col("at")).otherwise(F.col("source_path"))
    sites = listed.join(found, (F.col("language") == "Java") & (F.col("at") == F.col("wanted")), "left").withColumn("source_path", path)
    return sites.where("source_path is not null").select(*keys, "pos", "name", "source_path", "language", "line_no")


def with_call_sites(matched: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """matched with `exception_trace`, an array of call sites, filled only where a statement matched.

    Frames are parsed inside the row and resolved in the pass that matches, so the log is read and matched once. Where
    there are too many source files for tasks to hold, what is matched is written once, its traces are joined with the
    files and joined back by the keys.
    """
    parsed = matched.withColumn("lw_frames", F.when(F.col("stmt").isNotNull() & F.col("trace").isNotNull(), frames(F.col("trace"), F.col("trace_language"))))
    found = match.resolve_in_pass(parsed, files, "lw_frames")
    if found is not None:
        return found
    matched = materialise(matched, "matched")
    sites = call_sites(matched.where("trace is not null and stmt is not null"), files, keys)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "source_path", "language", "line_no"))), lambda x: x.dropFields("pos"))
    return matched.join(sites.groupBy(*keys).agg(in_order.alias("exception_trace")), keys, "left")
