"""The engine as one object: roots, catalogue and the way from a log to mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logweave.errors import CannotReadLog, NoLogMessages, NoLogStatements
from logweave.functions.formats import LogFormat
from logweave.operators import derive, emit, match, records
from logweave.sources import blocks, catalog, lines, tree
from logweave.tables import materialise, new_folder

KEYS = ["path", "rec_id"]


class Engine:
    """Keeps the statements of source roots and maps logs to them.

    Every table that outlives a call is written, to the store or else to the session's shared folder, so what a call
    returns doesn't depend on the state of files later on.
    """

    def __init__(self, spark: SparkSession, store: str | None = None) -> None:
        self.spark, self.store = spark, store
        self.roots = tree.Roots()
        #: Per root, by its place: snapshot and catalogue.
        self.tables: dict[str, tuple[DataFrame, DataFrame]] = {}
        #: Per root the id that its next new file gets; ids are never used again.
        self.next_id: dict[str, int] = {}
        #: Roots whose store is what the tables are of.
        self.kept: set[str] = set()
        self._own_store = store or new_folder(spark, "store")
        self.unreadable = spark.createDataFrame([], "root string, path string, language string, file_id long")

    def add_root(self, root: str) -> None:
        if not self.roots.add(root):
            return
        at = self.roots.paths[-1]
        found = catalog.load(self.spark, self.store, at) if self.store else None
        if found:
            self.tables[at], self.next_id[at] = (found[1], found[0]), found[2]
            self.kept.add(at)
        else:
            self.tables[at] = (self.spark.createDataFrame([], tree.SNAPSHOT), self.spark.createDataFrame([], catalog.STATEMENTS))
            self.next_id[at] = 0

    @property
    def snapshot(self) -> DataFrame:
        return self._all(0, tree.SNAPSHOT)

    @property
    def catalogue(self) -> DataFrame:
        return self._all(1, catalog.STATEMENTS)

    def _all(self, which: int, schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [t[which] for t in self.tables.values()] or [self.spark.createDataFrame([], schema)])

    def refresh(self) -> DataFrame:
        """Brings the catalogue in step with the roots; returns the change feed.

        `unreadable` then has the files that could not be read and the entries that could not be listed.
        """
        listed = [self.spark.createDataFrame([], "root string, path string, kind string, language string, mtime timestamp")]
        for root in self.roots.paths:
            listed.append(tree.list_tree(self.spark, root, tree.read_ignore(root)))
        current = materialise(reduce(DataFrame.unionByName, listed), "listed")
        tops = self.spark.createDataFrame([(r, n - 1) for r, n in self.next_id.items()], "root string, top long")
        snapshot, feed = tree.sync(self.snapshot, current, tops)
        changes = materialise(tree.delta(self.snapshot, materialise(snapshot, "snapshot")), "snapshot-delta")
        feed = materialise(feed, "feed")
        sources, unreadable = tree.read_sources(feed)
        errors = current.where("kind = 'Error'").select("root", "path", "language", F.lit(None).cast("long").alias("file_id"))
        self.unreadable = unreadable.unionByName(errors)
        fresh = materialise(catalog.extract(sources), "statements")
        gone = feed.where("event = 'DeletedFile'")
        tops = {r.root: r.top for r in feed.groupBy("root").agg(F.max("file_id").alias("top")).collect()}  # a row for each root
        changed = {r.root for r in changes.select("root").distinct().collect()}
        for root in self.roots.paths:
            own = F.col("root") == root
            self.next_id[root] = max(self.next_id[root], tops.get(root, -1) + 1)
            if root in changed:
                rows = (fresh.where(own), changes.where(own), gone.where(own).select("file_id"))
                stored = catalog.append(*rows, self._own_store, root, self.next_id[root], root not in self.kept)
                self.tables[root] = (stored[1], stored[0])
                self.kept.add(root)
        return feed

    @property
    def is_empty(self) -> bool:
        return self.catalogue.isEmpty()

    def statements(self) -> DataFrame:
        return catalog.for_matching(self.catalogue, self.roots.paths)

    def map_lines(self, found: DataFrame, fmt: LogFormat | None, start: int = 0, count: int | None = None) -> DataFrame:
        """Mappings of numbered lines: records with stmt, variables and exception_trace."""
        found = records.start_at(found, start)
        made = records.assemble(found, fmt) if fmt else records.bare_records(found)
        if fmt and count is not None:
            made = records.first_records(made, count)
        return self.map_records(made, fmt)

    def map_records(self, made: DataFrame, fmt: LogFormat | None) -> DataFrame:
        """Mappings of assembled records, which are read and matched once."""
        matched = match.match(records.parse(made, fmt), self.statements())
        traced = derive.with_call_sites(matched, catalog.source_files(self.snapshot, self.roots.paths), KEYS)
        return traced.withColumn("variables", derive.variables(F.col("body"), F.col("stmt"), F.col("captured")))

    def map_log(self, path: str, fmt: str | None = None, start: int = 0, count: int | None = None, observation: Observation | None = None) -> DataFrame:
        """JSON lines (path, first_line, json) of a log's mappings and of its lines that are no UTF-8.

        The log is read twice: once to number its lines and records, which also tells whether there are any, and once
        to map them. `observation` gets records, matched, traces and unreadable_lines, counted while the rows are
        read. Packed files, stores that only Spark reads, and logs of which lines are left out are numbered by a
        shuffle instead.
        """
        parsed = LogFormat.parse(fmt) if fmt else None
        if self.is_empty:
            raise NoLogStatements("no log statements found")
        try:
            index = blocks.index_log(self.spark, path, parsed) if not start else None
            if index is not None:
                return self._map_index(materialise(index, "log-index"), parsed, count, observation)
            found = lines.read_lines(self.spark, path)
        except PySparkException as e:
            raise CannotReadLog(f"cannot read log file {path}") from e
        # A line that begins a record is looked for first, which mostly ends after a few lines.
        seen = found.where(F.col("line_no") >= start) if start else lines.marked_lines(self.spark.read.option("lineSep", "\n").text(path))
        if parsed and (count == 0 or seen.where(F.col("ok") & parsed.matches(F.col("value"))).isEmpty()):
            raise NoLogMessages("no log messages found in input")
        rows = self.map_found(found, parsed, start, count).drop("failed")
        return rows if observation is None else rows.observe(observation, F.count("*").alias("rows"))

    def _map_index(self, index: DataFrame, fmt: LogFormat | None, count: int | None, observation: Observation | None) -> DataFrame:
        if fmt and (count == 0 or not index.agg(F.sum("begins")).first()[0]):
            raise NoLogMessages("no log messages found in input")
        made = blocks.read_records(index, fmt)
        if fmt and count is not None:
            made = made.where(~F.col("ok") | (F.col("rec_id") <= count))
        mapped = self.map_records(made, fmt)
        if observation is not None:
            ok = F.col("ok")
            counts = {"records": ok, "matched": ok & F.col("stmt").isNotNull(), "traces": ok & F.col("trace").isNotNull(), "unreadable_lines": ~ok}
            mapped = mapped.observe(observation, *(F.count_if(x).alias(n) for n, x in counts.items()))
        json = F.when(F.col("ok"), emit.mapping_json(mapped)).otherwise(emit.error_json(F.col("first_line")))
        return mapped.select("path", "first_line", json.alias("json"))

    def map_found(self, found: DataFrame, fmt: LogFormat | None, start: int = 0, count: int | None = None) -> DataFrame:
        """(path, first_line, json, failed) of the mappings of numbered lines, and of their lines that are no UTF-8."""
        mapped = self.map_lines(found.where("ok"), fmt, start, count)
        bad = found.where(~F.col("ok") & (F.col("line_no") >= start))
        rows = mapped.select("path", "first_line", emit.mapping_json(mapped).alias("json"), F.lit(False).alias("failed"))
        return rows.unionByName(bad.select("path", F.col("line_no").alias("first_line"), emit.error_json(F.col("line_no") - start).alias("json"), F.lit(True).alias("failed")))
