"""Command line: maps a log to the statements of source trees and prints JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Observation, SparkSession

from logweave.engine import Engine
from logweave.errors import LogweaveError
from logweave.tables import new_folder


def _standard_input(spark: SparkSession) -> str:
    """Copies standard input to a file in the shared folder, a piece at a time, so that tasks can read it."""
    at = new_folder(spark, "stdin")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/stdin.log")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    source = getattr(sys.stdin, "buffer", sys.stdin)
    while piece := source.read(1 << 20):
        out.write(bytearray(piece))
    out.close()
    return path.toString()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="logweave", description=__doc__)
    parser.add_argument("-d", "--sources", action="append", required=True, help="a source root; may be given more than once")
    parser.add_argument("-l", "--log", help="path of the log, in any store that Spark reads; standard input if not given")
    parser.add_argument("-f", "--format", help="regular expression with a group named body")
    parser.add_argument("-s", "--start", type=int, default=0, help="lines to leave out")
    parser.add_argument("-c", "--count", type=int, help="records to map")
    parser.add_argument("-o", "--output", help="folder for the JSON lines; printed if not given")
    parser.add_argument("--store", help="folder that keeps the statement catalogue")
    parser.add_argument("-v", "--verbose", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("logweave").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    try:
        engine = Engine(spark, args.store)
        for root in args.sources:
            engine.add_root(root)
        engine.refresh()
        for r in engine.unreadable.select("root", "path").toLocalIterator():
            print(f"warning: cannot read {r.root}/{r.path}", file=sys.stderr)
        counted = Observation("mapping")
        rows = engine.map_log(args.log or _standard_input(spark), args.format, args.start, args.count, counted if args.verbose else None)
        if args.output:
            rows.select("json").write.text(args.output)
        else:
            for r in rows.orderBy("path", "first_line").toLocalIterator():
                print(r.json)
        if args.verbose:
            print(", ".join(f"{k}: {v}" for k, v in counted.get.items()), file=sys.stderr)
    except LogweaveError as e:
        print(f"error: {e}" + (f"\nhelp: {e.help}" if e.help else ""), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
