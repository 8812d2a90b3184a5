import json
import time

from pyspark.sql import functions as F

from logweave.engine import Engine
from logweave.functions.formats import LogFormat
from logweave.operators import records
from logweave.plans import inputs
from logweave.streaming.stream import assemble_stream, map_log_files, map_stream


def test_stream_equals_batch(spark, tmp_path):
    lines = []
    for f in ("a", "b"):
        n = 0
        for i in range(6):
            lines.append((f, n, f"2024-01-01 00:00:0{i} INFO Tracker:5 [7] click on item {i}"))
            lines.append((f, n + 1, f"more {i}"))
            n += 2
    rows = spark.createDataFrame(lines, "path string, line_no long, value string").coalesce(1)
    for k in range(3):
        rows.where((F.col("line_no") >= 4 * k) & (F.col("line_no") < 4 * k + 4)).write.mode("append").parquet(str(tmp_path / "in"))
    fmt = inputs.log_format()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = assemble_stream(stream, fmt, 600_000).writeStream.format("memory").queryName("made").outputMode("append").start()
    until = time.time() + 90
    while spark.table("made").count() < 10 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    batch = records.assemble(rows, fmt, block_lines=3).where("rec_id < 6")
    got = [tuple(r) for r in spark.table("made").select("path", "rec_id", "first_line", "content").collect()]
    assert sorted(got) == sorted((r.path, r.rec_id, r.first_line, r.content) for r in batch.collect())


def test_lines_after_the_flush_are_kept(spark, tmp_path):
    fmt = inputs.log_format()
    head = "2024-01-01 00:00:0{} INFO Tracker:5 [7] click on item {}"
    given = [[(0, head.format(1, 1)), (1, "more 1")], [(2, "late 1"), (3, "late 2")], [(4, "later"), (5, head.format(2, 2))], [(6, "more 2")]]
    at, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    put = lambda rows: spark.createDataFrame([("a", n, v) for n, v in rows], "path string, line_no long, value string").coalesce(1).write.mode("append").parquet(at)
    put(given[0])
    stream = spark.readStream.schema("path string, line_no long, value string").parquet(at)
    rows = []
    each = lambda df, n: rows.extend(tuple(r) for r in df.select("rec_id", "part", "first_line", "content").collect())
    query = assemble_stream(stream, fmt, 500).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
    for k in range(4):
        until = time.time() + 90
        while len(rows) < (1, 2, 4, 5)[k] and time.time() < until:  # until the open record has gone out
            time.sleep(0.3)
        if k < 3:
            put(given[k + 1])
    query.stop()
    content = sorted(rows)
    assert [v for _, _, _, c in content for v in c.split("\n")] == [v for batch in given for _, v in batch]
    assert content[0] == (1, 0, 0, head.format(1, 1) + "\nmore 1") and content[1] == (1, 1, 2, "late 1\nlate 2") and content[2][:3] == (1, 2, 4) and [c[:3] for c in content[3:]] == [(2, 0, 5), (2, 1, 6)]


def test_log_files_as_they_arrive(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/Oven.java").write_text('class Oven {\n  void bake(int n) {\n    log.info("baked {} pots", n);\n  }\n}\n')
    engine = Engine(spark)
    engine.add_root(str(tmp_path / "src"))
    engine.refresh()
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_bytes(b"I baked 3 pots\nI baked 4 pots\nmore\n\xff\nI baked 5 pots\n")
    (logs / "b.log").write_text("I baked 6 pots\njava.lang.Error: hot\n    at Oven.bake(Oven.java:3)\n")
    rows = []
    fmt = LogFormat.parse("^I (?<body>.*)$")
    run = lambda: map_log_files(engine, str(logs), fmt, lambda df, n: rows.extend(df.collect()), str(tmp_path / "check")).awaitTermination(90)
    assert run()
    by_line = {(r.path.rsplit("/", 1)[1], r.first_line): json.loads(r.json) for r in rows}
    assert sorted(by_line) == [("a.log", 0), ("a.log", 1), ("a.log", 3), ("a.log", 4), ("b.log", 0)]
    assert by_line["a.log", 0]["variables"] == [{"expr": "n", "value": "3"}] and by_line["a.log", 1]["srcRef"] is None
    assert "error" in by_line["a.log", 3] and by_line["b.log", 0]["exceptionTrace"][0]["lineNumber"] == 3
    (logs / "c.log").write_text("I baked 7 pots\n")
    rows.clear()
    assert run() and [json.loads(r.json)["variables"][0]["value"] for r in rows] == ["7"]


def test_map_stream(spark, tmp_path):
    lines = [("app", 2 * i + k, v) for i in range(4) for k, v in enumerate((f"2024-01-01 00:00:0{i} INFO Tracker.java:5 [7] click on item {i}", "java.lang.Error: e\n    at org.example.Main.run(Main.java:3)"))]
    spark.createDataFrame(lines, "path string, line_no long, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, line_no long, value string").parquet(str(tmp_path / "in"))
    rows = []
    query = map_stream(stream, inputs.log_format(), inputs.statements(spark), lambda df, n: rows.extend(df.collect()), str(tmp_path / "check"), 600_000)
    until = time.time() + 90
    while len(rows) < 3 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert sorted(r.variables[0].value for r in rows) == ["item 0", "item 1", "item 2"]
    assert all(r.exception_trace[0].source_path == "/src/a/org/example/Main.java" for r in rows)
