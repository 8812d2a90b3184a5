import random

import pytest
from pyspark.sql import Observation

from logweave.engine import Engine
from logweave.functions.formats import LogFormat
from logweave.operators import records
from logweave.sources import blocks, lines

FMT = LogFormat.parse(r"^\d\d (?<body>.*)$")


@pytest.fixture
def logs(tmp_path):
    """Files with short and long lines, records over several blocks, bad lines, and ends of all kinds."""
    rng = random.Random(6)
    folder = tmp_path / "logs"
    folder.mkdir()
    for k in range(6):
        rows = []
        for i in range(120):
            head = rng.choice((b"%02d " % (i % 100), b"%02d " % (i % 100), b"more ", b"", b"\xff\xfe", b"\r"))
            rows.append(head + rng.choice(("x", "é☃", "long " * 40, "")).encode() * rng.choice((1, 1, 3)) + rng.choice((b"", b"\r")))
        (folder / f"f{k} {k}.log").write_bytes(b"\n".join(rows) + (b"\n" if k % 2 else b""))
    (folder / "none.log").write_bytes(b"")
    (folder / "feeds.log").write_bytes(b"\n\n\n")
    (folder / "one.log").write_bytes(b"01 a\n" + b"y" * 5000 + b"\n" + b"z" * 5000)
    return str(folder)


@pytest.mark.parametrize("size", [40, 4096, 1 << 24])
def test_lines_and_records_equal_those_of_the_text_source(spark, logs, size):
    if size == 40:
        logs += "/[no]*e*.log"  # few files, many blocks
    index = blocks.index_log(spark, logs, FMT, size)
    numbered = blocks.read_lines(index)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Repartition")  # blocks are dealt, lines are not
    text = lines.read_lines(spark, logs)
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert key(numbered, "path", "line_no", "ok", "value") == key(text, "path", "line_no", "ok", "value")
    found = blocks.read_records(index, FMT)
    want = records.assemble(text.where("ok"), FMT)
    assert key(found.where("ok"), "path", "rec_id", "first_line", "content") == key(want, "path", "rec_id", "first_line", "content")
    assert key(found.where("not ok"), "path", "first_line") == key(text.where("not ok"), "path", "line_no")


def test_lines_are_counted_without_a_format(spark, logs):
    for size in (50, 1 << 20):
        index = blocks.index_log(spark, logs, None, size)
        want = {r.path: r["count"] for r in lines.read_lines(spark, logs).groupBy("path").count().collect()}
        assert {r.path: r.n for r in index.groupBy("path").agg({"lines": "sum"}).toDF("path", "n").collect()} == want


def test_a_line_costs_one_block(spark, tmp_path, monkeypatch):
    log = tmp_path / "big.log"
    log.write_text("".join(f"{k % 100:02d} record {k}\n  more of {k}\n" for k in range(30_000)))
    index = blocks.index_log(spark, str(log), FMT, 20_000)
    index.write.parquet(str(tmp_path / "sidecar"))
    sidecar = spark.read.parquet(str(tmp_path / "sidecar"))
    path = sidecar.first().path
    assert sidecar.count() > 40 and blocks.block_of_line(sidecar, path, 41_001).count() == 1
    for line in (0, 1, 41_001, 59_999):
        found = blocks.record_at(sidecar, FMT, path, line).collect()
        assert [(r.first_line, r.content) for r in found] == [(line // 2 * 2, f"{line // 2 % 100:02d} record {line // 2}\n  more of {line // 2}")]
    assert blocks.record_at(sidecar, FMT, path, 70_000).first().first_line == 59_998
    # What the block's task reads, read here: the block and what its last record goes on for.
    r = blocks.block_of_line(sidecar, path, 41_001).first()
    source = blocks._Source(path)
    for inside, _ in source.lines(r.start, r.end, r.size):
        if not inside:
            break
    assert source.taken <= 20_000 + 1 + blocks._ON and log.stat().st_size > 900_000


def test_packed_files_are_read_by_the_text_source(spark, tmp_path):
    import gzip

    (tmp_path / "a.log.gz").write_bytes(gzip.compress(b"01 a\n"))
    assert blocks.index_log(spark, str(tmp_path / "a.log.gz"), FMT) is None
    assert not blocks._reads("viewfs://store/a.log") and not blocks._reads("nosuch://a/b.log")


def test_engine_reads_a_log_twice_and_counts_on_the_way(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/Kiln.java").write_text('class Kiln {\n  void fire(int n) {\n    log.info("fired {} tiles", n);\n  }\n}\n')
    # A file without statements resolves frames too.
    (tmp_path / "src/Clay.java").write_text("class Clay { void dig() { } }\n")
    log = tmp_path / "a.log"
    log.write_bytes(b"lost\n01 fired 3 tiles\n02 fired 4 tiles\njava.lang.Error: wet\n    at Clay.dig(Clay.java:1)\n\xff\n03 other\n")
    engine = Engine(spark)
    engine.add_root(str(tmp_path / "src"))
    engine.refresh()
    seen = Observation("seen")
    rows = engine.map_log(str(log), r"^\d\d (?<body>.*)$", observation=seen)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Relation [value" not in plan  # records, matches, call sites: in one stage
    found = {r.first_line: r.json for r in rows.collect()}
    assert sorted(found) == [1, 2, 5, 6] and '"Clay.java' not in found[1] and "/src/Clay.java" in found[2] and "error" in found[5]
    assert seen.get == {"records": 3, "matched": 2, "traces": 1, "unreadable_lines": 1}
    monkeypatch.setattr(blocks, "index_log", lambda *a: None)
    assert {r.first_line: r.json for r in engine.map_log(str(log), r"^\d\d (?<body>.*)$").collect()} == found
