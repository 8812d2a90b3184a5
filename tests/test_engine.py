"""The engine over small trees of a pottery shop: listing, catalogue, store, and logs mapped end to end."""

import json
import os

import pytest
from pyspark.sql import functions as F

from logweave import cli
from logweave.engine import Engine
from logweave.errors import CannotReadLog, InvalidFormat, MissingCapture, NoLogMessages, NoLogStatements, UnknownCapture
from logweave.functions import paths
from logweave.functions.formats import LogFormat
from logweave.sources import catalog, tree

FORMAT = r"^(?<timestamp>\d\d:\d\d\.\d) (?<level>[A-Z]) \[(?<thread>[^\]]*)\] (?<body>.*)$"
HINTED = r"^(?<timestamp>\d\d:\d\d\.\d) (?<level>[A-Z]) (?<file>[^ ]+)@(?<line>\w+) (?<body>.*)$"

JAVA = """package shop;
class Kiln {
  void fire(int cone) {
    logger.info("cone {} reached after {} min", cone, elapsed());
  }
  void cool() { logger.warn("door opened"); }
}
"""
PYTHON = """def glaze(pot):
    log.info("dipped %s", pot)
"""


@pytest.fixture
def shop(tmp_path):
    at = tmp_path / "shop"
    (at / "src/shop").mkdir(parents=True)
    (at / ".git").mkdir()
    (at / "out/deep").mkdir(parents=True)
    (at / ".gitignore").write_text("# made by tools\nout/\nTmp[0-9].java\n!Tmp7.java\n")
    (at / "src/shop/Kiln.java").write_text(JAVA)
    (at / "src/shop/Tmp1.java").write_text(JAVA)
    (at / "out/deep/Made.java").write_text(JAVA)
    (at / ".git/Hook.java").write_text(JAVA)
    (at / "src/readme.txt").write_text("text")
    (at / "src/broken.py").write_bytes(b"\xc3(")
    return at


def rows(engine, *args, **kw):
    return [json.loads(r.json) for r in engine.map_log(*args, **kw).orderBy("first_line").collect()]


def changes(feed):
    return sorted((r.event, r.path, r.file_id) for r in feed.collect())


def test_log_end_to_end(spark, shop, tmp_path):
    log = tmp_path / "shop.log"
    log.write_bytes(
        b"no record yet\n10:00.1 I [k1] cone 6 reached after 90 min\r\n\xfe\xff\n10:00.2 W [k1] door opened\n"
        b"java.lang.RuntimeException: too hot\n    at shop.Kiln.cool(Kiln.java:6)\n    at elsewhere.Gone.run(Gone.java:1)\n10:00.3 E [k2] unheard of\n"
    )
    engine = Engine(spark)
    engine.add_root(str(shop))
    engine.add_root(str(shop / "src"))
    assert engine.roots.paths == [str(shop)]
    assert changes(engine.refresh()) == [("NewFile", "src/broken.py", 0), ("NewFile", "src/shop/Kiln.java", 1)]
    assert [r.path for r in engine.unreadable.collect()] == ["src/broken.py"]
    out = rows(engine, str(log), FORMAT)
    where = f"{shop}/src/shop/Kiln.java"
    assert [x.get("variables") for x in out] == [[{"expr": "cone", "value": "6"}, {"expr": "elapsed()", "value": "90"}], None, [], []]
    source = out[0]["srcRef"]
    assert (source["sourcePath"], source["name"], source["lineNumber"], source["column"], source["vars"]) == (where, "fire", 4, 16, ["cone", "elapsed()"])
    assert out[0]["logRef"] == {"details": {"thread": "k1"}}
    assert out[1] == {"error": {"message": "unable to read line 2", "source": "stream did not contain valid UTF-8"}}
    assert out[2]["exceptionTrace"] == [{"name": "cool", "sourcePath": where, "language": "Java", "lineNumber": 6}]
    assert out[2]["logRef"]["details"]["trace"]["language"] == "Java" and out[2]["srcRef"]["text"] == '"door opened"'
    assert out[3]["srcRef"] is None and "exceptionTrace" not in out[3]
    assert [x["srcRef"]["name"] for x in rows(engine, str(log), FORMAT, start=3, count=1)] == ["cool"]
    assert len(rows(engine, str(log))) == 8
    log.write_text("10:00.1 I Kiln.java@4 cone 1 reached after 2 min\n10:00.1 I Wheel.java@4 cone 1 reached after 2 min\n10:00.2 I shop/Ki@x cone 3 reached after 4 min\n")
    out = rows(engine, str(log), HINTED)
    assert [len(x["variables"]) for x in out] == [2, 0, 2]
    assert out[2]["logRef"]["details"] == {"file": "shop/Ki", "lineno": 0}
    with pytest.raises(NoLogMessages):
        engine.map_log(str(log), "^never (?<body>.*)")
    with pytest.raises(CannotReadLog):
        engine.map_log(str(log) + ".gone")


def test_refresh_sees_what_changed_below(spark, shop, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.add_root(str(shop))
    engine.refresh()
    assert not engine.is_empty and engine.refresh().count() == 0
    (shop / "src/shop/Wheel.py").write_text(PYTHON)
    (shop / "src/shop/Kiln.java").write_text(JAVA.replace("door", "lid"))
    os.utime(shop / "src/shop/Kiln.java", (2, 2))
    feed = engine.refresh()
    expected = [("DeletedFile", "src/shop/Kiln.java", 1), ("NewFile", "src/shop/Kiln.java", 2), ("NewFile", "src/shop/Wheel.py", 3)]
    assert changes(feed) == expected
    assert sorted(r.text for r in engine.catalogue.collect()) == ['"cone {} reached after {} min"', '"dipped %s"', '"lid opened"']
    (shop / "src/shop/Kiln.java").unlink()
    engine.refresh()
    assert changes(feed) == expected  # what a call returned stays as it was
    assert engine.catalogue.count() == 1


def test_ids_are_never_used_again(spark, shop, tmp_path):
    for store in (None, str(tmp_path / "store")):
        engine = Engine(spark, store)
        engine.add_root(str(shop))
        engine.refresh()
        top = shop / "src/shop/Zz.py"
        top.write_text(PYTHON)
        assert changes(engine.refresh()) == [("NewFile", "src/shop/Zz.py", 2)]
        top.unlink()
        assert changes(engine.refresh()) == [("DeletedFile", "src/shop/Zz.py", 2)]
        if store:
            engine = Engine(spark, store)
            engine.add_root(str(shop))
        top.write_text(PYTHON)
        assert changes(engine.refresh()) == [("NewFile", "src/shop/Zz.py", 3)]
        top.unlink()


def test_a_changed_file_writes_its_own_rows(spark, shop, tmp_path, monkeypatch):
    store = tmp_path / "store"
    engine = Engine(spark, str(store))
    engine.add_root(str(shop))
    engine.refresh()
    newest = lambda name: spark.read.parquet(str(max(store.glob("cache.*/generation-*"), key=os.path.getmtime)) + "/" + name)
    whole = newest("statements").count()
    monkeypatch.setattr(catalog, "MOST_DELTAS", 4)
    sizes = []
    for k in range(6):
        (shop / "src/shop/Wheel.py").write_text(PYTHON.replace("dipped", f"turned {k}"))
        os.utime(shop / "src/shop/Wheel.py", (k + 5, k + 5))
        os.utime(shop / "src/shop", (9, 9))
        engine.refresh()
        sizes.append((newest("statements").count(), newest("snapshot").where("kind = 'File'").count(), newest("gone").count()))
        again = Engine(spark, str(store))
        again.add_root(str(shop))
        for e in (engine, again):
            assert e.catalogue.count() == whole + 1
            assert [r.text for r in catalog.of_file(e.catalogue, f"{shop}/src/shop/Wheel.py").collect()] == [f'"turned {k} %s"']
        assert sorted(map(tuple, again.snapshot.collect())) == sorted(map(tuple, engine.snapshot.collect())) and again.next_id == engine.next_id
        assert again.refresh().isEmpty()
    # Its own rows alone, but for the generation that merges those before.
    assert sizes[0] == (1, 1, 0) and sizes[1] == (1, 1, 1) and sizes[3][0] == whole + 1 and sizes[4] == (1, 1, 1)
    (shop / "src/shop/Wheel.py").unlink()
    engine.refresh()
    assert engine.catalogue.count() == whole and newest("statements").count() == 0 and engine.snapshot.where("path like '%Wheel.py'").isEmpty()


def test_two_roots_keep_their_tables(spark, shop, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "glaze.py").write_text(PYTHON)
    engine = Engine(spark, str(tmp_path / "store"))
    for root in (shop, other):
        engine.add_root(str(root))
    engine.refresh()
    (other / "more.py").write_text(PYTHON)
    assert changes(engine.refresh()) == [("NewFile", "more.py", 1)]
    again = Engine(spark, str(tmp_path / "store"))
    for root in (other, shop):
        again.add_root(str(root))
    assert again.catalogue.count() == engine.catalogue.count() == 4
    assert again.refresh().isEmpty()
    order = {r.source_path: r.root_ord for r in again.statements().collect()}
    assert order[f"{other}/glaze.py"] == 0 and order[f"{shop}/src/shop/Kiln.java"] == 1


def test_store_of_another_revision_or_cut_short(spark, shop, tmp_path, monkeypatch):
    store = tmp_path / "store"
    engine = Engine(spark, str(store))
    engine.add_root(str(shop))
    engine.refresh()
    (shop / "src/new.py").write_text(PYTHON)
    # The tables are written but the header is not: the generation before counts.
    monkeypatch.setattr(catalog, "_HEADER", "nothing int")
    with pytest.raises(Exception, match=".*"):
        engine.refresh()
    monkeypatch.undo()
    engine = Engine(spark, str(store))
    engine.add_root(str(shop))
    assert engine.catalogue.count() == 2
    assert [x[1] for x in changes(engine.refresh())] == ["src/new.py"]
    for part in store.glob("cache.*/generation-*/statements/part-*"):
        part.write_bytes(b"cut")
    engine = Engine(spark, str(store))
    engine.add_root(str(shop))
    assert engine.is_empty and engine.refresh().count() == 3 and engine.catalogue.count() == 3
    monkeypatch.setattr(catalog, "REVISION", 99)
    engine = Engine(spark, str(store))
    engine.add_root(str(shop))
    assert engine.is_empty


def test_kinds_of_entries(spark, shop):
    os.symlink(shop / "src", shop / "src/loop")
    os.symlink(shop / "src/shop/Kiln.java", shop / "src/Link.java")
    found = {r.path: r.kind for r in tree.list_tree(spark, str(shop), (shop / ".gitignore").read_text()).collect()}
    assert found == {
        ".gitignore": "UnsupportedFile", "src": "Directory", "src/shop": "Directory", "src/shop/Kiln.java": "File", "src/readme.txt": "UnsupportedFile",
        "src/broken.py": "File", "src/loop": "Unknown", "src/Link.java": "Unknown",
    }
    assert tree.list_tree(spark, str(shop / "nowhere")).count() == 0
    assert list(tree._entries(tree.filesystem(str(shop))[0], str(shop), "gone")) == [("gone", True, False, False, None)]
    errors = tree.classify(spark.createDataFrame([("gone", True, False, False, None)], tree._ENTRIES), F.lit("r"))
    assert errors.first().kind == "Error" and tree.stats(errors).first().errors == 1


@pytest.mark.parametrize(
    ("rules", "ignored", "kept"),
    [
        ("*.o\n", ["a.o", "d/a.o"], ["a.oo", "o"]),
        ("/top\n", ["top", "top/x"], ["d/top"]),
        ("a/b\n", ["a/b", "a/b/c"], ["x/a/b"]),
        ("out/\n", ["out/x", "d/out/x"], ["out"]),
        ("**/gen/*.rs\n", ["gen/a.rs", "x/y/gen/a.rs"], ["gen/x/a.rs"]),
        ("docs/**\n!docs/keep\n", ["docs/a", "docs/a/b"], ["docs/keep"]),
        ("[a-c]?.py\n[!x]9\n", ["b1.py", "a9"], ["d1.py", "x9", "abc.py"]),
        ("\\#a\n\\!b\nc\\*d\n", ["#a", "!b", "c*d"], ["a", "b", "cxd"]),
        ("!!c\n*\n!!c\n", ["c", "d"], ["!c"]),
        ("# note\n\nspace\\ \nplain   \n", ["space ", "plain"], ["# note", "space"]),
        ("open[\n", [], ["open[", "open"]),
        ("d\n!d/e\n", ["d", "d/f"], ["d/e"]),
    ],
)
def test_ignore_rules(spark, rules, ignored, kept):
    names = spark.createDataFrame([(x,) for x in ignored + kept], "path string")
    found = {r.path for r in names.where(paths.is_ignored(F.col("path"), paths.ignore_rules(rules))).collect()}
    assert found == set(ignored)


def test_statements_are_equal_and_shown(spark, shop):
    engine = Engine(spark)
    engine.add_root(str(shop))
    engine.refresh()
    one = engine.catalogue.select(F.struct("*").alias("one"))
    two = engine.catalogue.select(F.struct(*[F.lit("elsewhere").alias(c) if c == "source_path" else F.col(c) for c in engine.catalogue.columns]).alias("two"))
    assert one.crossJoin(two).where(catalog.same("one", "two")).count() == 2
    shown = [r[0] for r in one.select(catalog.display("one")).orderBy(F.col("one.line_no")).collect()]
    assert shown[0] == '[Line: 4, Col: 16] source `"cone {} reached after {} min"` name `fire` vars=["cone", "elapsed()"]'


def test_no_statements(spark, tmp_path):
    engine = Engine(spark)
    engine.add_root(str(tmp_path))
    engine.refresh()
    with pytest.raises(NoLogStatements):
        engine.map_log(str(tmp_path / "x.log"))


def test_command_line(spark, shop, tmp_path, capsys, monkeypatch):
    log = tmp_path / "a.log"
    log.write_text("10:00.2 W [k1] door opened\n")
    args = ["-d", str(shop), "-f", FORMAT]
    assert cli.main([*args, "-l", str(log)]) == 0
    out, err = capsys.readouterr()
    assert json.loads(out)["srcRef"]["name"] == "cool" and "src/broken.py" in err
    monkeypatch.setattr("sys.stdin", open(log))
    assert cli.main(args) == 0 and json.loads(capsys.readouterr().out)["srcRef"]["name"] == "cool"
    assert cli.main([*args, "-l", str(log), "-o", str(tmp_path / "out")]) == 0
    assert len(list((tmp_path / "out").glob("part-*"))) >= 1
    for bad in (["-l", str(log) + ".gone"], ["-l", str(log), "-f", "("], ["-l", str(log), "-f", "^x(?<body>y)"]):
        assert cli.main([*args, *bad]) == 1
    assert "help: " in capsys.readouterr().err


def test_formats():
    for text, error in (("(?<body>", InvalidFormat), (r"\d+", MissingCapture), ("(?<body>.*)(?<pid>x)", UnknownCapture)):
        with pytest.raises(error):
            LogFormat.parse(text)
    assert LogFormat.parse(HINTED).has_source_hint and not LogFormat.parse(FORMAT).has_source_hint
