"""One case per rule of extraction, in sources of a pottery shop."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.functions.templates import PLACEHOLDERS, Arg, compile_template, escape, expressions
from logweave.plans import queries
from logweave.sources import catalog
from logweave.sources.extract import statements


SF = "/root/testdata/sf0.001"


def pick(rows, *keys):
    return [tuple(r[k] for k in keys) for r in rows]


RUST = r'''use tracing as t;
struct Kiln { cone: u8 }
impl Kiln {
    fn fire(&self, shelf: usize) -> Result<(), Fault> {
        // warn!("only in a comment {}", shelf);
        info!("shelf {} loaded, cone {cone:>3}", shelf, cone = self.cone);
        t::error!(target: "kiln", "not first");
        let label = format!("glaze {}", 1);
        println!(r#"path "C:\kiln" of {0} in {1:?}"#, shelf, self);
        Ok(())
    }
}
static READY: () = warn!("outside of any function");
'''


def test_rust_rules():
    rows = statements(RUST, "Rust")
    # format! and macros whose first argument is no literal are no statements; comments aren't read.
    assert pick(rows, "line_no", "column", "name", "quality") == [
        (6, 14, "fire", len("shelfloaded,cone")),
        (9, 17, "fire", len(r'path"C:\\kiln"ofin')),
        (13, 25, RUST, len("outsideofanyfunction")),
    ]
    assert rows[0]["pattern"] == "(?s)^shelf (.+) loaded, cone (.+)$"
    assert rows[0]["args"] == [("Placeholder", None, None), ("Named", "cone", None)]
    assert rows[0]["vars"] == ["shelf", "cone = self.cone"] and rows[0]["exprs"] == ["shelf", "cone"]
    assert rows[1]["args"] == [("Positional", None, 0), ("Positional", None, 1)] and rows[1]["exprs"] == ["shelf", "self"]
    assert rows[1]["pattern"] == r'(?s)^path "C:\\kiln" of (.+) in (.+)$'


JAVA = r'''package shop;
public class Shelf {
  private final Logger shoplog = Logs.of(Shelf.class);
  static { shoplog.debug("before any method"); }
  Shelf(int width) {
    shoplog.info("shelf of {} cm holds {}", width,
        count(width, 2));
    if (width > 9) { shoplog.warn("\"wide\" one"); }
  }
  void move(String to) {
    shoplog.fine(STR."moved to \{to} by \{who()}");
    shoplog.info("a" + to);
    printer.info("no logger");
    shop.shoplog.info("a field of a field");
    Runnable r = () -> shoplog.trace("{}", to);
  }
}
'''


def test_java_rules():
    rows = statements(JAVA, "Java")
    assert pick(rows, "line_no", "end_line_no", "name", "text", "exprs") == [
        (4, 4, "Shelf", '"before any method"', []),
        (6, 7, "Shelf", '"shelf of {} cm holds {}"', ["width", "count(width, 2)"]),
        (8, 8, "Shelf", r'"\"wide\" one"', []),
        (11, 11, "move", r'"moved to \{to} by \{who()}"', ["to", "who()"]),
    ]  # a template without text of its own, as "{}", can't be told from anything else
    assert rows[3]["pattern"] == "(?s)^moved to (.+) by (.+)$"


CPP = r'''#include "kiln.h"
namespace kiln {
void Oven::heat(int cone, const char* who) {
  std::printf("cone %02d by %s\n", cone, who);
  log_line(stderr, "second argument counts: %d%%", cone);
  snprintf(out, 9, "no %d", cone);
  return log("returned %d", cone);
  log("next to " "another");
  log(R"x(raw \d %d)x", cone);
}
}
'''


def test_cpp_rules():
    rows = statements(CPP, "C++")
    assert pick(rows, "line_no", "name", "pattern", "exprs") == [
        (4, "Oven::heat(int cone, const char* who)", r"(?s)^cone (.+) by (.+)\n$", ["cone", "who"]),
        (5, "Oven::heat(int cone, const char* who)", "(?s)^second argument counts: (.+)(.+)$", ["cone", "<unknown>"]),
        (9, "Oven::heat(int cone, const char* who)", r"(?s)^raw \\d (.+)$", ["cone"]),
    ]


PYTHON = r'''import logging
log = logging.getLogger()
log.info("imported at %s", stamp)


class Wheel:
    async def turn(self, rpm, *, clay="grès"):
        log.debug("wheel of %s at %5.1f rpm", clay, rpm, extra={"k": 1})
        log.warning(f"{rpm!r:>4} is fast for {clay.title()}")
        log.error(r"C:\clay\%s", clay)
        log.info("one" "two")
        kept = log.info("its value is used")
        print(rpm)
        """a text alone"""
'''


def test_python_rules():
    rows = statements(PYTHON, "Python")
    assert pick(rows, "line_no", "name", "pattern", "exprs") == [
        (3, PYTHON, "(?s)^imported at (.+)$", ["stamp"]),
        (8, "turn", "(?s)^wheel of (.+) at (.+) rpm$", ["clay", "rpm"]),
        (9, "turn", "(?s)^(.+) is fast for (.+)$", ["rpm", "clay.title()"]),
        (10, "turn", r"(?s)^C:\\clay\\(.+)$", ["clay"]),
    ]
    assert statements("log.info('x'\ndef", "Python") == []


@pytest.mark.parametrize("language", ["Rust", "Java", "C++", "Python"])
def test_sources_without_statements(language):
    for code in ("", "\n\n", '"', "'''", "((((", "}}}}", "/* open", "\u00e9\u2603"):
        assert statements(code, language) == []


def test_columns_are_bytes_and_lines_count_from_one():
    (row,) = statements('/* é */\n/* é☃ */ fn dry() { warn!("grès"); }', "Rust")
    assert (row["line_no"], row["column"], row["name"]) == (2, len('/* é☃ */ fn dry() { warn!('.encode()), "dry")


@pytest.mark.parametrize(
    ("language", "text", "pattern", "args"),
    [
        ("Rust", "{:>8} of {total}", "(.+) of (.+)", (Arg("Placeholder"), Arg("Named", "total"))),
        ("Rust", "{3}/{a.b:?}", "(.+)/(.+)", (Arg("Positional", pos=3), Arg("Named", "a.b"))),
        ("Java", "{}: a (b) [c]", r"(.+): a \(b\) \[c\]", (Arg("Placeholder"),)),
        ("C++", "%-5ld|%*d|{x}", r"(.+)\|(.+)\|(.+)", (Arg("Placeholder"), Arg("Placeholder"), Arg("Named", "x"))),
        ("Python", "%(no)s %r", "%\\(no\\)s (.+)", (Arg("Placeholder"),)),
        ("Rust", "tab\there", r"tab\there", ()),
        ("Rust", "bell \\007!", r"bell \x07!", ()),
        ("Python", "\\N{SNOWMAN} melts", r"\w melts", ()),
    ],
)
def test_templates(language, text, pattern, args):
    made = compile_template(text, language)
    assert (made.pattern, made.executable, made.args) == (f"(?s)^{pattern}$", f"(?s)\\A{pattern}\\z", args)
    assert made.quality == sum(not c.isspace() for c in pattern.replace("(.+)", ""))


def test_templates_without_text_are_none():
    assert all(compile_template(t, "Java") is None for t in ("", "{}", " {} {} ", "\n"[:0]))


def test_expressions_of_values():
    named, second, open_ = Arg("Named", "n"), Arg("Positional", pos=1), Arg("Placeholder")
    assert expressions((open_, named, open_, second), ["a", "b"]) == ["a", "n", "b", "b"]
    assert expressions((open_, Arg("Positional", pos=7)), []) == ["<unknown>", "<unknown>"]


@pytest.mark.parametrize("name", ["q_extract_rust", "q_extract_java", "q_extract_cpp", "q_extract_python"])
def test_files_are_dealt_over_tasks(spark, name):
    # The table of parts is one row group, which a reader gives to one task.
    tasks = {r.task for r in queries.QUERIES[name](spark, SF).select(F.spark_partition_id().alias("task")).distinct().collect()}
    assert len(tasks) == spark.sparkContext.defaultParallelism > 1


def test_statements_of_many_files_come_together(monkeypatch):
    code = 'fn f() {\n    info!("a {} b", x);\n    warn!("c");\n}\n'
    files = pa.RecordBatch.from_pylist([{"root": "r", "file_id": k, "path": f"r/{k}", "language": "Rust", "content": code} for k in range(30)])
    out = list(catalog._extract(iter([files, files])))
    assert [b.num_rows for b in out] == [120]
    monkeypatch.setattr(catalog, "BATCH_STATEMENTS", 7)
    small = list(catalog._extract(iter([files, files])))
    assert max(b.num_rows for b in small) == 7 and pa.Table.from_batches(small).equals(pa.Table.from_batches(out))


def test_only_doubtful_templates_are_tried_as_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", " ", "\\", ".", "(", ")", "[", "{", "}", "{}", "n", "1", "q", "x4", "é", "\n", '"', "*", "%d"]) for _ in range(rng.randint(1, 7)))
        language, raw = rng.choice(["Rust", "Java", "C++", "Python"]), rng.random() < 0.3
        made = compile_template(text, language, raw)
        parts = [escape(p, raw) for p in re.split(re.sub(r"(?<!\\)\((?!\?)", "(?:", PLACEHOLDERS[language]), text)]
        try:
            re.compile("(.+)".join(parts))
            valid = any(not c.isspace() for p in parts for c in p)
        except re.error:
            valid = False
        assert (made is not None) == valid, text
