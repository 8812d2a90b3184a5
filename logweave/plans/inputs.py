"""Inputs of the registered queries: a log rendered from events, and a small statement catalogue; in DataFrames and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.formats import LogFormat
from logweave.functions.templates import compile_template, expressions

FORMAT = r"^(?<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (?<level>\w+) (?<file>[\w$.]+):(?<line>\d+) \[(?<thread>\d+)\] (?<body>.*)$"

#: root, path, language, line, name, template, vars
TEMPLATES = [
    (0, "/src/a/org/example/Accounts.java", "Java", 12, "signUp", "User {} signed up", ["userId"]),
    (0, "/src/a/org/example/Accounts.java", "Java", 30, "other", "User {} {} up", ["a", "b"]),
    (0, "/src/a/org/example/Tracker.java", "Java", 8, "track", "click on {}", ["what"]),
    (0, "/src/a/org/example/Tracker.java", "Java", 9, "track", "click on item {}", ["item"]),
    (0, "/src/a/view.rs", "Rust", 40, "render", "view value={1} by {0}", ["user", "value"]),
    (1, "/src/b/view.rs", "Rust", 41, "render", "view value={v} by {u}!", []),
    (1, "/src/b/org/example/Orders.java", "Java", 77, "buy", "purchase of {} done", ["amount", "unused"]),
    (0, "/src/a/org/example/Any.java", "Java", 5, "any", "{} failed", ["x"]),
    (1, "/src/b/any.py", "Python", 3, "any", "request %s failed%%", ["rid"]),
    (0, "/src/a/any.cc", "C++", 6, "any()", "request %d failed", ["id"]),
    (0, "/src/a/org/example/Main.java", "Java", 4, "main", "ready", []),
]

STATEMENT_TYPE = (
    "root_ord int, source_path string, file_name string, stmt_idx int, language string, line_no int, end_line_no int, column int, name string, text string, quality int, "
    "pattern string, executable string, prefix string, args array<struct<kind:string,name:string,pos:int>>, vars array<string>, exprs array<string>"
)


def rows() -> list[tuple]:
    seen: dict[str, int] = {}
    out = []
    for root, path, language, line, name, text, names in TEMPLATES:
        t = compile_template(text, language)
        idx = seen[path] = seen.get(path, -1) + 1
        args = [(a.kind, a.name, a.pos) for a in t.args]
        out.append((root, path, path.rsplit("/", 1)[1], idx, language, line, line, 8, name, f'"{text}"', t.quality, t.pattern, t.executable, t.prefix, args, names, expressions(t.args, names)))
    return out


def statements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), STATEMENT_TYPE)


def log_format() -> LogFormat:
    return LogFormat.parse(FORMAT)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, rec_id, first_line, content) of one record per event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, user, event = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    level = F.when(kind == "error", "ERROR").when(kind == "view", "DEBUG").otherwise("INFO")
    file = F.when(kind == "signup", "Accounts.java").when(kind == "click", "Tracker").when(kind == "view", "view.rs").when(kind == "purchase", "Orders").otherwise("Nowhere")
    third = F.col("event_id") % 3
    line = (F.col("event_id") % 50 + 1).cast("string")
    java = F.concat(F.lit("\njava.lang.IllegalStateException: bad state "), event, F.lit("\n    at org.example.Main.run(Main.java:"), line, F.lit(")\n    at org.other.Lost.go(Lost.java:7)\n    at java.base/java.lang.Thread.run(Thread.java:1447)"))
    python = F.concat(F.lit('\nTraceback (most recent call last):\n  File "/srv/app.py", line '), line, F.lit(', in main\n    go()\n  File "/srv/go.py", line 3, in go\nValueError: bad '), event)
    message = (
        F.when(kind == "signup", F.concat(F.lit("User "), user, F.lit(" signed up")))
        .when(kind == "click", F.concat(F.lit("click on item "), (F.col("event_id") % 100).cast("string")))
        .when(kind == "view", F.concat(F.lit("view value="), amount, F.lit(" by "), user))
        .when(kind == "purchase", F.concat(F.lit("purchase of "), amount, F.lit(" done")))
        .otherwise(F.concat(F.lit("request "), event, F.lit(" failed"), F.when(third == 0, java).when(third == 1, python).otherwise("")))
    )
    content = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" "), file, F.lit(":"), (F.col("user_id") % 90 + 10).cast("string"), F.lit(" ["), user, F.lit("] "), message)
    return e.select(F.lit("app.log").alias("path"), F.col("event_id").alias("rec_id"), F.col("event_id").cast("int").alias("first_line"), content.alias("content"))


_MESSAGE = r"""CASE event_type
    WHEN 'signup' THEN 'User ' || user_id || ' signed up'
    WHEN 'click' THEN 'click on item ' || (event_id % 100)
    WHEN 'view' THEN 'view value=' || CAST(value AS DECIMAL(18,2)) || ' by ' || user_id
    WHEN 'purchase' THEN 'purchase of ' || CAST(value AS DECIMAL(18,2)) || ' done'
    ELSE 'request ' || event_id || ' failed' END"""
_TRACE = r"""CASE WHEN event_type IN ('signup', 'click', 'view', 'purchase') THEN NULL
    WHEN event_id % 3 = 0 THEN 'java.lang.IllegalStateException: bad state ' || event_id || chr(10) || '    at org.example.Main.run(Main.java:' || (event_id % 50 + 1) || ')' || chr(10) || '    at org.other.Lost.go(Lost.java:7)' || chr(10)
    WHEN event_id % 3 = 1 THEN 'Traceback (most recent call last):' || chr(10) || '  File "/srv/app.py", line ' || (event_id % 50 + 1) || ', in main' || chr(10) || '    go()' || chr(10) || '  File "/srv/go.py", line 3, in go' || chr(10) || 'ValueError: bad ' || event_id
    END"""
_FILE = "CASE event_type WHEN 'signup' THEN 'Accounts.java' WHEN 'click' THEN 'Tracker' WHEN 'view' THEN 'view.rs' WHEN 'purchase' THEN 'Orders' ELSE 'Nowhere' END"

#: The parsed log in SQL, made from the events' fields rather than by parsing lines.
LOG_SQL = f"""l AS (
  SELECT event_id AS rec_id, event_type, user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
         {_FILE} AS file, user_id % 90 + 10 AS lineno, CAST(user_id AS VARCHAR) AS thread, {_MESSAGE} AS body, {_TRACE} AS trace
  FROM events
)"""


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


#: Of the templates above, in order: statement index in its file, quality, pattern and expressions, written out by hand.
EXPECTED = [
    (0, 12, r"User (.+) signed up", ["userId"]), (1, 6, r"User (.+) (.+) up", ["a", "b"]), (0, 7, r"click on (.+)", ["what"]), (1, 11, r"click on item (.+)", ["item"]),
    (0, 12, r"view value=(.+) by (.+)", ["value", "user"]), (0, 13, r"view value=(.+) by (.+)!", ["v", "u"]), (0, 14, r"purchase of (.+) done", ["amount"]), (0, 6, r"(.+) failed", ["x"]),
    (0, 13, r"request (.+) failed(.+)", ["rid", "<unknown>"]), (0, 13, r"request (.+) failed", ["id"]), (0, 5, r"ready", []),
]


def statements_sql() -> str:
    values = []
    for (root, path, _, line, name, *_), (idx, quality, pattern, found) in zip(TEMPLATES, EXPECTED, strict=True):
        exprs = "[" + ", ".join(_quoted(x) for x in found) + "]::VARCHAR[]"
        values.append("(" + ", ".join(_quoted(x) for x in (root, path, path.rsplit("/", 1)[1], idx, quality, rf"(?s)\A{pattern}\z", name, line)) + f", {exprs})")
    return "s(root_ord, source_path, file_name, stmt_idx, quality, executable, name, line_no, exprs) AS (VALUES\n  " + ",\n  ".join(values) + "\n)"


def match_sql(hint: str = "file", best: bool = False, where: str = "TRUE") -> str:
    """CTEs l, s, and m with the statement of each record."""
    order = "quality DESC, stmt_idx" if best else "stmt_idx"
    by_file = """(file = file_name) OR (file <> file_name AND contains(source_path, file)
      AND NOT EXISTS (SELECT 1 FROM s s2 WHERE s2.root_ord = s.root_ord AND s2.file_name = l.file))"""
    # "some": records of odd ids have their hint, the others none.
    pick = {"file": by_file, "none": "TRUE", "some": f"rec_id % 2 = 0 OR ({by_file})"}[hint]
    return f"""WITH {LOG_SQL}, {statements_sql()}, c AS (
  SELECT rec_id, s.* FROM l, s WHERE ({where}) AND ({pick}) AND regexp_matches(body, executable)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY rec_id, source_path ORDER BY {order}) AS k FROM c
), m AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY root_ord, quality DESC, source_path, stmt_idx) AS r FROM f WHERE k = 1) WHERE r = 1
)"""
