"""Registered queries: one per operator over the given tables, with equivalent SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import paths, templates, tokens
from logweave.operators import derive, emit, match, nav, records
from logweave.plans import inputs
from logweave.sources import catalog, lines, tree

KEYS = ["path", "rec_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scans, trees and catalogues.

_DOC_LINES = r"""lines AS (
  SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS line_no, unnest(p) AS value FROM (
    SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS p FROM documents WHERE length(text) > 0)
)"""


@query(f"WITH {_DOC_LINES} SELECT doc_id AS path, line_no, value FROM lines")
def q_line_split(spark, sf_dir):
    """Lines of texts, numbered."""
    return lines.split_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


_EXTENSIONS = ["rs", "java", "h", "hh", "hpp", "hxx", "tpp", "cc", "cpp", "cxx", "py", "c", "C", "txt", "pyi"]
#: Pages' addresses as paths: host parts as folders, with a folder and an extension by page_id.
_PATH_SQL = (
    "p AS (SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || CASE page_id % 7 WHEN 0 THEN '/.git/x.' WHEN 1 THEN '/build/x.' ELSE '/src/x.' END || ["
    + ", ".join(f"'{x}'" for x in _EXTENSIONS)
    + f"][page_id % {len(_EXTENSIONS)} + 1] AS path FROM pages)"
)


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    folder = F.when(F.col("page_id") % 7 == 0, "/.git/x.").when(F.col("page_id") % 7 == 1, "/build/x.").otherwise("/src/x.")
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("page_id") % len(_EXTENSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), clean, folder, ext).alias("path"))


_LANGUAGE_SQL = "CASE regexp_extract(path, '[.]([^./]+)$', 1) WHEN 'rs' THEN 'Rust' WHEN 'java' THEN 'Java' WHEN 'py' THEN 'Python' " + " ".join(f"WHEN '{x}' THEN 'C++'" for x in ("h", "hh", "hpp", "hxx", "tpp", "cc", "cpp", "cxx")) + " END"


@query(f"WITH {_PATH_SQL} SELECT page_id, path, {_LANGUAGE_SQL} AS language FROM p")
def q_lang_infer(spark, sf_dir):
    """Languages by extension."""
    return page_paths(spark, sf_dir).withColumn("language", paths.language(F.col("path")))


@query(f"WITH {_PATH_SQL} SELECT page_id, path FROM p WHERE NOT list_has_any(string_split(path, '/'), ['.git', '.hg', '.svn', '.vscode'])")
def q_vcs_prune(spark, sf_dir):
    """Paths outside folders of version control."""
    return page_paths(spark, sf_dir).where(~paths.is_vcs(F.col("path")))


@query(f"WITH {_PATH_SQL} SELECT page_id, path FROM p WHERE NOT (path LIKE '%/build/%' OR path LIKE '%.c' OR (path LIKE '%.py' AND path NOT LIKE '%/src/x.py'))")
def q_ignore_filter(spark, sf_dir):
    """Paths that ignore rules leave, the last matching rule deciding."""
    rules = paths.ignore_rules("# made by tools\nbuild/\n*.c\n*.py\n!src/x.py\n!**/src/x.py\n")
    return page_paths(spark, sf_dir).where(~paths.is_ignored(F.col("path"), rules))


@query(f"WITH {_PATH_SQL} SELECT page_id, path FROM p WHERE starts_with(path || '/', '/blog/') OR starts_with(path || '/', '/m.ththth.example.net/')")
def q_root_cover(spark, sf_dir):
    """Paths that a registered root covers, by whole components."""
    path = F.col("path")
    return page_paths(spark, sf_dir).where(paths.covered_by(path, "/blog") | paths.covered_by(path, "/m.ththth.example.net/"))


@query(f"WITH {_PATH_SQL} SELECT page_id, path, CASE WHEN page_id % 11 = 0 THEN 'Error' WHEN page_id % 5 = 0 THEN 'Directory' WHEN {_LANGUAGE_SQL} IS NOT NULL THEN 'File' ELSE 'UnsupportedFile' END AS kind FROM p")
def q_tree_kinds(spark, sf_dir):
    """Kinds of tree entries."""
    p = page_paths(spark, sf_dir)
    return p.withColumn("kind", paths.kind(F.col("path"), F.col("page_id") % 5 == 0, F.col("page_id") % 11 != 0))


@query(
    f"WITH {_PATH_SQL}, k AS (SELECT 'r' || page_id % 3 AS root, CASE WHEN page_id % 11 = 0 THEN 'Error' WHEN page_id % 5 = 0 THEN 'Directory' WHEN {_LANGUAGE_SQL} IS NOT NULL THEN 'File' ELSE 'UnsupportedFile' END AS kind FROM p) "
    "SELECT root, count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind = 'UnsupportedFile') AS unsupported_files, count(*) FILTER (kind = 'Directory') AS directories, count(*) FILTER (kind = 'Error') AS errors FROM k GROUP BY root"
)
def q_tree_stats(spark, sf_dir):
    """Counts of tree entries by kind."""
    return tree.stats(q_tree_kinds(spark, sf_dir).withColumn("root", F.concat(F.lit("r"), (F.col("page_id") % 3).cast("string"))))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as files of two syncs: some vanish, some are new, some change."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("d"), (F.col("o_orderkey") % 10).cast("string"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".rs")).alias("path"), "o_orderdate")
    key, base = F.col("o_orderkey"), [F.lit("r").alias("root"), "path", F.lit("File").alias("kind"), F.lit("Rust").alias("language")]
    old = o.where(key % 4 != 0).select(*base, F.col("o_orderdate").cast("timestamp").alias("mtime"), key.cast("long").alias("file_id"))
    new = o.where(key % 5 != 0).select(*base, F.when(key % 7 == 0, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate")).cast("timestamp").alias("mtime"))
    return old, new


_SYNC_SQL = """o AS (SELECT o_orderkey AS k, 'd' || o_orderkey % 10 || '/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.rs' AS path FROM orders),
top AS (SELECT max(k) AS t FROM o WHERE k % 4 <> 0),
fresh AS (SELECT k, path, (SELECT t FROM top) + row_number() OVER (ORDER BY string_split(path, '/')) AS file_id FROM o WHERE k % 5 <> 0 AND (k % 4 = 0 OR k % 7 = 0)),
feed AS (SELECT 'DeletedFile' AS event, path, k AS file_id FROM o WHERE k % 4 <> 0 AND (k % 5 = 0 OR k % 7 = 0) UNION ALL SELECT 'NewFile', path, file_id FROM fresh)"""


@query(f"WITH {_SYNC_SQL} SELECT event, path, file_id FROM feed")
def q_snapshot_diff(spark, sf_dir):
    """The change feed between two snapshots, with ids for new files."""
    return tree.sync(*_snapshots(spark, sf_dir))[1].select("event", "path", "file_id")


@query(f"WITH {_SYNC_SQL} SELECT o.path, coalesce(fresh.file_id, o.k) AS file_id FROM o LEFT JOIN fresh USING (k) WHERE o.k % 5 <> 0")
def q_snapshot_sync(spark, sf_dir):
    """The snapshot after a sync: unchanged files keep their ids."""
    return tree.sync(*_snapshots(spark, sf_dir))[0].select("path", "file_id")


@query(f"WITH {_SYNC_SQL} SELECT count(*) FILTER (event = 'DeletedFile') AS deleted, count(*) FILTER (event = 'NewFile') AS new, count(*) AS changes FROM feed")
def q_catalog_summary(spark, sf_dir):
    """Counts of a change feed."""
    return catalog.summary(tree.sync(*_snapshots(spark, sf_dir))[1])


@query(
    f"WITH {_SYNC_SQL}, c AS (SELECT path, l_linenumber AS stmt_idx, CAST(k AS BIGINT) AS file_id FROM o JOIN lineitem ON l_orderkey = k WHERE k % 4 <> 0) "
    "SELECT path, file_id, stmt_idx FROM c WHERE file_id NOT IN (SELECT file_id FROM feed WHERE event = 'DeletedFile') "
    "UNION ALL SELECT path, file_id, l_linenumber FROM fresh JOIN lineitem ON l_orderkey = k"
)
def q_catalog_delta(spark, sf_dir):
    """The catalogue after a change feed: statements of deleted files go, those of new files come."""
    old, new = _snapshots(spark, sf_dir)
    snapshot, feed = tree.sync(old, new)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber").alias("stmt_idx"))
    number = F.regexp_extract("path", r"(\d+)\.rs$", 1).cast("long")
    of = lambda files: files.withColumn("l_orderkey", number).join(items, "l_orderkey").select("root", "path", "file_id", "stmt_idx")
    return catalog.update(of(old), feed, of(feed.where("event = 'NewFile'"))).select("path", "file_id", "stmt_idx")


@query(f"WITH {_PATH_SQL} SELECT page_id, path, regexp_extract(path, '/([^/]+)$', 1) AS file_name FROM p")
def q_file_basename(spark, sf_dir):
    """Last components of paths."""
    return page_paths(spark, sf_dir).withColumn("file_name", paths.file_name(F.col("path")))


@query(f"WITH {_PATH_SQL} SELECT page_id, wanted, path FROM p JOIN (VALUES ('src/x.rs'), ('x.java'), ('rc/x.py'), ('build/x.h')) w(wanted) ON path = wanted OR ends_with(path, '/' || wanted)")
def q_find_suffix(spark, sf_dir):
    """Files whose paths end with a relative path."""
    wanted = spark.createDataFrame([("src/x.rs",), ("x.java",), ("rc/x.py",), ("build/x.h",)], "wanted string")
    p = page_paths(spark, sf_dir)
    return p.join(F.broadcast(wanted), paths.find_suffix(F.col("path"), F.col("wanted"))).select("page_id", "wanted", "path")


# Templates.

#: What parts' names are logged with: language and the rest of the template, by part.
_ENDINGS = [
    ("Rust", " costs {}"), ("Rust", ": {price:>8.2} of {0} (a.b) [c]"), ("Java", " x {} of {id}"), ("Java", r" \{count()}!"),
    ("C++", " %5.2f%% of %s"), ("C++", " {} {name} {12:d}"), ("Python", " %r\\n + %08.3f"), ("Python", " | plain"),
]
_TEMPLATE_SQL = "t AS (SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(_ENDINGS)) + " END AS language, p_name || CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(_ENDINGS)) + " END AS template FROM part)"


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("p_partkey") % len(_ENDINGS) + 1).cast("int")
    language, ending = (F.element_at(F.array(*[F.lit(e[k]) for e in _ENDINGS]), at) for k in range(2))
    return table(spark, sf_dir, "part").select("p_partkey", language.alias("language"), F.concat("p_name", ending).alias("template"))


@query(f"WITH {_TEMPLATE_SQL} SELECT p_partkey, language, template, CAST([1, 2, 2, 1, 3, 3, 2, 0][p_partkey % 8 + 1] AS BIGINT) AS n_args FROM t")
def q_placeholder_split(spark, sf_dir):
    """How many values templates log."""
    return _templates(spark, sf_dir).withColumn("n_args", templates.arg_count(F.col("template"), F.col("language")).cast("long"))


#: The endings' own characters, where a pattern's escapes count: costs, :of(a.b)[c], xof, !, of, none, a line feed and +, |plain.
@query(f"WITH {_TEMPLATE_SQL} SELECT t.p_partkey, template, length(replace(p_name, ' ', '')) + [5, 16, 3, 1, 2, 0, 4, 7][t.p_partkey % 8 + 1] AS quality FROM t JOIN part USING (p_partkey)")
def q_quality(spark, sf_dir):
    """Characters of templates' escaped literal text but white space."""
    return _templates(spark, sf_dir).select("p_partkey", "template", templates.quality(F.col("template"), F.col("language")).cast("long").alias("quality"))


@query(
    "SELECT p_partkey, k.pos AS at, k.kind, k.name, k.place FROM part JOIN (VALUES (0, 0, 'Placeholder', NULL, NULL), (1, 0, 'Named', 'price', NULL), (1, 1, 'Positional', NULL, 0), (2, 0, 'Placeholder', NULL, NULL), (2, 1, 'Placeholder', NULL, NULL), "
    "(3, 0, 'Named', 'count()', NULL), (4, 0, 'Placeholder', NULL, NULL), (4, 1, 'Placeholder', NULL, NULL), (4, 2, 'Placeholder', NULL, NULL), (5, 0, 'Placeholder', NULL, NULL), (5, 1, 'Named', 'name', NULL), (5, 2, 'Positional', NULL, 12), "
    "(6, 0, 'Placeholder', NULL, NULL), (6, 1, 'Placeholder', NULL, NULL)) k(m, pos, kind, name, place) ON p_partkey % 8 = m"
)
def q_arg_kinds(spark, sf_dir):
    """What placeholders name."""
    kinds = _templates(spark, sf_dir).select("p_partkey", F.posexplode(templates.arg_kinds(F.col("template"), F.col("language"))).alias("at", "k"))
    return kinds.select("p_partkey", "at", "k.kind", "k.name", F.col("k.pos").alias("place"))


# Statement extraction, from a source file rendered for each part.

_QUALITY_SQL = "length(replace(p_name, ' ', ''))"


def _extracted(spark: SparkSession, sf_dir: str, language: str, *code: str) -> DataFrame:
    """Statements of a file per part; {name}, {brand}, {size} and {key} of the code are its columns."""
    pieces = re.split(r"\{(name|brand|size|key)\}", "\n".join(code))
    columns = {"name": "p_name", "brand": "p_brand", "size": "p_size", "key": "p_partkey"}
    content = F.concat(*[F.col(columns[x]).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(pieces)])
    part = catalog.dealt(table(spark, sf_dir, "part").select(*columns.values()), "p_partkey")
    sources = part.select(F.lit("r").alias("root"), F.col("p_partkey").cast("string").alias("path"), F.lit(language).alias("language"), F.col("p_partkey").alias("file_id"), content.alias("content"))
    found = catalog.extract(sources)
    return found.select(
        F.col("file_id").alias("p_partkey"), "source_path", "stmt_idx", "line_no", "end_line_no", F.col("column").alias("col"), "name", "text", "quality", "pattern",
        F.array_join("vars", "|").alias("vars"), F.array_join("exprs", "|").alias("exprs"),
    )


def _extract_sql(*rows: tuple) -> str:
    """Rows (stmt_idx, line_no, end_line_no, col, name, text, quality, pattern, vars, exprs) as SQL expressions over part."""
    names = ("stmt_idx", "line_no", "end_line_no", "col", "name", "text", "quality", "pattern", "vars", "exprs")
    return " UNION ALL ".join("SELECT p_partkey, 'r/' || p_partkey AS source_path, " + ", ".join(f"{e} AS {n}" for n, e in zip(names, row, strict=True)) + " FROM part" for row in rows)


@query(_extract_sql((0, 4, 4, 10, "'p' || p_partkey", """'"' || p_name || ' of ' || p_brand || ' at {}: {k:?}"'""", f"{_QUALITY_SQL} + length(p_brand) + 5", "'(?s)^' || p_name || ' of ' || p_brand || ' at (.+): (.+)$'", "'n|k = 3'", "'n|k'")))
def q_extract_rust(spark, sf_dir):
    """Statements of Rust files."""
    code = ("// {name}", "fn p{key}(n: u32) {", '    // info!("none {}", n);', '    info!("{name} of {brand} at {}: {k:?}", n, k = 3);', '    let s = format!("{brand} {}", n);', "}", "")
    return _extracted(spark, sf_dir, "Rust", *code)


@query(
    _extract_sql(
        (0, 4, 5, 13, "'m' || p_partkey", """'"' || p_name || ' (' || p_size || ') sold {} times"'""", f"{_QUALITY_SQL} + length(p_size || '') + 13", r"'(?s)^' || p_name || ' \(' || p_size || '\) sold (.+) times$'", "'n|total(n, 1)'", "'n'"),
        (1, 8, 8, 16, "'P' || p_partkey", """'"' || p_name || ' made"'""", f"{_QUALITY_SQL} + 4", "'(?s)^' || p_name || ' made$'", "''", "''"),
    )
)
def q_extract_java(spark, sf_dir):
    """Statements of Java files."""
    code = ("package p;", "class P{key} {", "  void m{key}(int n) {", '    log.info("{name} ({size}) sold {} times",', "        n, total(n, 1));", '    other.info("{name}");', "  }", '  { logger.fine("{name} made"); }', "}", "")
    return _extracted(spark, sf_dir, "Java", *code)


@query(_extract_sql((0, 3, 3, 9, "'P::m' || p_partkey || '(int n, char* w)'", r"""'"' || p_name || ': %d of %s\n"'""", f"{_QUALITY_SQL} + 5", r"'(?s)^' || p_name || ': (.+) of (.+)\n$'", "'n + {size}|w'".replace("{size}", "' || p_size || '"), "'n + {size}|w'".replace("{size}", "' || p_size || '"))))
def q_extract_cpp(spark, sf_dir):
    """Statements of C++ files."""
    code = ("#include <x>", "void P::m{key}(int n, char* w) {", r'  printf("{name}: %d of %s\n", n + {size}, w);', '  snprintf(w, 9, "{name} %d", n);', "}", "")
    return _extracted(spark, sf_dir, "C++", *code)


@query(
    _extract_sql(
        (0, 2, 2, 13, "'m' || p_partkey", """'f"' || p_name || ' {n + ' || p_size || '} of {brand!r}"'""", f"{_QUALITY_SQL} + 2", "'(?s)^' || p_name || ' (.+) of (.+)$'", "''", "'n + ' || p_size || '|brand'"),
        (1, 3, 4, 14, "'m' || p_partkey", """'"%s left in ' || p_name || '"'""", f"{_QUALITY_SQL} + 6", "'(?s)^(.+) left in ' || p_name || '$'", "'n'", "'n'"),
    )
)
def q_extract_python(spark, sf_dir):
    """Statements of Python files."""
    code = ("def m{key}(n, brand='{brand}'):", '    log.info(f"{name} {n + {size}} of {brand!r}")', '    log.debug("%s left in {name}",', "              n)", '    x = log.info("{name}")', "")
    # {brand!r} is no column of the rendering, for only whole words in braces are.
    return _extracted(spark, sf_dir, "Python", *code)


# Records.


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse(inputs.log(spark, sf_dir), inputs.log_format())


@query("SELECT count(*) AS records, count(*) AS matching FROM events")
def q_format_match(spark, sf_dir):
    """Records that the format fits."""
    log = inputs.log(spark, sf_dir)
    return log.agg(F.count("*").alias("records"), F.count_if(inputs.log_format().matches(F.col("content"))).alias("matching"))


@query(f"WITH {inputs.LOG_SQL} SELECT rec_id, file, lineno, thread, logged, level FROM l")
def q_format_parse(spark, sf_dir):
    """What the format captures."""
    fmt, content = inputs.log_format(), F.col("content")
    captured = [fmt.capture("timestamp", content).alias("logged"), fmt.capture("level", content).alias("level")]
    return inputs.log(spark, sf_dir).select("rec_id", *fmt.details(content)[:3], *captured)


_RECORD_SQL = f"""WITH {_DOC_LINES}, b AS (
  SELECT *, sum(CASE WHEN regexp_matches(value, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS rec_id FROM lines
) SELECT doc_id AS path, CAST(rec_id AS BIGINT) AS rec_id, min(line_no) AS first_line, string_agg(value, chr(10) ORDER BY line_no) AS content FROM b WHERE rec_id > 0 GROUP BY ALL"""


@query(_RECORD_SQL)
def q_record_assembly(spark, sf_dir):
    """Records of several lines: a line that begins with a capital begins one."""
    fmt = inputs.LogFormat.parse("^(?<body>[A-Z].*)")
    return records.assemble(q_line_split(spark, sf_dir), fmt, block_lines=8)


@query("SELECT conv_id AS path, turn + 1 AS rec_id, turn AS first_line, text AS content FROM conversations")
def q_bare_records(spark, sf_dir):
    """Without a format each line is a record."""
    return records.bare_records(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), F.col("text").alias("value")))


@query(_RECORD_SQL.replace("FROM lines\n", "FROM lines WHERE line_no >= 2\n").replace("rec_id > 0", "rec_id BETWEEN 1 AND 3"))
def q_start_count(spark, sf_dir):
    """Three records from the third line on."""
    fmt = inputs.LogFormat.parse("^(?<body>[A-Z].*)")
    return records.first_records(records.assemble(records.start_at(q_line_split(spark, sf_dir), 2), fmt), 3)


@query(f"WITH {inputs.LOG_SQL} SELECT rec_id, body, CASE WHEN trace LIKE 'java%' THEN 'Java' WHEN trace IS NOT NULL THEN 'Python' END AS trace_language, trace FROM l")
def q_trace_split(spark, sf_dir):
    """Bodies without the stack traces that end them."""
    return parsed(spark, sf_dir).select("rec_id", "body", "trace_language", "trace")


@query("SELECT event_id AS rec_id, '' AS body, 'java.io.IOException: disk ' || event_id AS trace FROM events WHERE event_type = 'error'")
def q_one_line_trace(spark, sf_dir):
    """A body that is an exception's first line is a trace."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return records.split_trace(e.select(F.col("event_id").alias("rec_id"), F.concat(F.lit("java.io.IOException: disk "), F.col("event_id").cast("string")).alias("body"))).select("rec_id", "body", "trace")


# Matching.


def _won(spark: SparkSession, sf_dir: str, hinted: bool = True, best: bool = False) -> DataFrame:
    found = parsed(spark, sf_dir)
    found = found if hinted else found.withColumn("file", F.lit(None).cast("string"))
    return match.match(found, inputs.statements(spark), best)


def _short(matched: DataFrame) -> DataFrame:
    return matched.where("stmt is not null").select("rec_id", "stmt.source_path", "stmt.stmt_idx", "stmt.quality")


_WON = " SELECT rec_id, source_path, stmt_idx, quality FROM m"


@query(inputs.match_sql(where="file LIKE '%.%'") + _WON)
def q_match_exact_hint(spark, sf_dir):
    """Matches among the files of the hinted name."""
    return _short(match.match(parsed(spark, sf_dir).where("file like '%.%'"), inputs.statements(spark)))


@query(inputs.match_sql(where="file NOT LIKE '%.%'") + _WON)
def q_match_substr_hint(spark, sf_dir):
    """Matches among the files whose path contains the hint."""
    return _short(match.match(parsed(spark, sf_dir).where("file not like '%.%'"), inputs.statements(spark)))


@query(inputs.match_sql("none") + _WON)
def q_match_unhinted(spark, sf_dir):
    """Matches among all files."""
    return _short(_won(spark, sf_dir, False))


@query(inputs.match_sql("none").replace("WHERE r = 1", "").replace("\n)", "\n)", 1) + " SELECT rec_id, source_path, stmt_idx FROM f WHERE k = 1")
def q_first_in_file(spark, sf_dir):
    """The first statement of each file that fits a record."""
    found = parsed(spark, sf_dir).withColumn("file", F.lit(None).cast("string"))
    return match.first_in_files(found, inputs.statements(spark), ["rec_id"]).select("rec_id", "source_path", "stmt_idx")


@query(inputs.match_sql("none", best=True) + _WON)
def q_best_quality(spark, sf_dir):
    """Matches by the best statement of each file."""
    return _short(_won(spark, sf_dir, False, True))


@query(inputs.match_sql("none") + " SELECT root_ord, count(*) AS n FROM m GROUP BY root_ord")
def q_root_precedence(spark, sf_dir):
    """Matches by root: the first root with one wins."""
    return _won(spark, sf_dir, False).where("stmt is not null").groupBy("stmt.root_ord").agg(F.count("*").alias("n"))


@query(inputs.match_sql() + " SELECT l.rec_id, name FROM l LEFT JOIN m USING (rec_id)")
def q_unmatched(spark, sf_dir):
    """All records, with the statement's function or null."""
    return _won(spark, sf_dir).select("rec_id", "stmt.name")


_VARIABLES = """ , v AS (SELECT m.rec_id, exprs, executable, body, unnest(range(1, len(exprs) + 1)) AS i FROM m JOIN l USING (rec_id))
SELECT rec_id, i - 1 AS pos, exprs[i] AS expr, CASE i WHEN 1 THEN regexp_extract(body, executable, 1) WHEN 2 THEN regexp_extract(body, executable, 2) WHEN 3 THEN regexp_extract(body, executable, 3) END AS value FROM v"""


def _variables(matched: DataFrame) -> DataFrame:
    pairs = matched.select("rec_id", F.posexplode(derive.variables(F.col("body"), F.col("stmt"), F.col("captured"))).alias("pos", "v"))
    return pairs.select("rec_id", F.col("pos").cast("long").alias("pos"), "v.expr", "v.value")


@query(inputs.match_sql() + _VARIABLES)
def q_variables(spark, sf_dir):
    """Logged values with their expressions."""
    return _variables(_won(spark, sf_dir))


@query(inputs.match_sql() + _VARIABLES.replace("rec_id, i - 1 AS pos, exprs[i] AS expr", "rec_id AS first_line, exprs[i] AS name"))
def q_locals(spark, sf_dir):
    """Local variables of each record's frame: the expressions of its statement with their values."""
    mapped = _won(spark, sf_dir)
    found = nav.locals_of(mapped.withColumn("variables", derive.variables(F.col("body"), F.col("stmt"), F.col("captured"))))
    return found.select(F.col("first_line").cast("long").alias("first_line"), "name", "value")


@query(f"WITH {inputs.LOG_SQL} SELECT rec_id, CASE WHEN event_type = 'error' THEN body ELSE logged || ' ' || level || ' ' || file || ':' || lineno || ' [' || thread || '] ' || body END AS body FROM l")
def q_full_body(spark, sf_dir):
    """What records log: their bodies, or whole lines where no body was parsed, here of all but errors."""
    body = F.when(F.col("content").contains(" ERROR "), F.col("body"))
    return parsed(spark, sf_dir).select("rec_id", records.full_body(body, F.col("content")).alias("body"))


@query(inputs.match_sql(where="event_type = 'view'") + _VARIABLES)
def q_variables_positional(spark, sf_dir):
    """Logged values that placeholders name by position."""
    return _variables(match.match(parsed(spark, sf_dir).where("file = 'view.rs'"), inputs.statements(spark)))


def _files(spark: SparkSession) -> DataFrame:
    return inputs.statements(spark).select("root_ord", "source_path").distinct()


@query(f"WITH {inputs.LOG_SQL} SELECT rec_id, 'run' AS name, '/src/a/org/example/Main.java' AS source_path, event_id % 50 + 1 AS line_no FROM l WHERE trace LIKE 'java%'")
def q_callsites_java(spark, sf_dir):
    """Frames of Java traces that a source file resolves."""
    found = parsed(spark, sf_dir).where("trace_language = 'Java'")
    return derive.call_sites(found, _files(spark), KEYS).select("rec_id", "name", "source_path", F.col("line_no").cast("long").alias("line_no"))


@query(
    f"WITH {inputs.LOG_SQL}, t AS (SELECT rec_id, event_id FROM l WHERE trace LIKE 'Traceback%') SELECT rec_id, 0 AS pos, 'main' AS name, '/srv/app.py' AS source_path, event_id % 50 + 1 AS line_no FROM t UNION ALL SELECT rec_id, 1, 'go', '/srv/go.py', 3 FROM t"
)
def q_callsites_python(spark, sf_dir):
    """Frames of Python traces."""
    found = parsed(spark, sf_dir).where("trace_language = 'Python'")
    return derive.call_sites(found, _files(spark), KEYS).select("rec_id", "pos", "name", "source_path", F.col("line_no").cast("long").alias("line_no"))


@query(inputs.match_sql("some") + " SELECT l.rec_id, CASE WHEN m.rec_id IS NULL OR trace IS NULL THEN 0 WHEN trace LIKE 'java%' THEN 1 ELSE 2 END AS n_sites FROM l LEFT JOIN m USING (rec_id)")
def q_trace_gate(spark, sf_dir):
    """Call sites are given for matched records alone; of the records with traces, those with a hint match nothing."""
    found = parsed(spark, sf_dir)
    found = found.withColumn("file", F.when(F.col("rec_id") % 2 == 1, F.col("file")))
    out = derive.with_call_sites(match.match(found, inputs.statements(spark)), _files(spark), KEYS)
    return out.select("rec_id", F.greatest(F.size("exception_trace"), F.lit(0)).alias("n_sites"))


_TRACE_JSON_SQL = """CASE WHEN trace IS NULL THEN '' ELSE ',"trace":{"language":"' || CASE WHEN trace LIKE 'java%' THEN 'Java' ELSE 'Python' END || '","content":' || CAST(to_json(trace) AS VARCHAR) || '}' END"""


@query(
    inputs.match_sql()
    + f""" SELECT rec_id, '{{"logRef":{{"details":{{"thread":"' || thread || '","file":"' || file || '","lineno":' || lineno || {_TRACE_JSON_SQL} || '}}}},"srcRef":' || CASE WHEN m.rec_id IS NULL THEN 'null' ELSE '"' || name || '"' END || '}}' AS json FROM l LEFT JOIN m USING (rec_id)"""
)
def q_json_emit(spark, sf_dir):
    """Mappings as JSON, here with the statement's name alone for its source."""
    matched = _won(spark, sf_dir)
    rows = matched.withColumns({"exception_trace": F.lit(None).cast("array<struct<name:string,source_path:string,language:string,line_no:int>>"), "variables": derive.variables(F.col("body"), F.col("stmt"), F.col("captured"))})
    rows = rows.select("rec_id", "stmt.name", emit.mapping_json(rows).alias("json"))
    head = F.regexp_extract("json", r'^(\{"logRef":.*\}),"srcRef":', 1)
    return rows.select("rec_id", F.concat(head, F.lit(',"srcRef":'), F.coalesce(F.concat(F.lit('"'), "name", F.lit('"')), F.lit("null")), F.lit("}")).alias("json"))


def _source_json(row: tuple) -> str:
    """The wire shape of a statement, made with Python's own JSON."""
    _, path, _, _, language, line, end, column, name, text, quality, pattern, _, _, args, names, _ = row
    arg = lambda a: {"Named": a[1]} if a[0] == "Named" else {"Positional": a[2]} if a[0] == "Positional" else a[0]
    shape = {"sourcePath": path, "language": language, "lineNumber": line, "endLineNumber": end, "column": column, "name": name, "text": text, "quality": quality, "pattern": pattern, "args": [arg(a) for a in args], "vars": names}
    return json.dumps(shape, separators=(",", ":"), ensure_ascii=False)


def _json_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    shapes = ", ".join(f"({quoted(r[1])}, {r[3]}, {quoted(_source_json(r))})" for r in inputs.rows())
    value = " ".join(f"WHEN {i} THEN regexp_extract(body, executable, {i})" for i in (1, 2, 3))
    return (
        inputs.match_sql("none")
        + f""", j(source_path, stmt_idx, shape) AS (VALUES {shapes}), v AS (
  SELECT rec_id, string_agg('{{"expr":' || to_json(expr) || ',"value":' || to_json(value) || '}}', ',' ORDER BY i) AS vars FROM (
    SELECT rec_id, i, exprs[i] AS expr, CASE i {value} END AS value FROM (
      SELECT m.rec_id, exprs, executable, body, unnest(range(1, len(exprs) + 1)) AS i FROM m JOIN l USING (rec_id))) GROUP BY rec_id
) SELECT l.rec_id, '{{"logRef":{{"details":{{"thread":"' || thread || '","lineno":' || lineno || {_TRACE_JSON_SQL} || '}}}},"srcRef":' || coalesce(shape, 'null')
  || CASE WHEN shape IS NULL OR trace IS NULL THEN ''
     WHEN trace LIKE 'java%' THEN ',"exceptionTrace":[{{"name":"run","sourcePath":"/src/a/org/example/Main.java","language":"Java","lineNumber":' || (event_id % 50 + 1) || '}}]'
     ELSE ',"exceptionTrace":[{{"name":"main","sourcePath":"/srv/app.py","language":"Python","lineNumber":' || (event_id % 50 + 1) || '}},{{"name":"go","sourcePath":"/srv/go.py","language":"Python","lineNumber":3}}]' END
  || ',"variables":[' || coalesce(vars, '') || ']}}' AS json
FROM l LEFT JOIN m USING (rec_id) LEFT JOIN j USING (source_path, stmt_idx) LEFT JOIN v USING (rec_id)"""
    )


@query(_json_sql())
def q_json_full(spark, sf_dir):
    """Mappings as whole JSON lines: details with traces, sources with arguments and values, call sites, variables."""
    matched = derive.with_call_sites(_won(spark, sf_dir, False), _files(spark), KEYS)
    rows = matched.withColumn("variables", derive.variables(F.col("body"), F.col("stmt"), F.col("captured")))
    return rows.select("rec_id", emit.mapping_json(rows).alias("json"))


_LARGE_SQL = """c AS (SELECT o_orderkey AS k, o_orderkey % 2 AS loose, '/src/' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '/F' || (o_orderkey % 1000) || '.java' AS source_path FROM orders)
SELECT l_orderkey, l_linenumber, source_path, CAST(k AS INTEGER) AS line_no, CAST(l_partkey AS VARCHAR) AS value FROM lineitem JOIN c ON l_orderkey = k"""


@query(f"WITH {_LARGE_SQL}")
def q_match_large_catalogue(spark, sf_dir):
    """Matches against a statement for each order, half of which begin with a value."""
    key = F.col("o_orderkey").cast("string")
    loose = F.col("o_orderkey") % 2 == 1
    path = F.concat(F.lit("/src/"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("/F"), (F.col("o_orderkey") % 1000).cast("string"), F.lit(".java"))
    body = F.when(loose, F.concat(F.lit("(.+) goes to order "), key, F.lit(" now"))).otherwise(F.concat(F.lit("order "), key, F.lit(" takes (.+)")))
    none = F.array().cast("array<string>")
    statements = table(spark, sf_dir, "orders").select(
        F.lit(0).alias("root_ord"), path.alias("source_path"), F.regexp_extract(path, "([^/]+)$", 1).alias("file_name"), F.col("o_orderkey").cast("int").alias("stmt_idx"), F.lit("Java").alias("language"),
        F.col("o_orderkey").cast("int").alias("line_no"), F.col("o_orderkey").cast("int").alias("end_line_no"), F.lit(8).alias("column"), F.lit("f").alias("name"), F.lit("").alias("text"), F.lit(9).alias("quality"),
        F.lit("").alias("pattern"), F.concat(F.lit(r"(?s)\A"), body, F.lit(r"\z")).alias("executable"), F.when(loose, "").otherwise(F.concat(F.lit("order "), key, F.lit(" takes "))).alias("prefix"),
        F.array().cast("array<struct<kind:string,name:string,pos:int>>").alias("args"), none.alias("vars"), F.array(F.lit("x")).alias("exprs"),
    )
    order, part = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    logged = F.when(F.col("l_orderkey") % 2 == 1, F.concat(part, F.lit(" goes to order "), order, F.lit(" now"))).otherwise(F.concat(F.lit("order "), order, F.lit(" takes "), part))
    found = match.match(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", logged.alias("body"), F.lit(None).cast("string").alias("file")), statements)
    return found.where("stmt is not null").select("l_orderkey", "l_linenumber", "stmt.source_path", "stmt.line_no", F.col("captured")[0].alias("value"))


# Navigation.

_BREAKPOINTS = "b AS (SELECT 'u' || user_id % 20 AS path, CAST(event_id AS INTEGER) AS ord, CAST(event_id * 7919 % 400 AS INTEGER) AS line FROM events WHERE event_id % 10 = 0), n AS (SELECT 'u' || user_id % 20 AS path, count(*) AS n_lines FROM events GROUP BY 1)"


def _breakpoints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")))
    wanted = e.where("event_id % 10 = 0").select("path", F.col("event_id").cast("int").alias("ord"), (F.col("event_id") * 7919 % 400).cast("int").alias("line"))
    return wanted, nav.line_counts(e)


@query(f"WITH {_BREAKPOINTS} SELECT path, ord, line, line > 0 AND line < n_lines AS verified FROM b JOIN n USING (path)")
def q_breakpoints(spark, sf_dir):
    """Breakpoints, and whether they lie inside the log."""
    return nav.set_breakpoints(*_breakpoints(spark, sf_dir))


@query(f"WITH {_BREAKPOINTS} SELECT path, path IN (SELECT path FROM b WHERE line % 3 = 0 AND ord < 200) AS has_breakpoints FROM n")
def q_has_breakpoints(spark, sf_dir):
    """Logs and whether any breakpoint is set in them; here of the early ones on every third line."""
    stops, counts = _breakpoints(spark, sf_dir)
    return nav.has_breakpoints(counts, stops.where("line % 3 = 0 and ord < 200"))


@query(f"WITH {_BREAKPOINTS} SELECT path, 200 AS line, n_lines, coalesce(arg_min(b.line, ord) FILTER (b.line > 200), n_lines) AS next_line FROM n LEFT JOIN b USING (path) GROUP BY path, n_lines")
def q_next_bp(spark, sf_dir):
    """Where going on from line 200 stops."""
    stops, counts = _breakpoints(spark, sf_dir)
    return nav.continue_to(counts.withColumn("line", F.lit(200)), stops)


@query(f"WITH {_BREAKPOINTS} SELECT path, 200 AS line, n_lines, coalesce(arg_max(b.line, ord) FILTER (b.line < 200), 1) AS next_line FROM n LEFT JOIN b USING (path) GROUP BY path, n_lines")
def q_prev_bp(spark, sf_dir):
    """Where going back from line 200 stops."""
    stops, counts = _breakpoints(spark, sf_dir)
    return nav.continue_to(counts.withColumn("line", F.lit(200)), stops, back=True)


@query(f"WITH {_BREAKPOINTS} SELECT path, line, greatest(1, least(n_lines, line + 100)) AS ahead, greatest(1, least(n_lines, line - 100)) AS behind FROM b JOIN n USING (path)")
def q_step_clamp(spark, sf_dir):
    """Steps stay within the log."""
    stops, counts = _breakpoints(spark, sf_dir)
    return stops.join(counts, "path").select("path", "line", nav.step(F.col("line"), F.col("n_lines"), 100).alias("ahead"), nav.step(F.col("line"), F.col("n_lines"), -100).alias("behind"))


@query(inputs.match_sql() + " SELECT l.rec_id, coalesce(name, '???') AS name, coalesce(line_no, -1) AS line, coalesce(source_path, '???') AS source_path FROM l LEFT JOIN m USING (rec_id)")
def q_stack_frames(spark, sf_dir):
    """The frame of each record."""
    return nav.frames(_won(spark, sf_dir)).select(F.col("first_line").cast("long").alias("rec_id"), "name", "line", "source_path")


@query("SELECT event_id AS rec_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' ELSE 'info' END AS token FROM events")
def q_level_tokens(spark, sf_dir):
    """Highlighting class of a record's level."""
    level = inputs.log_format().capture("level", F.col("content"))
    return inputs.log(spark, sf_dir).select("rec_id", tokens.level_class(level).alias("token"))


_TOKEN_LINE_SQL = "'[' || ['info', 'W', 'dbg'][event_id % 3 + 1] || '] ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' \"' || event_type || '\" http://x.org/' || user_id || ' ' || [md5(event_type)[1:7], 'a.IOException', 'null'][event_id % 3 + 1] || ' ' || props"
#: What tokens of each class look like, written out here and not taken from what it tests.
_TOKENS_SQL = r"""
CASE WHEN regexp_matches(line, '\bTrace\b:|(?i:\[(verbose|verb|vrb|vb|v)\])|^[\s\d[:punct:]]*\bV\b') THEN 'verbose' END,
CASE WHEN regexp_matches(line, '\b(DEBUG|Debug)\b|(?i:\bdebug:)|(?i:\[(debug|dbug|dbg|de|d)\])|^[\s\d[:punct:]]*\bD\b') THEN 'debug' END,
CASE WHEN regexp_matches(line, '\b(HINT|INFO|INFORMATION|Info|NOTICE|II)\b|(?i:\b(info|information):)|(?i:\[(information|info|inf|in|i)\])|^[\s\d[:punct:]]*\bI\b') THEN 'info' END,
CASE WHEN regexp_matches(line, '\b(WARNING|WARN|Warn|WW)\b|(?i:\bwarning:)|(?i:\[(warning|warn|wrn|wn|w)\])|^[\s\d[:punct:]]*\bW\b') THEN 'warning' END,
CASE WHEN regexp_matches(line, '\b(ALERT|CRITICAL|EMERGENCY|ERROR|FAILURE|FAIL|Fatal|FATAL|Error|EE)\b|(?i:\berror:)|(?i:\[(error|eror|err|er|e|fatal|fatl|ftl|fa|f)\])|^[\s\d[:punct:]]*\bE\b') THEN 'error' END,
CASE WHEN regexp_matches(line, '\b\d{4}-\d{2}-\d{2}(T|\b)|(^|\s)\d{2}[^\w\s]\d{2}[^\w\s]\d{4}\b|\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?(Z| ?[+-]\d{1,2}:\d{2})?\b') THEN 'date' END,
CASE WHEN regexp_matches(line, '\b([0-9a-fA-F]{40}|[0-9a-fA-F]{10}|[0-9a-fA-F]{7})\b') THEN 'hash' END,
CASE WHEN regexp_matches(line, '\b[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\b|\b([0-9a-fA-F]{2,}[:-])+[0-9a-fA-F]{2,}\b') THEN 'guid' END,
CASE WHEN regexp_matches(line, '\b([0-9]+|true|false|null)\b|\b0x[a-fA-F0-9]+\b') THEN 'constant' END,
CASE WHEN regexp_matches(line, '"[^"]*"|(^|\W)''[^'']*''') THEN 'string' END,
CASE WHEN regexp_matches(line, '\b[a-zA-Z.]*Exception\b') THEN 'exception' END,
CASE WHEN regexp_matches(line, '^[\t ]*at[\t ]') THEN 'frame' END,
CASE WHEN regexp_matches(line, '\b[a-z]+://\S+\b/?') THEN 'address' END,
CASE WHEN regexp_matches(line, '(^|[^\w/\\.-])([\w-]+\.)+[\w-]+($|[^\w/\\.-])') THEN 'name' END"""


@query(f"WITH t AS (SELECT event_id, {_TOKEN_LINE_SQL} AS line FROM events) SELECT event_id, array_to_string(list_filter([{_TOKENS_SQL}], lambda x: x IS NOT NULL), ',') AS classes FROM t")
def q_token_classes(spark, sf_dir):
    """Highlighting classes of the tokens of lines."""
    pick = lambda *xs: F.element_at(F.array(*xs), (F.col("event_id") % 3 + 1).cast("int"))
    line = F.concat(
        F.lit("["), pick(F.lit("info"), F.lit("W"), F.lit("dbg")), F.lit("] "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(' "'), F.col("event_type"), F.lit('" http://x.org/'), F.col("user_id").cast("string"),
        F.lit(" "), pick(F.left(F.md5(F.col("event_type").cast("binary")), F.lit(7)), F.lit("a.IOException"), F.lit("null")), F.lit(" "), F.col("props"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(tokens.classes(line), ",").alias("classes"))


_SPAN_SQL = """WITH t AS (
  SELECT event_id, ['info', 'W', 'dbg'][event_id % 3 + 1] AS level, ['info', 'warning', 'debug'][event_id % 3 + 1] AS level_class, event_type, CAST(user_id AS VARCHAR) AS who,
         [md5(event_type)[1:7], 'a.IOException', 'null'][event_id % 3 + 1] AS tail, ['hash', 'exception', 'constant'][event_id % 3 + 1] AS tail_class FROM events
), p AS (
  SELECT event_id, [2 + length(level), 10, 8, 2 + length(event_type), 13 + length(who), length(tail), 3] AS lengths, [level_class, 'date', 'date', 'string', 'address', tail_class, 'string'] AS classes FROM t
), s AS (SELECT event_id, lengths, classes, unnest(range(1, 8)) AS i FROM p)
SELECT event_id, CAST(i - 1 AS INTEGER) AS pos, CAST(list_sum(list_concat([0], lengths[1:i - 1])) + i - 1 AS INTEGER) AS first, CAST(list_sum(lengths[1:i]) + i - 1 AS INTEGER) AS behind, classes[i] AS class FROM s"""


@query(_SPAN_SQL)
def q_token_spans(spark, sf_dir):
    """Where the tokens of lines lie, and their classes; each word of these lines is a token, with a space between them."""
    pick = lambda *xs: F.element_at(F.array(*xs), (F.col("event_id") % 3 + 1).cast("int"))
    line = F.concat(
        F.lit("["), pick(F.lit("info"), F.lit("W"), F.lit("dbg")), F.lit("] "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(' "'), F.col("event_type"), F.lit('" http://x.org/'), F.col("user_id").cast("string"),
        F.lit(" "), pick(F.left(F.md5(F.col("event_type").cast("binary")), F.lit(7)), F.lit("a.IOException"), F.lit("null")), F.lit(" 'q'"),
    )
    found = table(spark, sf_dir, "events").select("event_id", F.posexplode(tokens.spans(line)).alias("pos", "s"))
    return found.select("event_id", "pos", F.col("s.start").alias("first"), F.col("s.end").alias("behind"), "s.class")


# What users do with mappings.


@query(inputs.match_sql() + " SELECT name, level, count(*) AS n, count(DISTINCT thread) AS threads FROM m JOIN l USING (rec_id) GROUP BY ALL")
def q_statement_heat(spark, sf_dir):
    """How often each statement was logged, and by how many threads."""
    level = inputs.log_format().capture("level", F.col("content"))
    return _won(spark, sf_dir).where("stmt is not null").groupBy("stmt.name", level.alias("level")).agg(F.count("*").alias("n"), F.count_distinct("thread").alias("threads"))


@query(inputs.match_sql() + " SELECT l.thread, l.rec_id, name, lag(name) OVER (PARTITION BY l.thread ORDER BY l.rec_id) AS before FROM l LEFT JOIN m USING (rec_id)")
def q_user_path(spark, sf_dir):
    """Each thread's statements in order, with the one before."""
    order = Window.partitionBy("thread").orderBy("rec_id")
    return _won(spark, sf_dir).select("thread", "rec_id", "stmt.name").withColumn("before", F.lag("name").over(order))
