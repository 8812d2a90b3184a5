import random
import re
import time

import pytest
from pyspark.sql import functions as F

from logweave.functions.literal import Matcher
from logweave.functions.templates import compile_template
from logweave.operators import anchors, derive, match, records
from logweave.plans import inputs, queries

SF = "/root/testdata/sf0.001"


def by_regex(executable, body):
    m = re.compile(executable.removesuffix("\\z") + "\\Z").match(body)
    return list(m.groups()) if m else None


def test_segments_equal_greedy_regex():
    rng = random.Random(4)
    texts = ["{}", "a{}", "{}a", "{}{}", "a{}b{}a", "{}ab{}ab{}", "aa{}aa", "{} {}: {}", r"{}\w{}", r"a\d{}b", r"\ba{}", r"{}\n\t{}", r"{}\x41B{}", r"{}b\b", "é{}é", "", "a", r"\\{}", "{}a\\\"b{}", r"\q{}"]
    tried = matched = 0
    for text in texts:
        t = compile_template(text, "Java")
        if t is None:
            continue
        m = Matcher(t.executable)
        assert m.pattern is None
        for _ in range(400):
            body = "".join(rng.choice(["a", "b", "ab", " ", ":", "1", "é", "\n", "\t", "A", "B", "\\", '"', "\0"]) for _ in range(rng.randint(0, 9)))
            assert m.values(body) == by_regex(t.executable, body), (text, body)
            tried += 1
            matched += m.values(body) is not None
    assert tried > 5000 and matched > 400
    repeated = Matcher("(?s)\\A(.+) and \\1\\z")
    assert repeated.values("x and x") == ["x"] and repeated.values("x and y") is None and repeated.literals() == []
    assert Matcher("(?s)\\Ax\0\\w\\wy(.+)\\z").literals() == ["x\0", "y"]


def test_long_bodies_take_linear_time():
    m = Matcher(compile_template("{} a {} a {} end", "Java").executable)
    began = time.perf_counter()
    assert m.values(" a" * 50_000) is None  # 100 KB; a backtracking search would not come back
    found = m.values(" a" * 50_000 + " a x end")
    assert time.perf_counter() - began < 0.2 and [len(v) for v in found][1:] == [1, 1]


def catalogue(spark, n):
    """A statement in each of n files of two roots; neighbours share long beginnings."""
    rows = []
    for k in range(n):
        t = compile_template((f"the service with number {k} has {{}} of {{}}", f"{{}} was given to the service {k}", "{}: {}")[k % 3 if k % 50 else 2], "Java")
        rows.append((k % 2, f"/r{k % 2}/d{k % 7}/F{k % 90}.java", f"F{k % 90}.java", k, "Java", k, k, 0, f"f{k}", "t", t.quality, t.pattern, t.executable, t.prefix, [], [], ["a", "b"]))
    return spark.createDataFrame(rows, inputs.STATEMENT_TYPE)


def test_slices_give_what_one_gives(spark, monkeypatch):
    statements = catalogue(spark, 400)
    bodies = [f"the service with number {k} has {k} of x" for k in range(0, 400, 7)] + [f"w{k} was given to the service {k}" for k in range(0, 400, 5)] + ["a: b", "nothing", None, "", ": "]
    rows = [(i, b, h) for i, (b, h) in enumerate((b, h) for b in bodies for h in (None, "F1.java", "d3", "F9"))]
    log = spark.createDataFrame(rows, "rec_id int, body string, file string").repartition(3)
    key = lambda df: sorted((r.rec_id, r.stmt and tuple(r.stmt[c] for c in ("root_ord", "source_path", "stmt_idx")), r.captured) for r in df.collect())
    whole = key(match.match(log, statements))
    assert sum(s is not None for _, s, _ in whole) > 40
    passes, real = [], match._winners
    monkeypatch.setattr(match, "SLICE_STATEMENTS", 90)
    monkeypatch.setattr(match, "_winners", lambda *a: passes.append(1) or real(*a))
    sliced = match.match(log, statements)
    assert key(sliced) == whole and len(passes) == 5
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # a task holds one slice
    firsts = sorted(tuple(r) for r in match.first_in_files(log, statements, ["rec_id"]).collect())
    monkeypatch.setattr(match, "SLICE_STATEMENTS", 100_000)
    assert firsts == sorted(tuple(r) for r in match.first_in_files(log, statements, ["rec_id"]).collect())


def test_joined_anchors_give_what_one_slice_gives(spark, monkeypatch):
    statements = catalogue(spark, 400)
    bodies = [f"the service with number {k} has {k} of x" for k in range(0, 400, 7)] + [f"é{k} was given to the service {k}" for k in range(0, 400, 5)] + ["a: b", "nothing", None, "", ": "]
    rows = [(i, b, h) for i, (b, h) in enumerate((b, h) for b in bodies for h in (None, None, "F1.java", "d3", "F9"))] + [(7, bodies[0], None)] * 2
    log = spark.createDataFrame(rows, "rec_id int, body string, file string").repartition(3)
    key = lambda df: sorted(((r.rec_id, r.stmt and tuple(r.stmt[c] for c in ("root_ord", "source_path", "stmt_idx")), r.captured) for r in df.collect()), key=str)
    firsts = lambda: sorted(tuple(r) for r in match.first_in_files(log, statements, ["rec_id"]).collect())
    whole, best, first = key(match.match(log, statements)), key(match.match(log, statements, True)), firsts()
    assert sum(s is not None for _, s, _ in whole) > 40
    monkeypatch.setattr(match, "SLICE_STATEMENTS", 20)
    monkeypatch.setattr(match, "MOST_SLICES", 2)
    monkeypatch.setattr(anchors, "_STEP", 7)
    passes, real = [], match._fits
    monkeypatch.setattr(match, "_fits", lambda *a: passes.append(1) or real(*a))
    # Only the statements without much literal text are passes, however many others there are.
    loose = sum(k % 3 == 2 or k % 50 == 0 for k in range(400))
    assert key(match.match(log, statements)) == whole and len(passes) == -(-loose // 20)
    assert key(match.match(log, statements, True)) == best and firsts() == first
    monkeypatch.setattr(anchors, "COMMON", 1 / anchors.SAMPLE_RECORDS)
    assert key(match.match(log, statements)) == whole


def test_candidates_are_bounded_by_hits(spark):
    _, index = match._Slice(catalogue(spark, 6000).select(*match.STATEMENT, "file_name").toArrow()).opened()
    loose = sum(k % 3 == 2 or k % 50 == 0 for k in range(6000))
    assert len(index.candidates("the service with number 4321 has 3 of x")) <= 12
    assert loose <= len(index.candidates("1: 2")) <= loose + 2


def brute_find(wanted, files):
    parts = wanted.split("/")
    out = []
    for root, path in files:
        have = path.split("/")
        k = 0
        for c in have[:-1]:
            k += k < len(parts) - 1 and c == parts[k]
        if have[-1] == parts[-1] and k == len(parts) - 1:
            out.append((wanted, root, path, path == wanted or path.endswith("/" + wanted)))
    return out


def test_find_files_by_suffix(spark):
    rng = random.Random(2)
    files = sorted({(rng.randrange(2), "/r/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) + rng.choice(("/X.java", "/Y.java"))) for _ in range(120)})
    files = [(o, p.replace("//", "/")) for o, p in files]
    wanted = {"/".join([*(rng.choice("abcd") for _ in range(rng.randint(0, 3))), rng.choice(("X.java", "Y.java", "Z.java"))]) for _ in range(60)} | {"/r/X.java", "a/.*/X.java", r"\Qa\E/X.java"}
    table = spark.createDataFrame(files, "root_ord int, source_path string")
    asked = spark.createDataFrame([(w,) for w in wanted] + [(None,)], "wanted string")
    got = sorted(map(tuple, derive.find_files(asked, table).collect()))
    assert got == sorted(x for w in wanted for x in brute_find(w, files)) and len({x[3] for x in got}) == 2
    best = {w: min(((o, not d, p) for w2, o, p, d in got if w2 == w))[2] for w, *_ in got}
    assert {r.wanted: r.source_path for r in derive.resolve(asked, table).collect()} == best
    resolved = match._Files(table.toArrow()).opened()
    assert {w: resolved(w) for w in wanted if resolved(w)} == best


@pytest.mark.parametrize("name", ["q_json_full", "q_trace_gate"])
def test_log_is_read_and_matched_once(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    assert plan.count("MapInArrow") == 2  # one matches, one resolves


def test_joined_call_sites_equal_those_of_the_pass(spark, monkeypatch):
    files = spark.createDataFrame([(0, "/src/a/org/example/Main.java"), (1, "/src/b/java/base/java/lang/Thread.java")], "root_ord int, source_path string")
    matched = match.match(records.parse(inputs.log(spark, SF), inputs.log_format()).withColumn("file", F.lit(None).cast("string")), inputs.statements(spark))
    key = lambda df: sorted((r.rec_id, r.exception_trace) for r in df.where("trace is not null").collect())
    in_pass = key(derive.with_call_sites(matched, files, ["path", "rec_id"]))
    monkeypatch.setattr(match, "MOST_FILES", 1)
    joined = key(derive.with_call_sites(matched, files, ["path", "rec_id"]))
    assert [(i, x or None) for i, x in in_pass] == [(i, x or None) for i, x in joined] and sum(bool(x) for _, x in joined) > 20
