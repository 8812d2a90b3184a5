import hashlib
import re
from itertools import permutations

from pyspark.sql import Row

from logweave.llm import fill_middle, filter_audit
from logweave.llm.queries import op12_fill_middle

FILTERS = "ABCDE"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_audit_equals_brute_force(spark):
    many = " ".join(f"w{k}" for k in range(60))
    texts = ["", None, "a a a", many, many, many + " $", "ABC " + many, "W " * 60, "#", many.upper(), many, "x" * 300_000, "é " * 70, "a\tb\x0bc " * 30]
    rows = [(i, t, ("p", "q", None, "")[i % 4], "clash") for i, t in enumerate(texts)]
    rows += [(3, many, "q", "again"), (None, many, "p", ""), (None, "alone", "q", ""), (None, "alone", "q", "")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 14)] + [(3, 0, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit_filters(docs, marks).collect()}

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, part, _ in rows:
        t = t or ""
        w = words(t)
        first = min([j for j, u, *_ in rows if (u or "") == t and j is not None], default=None)
        own = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i != first}
        fails.append((part or "", i, {k for k, v in own.items() if v}))
    want, shapley = {}, {}
    for part in {p for p, *_ in fails}:
        for order in permutations(FILTERS):
            left = [(i, f) for p, i, f in fails if p == part]
            gone = []
            for k, x in enumerate(order):
                out = [(i, f) for i, f in left if x in f]
                stay = [(i, f) for i, f in left if x not in f]
                want[part, "".join(order), k + 1] = [len(stay), len(out), sum(x in f for _, f in gone), sum(f == {x} for _, f in left + gone), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out)]
                shapley[part, x] = shapley.get((part, x), 0) + len(out)
                left, gone = stay, gone + out
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert filter_audit.audit_filters(docs.limit(0), marks).count() == 0
    assert filter_audit.audit_filters(docs, marks.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def cut_by_hand(i, t):
    t = t or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    parts = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, None, t
    p, m, s = parts
    return (len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_brute_force(spark):
    texts = ["", None, "a", "one two", "\x01\x02\x01", "\x021 \x01a\x02", "<P>x", "a<P", "<", "<S", "M><P x <", "naïve 😀😀 text\n\n", "$1 \\ $0", "x" * 200_000, "a b " * 60_000, "\x00nul", "<M>", "..", "é"]
    rows = [(i * 20 + k, t) for k, t in enumerate(texts) for i in range(25)] + [(None, "no id at all"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, fim_n="old", lw_text="kept", **{"a.b": 1}) for i, t in rows], "doc_id long, text string, fim_n string, lw_text string, `a.b` int")
    out = fill_middle.fill_in_middle(docs).withColumn("again", fill_middle.restored(fill_middle.F.col("fim_output"), fill_middle.F.col("fim_form"))).collect()
    assert len(out) == len(rows) and all(r.lw_text == "kept" and r["a.b"] == 1 and r.again == (r.text or "") for r in out)
    got = sorted(((r.doc_id, (r.fim_n, r.fim_form, r.fim_prefix, r.fim_middle, r.fim_suffix, r.fim_output)) for r in out), key=lambda x: (x[0] or -1, x[1][5]))
    assert got == sorted(((i, cut_by_hand(i, t)) for i, t in rows), key=lambda x: (x[0] or -1, x[1][5]))
    assert {r.fim_form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    assert {r.fim_form for r in fill_middle.fill_in_middle(docs, spm_percent=100, fim_percent=100).where("text = 'one two'").collect()} == {"spm"}


def test_fill_in_middle_query(spark):
    rows = op12_fill_middle(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        n, form, p, m, _, out = cut_by_hand(r.doc_id, texts[r.doc_id])
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(r) == (r.doc_id, n, form, p if p is None else len(p), m if m is None else len(m), sha(out), sha(texts[r.doc_id]))
