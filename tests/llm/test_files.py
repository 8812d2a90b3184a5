import random
import gzip
import hashlib

import numpy as np
import pytest

from logweave.llm import fingerprint, html_extract, spm, warc


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big, other = "é" * 700, "x" * 1000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "http://c d", "small"), (5, "http://e", None), (6, "http://f", other), (9, "http://g", big), (None, "http://h", other), (10, "http://i", "x" * 999), (11, "http://i", "x" * 999)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()}
    last = {big: 9, other: 6}
    for i, _, html in rows:
        data = (html or "").encode()
        again = html in last and last[html] != i
        assert got[i] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[html] if again else None)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STEP", 100)
    folder = f"file://{tmp_path}/w"
    from pyspark.sql import functions as F

    rows = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), F.repeat(F.lit("ab\r\n\r\n"), F.col("id").cast("int") * 9).cast("binary").alias("payload"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit")).coalesce(2)
    manifest = warc.write_archives(rows, folder)
    assert manifest.agg(F.sum("records")).first()[0] == 40
    index = warc.normalise_archives(manifest, folder)
    for r in index.collect():
        with open(r.path, "rb") as f:
            f.seek(r.offset)
            member = gzip.decompress(f.read(r.length))
        assert member.startswith(b"WARC/1.1\r\n") and r.record_id.encode() in member
    path = index.first().path
    lines = open(f"{path}.idx.jsonl").read().splitlines()
    assert len(lines) == index.where(F.col("path") == path).count()
    back = warc.read_archives(index, folder, with_payload=True)
    assert {r.page_id: bytes(r.payload) for r in back.collect()} == {i: b"ab\r\n\r\n" * 9 * i for i in range(40)}


def test_record_stream_cut_short():
    record = warc.warc_record(1, "http://a", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    assert list(warc.RecordStream(iter([record[:30], record[30:] + record]))) == [record, record]
    for cut in (record[:50], record[:-6]):
        try:
            list(warc.RecordStream(iter([cut])))
        except ValueError:
            continue
        raise AssertionError("a cut archive must not pass")


def test_fingerprints(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghijklmno"), rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(200)) for i in range(40)] + [(50, None), (51, ""), (52, "é"), (53, "a" * 5000)]
    rows += [(60, rows[3][1]), (None, "last")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, part string").repartition(5)
    got = {r.doc_id: r for r in fingerprint.document_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0] if r[0] is not None else 1)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        own, after, nxt = fingerprint.fingerprints([t.encode(), edited.encode(), following.encode()])
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == fingerprint.encode(own) and got[i].edited_fingerprint == fingerprint.encode(after)
        assert got[i].near_edited == fingerprint.likeness(own, after) and got[i].near_next == fingerprint.likeness(own, nxt)
        if i is not None and i < 39:
            assert got[i].near_edited > 0.4 > 0.3 > got[i].near_next
    assert got[60].fingerprint == got[3].fingerprint
    alone = fingerprint.document_fingerprints(docs.where("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprint.document_fingerprints(docs.limit(0)).count() == 0


def test_likeness_from_all_phrases(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmno"), rng.integers(2, 9))) for _ in range(n))
    rows = []
    for i in range(0, 12, 2):  # neighbours that share some 2% of their words
        passage = text(60)
        rows += [(i, f"{text(1500)} {passage} {text(1500)}"), (i + 1, f"{text(2000)} {passage} {text(1000)}")]
    got = {r.doc_id: r for r in fingerprint.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(fingerprint.fingerprints([t.encode()])[0].tolist()) for _, t in rows]
    for i in range(1, 12, 2):
        assert got[i].near_next == 2 * len(sets[i] & sets[i - 1]) / (len(sets[i]) + len(sets[i - 1]))
        alone = sets[i - 1] & sets[(i + 2) % 12]
        assert len(sets[i] & sets[i - 1]) > len(alone) + 20
    assert all(len(r.fingerprint) == 8 * fingerprint.KEPT for r in got.values())


def test_long_texts_are_parsed_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (130, 1000, 5000)]
    texts += [b"a" * 3000, b"ab" * 900, b"".join(bytes([x]) * k for x, k in zip(rng.integers(97, 105, 400), rng.integers(1, 40, 400), strict=True)), b"x" * 500 + texts[1] + b"y" * 700]
    whole = fingerprint.fingerprints(texts)
    monkeypatch.setattr(fingerprint, "PIECE_BYTES", 64)
    for a, b in zip(whole, fingerprint.fingerprints(texts), strict=True):
        assert a.tolist() == b.tolist()


def brute_names(text):
    """Phrase names of the last two rounds by plain loops over Python numbers."""
    mask = (1 << 64) - 1
    mix = lambda x: int(fingerprint.mix64(np.array([x & mask], np.uint64))[0])
    symbols, names = [mix(b) for b in text], set()
    for k in range(fingerprint.ROUNDS):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        s = [x if n == 1 else mix(x ^ mix(n)) for x, n in runs]
        label = list(s)
        for _ in range(fingerprint.TOSSES):
            made = []
            for i, x in enumerate(label):
                differ = (x ^ (label[i - 1] if i else ~x & mask)) or 1
                bit = (differ & -differ).bit_length() - 1
                made.append(2 * bit | (x >> bit & 1))
            label = made
        starts = [0] + [i for i in range(2, len(s) - 1) if label[i] > label[i - 1] and label[i] >= label[i + 1]]
        symbols = []
        for a, b in zip(starts, starts[1:] + [len(s)], strict=True):
            symbols.append(int(fingerprint.segment_hashes(np.array(s[a:b], np.uint64), np.array([0]), np.array([b - a]))[0]))
        if k >= fingerprint.ROUNDS - 2:
            names |= {mix(x + k) for x in symbols}
    return names


def test_fingerprints_equal_brute_force():
    rng = np.random.default_rng(4)
    texts = [b"a", b"ab", b"aab", b"aaaa", *(bytes(rng.integers(97, 97 + k, n, dtype=np.uint8)) for k, n in ((2, 50), (26, 300), (4, 400), (26, 3)))]
    for text, found in zip(texts, fingerprint.fingerprints(texts), strict=True):
        assert set(found.tolist()) == brute_names(text)


def test_very_long_texts(spark):
    rng = np.random.default_rng(6)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(250_000)]
    long = " ".join(words)
    docs = spark.createDataFrame([(1, long, "s"), (2, "short text", "s"), (3, long + " x", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    from logweave.llm import mixing, quality, substring, toxicity

    prints = {r.doc_id: r for r in fingerprint.document_fingerprints(docs).collect()}
    assert prints[2].n_chars == 10 and prints[3].near_edited > 0.6
    assert {r.doc_id: r.n_words for r in substring.repeated_passages(docs).collect()} == {1: 250_000, 3: 250_000}
    assert mixing.mix_sources(docs).count() >= 3
    assert spm.encode_documents(docs).count() == 3
    assert quality.score_quality(docs, labels).count() == toxicity.score_toxicity(docs, labels).count() == 3
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "concat('<article><p>', text, '</p></article>') AS html")
    assert {r.page_id: r.n_chars for r in html_extract.extract_main_text(pages).collect()} == {1: len(long), 2: 10, 3: len(long) + 2}
    assert {r.page_id: r.record_type for r in warc.archive_round_trip(pages).collect()} == dict.fromkeys((1, 2, 3), "response")


def test_parsing_is_local():
    rng = np.random.default_rng(2)
    body = bytes(rng.integers(97, 110, 4000, dtype=np.uint8))

    def names(t):
        s, d = fingerprint.mix64(np.frombuffer(t, np.uint8).astype(np.uint64)), np.zeros(len(t), int)
        for _ in range(3):
            s, d = fingerprint.parse_round(s, d)
        return set(s.tolist())

    a, b = names(b"prefix" + body), names(b"another start of some length " + body + b" end")
    assert len(a & b) >= len(a) - 8


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><header><p>Site</p></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies on this page to make it better for all of you</div>
<article><h1>A title</h1><p>First &lt;b&gt;\n  para&nbsp;graph<br>of <b>text</b> that is long enough to be read</p><p>To.<script>if (a < b) { c("</p>") }</script>
<div class="ad">Buy now</div><p>Last words &copy 2020<section id="comments"><p>A comment that somebody wrote here about the text</p></section></article>
<aside>See also</aside><form><p>Your name</p></form><footer>All rights</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<article><p>Cut off in the <b>middle of"), (None, "u", "no markup"), (5, "u", "<" * 3000), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars long")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract_main_text(pages).collect()]
    text = "A title\nFirst <b> para graph of text that is long enough to be read\nTo.\nLast words © 2020"
    assert got[0] == got[6] == (1, text, len(text))
    assert got[1] == (2, "", 0) and got[2] == (3, "", 0) and got[3][1] == "Cut off in the middle of"
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "seen"),
    [
        ("<html><head><title>T</title><meta charset=utf-8><p>One</p><p>Two</p>", ["One", "Two"]),
        ("<head><title>T<x></title><script>a='<p>'</script><link rel=x><article>One</article>", ["One"]),
        ("<head><title>T</title></head><p>One</p>", ["One"]),
        ("<head><style>p{}</style><body><p>One</p>", ["One"]),
        ("<p>One</p><svg><path d=x><p>Two</p>", ["One", "Two"]),
        ("<div>One <select><option>a</div><p>Two</p>", ["One", "Two"]),
        ("<noscript>no<div>One</div>", ["One"]),
        ("<p>One</p><script>x<p>Two</p>", ["One"]),
    ],
)
def test_unclosed_unseen_elements(page, seen):
    assert [b.text for b in html_extract.blocks(page)] == seen


def test_tree_on_held_back_pages():
    pages = [html_extract.labelled_page(k) for k in range(html_extract.MADE, html_extract.MADE + html_extract.HELD_BACK)]
    rows, labels = html_extract.labelled(pages)
    kept = html_extract.trained_tree().decide(rows)
    assert (kept & (labels > 0)).sum() >= 0.99 * kept.sum() and (kept & (labels > 0)).sum() >= 0.99 * labels.sum()
    # Neither the texts' measures nor the elements' names do it alone.
    learnt = html_extract.labelled([*html_extract.BY_HAND, *map(html_extract.labelled_page, range(html_extract.MADE))])
    for some in (range(3, 9), range(2)):
        alone = html_extract.grow(learnt[0][:, list(some)], learnt[1]).decide(rows[:, list(some)])
        assert (alone & (labels > 0)).sum() < 0.9 * alone.sum()
    # Pages without any telling element or class are told by lengths and links.
    bare = [p for k, p in enumerate(pages, html_extract.MADE) if k % 3 == 2]
    rows, labels = html_extract.labelled(bare)
    assert not rows[:, :2].any() and (html_extract.trained_tree().decide(rows) == (labels > 0)).mean() > 0.97


def test_deep_markup_takes_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<div>" * 40_000 + "x" + "</table>" * 40_000, "<b>x<div>" + "<i>" * 40_000 + "</b>" * 40_000, "<b>" * 40_000 + "<h1>x</h1>" * 9_000, "<p>" * 40_000 + "long " * 200_000):
        assert html_extract.blocks(page)
    assert time.perf_counter() - began < 20


def test_sentencepiece(spark):
    model = spm.model_of(open(spm.MODEL_PATH, "rb").read())
    texts = ["", "a", " a", "a  b", " ", "▁x ▁", "日本語 テキスト", "hello world\n\n  x", "\t\x00é", "🎉🎉", "w" * 3000 + " y", None, "the end"]
    docs = spark.createDataFrame([(i, t, "src", 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_ids long")
    out = spm.encode_documents(docs)
    assert out.columns == ["doc_id", "source", "ids", "n_ids", "text_sha256"]
    back = {r.doc_id: r.text for r in spm.decode_documents(out).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert spm.encode_documents(docs.limit(0)).count() == 0
    for t in texts:
        if t and len(t) < 200:
            whole = spm.SPACE + t.replace(spm.SPACE, spm.LITERAL).replace(" ", spm.SPACE)
            for step in (1, 3, 100):
                parts = [whole[i : i + step] for i in range(0, len(whole), step)]
                assert [i for ids in model.stream(parts) for i in ids] == model.encode(t)


def test_sentencepiece_equals_brute_force():
    model = spm.model_of(open(spm.MODEL_PATH, "rb").read())
    assert not hasattr(model, "short")  # one search for segments of any length

    def brute(text):
        """The best segmentation of the whole text at once, of equal sums the one with the longest last piece."""
        text = spm.SPACE + text.replace(spm.SPACE, spm.LITERAL).replace(" ", spm.SPACE)
        best = [(0.0, [])]
        for end in range(1, len(text) + 1):
            found = None
            for start in range(max(0, end - model.longest), end):
                piece = text[start:end]
                if piece in model.pieces:
                    i, score = model.pieces[piece]
                    own = [i]
                elif end == start + 1:
                    own = [model.bytes[b] for b in piece.replace(spm.LITERAL, spm.SPACE).encode()]
                    score = model.unknown
                else:
                    continue
                if found is None or best[start][0] + score > found[0]:
                    found = (best[start][0] + score, best[start][1] + own)
            best.append(found)
        return best[-1][1]

    import random

    rng = random.Random(9)
    for alphabet in ("ab", "the ", "aeiou rstln", "é日▁ \n☃x", "ab" * 40 + " "):
        for n in (1, 2, 7, 60, 64, 65, 300, 700):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert model.encode(text) == brute(text), text
            whole = spm.SPACE + text.replace(spm.SPACE, spm.LITERAL).replace(" ", spm.SPACE)
            assert [i for ids in model.stream(whole[k : k + 5] for k in range(0, len(whole), 5)) for i in ids] == brute(text)


def test_sentencepiece_streams_documents(monkeypatch):
    model = spm.model_of(open(spm.MODEL_PATH, "rb").read())
    prose = "It was a bright cold day in April, and the clocks were striking thirteen.\n" * 40
    assert len(list(model.commits(prose))) > len(prose) / 100  # and not once at the end
    rng = random.Random(3)
    texts = [prose, "x" * 5000, " " * 2000 + "a", "word " * 300 + "y" * 700 + "\n\n" + "z" * 255 + " " + "z" * 256 + " \n" + " " * 300, "▁" * 600 + " ▁a"]
    texts += ["".join(rng.choice("ab \n▁") * rng.choice((1, 1, 2, 90)) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    once = []
    for t in texts:
        whole = (spm.SPACE if t else "") + t.replace(spm.SPACE, spm.LITERAL).replace(" ", spm.SPACE)
        once.append([i for ids in model.stream([whole]) for i in ids])
    for step in (256, 16, 1):
        monkeypatch.setattr(spm, "STEP", step)
        model.known.forget()
        for t, ids in zip(texts, once, strict=True):
            assert model.encode(t) == ids and model.decode(ids) == t


def test_sentencepiece_window_is_bounded():
    model = spm.model_of(open(spm.MODEL_PATH, "rb").read())
    given, most = 0, 0

    def parts():
        nonlocal given
        for _ in range(3000):
            given += 9
            yield "plainwords"[:9]

    done = 0
    for ids in model.stream(parts()):
        done += len(model.decode(ids))
        most = max(most, given - done)
    assert most < 20 * model.longest


def test_sentencepiece_equals_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(open(spm.MODEL_PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # the library adds up in single precision
        p.score = max(p.score, -50_000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = spm.Model(proto.SerializeToString())
    for t in ("hello there, general", "unaffordable  spaces", "naïve café — déjà vu\nnext line", "import numpy as np", "ünïcödé ☃"):
        assert model.encode(t) == library.encode(t)
