"""Redaction, verification, reports, review, pages, geometry, model output and streams on stated cases."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import geometry as G
from spanlake.operators import merge as M
from spanlake.operators import model as L
from spanlake.operators import pages as P
from spanlake.operators import recognition as O
from spanlake.operators import redact as R
from spanlake.operators import report as S
from spanlake.operators import review as V
from spanlake.operators import verify as Y
from spanlake.operators.detect import detect, explode_entities
from spanlake.plans.operator_queries import QUERIES

SF = "/root/testdata/sf0.001"
SPAN = "array<struct<start_pos:int,end_pos:int,category:string,text:string,accepted:boolean>>"


def spans(text, *pairs):
    return [(a, b, "EMAIL", text[a:b], ok) for a, b, *rest in pairs for ok in [rest[0] if rest else True]]


REDACT = [
    ("Email me at test@example.com please", [(12, 28)], "text", "Email me at [REDACTED] please"),
    ("Call 555-1234 or email a@b.com", [(5, 13), (23, 30)], "text", "Call [REDACTED] or email [REDACTED]"),
    ("test@example.com is my email", [(0, 16)], "text", "[REDACTED] is my email"),
    ("My email is test@example.com", [(12, 28)], "text", "My email is [REDACTED]"),
    ("SSN: 123-45-6789", [(5, 16)], "blocks", "SSN: " + "█" * 11),
    ("Email a@b.com and c@d.com", [(6, 13), (18, 25, False)], "text", "Email [REDACTED] and c@d.com"),
    ("Email a@b.com", [(6, 13, False)], "text", "Email a@b.com"),
    ("Nothing to redact here", [], "text", "Nothing to redact here"),
    ("", [], "text", ""),
    ("A 123-45-6789 B 987-65-4321 C", [(2, 13), (16, 27)], "text", "A [REDACTED] B [REDACTED] C"),
]


@pytest.mark.parametrize("mode", ["safe", "compat"])
def test_redaction(spark, mode):
    rows = spark.createDataFrame([(i, t, spans(t, *p), s) for i, (t, p, s, _) in enumerate(REDACT)], f"id int, text string, spans {SPAN}, style string")
    for style in ("text", "blocks"):
        got = rows.where(F.col("style") == style).select("id", R.redact(F.col("text"), R.accepted(F.col("spans")), style, mode).alias("r")).collect()
        for r in got:
            assert r.r == REDACT[r.id][3]


def test_overlaps_and_rules(spark):
    t = "abcdefghij"
    rows = spark.createDataFrame([(t, spans(t, (1, 5), (3, 7)))], f"text string, spans {SPAN}")
    safe, compat = rows.select(R.redact(F.col("text"), F.col("spans"), "blocks"), R.redact(F.col("text"), F.col("spans"), "text", "compat")).first()
    assert safe == "a" + "█" * 6 + "hij"
    x = t[:3] + "[REDACTED]" + t[7:]
    assert compat == x[:1] + "[REDACTED]" + x[5:]
    none = rows.select(F.size(R.accepted(F.col("spans"), F.create_map(F.lit("EMAIL"), F.lit(False))))).first()[0]
    assert none == 0


def test_segments(spark):
    t = "Email me at test@example.com please"
    rows = spark.createDataFrame([(t, spans(t, (12, 28)))], f"text string, spans {SPAN}")
    got = [tuple(x) for x in rows.select(R.segments(F.col("text"), F.col("spans"))).first()[0]]
    assert got == [("Email me at ", None), ("test@example.com", "EMAIL"), (" please", None)]


def test_leaks(spark):
    cases = [
        (b"This is a clean PDF with no personal data", ["John Smith", "123-45-6789"], []),
        (b"Some PDF content John Smith more content", ["John Smith"], [("John Smith", 17)]),
        (b"metadata author: john smith", ["John Smith"], [("John Smith", 17)]),
        (b"John Smith lives at 123 Main St", ["John Smith", "123 Main St"], [("John Smith", 0), ("123 Main St", 20)]),
        (b"John Smith appears twice John Smith", ["John Smith", "john smith", "JOHN SMITH"], [("John Smith", 0)]),
        (b"xx\0J\0o\0h\0nxx", ["John"], [("John", 2)]),
        (b"AAAA123-45-6789BBBB", ["123-45-6789"], [("123-45-6789", 4)]),
        (b"", ["John Smith"], []),
        (b"anything", [], []),
        ("le café".encode(), ["café"], [("café", 3)]),
    ]
    rows = spark.createDataFrame([(i, d, p) for i, (d, p, _) in enumerate(cases)], "id int, data binary, pii array<string>")
    for r in rows.select("id", Y.leaks(F.col("data"), F.col("pii")).alias("l")).collect():
        assert [(x.text, x.byte_offset) for x in r.l] == cases[r.id][2]


@pytest.fixture(scope="module")
def entities(spark):
    rows = spark.createDataFrame([(1, "a@b.com, A@B.com and 123-45-6789"), (2, "c@d.org")], "doc_id int, text string")
    return explode_entities(detect(rows), "doc_id").withColumn("accepted", F.col("start_pos") != 9)


def test_reports(entities):
    assert S.summary(entities).first()[:4] == (4, 3, 1, 3)
    g = {(r.doc_id, r.category): r for r in S.groups(entities, ["doc_id"]).collect()}
    assert g[1, "EMAIL"].ids == ["1-0-7-EMAIL", "1-9-16-EMAIL"] and not g[1, "EMAIL"].all_accepted and not g[1, "EMAIL"].none_accepted
    c = {(r.doc_id, r.category): (r.n_unique, r.n_total, r.state) for r in S.category_groups(entities, ["doc_id"]).collect()}
    assert c[1, "EMAIL"] == (1, 2, "mixed") and c[2, "EMAIL"] == (1, 1, "all")
    text = S.render(entities, "doc_id", F.lit("2024-01-01 00:00:00")).where("doc_id = 1").first().report
    assert "[Email]\n  - a@b.com\n[SSN]\n  - 123-45-6789" in text and "KEPT\n----\n  - [Email] A@B.com" in text


def test_review(spark, entities):
    log = spark.createDataFrame([(1, "1-0-7-EMAIL", 1, False), (1, "1-0-7-EMAIL", 2, True), (2, "2-0-7-EMAIL", 1, False)], "doc_id int, entity_id string, seq int, accepted boolean")
    got = {r.entity_id: r.accepted for r in V.final_state(entities, log).collect()}
    assert got["1-0-7-EMAIL"] and not got["2-0-7-EMAIL"] and not got["1-9-16-EMAIL"]
    assert {r.entity_id for r in V.toggle(entities, log).where("not accepted").collect()} == {"1-9-16-EMAIL", "2-0-7-EMAIL"}
    acts = [(1, 1, "reject_all", None, None), (1, 2, "toggle", "1-0-7-EMAIL", None), (1, 3, "undo", None, None), (1, 4, "undo", None, None), (1, 5, "redo", None, None), (2, 1, "category", "EMAIL", False), (2, 2, "undo", None, None), (2, 3, "undo", None, None)]
    state = {r.entity_id: r.accepted for r in V.replay(entities, spark.createDataFrame(acts, "doc_id int, seq int, action string, target string, accepted boolean")).collect()}
    assert state == {"1-0-7-EMAIL": False, "1-9-16-EMAIL": False, "1-21-32-SSN": False, "2-0-7-EMAIL": True}


def test_merge(spark):
    e = "array<struct<start_pos:int,end_pos:int,category:string,text:string>>"
    rows = spark.createDataFrame([([(5, 9, "SSN", "x")], [(5, 9, "PERSON", "x"), (0, 3, "PERSON", "y"), (5, 8, "DATE", "z")])], f"a {e}, b {e}")
    got = [(x.start_pos, x.end_pos, x.source) for x in rows.select(M.merge(F.col("a"), F.col("b"))).first()[0]]
    assert got == [(0, 3, "ner"), (5, 9, "regex"), (5, 8, "ner")]


def test_chunks():
    assert L.cut("") == []
    for n in (1, 1499, 1500):
        assert L.cut("x" * n) == [(0, n)]
    assert L.cut("x" * 1501) == [(0, 1500), (1300, 201)]
    assert L.cut("a" * 900 + "." + "b" * 900)[:2] == [(0, 901), (701, 1100)]
    assert L.cut("a" * 900 + " " + "b" * 900)[0] == (0, 901)


def test_parse_and_locate():
    assert L.parse('[{"type":"PERSON","text":"Ann"}, 5, {"type":"X","text":"a"}, {"type":"Y","text":7},]') == [{"type": "PERSON", "text": "Ann"}]
    assert L.parse("[1, 2") == [] and L.parse(None) == [] and L.parse("[NaN]") == []
    assert L.locate("aa", "aaa", set()) == [(0, 2, True), (1, 3, True)]
    assert L.locate("John  smith", "x JOHN\nSMITH y", set()) == [(2, 12, False)]
    assert L.locate("BHUICYAN", "name BHUIYAN here", set()) == [(5, 12, False)]
    assert L.locate("zzz", "abc", set()) == [] and L.locate("  ", "abc", set()) == []
    got = L.place("Ann met Ann", [[{"type": "PERSON", "text": "Ann"}], [{"type": "PERSON", "text": "Ann"}, {"type": "?", "text": "met"}]])
    assert [(e["start_pos"], e["confidence"]) for e in got] == [(0, 0.95), (8, 0.95)]


def test_model_detection(spark):
    rows = spark.createDataFrame([(1, "Ann Lee was here. " * 120), (2, None), (3, "")], "doc_id int, text string")
    got = L.detect(rows, L.FirstWords(2)).collect()
    assert {r.doc_id for r in got} == {1} and sum(r.text == "Ann Lee" for r in got) == 120


def test_pages(spark):
    items = [(1, 0, 0, "Hello", 10.0, 700.0, 12.0, 30.0, False), (1, 0, 1, "World", 60.0, 700.0, 12.0, 30.0, True), (1, 0, 2, "next", 10.0, 680.0, 12.0, 24.0, False), (1, 0, 3, "low", 10.0, 660.0, 12.0, 18.0, False), (1, 1, 0, "C A R D", 0.0, 0.0, 12.0, 10.0, False)]
    df = spark.createDataFrame(items, "doc_id int, page_index int, item_idx int, str string, x double, y double, font_h double, width double, has_eol boolean")
    pages = P.page_offsets(P.page_text(df, ["doc_id", "page_index"]))
    got = {r.page_index: (r.text, r.text_start, r.text_end) for r in pages.collect()}
    assert got == {0: ("Hello World\nnext\nlow", 0, 20), 1: ("CARD", 22, 26)}
    fused = P.fuse(pages, spark.createDataFrame([(1, 0, "seen")], "doc_id int, page_index int, text string"))
    assert {r.page_index: (r.text, r.text_start) for r in fused.collect()} == {0: ("seen", 0), 1: ("CARD", 6)}
    assert P.document_text(pages).first().text == "Hello World\nnext\nlow\n\nCARD"


def test_quality(spark):
    rows = spark.createDataFrame([(1, []), (2, ["  "]), (3, list("abcdefgh")), (4, ["word" * 50] * 40)], "id int, s array<string>")
    got = {r.id: r.q for r in rows.select("id", P.page_quality(F.col("s"), F.lit(612.0), F.lit(792.0)).alias("q")).collect()}
    assert got[1].needs_vision and got[2].needs_vision and got[3].reason.startswith("Many single") and got[4].score == 1.0 and got[4].reason is None


def test_boxes(spark):
    items = [{"str": "Call 555", "x": 10.0, "y": 700.0, "font_h": 10.0, "width": 80.0, "has_eol": False}, {"str": "-1234", "x": 90.0, "y": 700.0, "font_h": 10.0, "width": 50.0, "has_eol": True}]
    (x, y, w, h), = G.item_boxes("555-1234", items, 792.0)
    assert (x, y, round(w, 6), h) == (59.0, 82.0, 82.0, 14.0)
    words = [{"text": t, "x0": 10.0 * i, "y0": 5.0, "x1": 10.0 * i + 9, "y1": 15.0} for i, t in enumerate(["Mr", "JOHN", "SMlTH", "mail:a@b.co"])]
    assert G.word_boxes("mr john", words) == [(0.0, 5.0, 19.0, 10.0)]
    assert G.word_boxes("a@b.co", words) == [(30.0, 5.0, 9.0, 10.0)]
    assert G.word_boxes("John Smith", words) == [(10.0, 5.0, 19.0, 10.0)]
    assert G.word_boxes("", words) == [] and G.word_boxes("nobody at all", words) == []
    ents = spark.createDataFrame([(1, "e1", 5, 13, "555-1234", True)], "doc_id int, entity_id string, start_pos int, end_pos int, text string, accepted boolean")
    pages = spark.createDataFrame([(1, 0, 792.0, 0, 13, items, None)], "doc_id int, page_index int, height double, text_start int, text_end int, items array<struct<str:string,x:double,y:double,font_h:double,width:double,has_eol:boolean>>, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")
    over = G.overlays(ents, pages)
    assert len(G.page_boxes(over, ents).first().boxes) == 1 and G.unmapped(ents, over).count() == 0


def _plain_word_boxes(needle, words):
    """A plain reading of what word_boxes() is to give."""
    low = L._EDGES.sub("", needle.lower())
    kept = [(t, w) for w in words if (t := L._EDGES.sub("", w["text"]))]
    if not low or not kept:
        return []
    boxes = lambda a, b: G._merged([(w["x0"], w["y0"], w["x1"] - w["x0"], w["y1"] - w["y0"]) for _, w in kept[a:b]])
    for a in range(len(kept)):
        for b in range(a + 1, len(kept) + 1):
            if " ".join(t for t, _ in kept[a:b]).lower() == low:
                return boxes(a, b)
    if inside := [k for k, (t, _) in enumerate(kept) if low in t.lower()]:
        return G._merged([x for k in inside for x in boxes(k, k + 1)])
    parts = [p for p in L._SPACE.split(low) if p]
    for a in range(len(kept) - len(parts) + 1):
        far = [L.distance(kept[a + k][0].lower(), p) for k, p in enumerate(parts)]
        if all(d <= max(2, math.ceil(len(p) * 0.3)) for d, p in zip(far, parts, strict=True)) and sum(far) <= max(3, math.ceil(len(low) * 0.2)):
            return boxes(a, a + len(parts))
    for a in range(len(kept)):
        for b in range(a + 1, min(a + 10, len(kept)) + 1):
            if low in " ".join(t for t, _ in kept[a:b]).lower():
                return boxes(a, b)
            if sum(len(t) + 1 for t, _ in kept[a:b]) - 1 > len(low) + 20:
                break
    return []


def test_overlays_of_many_entities(spark):
    """More entities than a block, on a scan and on a page of items: each as by itself, with ids and keys of other kinds."""
    rnd = random.Random(5)
    token = lambda: "".join(rnd.choice(["a", "b", "abc", "A", "Σ", "x y", "e"]) for _ in range(rnd.randrange(6)))
    words = [{"text": token(), "x0": 10.0 * k, "y0": float(k // 9), "x1": 10.0 * k + 9, "y1": 9.0} for k in range(60)]
    items = [{"str": token(), "x": 20.0 * (k % 7), "y": 700.0 - k // 7 * 9, "font_h": rnd.choice([0.0, -8.0, 10.0]), "width": 15.0, "has_eol": k % 5 == 4} for k in range(60)]
    texts = [rnd.choice([token(), token() + " " + token(), " ".join(w["text"] for w in words[k % 50 : k % 50 + 2]), items[k % 60]["str"]]) for k in range(2 * G.BLOCK + 3)]
    entities = spark.createDataFrame([("d", k, k, k + 1, t) for k, t in enumerate(texts)], "file string, entity_id long, start_pos int, end_pos int, text string")
    shape = "file string, page_index long, height int, text_start int, text_end int, items array<struct<str:string,x:double,y:double,font_h:double,width:double,has_eol:boolean>>, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
    pages = spark.createDataFrame([("d", 0, 792, 0, 300, items, None), ("d", 1, 792, 300, 301, None, words), ("d", 2, 792, 301, 302, [], None)], shape)
    got = {(r.page_index, r.entity_id): [tuple(b) for b in r.boxes] for r in G.overlays(entities, pages, "file").collect()}
    want = {(1, k): b for k, t in enumerate(texts) if (b := _plain_word_boxes(t, words))} | {(0, k): b for k, t in enumerate(texts[:300]) if (b := G.item_boxes(t, items, 792.0))}
    assert got == want and {p for p, _ in want} == {0, 1} and max(k for _, k in want) >= 2 * G.BLOCK


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("query", ["entities_without_boxes", "page_overlays", "page_black_boxes"])
def test_boxes_deal_texts_alone(spark, query):
    """What pages hold, a struct for each word, meets its entities where it is made: below the search only texts are dealt."""
    above, search, below = QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")
    assert search and "REPARTITION_BY_COL" in below and "ENSURE_REQUIREMENTS" not in below


def _dealt(plan):
    """Bytes that the exchanges of a plan that ran wrote; those read a second time count once."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [] if name == "ReusedExchange" else [plan.children().apply(k) for k in range(plan.children().size())]
    return (plan.metrics().apply("dataSize").value() if name == "Exchange" else 0) + sum(map(_dealt, inner))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("query", ["page_overlays", "page_black_boxes"])
def test_boxes_deal_no_more_than_twice_the_text(spark, query):
    rows = QUERIES[query](spark, SF)
    assert rows.collect()
    text = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert text < _dealt(rows._jdf.queryExecution().executedPlan()) < 2 * text


def test_recognition(spark):
    assert O.stretch(np.array([[[0, 0, 0], [100, 100, 100], [200, 200, 200]]], np.uint8)).tolist() == [[0, 76, 255]]
    assert O.black_out(np.full((9, 9), 255, np.uint8), [(1, 1, 1, 1)], 3).sum() == 255 * (81 - 9)
    w = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>"
    one = lambda c: [("w", 1.0, 2.0, 3.0, 4.0, c)] * 11
    rows = spark.createDataFrame([(one(0.2), one(0.9), one(0.5)), (one(0.6), one(0.9), one(0.9)), (one(0.2), one(0.1), one(0.3))], f"a {w}, b {w}, c {w}")
    assert [r[0] for r in rows.select(O.choose_rotation(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["cw", "none", "ccw"]
    r = rows.limit(1).select(O.to_page(F.col("a"), F.lit("cw"), F.lit(40.0), F.lit(80.0))).first()[0][0]
    assert (r.x0, r.y0, r.x1, r.y1) == (0.5, 77 / 4, 1.0, 79 / 4)


def test_functions(spark):
    row = spark.createDataFrame([("  A  B\n", 0.285, "ab\U0001f600cd")], "s string, x double, u string")
    got = row.select(T.trim(F.col("s")), T.normalize_spaces(F.col("s")), T.round_half_up(F.col("x")), T.utf16_offset(F.col("u"), F.lit(3))).first()
    assert tuple(got) == ("A  B", "a b", 0.28, 4)


def test_stream(spark, tmp_path):
    from spanlake.streaming.redaction import start

    spark.createDataFrame([(1, "mail a@b.com")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().redacted == "mail [REDACTED]"


def test_set_category_takes_all_rules(spark):
    from spanlake.operators import review

    ents = spark.range(1500).selectExpr("id", "concat('c', id) AS category", "true AS accepted")
    rules = spark.range(1500).selectExpr("concat('c', id) AS category", "false AS accepted")
    assert review.set_category(ents, rules).where("accepted").count() == 0


def test_model_detection_word_by_word(spark):
    """First words of chunks located by a reading of the rules without regular expressions."""
    import json
    import random

    space = set("\t\n\x0b\f\r \u00a0")
    rng = random.Random(2)
    names = ["Ann", "ann", "Bo Lee", "Bo\nLee", "Corinna", "Corina", "corinna", "x", "Bo  lee", "Anneliese"]
    docs = [(k, " ".join(rng.choice(names) + rng.choice([".", "", " said"]) for _ in range(rng.choice([3, 40, 500])))) for k in range(12)]

    def words(text):
        out, at = [], 0
        for k, c in enumerate(text + " "):
            if c in space:
                if k > at:
                    out.append((text[at:k].lower(), at, k))
                at = k + 1
        return out

    def edits(a, b):
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return table[-1][-1]

    def loose(text, at, parts):
        for n, p in enumerate(parts):
            while n and at < len(text) and text[at] in space:
                at += 1
            if text[at : at + len(p)].lower() != p:
                return None
            at += len(p)
        return at

    def find(needle, text, taken):
        exact = [(a, a + len(needle)) for a in range(len(text)) if text.startswith(needle, a) and (a, a + len(needle)) not in taken]
        if exact:
            return exact, 0.95
        parts = needle.lower().split()
        near = [(a, z) for a in range(len(text)) if (z := loose(text, a, parts)) and (a, z) not in taken]
        if near or len(" ".join(parts)) < 4:
            return near, 0.8
        have = words(text)
        for i in range(len(have) - len(parts) + 1):
            far = [edits(h[0], p) for h, p in zip(have[i : i + len(parts)], parts, strict=True)]
            span = (have[i][1], have[i + len(parts) - 1][2])
            if all(d <= max(2, -(-len(p) // 4)) for d, p in zip(far, parts, strict=True)) and sum(far) and span not in taken:
                return [span], 0.8
        return [], 0.8

    want = []
    for k, text in docs:
        taken, out = set(), []
        for a, n in L.cut(text):
            needle = " ".join(text[a : a + n].split()[:2])
            if len(needle) < 2:
                continue
            spans, sure = find(needle, text, taken)
            taken |= set(spans)
            out += [(k, a, b, json.dumps(needle), sure) for a, b in spans]
        want += out
    got = [(r.doc_id, r.start_pos, r.end_pos, json.dumps(r.text), r.confidence) for r in L.detect(spark.createDataFrame(docs, "doc_id int, text string"), L.FirstWords(2)).collect()]
    assert sorted(got) == sorted(want) and {c for *_, c in got} == {0.95, 0.8}


def test_engines_boxes_and_clocks(spark):
    """Engines, black boxes, timings and clocks on stated rows."""
    images = spark.createDataFrame([(1, bytes(range(12)), 2, [(0.0, 0.0, 1.0, 2.0)]), (2, None, 2, None)], "id int, data binary, width int, boxes array<struct<x:double,y:double,width:double,height:double>>")
    got = {r.id: r.data for r in O.black_out_images(images).collect()}
    assert bytes(got[1]) == bytes([0, 0, 0, 3, 4, 5, 0, 0, 0, 9, 10, 11]) and got[2] is None
    words = {r.id: r.words for r in O.recognise(images.withColumnRenamed("data", "grey"), O.Columns()).collect()}
    assert [w.text for w in words[1]] == [bytes([2 * k, 2 * k + 1]).hex() for k in range(6)] and words[2] == []
    times = spark.sql("SELECT timestamp_seconds(s) AS t FROM VALUES (0), (1709251199), (-1) AS v(s)")
    assert [r[0] for r in times.select(T.utc_clock(F.col("t"))).collect()] == ["1970-01-01 00:00:00", "2024-02-29 23:59:59", "1969-12-31 23:59:59"]


def test_clock_of_far_years(spark):
    """Years of more or fewer than four digits, as SQL writes them."""
    times = spark.sql("SELECT timestamp_seconds(s) AS t FROM VALUES (253402300799), (253402300800), (777591000000), (-62135596801), (-62167219201), (-377705116801) AS v(s)")
    want = ["9999-12-31 23:59:59", "10000-01-01 00:00:00", "26610-11-17 20:00:00", "0000-12-31 23:59:59", "-1-12-31 23:59:59", "-10000-12-31 23:59:59"]
    assert [r[0] for r in times.select(T.utc_clock(F.col("t"))).collect()] == want


def test_grey_values_at_halves():
    """Weighted colours are added from left to right: a value next to a half goes as the plain sum does, here as SQL gave it."""
    image = np.frombuffer(bytes.fromhex("193bce4989e5da601e335d66ed6e8687" * 12), np.uint8).reshape(-1, 3)
    assert O.stretch(image).tobytes().hex() == "104c491fd40c44ff00ff46ccff033f4b" * 4


def test_many_matches_in_one_text(spark):
    """Lists beyond a block: places stay those in the text, overlaps go across the edges of blocks, and time stays in proportion."""
    import time

    one = "a@b.co 123-45-6789 x "
    for n in (1, 85, 86, 128, 129, 400, 20_000):
        rows = spark.createDataFrame([(n, one * n)], "doc_id int, text string")
        began = time.time()
        got = detect(rows).first().entities
        assert [(e.start_pos, e.end_pos) for e in got] == [x for k in range(n) for x in ((21 * k, 21 * k + 6), (21 * k + 7, 21 * k + 18))]
    assert time.time() - began < 60


def test_shared_folder_of_a_cluster():
    from types import SimpleNamespace as N

    from spanlake.sources.shared import shared_folder

    def session(master, where=None, chosen=None):
        gone = N(isDefined=lambda: chosen is not None, get=lambda: chosen)
        return N(conf=N(get=lambda k, d: where), sparkContext=N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: gone))))

    assert shared_folder(session("yarn", "hdfs:/x")) == "hdfs:/x" and shared_folder(session("yarn", None, "hdfs:/y")) == "hdfs:/y"
    assert shared_folder(session("local[4]")).endswith("spanlake-checkpoints")
    for master in ("yarn", "local-cluster[1,1,1]", "spark://h:1"):
        with pytest.raises(ValueError):
            shared_folder(session(master))


def test_leaks_that_are_planted(spark):
    """All entities of a text go; one that the rules keep is found again, and so is a copy that detection can't see."""
    rows = spark.createDataFrame([(1, "a@b.com and x123-45-6789 and 123-45-6789"), (2, "mail c@d.org")], "doc_id int, text string")
    found = detect(rows)
    left = found.select("doc_id", Y.leaks(R.redact(F.col("text"), F.col("entities")).cast("binary"), F.transform("entities", lambda e: e["text"])).alias("l"))
    assert {r.doc_id: [x.text for x in r.l] for r in left.collect()} == {1: ["123-45-6789"], 2: []}
