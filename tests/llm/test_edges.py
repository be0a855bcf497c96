"""Every operator on difficult rows and on empty tables: rows and other columns stay, results are as documented."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanlake.llm import decontaminate, fingerprints, html_text, line_dedup, near_dedup, sampled_pieces, sharding, substring_dedup, token_counts, toxicity
from tests.llm.conftest import ODD


def ids(df):
    """How often each id stands in the result, in which columns that clash with an operator's own names must be whole."""
    want = [c for c in ODD if c.startswith("__") or c in ("a.b c", "Lines")]
    own = [c for c in df.columns if c in want]
    if own:
        assert set(own) == set(want)
        assert all(r[c] == f"own {c}" for r in df.select(*[f"`{c}`" for c in own]).collect() for c in own)
    return Counter(r[0] for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def want(edges):
    return ids(edges)


def test_sharding(edges, empty, want):
    key = [F.xxhash64("text"), F.col("doc_id")]
    out = sharding.shard(edges, key, F.octet_length("text"), 3)
    assert ids(out) == want and set(edges.columns) <= set(out.columns)
    slots = out.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert all(r.s == list(range(len(r.s))) for r in slots)
    assert sharding.shard(empty, key, F.octet_length("text"), 3).count() == 0


def test_near_duplicates(edges, empty, want):
    out = near_dedup.near_duplicates(edges)
    assert ids(out) == want
    got = {(r.doc_id, r.text is None): r.class_id for r in out.collect()}
    assert got[5, False] == got[6, False] == 5 and got[4, False] == 4 and out.drop("rep_id", "class_id", "class_key", "kept").columns == edges.columns
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    # Texts without an id, and different ones of one id, meet nobody; repeated rows are one document.
    assert len({r.class_key for r in rows.values()}) == len({r.text or "" for r in rows.values()})
    assert rows[None, "a text without an id"].class_id is None and rows[None, "a text without an id"].kept
    assert rows[7, "another text under the same id"].class_key != rows[7, "Grüße 中文 \U0001f600 ▁ x"].class_key
    assert rows[None, None].class_id == 1 and not rows[None, None].kept and rows[1, None].kept and not rows[2, ""].kept
    assert out.where("kept and doc_id = 7").count() == 3 and [r.doc_id for r in out.where("kept and doc_id in (5, 6)").collect()] == [5]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_without_ids(spark):
    """Unrelated texts with null or equal ids stay apart; a near copy joins its own class only."""
    words = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    rows = [(None, words[0]), (None, words[1]), (7, words[2]), (7, words[1] + " more"), (5, words[0] + " end"), (None, words[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep_id": F.lit("x"), "kept": F.lit("y"), "node": F.lit(1), "group": F.lit(2), "rep": F.lit(3), "component": F.lit(4)})
    out = near_dedup.near_duplicates(docs).collect()
    keys = {r.text: r.class_key for r in out}
    assert len(out) == 6 and keys[words[0]] == keys[words[0] + " end"] and keys[words[1]] == keys[words[1] + " more"] and len(set(keys.values())) == 3
    assert {(r.text, r.class_id) for r in out} == {(words[0], 5), (words[0] + " end", 5), (words[1], 7), (words[1] + " more", 7), (words[2], 7)}
    assert Counter(r.text for r in out if r.kept) == {words[0] + " end": 1, words[1] + " more": 1, words[2]: 1}


def test_decontamination(spark, edges, empty, want):
    items = spark.createDataFrame([(1, "Short ONE"), (1, "short one"), (2, None), (3, ""), (4, "!!"), (None, "short one"), (5, "word0 in line0 word1 in line1 word2 in line2 word3")], "item_id int, text string")
    out = decontaminate.scan(edges, items)
    assert ids(out) == want
    got = {(r.doc_id, r.n_words): r for r in out.collect()}
    assert got[4, 2].n_hit == 2 and got[4, 2].item_ids == ["1"] and got[5, 60000].item_ids == ["5"]
    kept = decontaminate.remove_spans(out).select(*[f"`{c}`" for c in edges.columns])
    assert ids(kept) == want - Counter({4: 1})
    assert decontaminate.scan(empty, items).count() == 0 and decontaminate.scan(edges, items.limit(0)).where("n_hit > 0").count() == 0


def test_line_dedup(spark, edges, empty, want):
    out = line_dedup.remove_lines(edges)
    assert ids(out) == want
    gone = {r.doc_id for r in out.where("removed_all").collect()}
    assert gone == {6}
    assert line_dedup.remove_lines(empty).count() == 0


def test_fingerprints(edges, empty, want):
    out = fingerprints.fingerprint(edges)
    assert ids(out) == want
    rows = out.collect()
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2)} == {""}
    assert fingerprints.fingerprint(empty).count() == 0
    one = fingerprints.fingerprint(edges.where("doc_id = 4")).first()
    assert one.near_next == 1.0


def test_fingerprints_of_one_id(spark):
    """Rows that share an id are dealt by their texts and still follow each other in one order."""
    texts = [f"text number {k} " * (k % 7) for k in range(60)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(5, "last")], "doc_id long, text string")
    order = [r.text for r in docs.where("doc_id is null").orderBy(F.xxhash64("text")).collect()]
    out = fingerprints.fingerprint(docs.repartition(6))
    got = Counter(r.edited_sha256 for r in out.collect())
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest() for t, n in zip([*order, "last"], [*order[1:], "last", order[0]], strict=True))
    assert got == want


def test_pages(spark):
    rows = [(1, None, None), (None, "http://a.b/c", ""), (2, "nohost", "<p>x"), (2, "nohost", "<p>x"), (3, "http://a.b", "<div" * 5000), (4, "http://a.b", "<article><p>Some text &amp; more</p></article><footer>f</footer>")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("n_chars", F.lit("clash"))
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect())
    unclosed = "<div" * 5000
    assert got == Counter([(1, "", 0), (None, "", 0), (2, "x", 1), (2, "x", 1), (3, unclosed, len(unclosed)), (4, "Some text & more", 16)])
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_substring_dedup(edges, empty, want):
    out = substring_dedup.kept_words(substring_dedup.repeated_spans(edges))
    assert ids(out) == want
    got = {r.doc_id: r for r in out.collect()}
    assert got[6].n_removed == got[6].n_words == 60000 and bytes(got[6].kept) == b""
    assert got[4].n_words == 2 and got[4].n_removed == 0
    assert substring_dedup.kept_words(substring_dedup.repeated_spans(empty)).count() == 0


def test_sampled_pieces(edges, empty, want):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = sampled_pieces.encode_texts(edges, path, ["doc_id"])
    assert ids(out) == want and out.where("not lossless").count() == 0
    rows = out.collect()
    assert all(r.n_pieces == len(r.ids) and (r.n_pieces > 0) == bool(r.text) for r in rows)
    again = sampled_pieces.encode_texts(edges.repartition(5), path, ["doc_id"])
    assert Counter((r.doc_id, r.ids_sha256) for r in rows) == Counter((r.doc_id, r.ids_sha256) for r in again.collect())
    assert sampled_pieces.encode_texts(empty, path, ["doc_id"]).count() == 0


def test_token_counts(edges, empty, want, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_counts, "HELD", 50)
    out = token_counts.count_tokens(edges, path, ["doc_id", "text"], head=100)
    assert ids(out) == want
    assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in out.collect())
    assert token_counts.count_tokens(empty, path, ["doc_id"]).count() == 0


def test_token_counts_where_hashes_meet(edges, monkeypatch):
    """With 64-bit hashes cut to two bits, the 32 others still tell pre-tokens apart."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    first, second = token_counts._hashers()
    few = edges.where("doc_id in (4, 7)")
    classes = np.frombuffer(token_counts._classes(path), np.uint8)
    monkeypatch.setattr(token_counts, "_hashers", lambda: (lambda *a: first(*a) & np.uint64(3), second))
    body = [r.text.encode() for r in few.collect()]
    content, offsets = np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)])
    rows, h, g, starts, stops, _ = token_counts.frequencies(content, offsets, b"<|endoftext|>", classes)
    at, back = token_counts._distinct(h, g)
    tokens = [content[a:z].tobytes() for a, z in zip(starts, stops, strict=True)]
    assert len(at) == len(set(tokens)) and [tokens[k] for k in at[back]] == tokens


def test_toxicity(spark, edges, empty, want):
    labels = spark.createDataFrame([(4, 0, None), (7, 1, 1), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(edges, labels)
    out = toxicity.score(edges, model)
    assert ids(out) == want and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert hashlib.md5(repr(model.stems).encode()).hexdigest() == hashlib.md5(repr(toxicity.train(edges, labels).stems).encode()).hexdigest()


def test_bounds_of_the_training_rows(spark, monkeypatch):
    """Both bounds hold where ids repeat, and clashing labels of one text give one and the same fit."""
    docs = spark.createDataFrame([(1, f"you idiot number {i % 7}") for i in range(50)] + [(k, f"a kind text {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0)] + [(k, 0) for k in range(2, 40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append((texts, labels.tolist())))
    for part in (1, 5):
        toxicity.train(docs.repartition(part), labels, max_rows=60)
    assert seen[0] == seen[1] and len(seen[0][0]) == len(set(seen[0][0])) <= 60
    assert all(y == ("idiot" in t) for t, y in zip(*seen[0], strict=True))
    toxicity.train(docs, labels, max_rows=1)
    toxicity.train(docs, labels, max_bytes=100)
    assert len(seen[2][0]) <= 1 and 0 < sum(len(t) for t in seen[3][0]) <= 100
