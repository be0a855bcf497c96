"""Operators that SQL cannot express, against brute force, round trips and held-out labels on small tables."""

import itertools
import os
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanlake.llm._common import SpanHasher, rolled
from spanlake.llm import components, decontaminate, fingerprints, html_text, line_dedup, near_dedup, sampled_pieces, sharding, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def texts(n, seed=1):
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        if i % 5 == 1:
            t = out[-1][:]
        elif i % 5 == 2 and len(out) > 3:
            t = out[-2][:]
            for _ in range(max(1, len(t) // 60)):
                t[rng.randrange(len(t))] = "edit"
        elif i % 5 == 3:
            t[10:10] = passage
        out.append(t)
    return [(i, "\n".join(" ".join(t[k : k + 9]) for k in range(0, len(t), 9))) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return texts(120)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_near_duplicates(docs, rows):
    def shingles(t):
        w = re.findall(r"[a-z0-9]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    # Weighted similarity may link a little more, never less.
    assert all(got[i] == got[find(i)] for i in sets)
    assert sum(got[i] != find(i) for i in sets) <= 2


def test_large_buckets_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i] + [f"e{i}"] + base[i + 1 :])) for i in range(0, 60)] + [(1000 + i, " ".join(f"x{i}y{k}" for k in range(30))) for i in range(10)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0 if i < 1000 else i) for i, _ in rows)
    # A chain: each text is near the next few only, so that most links are not to the least text of the cluster.
    chain = [(i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 100))) for i in range(40)]
    docs = spark.createDataFrame(chain + [(100, "c1 c2 c3 c4 c5 c6")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert all(got[i] == (0 if i < 100 else i) for i in got)


def test_variants_in_a_hot_group(spark):
    """Plain similarity 0.81 to a base whose shingles weigh 1.4 and others 8: each variant shares a band with the base."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 401):
        t = base[:]
        t[rng.randrange(5, 45)], t[rng.randrange(55, 95)] = f"e{i}", f"f{i}"
        rows.append((i, " ".join(t)))
    body = np.frombuffer(rows[0][1].encode(), np.uint8)
    idf = np.full(near_dedup.CELLS, 8, np.float32)
    idf[near_dedup._cell(near_dedup.shingles(body, np.array([0, len(body)]))[1])] = 1.4
    out = near_dedup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), spark.sparkContext.broadcast(idf))
    bands = {r.doc_id: set(r["__bands"]) for r in out.collect()}
    assert [i for i in bands if not bands[i] & bands[0]] == []


@pytest.mark.parametrize("block_bytes", [32 << 20, 3000])
def test_decontamination(spark, monkeypatch, block_bytes):
    """Many items, short ones and repeated ones too, in one part and in several, against a search word by word."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rng = random.Random(8)
    words = ["".join(rng.choice("abc\u00e9") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    items = [(k, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(150)]
    items += [(k + 1000, t.upper()) for k, t in items[:5]] + [(1, items[3][1])]
    rows = []
    for k in range(80):
        t = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            i = rng.choice(items)[1].split()
            at, a = rng.randint(0, len(t)), rng.randint(0, max(0, len(i) - 10))
            t[at:at] = i[a : a + rng.choice([5, 10, 30])]
        rows.append((k, " ".join(t)))

    def cut(t):
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))

    windows = {}
    for k, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(k))
    got = {r.doc_id: r for r in decontaminate.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    hits = 0
    for k, t in rows:
        w = cut(t)
        found = [(a, n, windows[x]) for n in range(1, 11) for a in range(len(w) - n + 1) if (x := tuple(w[a : a + n])) in windows]
        covered = {p for a, n, _ in found for p in range(a, a + n)}
        assert got[k].n_words == len(w) and got[k].n_hit == len(covered) and got[k].item_ids == sorted(set().union(*[i for _, _, i in found]))
        assert {p for a, b in zip(got[k].hit_spans[::2], got[k].hit_spans[1::2], strict=True) for p in range(a, b)} == covered
        hits += len(covered)
    assert hits > 100
    docs, few = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, two = (Counter((r.doc_id, r.text, r.n_hit) for r in x.collect()) for x in (decontaminate.clean(docs, few), decontaminate.remove_spans(decontaminate.scan(docs, few))))
    assert one == two and one


def late_lines(rows, min_bytes=0):
    """Of each text, the lines (blank ones not counted) that stand earlier, in runs of at least min_bytes; ids are distinct."""

    def says(x):
        return any(unicodedata.category(c)[0] in "LNM" for c in x)

    seen, out = {}, {}
    for i, t in sorted(rows):
        late = []
        solid = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        for k, x in enumerate(solid):
            late.append(says(x) and x in seen)
            seen.setdefault(x, (i, k))
        out[i] = {k for run, of in itertools.groupby(range(len(late)), late.__getitem__) if run for of in [list(of)] if sum(len(solid[k].encode()) for k in of) >= min_bytes for k in of}
    return out


def without(t, drop):
    parts = t.split("\n")
    solid = [k for k, x in enumerate(parts) if x.strip(" \t\n\r\x0b\x0c")]
    gone = {solid[k] for k in drop}
    return "\n".join(x for k, x in enumerate(parts) if k not in gone)


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_line_dedup(docs, rows, min_bytes):
    gone = late_lines(rows, min_bytes)
    got = {r.doc_id: r for r in line_dedup.remove_lines(docs, min_bytes=min_bytes).collect()}
    for i, t in rows:
        assert got[i].text == without(t, gone[i]) and got[i].n_removed == len(gone[i])


def test_copies_of_long_texts(spark):
    """Copies under one id and under others, beside a near copy: equal rows are one document, and rounds stay few."""
    long = [f"line {k} of a long text" for k in range(200)]
    near = [*long[:120], "own line", *long[121:]]
    rows = [(7, "\n".join(long))] * 3 + [(k, "\n".join(long)) for k in (8, 9, 10)] + [(11, "\n".join(near)), (11, "\n".join(near)), (None, "line 5 of a long text\n---")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_lines", "id", "rank", "h", "first", "gone", "k1")})
    out = line_dedup.remove_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    got = Counter((r.doc_id, r.text, r.n_removed, r.removed_all) for r in out.collect())
    first = "\n".join(x for x in long if x != "line 5 of a long text")
    assert got == Counter([(7, first, 1, False)] * 3 + [(k, "", 200, True) for k in (8, 9, 10)] + [(11, "own line", 199, False)] * 2 + [(None, "line 5 of a long text\n---", 0, False)])


def test_suffix_intervals(docs, rows):
    """Against sorted suffixes: who shares a rank at each depth, and that ranks are in one order of lines at all depths."""
    found = [x.collect() for x in line_dedup.suffix_intervals(docs)]
    seqs = {}
    for i, t in sorted(rows):
        seqs.setdefault(t, i)
    seqs = {i: t.split("\n") for t, i in seqs.items()}
    number = {}
    for r in found[0]:
        number[seqs[r.id][r.line]] = r.rank
    for level, got in enumerate(found):
        h = 2**level
        classes = {}
        for i, lines in seqs.items():
            for k in range(len(lines) - h + 1):
                classes.setdefault(tuple(lines[k : k + h]), []).append((i, k))
        want = {p: c for c in classes.values() if len(c) > 1 for p in c}
        assert {(r.id, r.line) for r in got} == set(want) and all(r.h == h for r in got)
        by_rank = {}
        for r in got:
            by_rank.setdefault(r.rank, []).append((r.id, r.line))
            assert r.late == (min(want[r.id, r.line]) < (r.id, r.line))
        assert all(sorted(c) == sorted(want[c[0]]) for c in by_rank.values())
        keys = [[number[x] for x in seqs[c[0][0]][c[0][1] : c[0][1] + h]] for _, c in sorted(by_rank.items())]
        assert keys == sorted(keys)
    assert len(found) > 3


def test_short_repeated_lines_go(spark):
    """Written out by hand: short lines, a run of short lines under a rule of length, and lines that say nothing."""
    rows = [(1, "And ornd.\nfirst text here\n}\n---\n\u7d42"), (2, "And ornd.\nown words\n}\n---\n\u7d42\nAnd ornd."), (3, "a" * 12 + "\n" + "b" * 12 + "\n" + "c" * 12), (4, "x\n" + "a" * 12 + "\n" + "b" * 12 + "\n" + "c" * 12 + "\ny"), (5, "z\n" + "b" * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.remove_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "own words\n}\n---", 3: rows[2][1], 4: "x\ny", 5: "z"}
    got = {r.doc_id: r.text for r in line_dedup.remove_lines(docs, min_bytes=25).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "x\ny", 5: rows[4][1]}


@pytest.mark.parametrize("max_cells", [0, 1 << 29])
@pytest.mark.parametrize("hot", [2, 256])
def test_substring_dedup(docs, rows, hot, max_cells):
    first = {}
    words = {i: t.split() for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    got = {r.doc_id: bytes(r.kept).decode() for r in substring_dedup.kept_words(substring_dedup.repeated_spans(docs, hot_at=hot, max_cells=max_cells)).collect()}
    for i, w in words.items():
        out = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        assert got[i] == " ".join(x for p, x in enumerate(w) if p not in out)


def test_shards_by_sorting(spark):
    rng = random.Random(2)
    data = [(rng.choice([5, 5, 5, rng.randint(-(2**62), 2**62)]), k, rng.randint(0, 50)) for k in range(3000)]
    df = spark.createDataFrame(data, "a long, b long, size long")
    got = sorted((r.a, r.b, r.shard, r.slot) for r in sharding.shard(df, [df.a, df.b], df["size"], 7).collect())
    total, below, slots = sum(x[2] for x in data), 0, Counter()
    for (a, b, size), g in zip(sorted(data), got, strict=True):
        s = below * 7 // total
        assert g == (a, b, s, slots[s])
        slots[s] += 1
        below += size


def test_hashes_of_structured_spans_differ():
    """Thue-Morse strings and their complements cancel out in sums of powers of two's units; here no step can cancel."""
    tm = [bin(i).count("1") % 2 for i in range(4096)]
    for n in (8, 64, 512, 1024, 2048, 4096):
        body = np.array([97 + x for x in tm[:n]] + [98 - x for x in tm[:n]], np.uint8)
        for seed in (9, 21, 41, 42, 71, 72):
            a, b = SpanHasher(seed)(body, np.array([0, n]), np.array([n, 2 * n]))
            assert a != b
        h = np.where(body == 97, 3, 5).astype(np.uint64)
        r = rolled(h, n, np.uint64(0x9E3779B97F4A7C15))
        assert len(r) == n + 1 and r[0] != r[-1]
    rng = np.random.default_rng(1)
    body = rng.integers(0, 3, 3000).astype(np.uint8)
    start = rng.integers(0, 3000, 4000)
    stop = np.minimum(3000, start + rng.integers(0, 1400, 4000))
    seen = {}
    for h, a, b in zip(SpanHasher(5)(body, start, stop).tolist(), start, stop, strict=True):
        assert seen.setdefault(h, body[a:b].tobytes()) == body[a:b].tobytes()
    again = SpanHasher(5)(body, start, stop).tolist()
    same = {}
    for h, a, b in zip(again, start, stop, strict=True):
        assert same.setdefault(body[a:b].tobytes(), h) == h


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


def test_entropy_and_likeness():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 107, 4000).astype(np.uint8)
    bins = fingerprints.entropies(data)
    for i in range(0, len(bins), 37):
        n = np.bincount(data[i : i + 32])
        n = n[n > 0] / 32
        assert abs(bins[i] / 1023 * 5 + (n * np.log2(n)).sum()) < 0.01
    rank = np.arange(1024)
    a = bytes(rng.integers(97, 123, 3000).astype(np.uint8))
    b = a[:2250] + bytes(rng.integers(97, 123, 750).astype(np.uint8))
    c = bytes(rng.integers(97, 123, 3000).astype(np.uint8))
    x, y, z, x2 = fingerprints.digests([a, b, c, a], rank)
    assert fingerprints.likeness(x, x2) == 1.0 and fingerprints.likeness(x, y) > 0.5 and fingerprints.likeness(x, z) < 0.1


def test_long_texts_give_what_short_slices_give(monkeypatch):
    """Features and segmentations of texts that are taken part by part."""
    rng = np.random.default_rng(6)
    rank = rng.permutation(1024)
    data = bytes(rng.choice(np.frombuffer(b"abcdefghij klmn opq", np.uint8), 20_000))
    whole = fingerprints.digests([data], rank)[0]
    docs_rank = [fingerprints.entropies(np.frombuffer(data, np.uint8))]
    for size in (1000, 4097):
        monkeypatch.setattr(fingerprints, "SLICE_BYTES", size)
        assert (fingerprints.digests([b"x", data, data], rank)[1] == whole).all()
        parts = [fingerprints.entropies(np.frombuffer(data[a : a + size + 31], np.uint8)) for a in range(0, len(data), size)]
        assert (np.concatenate(parts) == docs_rank[0]).all()
    v = sampled_pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    text = ("  Some words, é 中文 ▁ and\n" + "longer " * 3 + "x" * 300 + " ") * 40
    body, key = np.frombuffer(text.encode(), np.uint8), np.array([7], np.uint64)
    want = sampled_pieces.encode(body, np.array([0, len(body)]), key, v)[0]
    for size in (50, 777, 1 << 20):
        monkeypatch.setattr(sampled_pieces, "SLICE", size)
        ids, same = sampled_pieces.encode_long(body, key, v)
        assert same and ids.tolist() == want.tolist()


def test_sampling_follows_the_weights():
    v = sampled_pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    word = "▁there"
    ways = {}

    def go(i, ids, p):
        if i == len(word):
            ways[tuple(ids)] = p
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in v.weight:
                k, w = v.weight[word[i:j]]
                go(j, [*ids, k], p * np.exp(w))

    go(0, [], 1.0)
    n = 20_000
    body = np.frombuffer(b"there" * n, np.uint8)
    ids, first = sampled_pieces.encode(body, np.arange(n + 1) * 5, np.arange(n, dtype=np.uint64), v)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True))
    total = sum(ways.values())
    assert set(seen) <= set(ways)
    assert all(abs(seen[k] / n - p / total) < 0.02 for k, p in ways.items())


def test_long_chunks_agree_with_short_ones(monkeypatch):
    v = sampled_pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    body = "some words, é and\n▁ and longerwordswithoutspaces".encode()
    args = np.frombuffer(body, np.uint8), np.array([0, len(body)]), np.array([9], np.uint64), v
    one = sampled_pieces.encode(*args)[0].tolist()
    monkeypatch.setattr(sampled_pieces, "PLAIN", 3)
    assert sampled_pieces.encode(*args)[0].tolist() == one and sampled_pieces.decode(np.array(one), np.array([0, len(one)]), v) == [body]


def test_improbable_chunks_are_sampled_and_disturb_nobody(monkeypatch):
    v = sampled_pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    rng = random.Random(5)
    base64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200))
    rows = ["some words before it", base64, "\u304b\u306a" * 60, "zz" + "\u7d42" * 240, "and some other words that come after it"]

    def encode(some):
        body = [rows[i].encode() for i in some]
        ids, first = sampled_pieces.encode(np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)]), np.array(some, np.uint64), v)
        return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]

    with np.errstate(divide="raise", invalid="raise"):
        together = encode(range(5))
        assert together == [encode([i])[0] for i in range(5)]
    monkeypatch.setattr(sampled_pieces, "PLAIN", 3)
    assert encode(range(5)) == together


def test_grammar_marks_context():
    g = toxicity.GRAMMAR

    def read(*tags):
        state, out = g.start, []
        for t in tags:
            o, w, state = g.step(state, t)
            out.append((o, round(w, 2)))
        return out

    assert read("T", "O", "I3")[-1] == ("I3t", 0.7)
    assert read("N", "O", "I2")[-1] == ("I2-", -1.5)
    assert read("R", "O", "O", "O", "H")[-1] == ("Hq", -0.7)
    assert read("T", "R", "N", "I1")[-1] == ("I1-qt", -1.5)
    assert read("O", "I1") == [("O", 0.0), ("I1", 0.0)]


def main_text(page, path=None):
    return html_text.extract(html_text.Page(page), path)


def test_page_with_everything():
    page = """<html><head><title>T</title><style>p{}</style></head><body><div id="cookie-banner">Cookies</div><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="page-3"><div class="sidebar"><p>Links here</p></div><div class="post-12 entry"><h1>A &quot;title&quot;</h1><p>First <b>bold</b><i>ly</i>
    text<br>next<p>Second &amp; last<ul><li>one<li>two</ul><script>var a="</p>"</script><aside>ad</aside></div><section class="comments"><p>Nice read</p></section></div><footer>f</footer>"""
    read = html_text.Page(page)
    assert read.path_of(read.best()[0]) == "/body/div.page-#/div.entry post-#"
    assert main_text(page) == 'A "title"\nFirst boldly text next\nSecond & last\none\ntwo'
    assert main_text(page, "/body/absent") == main_text(page) == main_text(page, "/body/div.page-#/div.entry post-#")


def test_composed_pages():
    """Pages put together from article parts and boilerplate, inline and in blocks; what is put in must come out."""
    rng = random.Random(11)
    inline = ["<noscript><div>enable js</div></noscript>", "<span class='advert'>Buy now</span>", "<textarea>a <p> b</textarea>", "<video><p>no video</p></video>", "<iframe src=x><p>frame</p></iframe>", "<button>press</button>", "<object>thing</object>", "<svg><text>drawn</text></svg>", "<script>if (a<b) '</p>'</script>", "<style>p{}</style>", "<!-- <p>gone</p> -->", "<select><option>one<option>two</select>", "<template><p>t</p></template>", "<i class='cookie-notice'>we use cookies</i>"]
    block = ["<nav><ul><li>Home<li>News</ul></nav>", "<div class='sidebar'><p>More of it</p></div>", "<aside>Aside</aside>", "<div id='adSlot_3'>Ad</div>", "<form><label>Name</label><input><p>Send</p></form>", "<div class='cookie-banner'><p>Cookies here</p></div>", "<div role='navigation'>Go</div>", "<footer>Foot</footer>", "<div class='share-bar'>Share this</div>", "<ul class='breadcrumb'><li>a<li>b</ul>", "<div class='newsletter-signup'>Sign up</div>", "<div class='notice'>A notice</div>", "<menu><li>x</menu>", "<dialog>Hello</dialog>", *inline]
    kinds = ["article class='post share-enabled'", "article class='byline'", "div class='search-term'", "div class='legal-analysis'", "article class='post category-notice'", "main class='content-with-sidebar'", "div class='story has-sidebar'", "article"]
    for n in range(300):
        text, body = [], []
        wrap = rng.choice(kinds)
        for k in range(rng.randint(3, 9)):
            words = [f"w{n}x{k}y{i}" for i in range(rng.randint(5, 30))]
            at = rng.randrange(1, len(words))
            tag = rng.choice(["p", "h2", "li", "blockquote", "p class='byline'", "div class='search-term'", "section class='legal-analysis'"])
            body.append(f"<{tag}>{' '.join(words[:at])} {rng.choice(inline) if rng.random() < 0.5 else ''} <b>{'&nbsp; '.join(words[at:])}</b></{tag.split()[0]}>")
            text.append(" ".join(words))
            if rng.random() < 0.4:
                body.append(rng.choice(block))
        comments = "<section class='comments'>" + "<p>I do think so too, and more than that</p>" * rng.choice([1, 80]) + "</section>"
        page = f"<html><body><header>Site</header>{rng.choice(block)}<{wrap}>{''.join(body)}</{wrap.split()[0]}>{comments}{rng.choice(block)}<footer>&copy; all</footer></body></html>"
        assert main_text(page) == "\n".join(text), page


@pytest.mark.parametrize("wrap", ["article class='post category-notice'", "article class='post tag-social'", "div class='content-with-sidebar'", "div class='layout-right-sidebar'", "div class='notice'", "form id='aspnetForm'", "div class='banner'"])
def test_marks_spare_articles_and_most_of_the_text(wrap):
    page = f"<body><{wrap}><p>The text of the page, which is long</p></{wrap.split()[0]}><div class='share-bar'>Share</div><div class='sidebar'>More</div></body>"
    assert main_text(page) == "The text of the page, which is long"


def test_open_anchors_link_nothing():
    page = "<body><a name=top><div><p>The story as it is told, with many words</p></div><div><a href=/x>Somewhere else, with as many words as that</a></div></body>"
    assert main_text(page) == "The story as it is told, with many words"


@pytest.mark.parametrize("wrap", ["article", "main", "div class='story'"])
def test_whole_articles(wrap):
    long = "long text " * 30
    page = f"<body><{wrap}><header class='entry-header'><h1>Heading</h1></header><p>Lead</p><div class='body'><section class='intro'><p>{long}</p></section><section class='more'><div><div><p>{long}</p></div></div></section></div></{wrap.split()[0]}><div><a href=/x>Somewhere else on this site</a></div></body>"
    assert main_text(page).split("\n") == (["Heading"] if wrap in ("article", "main") else []) + ["Lead", long.strip(), long.strip()]


@pytest.mark.parametrize("page", ["<div>" * 100_000, "<div>t" * 100_000, "<div class=ad>t" * 100_000, "<b>" * 50_000 + "<h1>x</h1>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<p>" + "<b>" * 50_000 + "<h1>x</h1>" * 50_000])
def test_deep_pages_take_time_in_proportion(page):
    began = time.time()
    read = html_text.Page(page)
    found = read.best()
    assert html_text.extract(read, None) == html_text.extract(read, read.path_of(found[0]) if found else None)
    assert time.time() - began < 20


def test_hosts_agree_on_a_path(spark, monkeypatch):
    """Pages whose own best container is another one follow the path of their host, sent to all or joined."""
    long, short = "<p>story words go here now</p>" * 8, "<p>brief</p>"
    shape = "<body><div class='story-{n}'>{story}</div><section class='extra'>{extra}</section></body>"
    rows = [(k, f"http://a.b/{k}", shape.format(n=k, story=long, extra="<p>x</p>")) for k in range(4)]
    rows += [(9, "http://A.b/9", shape.format(n=9, story=short, extra=long)), (10, "http://c.d/", shape.format(n=1, story=short, extra=long))]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    for size in (8 << 20, 0):
        monkeypatch.setattr(html_text, "BROADCAST_BYTES", size)
        out = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
        # The winner is widened by what stands beside it without links.
        assert out[9].split("\n")[0] == "brief" and out[0].startswith("story words go here now")


@needs_data
def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    out = toxicity.op10_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert right > 0.93
