"""The registered queries that SQL cannot express, over whole small tables, against versions that share no code with them."""

import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from spanlake.llm import fingerprints, sampled_pieces, toxicity
from spanlake.llm.registry import QUERIES
from tests.llm.test_pipeline import near_classes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op2(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op2_near_dedup"](spark, SF).collect()}
    want, close = near_classes(texts)
    assert set(got) == set(texts) and {i for i in got if got[i].class_id != want[i]} <= close and len(close) < 5
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def plain_features(data, rank):
    """Windows of 32 bytes that are the least, by rank and place, of eight or more runs of 32 neighbours."""
    key = []
    for i in range(len(data) - 31):
        count = np.array(list(Counter(data[i : i + 32]).values()))
        # In units of 2^-16 bit, as c log2 c are told there.
        total = int(sum(sum(int(x) for x in fingerprints._STEP[:c]) for c in count.tolist()))
        key.append((rank[1023 - total * 1023 // fingerprints._MOST], i))
    wins = Counter(min(key[g : g + 32])[1] for g in range(len(key) - 31))
    return [(i, i + 32) for i in sorted(wins) if wins[i] >= 8]


def plain_fingerprint(data, rank):
    if len(data) >= 128:
        spans = plain_features(data, rank)
    else:
        width = 8 if len(data) >= 24 else 3
        spans = [(i, min(len(data), i + width)) for i in range(max(1, len(data) - width + 1))] if data else []
    body = np.frombuffer(data, np.uint8)
    out = []
    for k in range(0, len(spans), 160):
        bits = [0] * 2048
        for a, b in spans[k : k + 160]:
            h = int(fingerprints._HASH(body, np.array([a]), np.array([b]))[0])
            for j in range(5):
                bits[h >> 11 * j & 2047] = 1
        out.append(bits)
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for x in a:
        best = 0.0
        for y in b:
            n, m, both = sum(x), sum(y), sum(p & q for p, q in zip(x, y, strict=True))
            chance = n * m / 2048
            floor = chance + 0.1 * max(0, min(n, m) - chance)
            best = max(best, min(1.0, max(0.0, (both - floor) / max(min(n, m) - floor, 1e-9))))
        total += sum(x) * best
    return total / sum(map(sum, a))


def test_op5(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeféß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows = [(i * 3 - 5, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 3, 12, 25, 60, 200, 200, 500, 1])]
    rows += [(100, rows[7][1]), (101, None), (102, "x" * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, str(tmp_path)).collect()}
    texts = [t or "" for _, t in rows]
    count = Counter()
    for t in texts:
        data = t.encode()
        for i in range(len(data) - 31):
            total = int(sum(sum(int(x) for x in fingerprints._STEP[:c]) for c in Counter(data[i : i + 32]).values()))
            count[1023 - total * 1023 // fingerprints._MOST] += 1
    rank = {b: k for k, b in enumerate(sorted(range(1024), key=lambda b: (count[b], b)))}

    def as_hex(bits):
        return np.packbits(np.array(bits, np.uint8).reshape(-1, 2048), axis=1).tobytes().hex() if bits else ""

    for k, (i, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(rows)]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        own, changed, follows = (plain_fingerprint(x.encode(), rank) for x in (t, edited, after))
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == as_hex(own) and got[i].edited_fingerprint == as_hex(changed)
        assert math.isclose(got[i].near_edited, plain_likeness(own, changed), abs_tol=1e-9) and math.isclose(got[i].near_next, plain_likeness(own, follows), abs_tol=1e-9)


def test_op8(spark, texts):
    """A lattice over each whole text, without chunks, walked with the same numbers."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = sampled_pieces.Vocabulary(path, 1.0)
    some = {i: t[:400] for i, t in sorted(texts.items()) if t}
    some |= {-1: "▁ odd \U0001f600 中文中文 x", -2: "  two  spaces ", -3: "a" * 600}
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in sampled_pieces.encode_texts(docs, path, ["doc_id"]).collect()}
    from pyspark.sql import functions as F

    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(0)).alias("k")).collect()}
    for i, text in some.items():
        chars = "▁" + "".join("\0" if c == "▁" else "▁" if c == " " else c for c in text)
        true = " " + text
        total, ways = [0.0], [[]]
        for j in range(1, len(chars) + 1):
            got_ways = [(a, *v.weight[p]) for a in range(max(0, j - v.longest), j) if (p := chars[a:j]) in v.weight and not any(x == "▁" and y != "▁" for x, y in zip(p[1:], p, strict=False))]
            if chars[j - 1] not in v.weight or chars[j - 1] == "\0":
                got_ways.append((j - 1, None, 0.0))
            logs = [total[a] + w for a, _, w in got_ways]
            top = max(logs)
            total.append(top + math.log(sum(math.exp(x - top) for x in logs)))
            ways.append([(a, p, x) for (a, p, _), x in zip(got_ways, logs, strict=True)])
        ids, j = [], len(chars)
        key = sampled_pieces.mix(np.array([keys[i]], np.int64).view(np.uint64))
        while j:
            u = float(sampled_pieces._uniform(key, np.array([j]))[0])
            lone = len(ways[j]) == 1
            for a, p, x in ways[j]:
                u -= math.exp(x - total[j])
                if u < 0 or lone:
                    break
            ids[:0] = [p] if p is not None else [int(v.byte_id[c]) for c in true[j - 1].encode()]
            j = a
        assert got[i].ids == ids and got[i].lossless, i
    out = {r.doc_id: r for r in QUERIES["op8_sampled_pieces"](spark, SF).collect()}
    assert set(out) == set(texts) and all(r.lossless and (r.n_pieces > 0) == bool(texts[i]) for i, r in out.items())


def test_op9(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)


def plain_marks(tags):
    """The three passes one after the other, each over what the one before wrote."""
    weights = [0.0] * len(tags)

    def near(tags, trigger, reach, mark, weight):
        left, out = 0, []
        for k, t in enumerate(tags):
            if t == trigger:
                left = reach
                out.append("O")
                continue
            if left and t[0] in "IH":
                t += mark
                weights[k] += weight
            left = max(0, left - 1)
            out.append(t)
        return out

    tags = near(tags, "N", 3, "-", -1.5)
    said, out = False, []
    for k, t in enumerate(tags):
        if t == "R":
            said = True
            t = "O"
        elif said and t[0] in "IH":
            t += "q"
            weights[k] -= 0.7
        out.append(t)
    return list(zip(near(out, "T", 4, "t", 0.7), [round(w, 9) for w in weights], strict=True)), weights


def test_op10_grammar():
    rng = random.Random(4)
    for _ in range(3000):
        tags = [rng.choice(["I1", "I2", "I3", "H", "T", "N", "R", "O", "O", "O"]) for _ in range(rng.randint(1, 14))]
        want, weights = plain_marks(tags[:])
        state, got = toxicity.GRAMMAR.start, []
        for t in tags:
            o, w, state = toxicity.GRAMMAR.step(state, t)
            got.append((o, w))
        assert [o for o, _ in got] == [o for o, _ in want]
        assert all(math.isclose(w, x, abs_tol=1e-9) for (_, w), x in zip(got, weights, strict=True))


def test_op10(spark, texts):
    import zlib

    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(got) == set(texts)
    for i, t in texts.items():
        score = float(model.scores([t])[0])
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].score == score and got[i].predicted == int(score >= 0.5)
