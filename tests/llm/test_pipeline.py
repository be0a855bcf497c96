"""The pipeline, stage by stage on what the stage before it left, against brute-force versions that share no code with it."""

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanlake.llm import toxicity
from tests.llm.test_brute_force import late_lines, without

SF = "/root/testdata/sf0.001"
WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+", re.I)


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near_classes(texts):
    """Least id of the class of each id, and the ids of pairs so near the threshold that the sketch of frequencies decides."""
    sets = {i: shingles(t) for i, t in texts.items()}
    df = Counter(x for s in sets.values() for x in s)
    n = sum(bool(s) for s in sets.values())
    weigh = {x: math.log1p(n / c) for x, c in df.items()}
    up, close = {i: i for i in texts}, set()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (texts[a] or "") == (texts[b] or ""):
                near = 1.0
            elif not sets[a].keys() & sets[b].keys():
                continue
            else:
                every = sets[a].keys() | sets[b].keys()
                plain = len(sets[a].keys() & sets[b].keys()) / len(every)
                weighted = sum(weigh[x] * min(sets[a][x], sets[b][x]) for x in every) / sum(weigh[x] * max(sets[a][x], sets[b][x]) for x in every)
                near = max(plain, weighted)
                if abs(weighted - 0.8) < 0.02 and plain < 0.8:
                    close |= {a, b}
            if near >= 0.8:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}, close


def without_windows(text, items):
    """The text without the words of item windows, and the part of its words that these are."""
    lower = {c: c + 32 for c in range(65, 91)}
    windows = set()
    for t in items:
        w = [x.translate(lower) for x in WORD.findall(t or "")]
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    at = [m.span() for m in WORD.finditer(text or "")]
    w = [text[a:b].translate(lower) for a, b in at]
    hit = sorted({p for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)})
    out, end = [], 0
    for k, p in enumerate(hit):
        if not k or hit[k - 1] != p - 1:
            out.append(text[end : at[p][0]])
        end = at[p][1]
    return "".join(out) + text[end:] if hit else text, len(hit) / max(1, len(w))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    import corpus_pipeline as C
    import sentencepiece

    def rows(df):
        out = {r.doc_id: r for r in df.collect()}
        assert len(out) == df.count()
        return out

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = rows(docs)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stage = C.drop_toxic(spark, docs, SF)
    clean = {i: r.text for i, r in source.items() if model.scores([r.text])[0] < 0.5}
    assert stage.columns == docs.columns and {i: r.text for i, r in rows(stage).items()} == clean

    stage = C.drop_repeated_lines(spark, stage, SF)
    gone, lines = late_lines(list(clean.items())), {}
    for i, t in clean.items():
        if not gone[i] or len(gone[i]) < sum(bool(x.encode().strip()) for x in t.split("\n")):
            lines[i] = without(t, gone[i])
    got = rows(stage)
    assert stage.columns == docs.columns and {i: (r.text, r.n_chars) for i, r in got.items()} == {i: (t, len(t)) for i, t in lines.items()}

    stage = C.keep_one_of_each(spark, stage, SF)
    classes, close = near_classes(lines)
    want = {i for i, c in classes.items() if i == c}
    kept = {i: r.text for i, r in rows(stage).items()}
    assert stage.columns == docs.columns and set(kept) ^ want <= close and all(kept[i] == lines[i] for i in kept)
    assert len(close) < 5

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = C.remove_benchmark(spark, stage, SF)
    want = {i: t for i, text in kept.items() for t, part in [without_windows(text, items)] if part <= C.MAX_COVERAGE}
    got = rows(stage)
    assert stage.columns == docs.columns and {i: (r.text, r.n_chars) for i, r in got.items()} == {i: (t, None if t is None else len(t)) for i, t in want.items()}

    out = C.run(spark, SF).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id for r in out} == set(want) and len(out) == len(want)
    for r in out:
        said = b"".join(bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("\u2581", " ").encode() for i in r.ids for p in [library.id_to_piece(i)])
        assert said == (" " + want[r.doc_id]).encode() if want[r.doc_id] else said == b""
        assert r.lossless and r.n_pieces == len(r.ids) and hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() == r.ids_sha256


ODD = ("score", "n_words", "class_id", "class_key", "kept", "spans", "hit_spans", "n_lines", "group", "node", "id", "__score", "__id", "own_3")


def test_planted_cases(spark, tmp_path):
    """A small folder of cases: copies, near copies, benchmark passages, repeated rows, null ids and clashing columns."""
    import corpus_pipeline as C

    own = [" ".join(f"w{k}a{i}" for i in range(80)) for k in range(6)]
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(1, own[0]), (2, own[0] + " end"), (3, own[1]), (3, own[1]), (None, own[2]), (None, own[3]), (4, own[4] + " " + item), (5, item + " x"), (6, None), (7, own[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("kept") for c in ODD})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and all(now.where(F.col(f"`{c}`") != "kept").count() == 0 for c in ODD)
    got = Counter((r.doc_id, r.text) for r in now.collect())
    assert got == Counter({(1, own[0]): 1, (3, own[1]): 1, (None, own[2]): 1, (None, own[3]): 1, (4, own[4] + " "): 1, (6, None): 1, (7, own[5]): 1})
    assert sum(r.n_pieces > 0 for r in C.run(spark, str(tmp_path)).collect()) == 6
