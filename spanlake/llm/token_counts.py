"""Exact token counts of a byte-level BPE without making token ids for documents.

Texts are cut into pre-tokens by array operations over code points. The pieces of each distinct pre-token are counted
once. Counts of the most frequent pre-tokens, a fixed number of them, go to every worker; each document's frequencies of
all others are joined to their counts by a hash of 96 bits, and both sums are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from spanlake.llm._common import SpanHasher, add_columns, binary, checkpoint, pieces, released, table

#: Pre-tokens whose counts are sent to all workers: 16 bytes each, so 4 MB whatever the corpus.
HEAD = 1 << 18
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 1 << 20


@cache
def _classes(path: str) -> bytes:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 other, as the library itself tells them apart."""
    import regex
    from tokenizers import Tokenizer

    cutter = Tokenizer.from_file(path).pre_tokenizer
    out = bytearray(b"\3" * 0x110000)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    asked = [ord(c) for c in regex.findall(r"[\p{L}\p{N}\p{White_Space}]", every) if c != " "]
    for at in range(0, len(asked), 256):
        points = asked[at : at + 256]
        # In "ac1" and ".c" a letter stays with a, a number with 1, another mark with the full stop.
        spans = [span for _, span in cutter.pre_tokenize_str("".join(f"a{chr(c)}1.{chr(c)}a" for c in points))]
        starts = {a for a, _ in spans}
        for i, c in enumerate(points):
            p = 6 * i
            out[c] = 1 if p + 1 not in starts else 2 if p + 2 not in starts else 3 if p + 4 not in starts else 0
    out[32] = 0
    return bytes(out)


@cache
def _hashers() -> tuple[SpanHasher, SpanHasher]:
    return SpanHasher(9), SpanHasher(10)


def cut(points: np.ndarray, seg: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First code points of all pre-tokens; seg: first code points of the texts, each taken by itself."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    first = np.zeros(n + 1, bool)
    first[seg[seg < n]] = True
    first[n] = True
    run = first[:n].copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    ends = np.append(run[1:], True)  # the last code point of each run
    white = kind == 0
    space = points == 32
    inner_end = ends & ~first[1:]  # the run's text goes on
    start = run.copy()
    # The last white space before other text stands alone or, if a space, with what follows.
    start |= white & inner_end
    held = np.zeros(n, bool)
    held[1:] = (space & inner_end)[:-1]
    start &= ~held | white
    # A contraction at the start of a token.
    at = np.flatnonzero((points == 39) & run & start)
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    a = points[at + 1]
    one = np.isin(a, [ord(c) for c in "stmd"])
    b = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
    b = np.where(first[np.minimum(at + 2, n)], 0, b)
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    start[at[one | two] + 1] = False
    for p in (at[one] + 2, at[two] + 3):
        start[p[p < n]] = True
    return np.flatnonzero(start)


def frequencies(content: np.ndarray, offsets: np.ndarray, special: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in content[offsets[i]:offsets[i + 1]]: row, hash of 64 bits and of 32 more, first byte and end of each pre-token, and special tokens of each row."""
    body = content[offsets[0] : offsets[-1]].tobytes()
    marks = (offsets - offsets[0]).astype(np.int64)
    specials = np.zeros(len(marks) - 1, np.int64)
    seg = marks[:-1]
    drop = np.zeros(0, np.int64)
    if special and special in body:
        at, p = [], body.find(special)
        while p >= 0:
            row = int(np.searchsorted(marks, p, "right")) - 1
            if p + len(special) <= marks[row + 1]:
                at.append(p)
                specials[row] += 1
                p = body.find(special, p + len(special))
            else:
                p = body.find(special, p + 1)
        drop = np.array(at, np.int64)
        seg = np.unique(np.concatenate((seg, drop, drop + len(special))))
    raw = np.frombuffer(body, np.uint8)
    lead = (raw & 0xC0) != 0x80
    points = np.frombuffer(body.decode().encode("utf-32-le"), np.uint32)
    first_byte = np.append(np.flatnonzero(lead), len(raw))
    seg_points = np.searchsorted(first_byte, seg)
    starts = first_byte[cut(points, seg_points, classes)]
    stops = np.append(starts[1:], len(raw))
    if len(drop):
        own = np.isin(np.searchsorted(seg, starts, "right") - 1, np.searchsorted(seg, drop))
        starts, stops = starts[~own], stops[~own]
    rows = np.searchsorted(marks, starts, "right") - 1
    h, g = (hasher(raw, starts, stops) for hasher in _hashers())
    return rows, h, g.astype(np.uint32).view(np.int32), starts + offsets[0], stops + offsets[0], specials


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct hash of 96 bits the place of one that has it, in the order of h, and the number of each one's hash."""
    _, at, back = np.unique(h, return_index=True, return_inverse=True)
    if (g[at][back] != g).any():  # 64 bits alone met by chance
        order = np.lexsort((g, h))
        a, b = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = order[new]
        back = np.empty(len(h), np.int64)
        back[order] = np.cumsum(new) - 1
    return at, back


def _pretokens(docs: DataFrame, text: str, special: bytes, classes) -> DataFrame:
    """Distinct pre-tokens of the corpus with their frequencies; classes: the broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []

        def merged():
            h, g, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            at, back = _distinct(h, g)
            tokens = np.empty(len(h), object)
            tokens[:] = [t for x in held for t in x[3]]
            return h[at], g[at], np.bincount(back, n).astype(np.int64), tokens[at].tolist()

        def flush():
            h, g, n, tokens = merged()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g), pa.array(tokens, pa.binary()), pa.array(n)], names=["h", "g", "token", "n"])

        size, kinds = 0, np.frombuffer(classes.value, np.uint8)
        for b in batches:
            content, offsets, _ = binary(b.column(0))
            for i, j in pieces(np.diff(offsets)):
                _, h, g, starts, stops, _ = frequencies(content, offsets[i : j + 1], special, kinds)
                at, back = _distinct(h, g)
                held.append((h[at], g[at], np.bincount(back, minlength=len(at)), [content[a:z].tobytes() for a, z in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]))
                size += len(at)
                if size > HELD:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield flush()
                        held.clear()
                        size = 0
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(released(run), "h long, g int, token binary, n long")
    return rows.groupBy("h", "g").agg(F.first("token").alias("token"), F.sum("n").alias("n"))


def _counted(tokens: DataFrame, path: str) -> DataFrame:
    """tokens with the number of pieces of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path).model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        # The printable form of bytes that the vocabulary is written in: other bytes follow from 256 on, in order.
        form = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        forms = str.maketrans({chr(b): c for b, c in form.items()})
        for b in batches:
            count = [len(model.tokenize(t.decode("latin-1").translate(forms))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(count, pa.int64())], names=["h", "g", "n", "pieces"])

    return tokens.select("h", "g", "token", "n").mapInArrow(released(run), "h long, g int, n long, pieces long")


def _commonest(counted: DataFrame, most: int) -> int:
    """The least frequency of which and above there are no more than `most` pre-tokens; from a histogram of powers of 2^(1/16)."""
    bins = counted.groupBy(F.floor(F.log2("n") * 16).alias("b")).agg(F.count("*").alias("c"), F.max("n").alias("n")).orderBy(F.desc("b")).collect()
    total, least = 0, 1 + max((r.n for r in bins), default=0)
    for r, below in zip(bins, [*bins[1:], None], strict=False):
        total += r.c
        if total > most:
            break
        least = below.n + 1 if below else 1
    return least


def count_tokens(docs: DataFrame, path: str, keep: list[str], text: str = "text", out: str = "n_tokens", special: str = "<|endoftext|>", head: int = HEAD) -> DataFrame:
    """The columns `keep` of docs and the number of tokens of each text, a row for each row of docs.

    A null or empty text has 0. The special string is one token wherever it stands, as the library takes it. Repeated
    rows each get their own count. A worker holds one text whole, with about 35 bytes a byte of it. `keep` may hold any
    columns of docs, also none that tell the rows apart.
    """
    mark, sc = special.encode(), docs.sparkSession.sparkContext
    classes = sc.broadcast(_classes(path))
    counted = checkpoint(_counted(_pretokens(docs, text, mark, classes), path))
    top = counted.where(F.col("n") >= _commonest(counted, head)).select("h", "g", "pieces").toPandas().sort_values(["h", "g"]).drop_duplicates("h")
    sent = sc.broadcast((top["h"].to_numpy(np.int64), top["g"].to_numpy(np.int32), top["pieces"].to_numpy(np.int32)))

    def work(cols):
        (keys, more, sizes), kinds = sent.value, np.frombuffer(classes.value, np.uint8)
        content, offsets, _ = binary(cols[0])
        total, tails, others, freqs = [], [], [], []
        for i, j in pieces(np.diff(offsets)):
            rows, h, g, _, _, specials = frequencies(content, offsets[i : j + 1], mark, kinds)
            h = h.view(np.int64)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1) if len(keys) else np.zeros(len(h), np.int64)
            hit = (keys[at] == h) & (more[at] == g) if len(keys) else np.zeros(len(h), bool)
            total += (specials + np.bincount(rows[hit], sizes[at[hit]], j - i).astype(np.int64)).tolist()
            order = np.lexsort((g[~hit], h[~hit], rows[~hit]))
            r, t, u = rows[~hit][order], h[~hit][order], g[~hit][order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1])
            first = np.flatnonzero(new)
            f = np.diff(np.append(first, len(r)))
            edges = pa.array(np.searchsorted(r[first], np.arange(j - i + 1)).astype(np.int32))
            for out_, values in ((tails, t[first]), (others, u[first]), (freqs, f.astype(np.int32))):
                out_.append(pa.ListArray.from_arrays(edges, pa.array(values)))
        return [pa.array(total, pa.int64()), *(pa.concat_arrays(x) for x in (tails, others, freqs))]

    fields = [StructField("__head", LongType(), False), StructField("__tail", ArrayType(LongType(), False), False), StructField("__more", ArrayType(IntegerType(), False), False), StructField("__freq", ArrayType(IntegerType(), False), False)]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    own = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*own, F.xxhash64(*own, text).alias("__a"), F.hash(F.md5(body), *own).alias("__b"), body.alias("__text"))
    seen = checkpoint(add_columns(rows, [F.col("__text")], fields, work).drop("__text"))
    # A row is known by its hashes. The first pair of each row is marked, so that repeated rows can be told apart.
    pairs = seen.where(F.size("__tail") > 0).select("__a", "__b", F.posexplode(F.arrays_zip("__tail", "__more", "__freq")).alias("i", "p"))
    pairs = pairs.select("__a", "__b", F.col("p.__tail").alias("h"), F.col("p.__more").alias("g"), F.col("p.__freq").alias("f"), (F.col("i") == 0).cast("long").alias("one"))
    rest = pairs.join(counted.select("h", "g", "pieces"), ["h", "g"]).groupBy("__a", "__b").agg(F.expr("sum(f * pieces) div sum(one)").alias("__rest"))
    return seen.join(rest, ["__a", "__b"], "left").select(*own, (F.col("__head") + F.coalesce("__rest", F.lit(0))).alias(out))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counts = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "n_bytes"])
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
