"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. A fixed-size sketch of document frequencies over all documents gives the weights.
2. Each text gets 48 consistent weighted samples and 48 plain ones, each in 16 bands of 3; equal texts are one from
   here on. Weights can put a pair of plain similarity 0.8 far below, so that each measure needs bands of its own.
3. Texts that share a band and half of its kind of samples are candidates, in buckets of any size.
4. Candidates that hang together are a cluster, in which pairs are compared exactly: a pair is linked from a weighted
   Jaccard similarity of 0.8, or a plain one, which the weights can put below.
5. Components of the links are the classes.

Buckets (3) and clusters (4) are searched alike: all members against the least one first, then only those that are not
linked to it against all, in blocks. Pairs of which both are linked to the least one are in one part already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from spanlake.llm._common import SpanHasher, add_columns, any_names, binary, checkpoint, mix, pieces, released, table
from spanlake.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, WIDTH = 16, 3
SAMPLES = BANDS * WIDTH
#: Cells of the document-frequency sketch: 4 MB of weights, whatever the corpus. Parts it is merged in, and lanes in
#: which the tasks' sketches of a part are merged before.
CELLS, PARTS, LANES = 1 << 20, 64, 16
#: Rows of a block of a bucket, and rows and bytes of text of a block of a cluster, about.
BUCKET, BLOCK, BLOCK_BYTES = 512, 256, 4 << 20

_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HASH = SpanHasher(21)
_rng = np.random.Generator(np.random.PCG64(22))
_ODD = _rng.integers(1, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD_PLAIN = np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROLL = [int(x) * 2 + 1 for x in _rng.integers(1, 1 << 62, SHINGLE)]
#: Gamma(2, 1), Gamma(2, 1) and uniform variates that a shingle's hash picks for each sample.
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32) + np.float32(1e-3)
_LNC = np.log(_rng.gamma(2.0, 1.0, 1 << 16) + 1e-12).astype(np.float32)
_BETA = _rng.random(1 << 16).astype(np.float32)
_INV = (1 / _R).astype(np.float32)


def shingles(content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of the distinct shingles of each text; a text of fewer words is one shingle."""
    sep = _SEP[content]
    edge = np.ones(len(content) + 1, bool)
    edge[1:-1] = sep[1:] != sep[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    at = at[at < len(content)]
    stop = np.append(at[1:], len(content))
    word = ~sep[at] if len(at) else np.zeros(0, bool)
    start, stop = at[word], stop[word]
    first = np.searchsorted(start, offsets)
    h = _HASH(_LOWER[content], start, stop)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(h) - SHINGLE + 1
    docs, hashes = [], []
    with np.errstate(over="ignore"):
        if n > 0:
            own = np.flatnonzero(doc[:n] == doc[SHINGLE - 1 :])
            total = sum(h[own + i] * np.uint64(c & (1 << 64) - 1) for i, c in enumerate(_ROLL))
            docs.append(doc[own])
            hashes.append(mix(total))
        for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE)).tolist():
            x = h[first[d] : first[d + 1]]
            docs.append(np.array([d]))
            hashes.append(mix(np.array([sum(int(v) * c for v, c in zip(x.tolist(), _ROLL, strict=False)) + len(x) & (1 << 64) - 1], np.uint64)))
    docs, hashes = np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    s = np.flatnonzero(new)
    return docs[s], hashes[s], np.diff(np.append(s, len(docs)))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _texts(batch_column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    content, offsets, _ = binary(batch_column)
    for i, j in pieces(np.diff(offsets)):
        own = offsets[i : j + 1]
        yield i, j, *shingles(content[own[0] : own[-1]], own - own[0])


def weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """ln(1 + N / df) for each cell; df: documents with a shingle in the cell, N: documents with a shingle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(CELLS, np.int64), 0
        for b in batches:
            for _, _, doc, h, _ in _texts(b.column(0)):
                total += np.bincount(_cell(h), minlength=CELLS)
                n += len(np.unique(doc))
        width, lane = CELLS // PARTS, TaskContext.get().partitionId() % LANES
        for p in range(PARTS if n else 0):
            part = total[p * width : (p + 1) * width]
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_pydict({"part": [p], "lane": [lane], "at": [at.astype(np.uint16).tobytes()], "n": [part[at].tobytes()], "docs": [n if p == 0 else 0]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for p, lane, at, n, docs_ in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                s = sums.setdefault((p, lane), [np.zeros(CELLS // PARTS, np.int64), 0])
                s[0][np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
                s[1] += docs_
        for (p, lane), (total, n) in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"part": [p], "lane": [lane], "at": [at.astype(np.uint16).tobytes()], "n": [total[at].tobytes()], "docs": [n]})

    schema = "part long, lane long, at binary, n binary, docs long"
    parts = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary")).mapInArrow(released(count), schema)
    # First the sketches of a lane, then the lanes, so that no task merges those of all tasks.
    parts = parts.repartition("part", "lane").mapInArrow(released(merge), schema).withColumn("lane", F.lit(0).cast("long"))
    df, n = np.zeros(CELLS, np.int64), 0
    for r in parts.repartition(PARTS, "part").mapInArrow(released(merge), schema).collect():
        df[r.part * (CELLS // PARTS) + np.frombuffer(r.at, np.uint16).astype(np.int64)] = np.frombuffer(r.n, np.int64)
        n += r.docs
    return np.log1p(max(n, 1) / np.maximum(df, 1)).astype(np.float32)


def samples(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The SAMPLES consistent weighted samples (shingle and quantile, hashed) of one weighted set."""
    best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    ln = np.log(weight).astype(np.float32)[:, None]
    for i in range(0, len(h), 512):
        x = h[i : i + 512, None]
        with np.errstate(over="ignore"):
            at = ((x * _ODD) >> np.uint64(48)).astype(np.intp)
        r, beta = _R[at], _BETA[at]
        t = np.floor(ln[i : i + 512] * _INV[at] + beta)
        a = _LNC[at] - r * (t - beta + np.float32(1))
        k = a.argmin(0)
        cols = np.arange(SAMPLES)
        better = a[k, cols] < best
        best = np.where(better, a[k, cols], best)
        with np.errstate(over="ignore"):
            found = mix(x[k, 0] ^ (t[k, cols].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out = np.where(better, found, out)
    return out


def plain_samples(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of SAMPLES least hashes for each of the sets that begin at first; none is empty."""
    with np.errstate(over="ignore"):
        return np.stack([np.minimum.reduceat(h * c, first) for c in _ODD_PLAIN], 1) if len(first) else np.zeros((0, SAMPLES), np.uint64)


def _keys(s: np.ndarray, kind: int) -> np.ndarray:
    """The key of each band; its last bit is the kind of the samples, so that kinds never share a bucket."""
    with np.errstate(over="ignore"):
        x = s.reshape(BANDS, WIDTH)
        key = mix(mix(mix(x[:, 0]) + x[:, 1]) + x[:, 2] + np.arange(BANDS, dtype=np.uint64))
    return (key & ~np.uint64(1) | np.uint64(kind)).view(np.int64)


def signatures(docs: DataFrame, idf, text: str = "text") -> DataFrame:
    """docs with __sig and __plain (16 bits of each weighted and plain sample; null without words) and __bands."""

    def work(cols):
        sig, plain, bands = [], [], []
        for i, j, doc, h, n in _texts(cols[0]):
            edges = np.searchsorted(doc, np.arange(j - i + 1))
            w = n * idf.value[_cell(h)]
            least = iter(plain_samples(h, edges[:-1][np.diff(edges) > 0]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    sig.append(None)
                    plain.append(None)
                    bands.append(None)
                    continue
                s = samples(h[a:b], w[a:b])
                p = next(least)
                sig.append(mix(s).astype(np.uint16).tobytes())
                plain.append(mix(p).astype(np.uint16).tobytes())
                bands.append(np.concatenate((_keys(s, 0), _keys(p, 1))))
        return [pa.array(sig, pa.binary()), pa.array(plain, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return add_columns(docs, [body], [StructField("__sig", BinaryType()), StructField("__plain", BinaryType()), StructField("__bands", ArrayType(LongType()))], work)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows with equal keys (the first columns), across batches."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(i)) for i in range(n_keys)]
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(change).tolist()
        for s, e in zip(at, [*at[1:], b.num_rows], strict=True):
            now = tuple(int(c[s]) for c in cols)
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(b.slice(s, e - s))
    if held:
        yield key, held


def _near_pairs(rows: DataFrame, stats: DataFrame, star: Callable, cross: Callable, payload: str) -> DataFrame:
    """Links (a, b) that join the members of each group as all pairs that are near would; rows (group, node, payload).

    stats: (group, n, head, parts), the members of each group, its least one and its blocks. `star` says of the
    members of a block whether they are near the head. Groups of which some are not go on: each block of these meets
    each block of all members in `cross`.
    """
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    known = rows.join(stats.hint("merge"), "group")
    is_head = F.col("node") == F.col("head")
    to = F.when(is_head, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    stars = known.select("group", F.explode(to).alias("part"), "head", "node", is_head.alias("first"), payload)
    stars = stars.repartition("group", "part").sortWithinPartitions("group", "part", F.desc("first"))
    flags = checkpoint(stars.mapInArrow(released(star), "group long, head long, node long, near boolean"))
    # The head is no row of flags: groups of two are done with.
    rest = flags.groupBy("group").agg(F.sum((~F.col("near")).cast("long")).alias("rest"), F.count("*").alias("others")).where("rest > 0 and others > 1").drop("others")
    parts = F.greatest(F.lit(1), F.ceil(F.col("parts") * F.col("rest") / F.col("n"))).cast("int")
    todo = checkpoint(rest.join(stats.hint("merge"), "group").select("group", "head", "parts", parts.alias("few")))
    left = rows.join(flags.where("not near").select("group", "node"), ["group", "node"]).join(todo.hint("merge"), "group")
    left = left.select("group", F.pmod(F.xxhash64("node"), F.col("few")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), "node", payload)
    right = rows.join(todo.hint("merge"), "group").select("group", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), own.alias("j"), F.lit(1).alias("side"), "node", payload)
    both = left.unionByName(right).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return flags.where("near").select(F.col("node").alias("a"), F.col("head").alias("b")).unionByName(both.mapInArrow(released(cross), "a long, b long"))


def _joins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs, in their order, join two parts."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out[k] = True
    return out


def _sampled(column: pa.Array) -> np.ndarray:
    content, offsets, _ = binary(column)
    return content[offsets[0] : offsets[-1]].view(np.uint16).reshape(-1, SAMPLES)


def _candidates(reps: DataFrame) -> DataFrame:
    """Links (a, b) of texts that share a band and half of the band's kind of samples, as many as join them."""
    members = reps.where("__sig is not null").select(F.explode("__bands").alias("group"), "node")
    blocks = F.ceil(F.col("n") / BUCKET).cast("int").alias("parts")
    stats = checkpoint(members.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1").select("group", "n", "head", blocks))
    # Only numbers move until the buckets of one are gone; then the samples of the band's kind come to the others.
    shared = members.join(stats.select("group").hint("merge"), "group").join(reps.select("node", "__sig", "__plain"), "node")
    shared = checkpoint(shared.select("group", "node", F.when(F.col("group").bitwiseAND(1) == 0, F.col("__sig")).otherwise(F.col("__plain")).alias("sig")))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = np.zeros((1, SAMPLES), np.uint16)
        for b in batches:
            if not b.num_rows:
                continue
            first = np.asarray(b.column(4))
            sig = np.concatenate((carried, _sampled(b.column(5))))
            at = np.maximum.accumulate(np.where(first, np.arange(1, len(sig)), 0))
            near = (sig[1:] == sig[at]).sum(1) * 2 >= SAMPLES
            carried = sig[at[-1] : at[-1] + 1]
            keep = np.flatnonzero(~first)
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(keep)) for i in (0, 2, 3)] + [pa.array(near[keep])], names=["group", "head", "node", "near"])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, 3):
            side, ids = (np.concatenate([np.asarray(p.column(i)) for p in parts]) for i in (3, 4))
            sig = np.concatenate([_sampled(p.column(5)) for p in parts])
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            a, b = [], []
            for x in one.tolist():
                hit = two[(sig[two] == sig[x]).sum(1) * 2 >= SAMPLES]
                a.append(np.full(len(hit), ids[x]))
                b.append(ids[hit])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                keep = _joins(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return _near_pairs(shared, stats, star, cross, "sig")


def likeness(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """The greater of weighted and plain Jaccard similarity of all left with all right sets (tokens, weights, 1 or 0)."""
    sets = [*left, *right]
    tokens = np.concatenate([x[0] for x in sets])
    owner = np.repeat(np.arange(len(sets)), [len(x[0]) for x in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    s = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    count = np.diff(np.append(s, len(tokens)))
    number = np.repeat(np.arange(len(s)), count)
    weight = [np.concatenate([x[k] for x in sets])[order][s].astype(np.float32) for k in (1, 2)]
    inter = [np.zeros((len(left), len(right))) for _ in weight]
    shared = np.flatnonzero(count > 1)
    column = np.full(len(s), -1)
    for i in range(0, len(shared), 2048):
        part = shared[i : i + 2048]
        column[part] = np.arange(len(part))
        rows = np.flatnonzero(column[number] >= 0)
        m = np.zeros((len(sets), len(part)), np.float32)
        m[owner[rows], column[number[rows]]] = 1
        for total, w in zip(inter, weight, strict=True):
            total += (m[: len(left)] * w[part]) @ m[len(left) :].T
        column[part] = -1
    out = np.zeros((len(left), len(right)))
    for k, total in zip((1, 2), inter, strict=True):
        size = np.array([x[k].sum(dtype=np.float64) for x in sets])
        union = size[: len(left), None] + size[None, len(left) :] - total
        np.maximum(out, np.divide(total, union, out=np.zeros_like(total), where=union > 0), out=out)
    return out + 1e-6  # the sums are of single precision


def _tokens(texts: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each text's weighted set: a shingle of count k stands k times, as tokens of levels 1 to k, so that sets suffice."""
    out = []
    for i, j, doc, h, n in _texts(texts):
        edges = np.searchsorted(doc, np.arange(j - i + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k = n[a:b]
            level = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            with np.errstate(over="ignore"):
                t = np.where(level > 0, mix(np.repeat(h[a:b], k) + level.astype(np.uint64)), np.repeat(h[a:b], k))
            out.append((t, np.repeat(idf[_cell(h[a:b])], k), (level == 0).astype(np.float32)))
    return out


def _verified(texts: DataFrame, sizes: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) of texts of at least the threshold, as many as join them; texts (group, node, t), sizes (group, node, __size)."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("parts")
    totals = sizes.groupBy("group").agg(F.count("*").alias("n"), F.sum("__size").alias("bytes"), F.min("node").alias("head"))
    stats = checkpoint(totals.select("group", "n", "head", blocks))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, _, head), parts in _groups(batches, 3):
            first, ids = (np.concatenate([np.asarray(p.column(i)) for p in parts]) for i in (4, 3))
            sets = [t for p in parts for t in _tokens(p.column(5), idf.value)]
            k = int(np.flatnonzero(first)[0])
            others = np.flatnonzero(~first)
            near = [likeness([sets[k]], [sets[x] for x in others[s : s + 1024]])[0] >= threshold for s in range(0, len(others), 1024)]
            if near:
                yield pa.RecordBatch.from_pydict({"group": np.full(len(others), group), "head": np.full(len(others), head), "node": ids[others], "near": np.concatenate(near)})

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, 3):
            side, ids = (np.concatenate([np.asarray(p.column(i)) for p in parts]) for i in (3, 4))
            sets = [t for p in parts for t in _tokens(p.column(5), idf.value)]
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for s in range(0, len(one), 256):
                for u in range(0, len(two), 1024):
                    rows_, cols = one[s : s + 256], two[u : u + 1024]
                    x, y = np.nonzero(likeness([sets[i] for i in rows_], [sets[i] for i in cols]) >= threshold)
                    a, b = ids[rows_[x]], ids[cols[y]]
                    keep = _joins(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return _near_pairs(texts, stats, star, cross, "t")


@any_names
def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs with rep_id, class_id, class_key and kept.

    rep_id is the least id of the rows with an equal text, class_id the least id of the near-duplicate class; ids that
    are null count only where there are no others, and give null. class_key is a number of the class by itself: classes
    of texts, so that rows with null or clashing ids never meet by their ids. kept marks the rows of one document of the
    class: those with the least id (null ids last) and, among them, the least hash of the text.

    Texts without words are alike only to equal texts; null texts count as empty. A worker holds one text whole, with
    about 25 bytes a byte of it. Rows stay as they are, repeated ones too, which are one document: all or none of them
    are kept. Columns of docs that have the name of a new one give way.
    """
    sc = docs.sparkSession.sparkContext
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__text": body, "__h1": F.xxhash64(body), "__h2": F.xxhash64(F.md5(body.cast("binary")), F.lit(1))})
    rows = marked.select("__id", "__h1", "__h2", "__text")
    idf = sc.broadcast(weights(rows, "__text"))
    signed = signatures(rows.withColumn("__size", F.octet_length("__text").cast("long")), idf, "__text").drop("__text")
    firsts = [F.first(c).alias(c) for c in ("__size", "__sig", "__plain", "__bands")]
    # A number for each text: the rows are written once, with their numbers.
    reps = checkpoint(signed.groupBy("__h1", "__h2").agg(F.min("__id").alias("rep"), *firsts).withColumn("node", F.monotonically_increasing_id()))
    found = components(_candidates(reps)).withColumnRenamed("component", "group")
    heads = found.select(F.col("group").alias("node"), "group").distinct()
    clusters = checkpoint(reps.select("__h1", "__h2", "node", "rep", "__size").join(found.unionByName(heads), "node"))
    # Of equal texts, one stands for all.
    texts = rows.join(clusters.hint("shuffle_hash"), ["__h1", "__h2"]).where(F.col("__id").eqNullSafe(F.col("rep")))
    texts = checkpoint(texts.select("group", "node", F.col("__text").cast("binary").alias("t")).dropDuplicates(["node"]))
    classes = components(_verified(texts, clusters.select("group", "node", "__size"), idf, threshold))
    linked = classes.unionByName(classes.select(F.col("component").alias("node"), "component").distinct())
    order = F.struct(F.col("rep").isNull(), "rep", "__h1", "__h2", "node")
    members = checkpoint(linked.join(reps.select("node", "rep", "__h1", "__h2"), "node"))
    firsts = members.groupBy("component").agg(F.min("rep").alias("least"), F.min(order).getField("node").alias("first"))
    of_class = members.select("node", "component").join(firsts.hint("merge"), "component")
    alone = F.col("component").isNull()
    named = checkpoint(
        reps.select("__h1", "__h2", "node", "rep")
        .join(of_class, "node", "left")
        .select(
            "__h1",
            "__h2",
            F.col("rep").alias("rep_id"),
            F.when(alone, F.col("rep")).otherwise(F.col("least")).alias("class_id"),
            F.coalesce("component", "node").alias("class_key"),
            (alone | (F.col("first") == F.col("node"))).alias("__first"),
        )
    )
    new = ("rep_id", "class_id", "class_key", "kept")
    plain = marked.select(*[f"`{c}`" for c in docs.columns if c not in new], "__h1", "__h2", "__id")
    out = plain.join(named.hint("merge"), ["__h1", "__h2"]).withColumn("kept", F.col("__first") & F.col("__id").eqNullSafe(F.col("rep_id")))
    return out.drop("__h1", "__h2", "__id", "__first")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "rep_id", "class_id", "kept")
