"""Document fingerprints from improbable features.

Every window of 32 bytes has an entropy; how rare each entropy is over the whole corpus ranks the windows. A window that
is the rarest of enough of the groups of neighbours it stands in is a feature. Features go, in order, into a chain of
Bloom filters of 2,048 bits, and two chains are compared by their overlapping bits, above what chance gives.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm._common import SLICE_BYTES, SpanHasher, binary, pieces, released, table

WINDOW, GROUP, POPULAR = 32, 32, 8
FILTER_BITS, HASHES, FEATURES = 2048, 5, 160
BINS = 1024
LANES = 2048
#: Bytes below which a text has too few groups to choose by: all its windows of 8 bytes (of 3 below 24 bytes) are features.
SHORT = 128
_HASH = SpanHasher(51)
# c * log2(c) in fixed point, and its steps.
_SCALE = 1 << 16
_STEP = np.diff(np.array([c * np.log2(c) if c else 0 for c in range(WINDOW + 2)]) * _SCALE).astype(np.int32)
_MOST = int(WINDOW * np.log2(WINDOW) * _SCALE)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy bin (0 to BINS - 1) of the window that starts at each byte; the bytes are walked in many lanes at once."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    lanes = max(1, min(LANES, n // 256))
    steps = -(-n // lanes)
    padded = np.zeros(lanes * steps + WINDOW, np.uint8)
    padded[: len(data)] = data
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, steps + WINDOW - 1)[:: steps][:lanes].T)
    base = np.arange(lanes, dtype=np.int64) * 256
    count = np.zeros(lanes * 256, np.uint8)
    total = np.zeros(lanes, np.int32)
    out = np.empty((steps, lanes), np.int32)
    for t in range(steps + WINDOW - 1):
        if t >= WINDOW:
            at = base + rows[t - WINDOW]
            c = count[at] - 1
            total -= _STEP[c]
            count[at] = c
        at = base + rows[t]
        c = count[at]
        total += _STEP[c]
        count[at] = c + 1
        if t >= WINDOW - 1:
            out[t - WINDOW + 1] = total
    flat = out.T.reshape(-1)[:n].astype(np.int64)
    return (BINS - 1) - flat * (BINS - 1) // _MOST


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Windows that lie in one text."""
    good = np.ones(n, bool)
    for k in range(1, WINDOW):
        at = offsets[1:-1] - k
        good[at[(at >= 0) & (at < n)]] = False
    return good


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy bin: the least frequent over all texts first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            content, offsets, _ = binary(b.column(0))
            for i, j in pieces(np.diff(offsets)):
                own = offsets[i : j + 1] - offsets[i]
                if j == i + 1:  # one text, as long as it may be: all windows, some at a time
                    text = content[offsets[i] : offsets[j]]
                    for a in range(0, len(text), SLICE_BYTES):
                        total += np.bincount(entropies(text[a : a + SLICE_BYTES + WINDOW - 1]), minlength=BINS)
                    continue
                e = entropies(content[offsets[i] : offsets[j]])
                total += np.bincount(e[_inside(own, len(e))], minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bin": at, "n": total[at]})

    found = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary")).mapInArrow(released(count), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(BINS, np.int64)
    for r in found:
        n[r.bin] = r.n
    rank = np.empty(BINS, np.int64)
    rank[np.lexsort((np.arange(BINS), n))] = np.arange(BINS)
    return rank


def _chosen(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first byte of the windows that are the rarest of POPULAR groups or more, in order."""
    e = entropies(data)
    n = len(e)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    good = _inside(offsets, n)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:n]
    key = rank[e] * (n + 1) + np.arange(n)
    key[~good] = BINS * (n + 1) + np.flatnonzero(~good)
    low, span = key, 1
    while span < GROUP:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    groups = np.flatnonzero(doc[: len(low)] == doc[GROUP - 1 : GROUP - 1 + len(low)]) if len(low) else np.zeros(0, np.int64)
    groups = groups[good[groups + GROUP - 1]]
    popular = np.bincount(low[groups] % (n + 1), minlength=n) >= POPULAR
    chosen = np.flatnonzero(good & popular & (sizes >= SHORT)[doc])
    return doc[chosen], chosen


def _long_features(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes of the features of one long text, some windows at a time with the neighbours whose groups they stand in."""
    out = []
    for a in range(0, len(data) - WINDOW + 1, SLICE_BYTES):
        lo, hi = max(0, a - GROUP + 1), min(len(data), a + SLICE_BYTES + GROUP + WINDOW - 2)
        part = data[lo:hi]
        _, at = _chosen(part, np.array([0, len(part)]), rank)
        at = at[(at >= a - lo) & (at < a - lo + SLICE_BYTES)]
        out.append(_HASH(part, at, at + WINDOW))
    return np.concatenate(out)


def _filters(owner: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """The chained filters of n texts from the hashes of their features in order."""
    first = np.searchsorted(owner, np.arange(n + 1))
    filters = -(-np.diff(first) // FEATURES)
    base = np.concatenate(([0], np.cumsum(filters)))
    own = base[owner] + (np.arange(len(owner)) - first[owner]) // FEATURES
    bits = np.zeros(base[-1] * FILTER_BITS, bool)
    for k in range(HASHES):
        bits[own * FILTER_BITS + ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.split(np.packbits(bits.reshape(-1, FILTER_BITS), axis=1), base[1:-1])


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, as rows of 256 bytes; no text, no filter."""
    out = []
    for i, j in pieces(np.array([len(t) for t in texts], np.int64)):
        if j == i + 1 and len(texts[i]) > 2 * SLICE_BYTES:
            h = _long_features(np.frombuffer(texts[i], np.uint8), rank)
            out += _filters(np.zeros(len(h), np.int64), h, 1)
            continue
        some = texts[i:j]
        data = np.frombuffer(b"".join(some), np.uint8)
        sizes = np.array([len(t) for t in some], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        owner, start = _chosen(data, offsets, rank)
        owners, starts, stops = [owner], [start], [start + WINDOW]
        for d in np.flatnonzero((sizes > 0) & (sizes < SHORT)).tolist():
            width = 8 if sizes[d] >= 24 else 3
            at = np.arange(max(1, sizes[d] - width + 1)) + offsets[d]
            owners.append(np.full(len(at), d))
            starts.append(at)
            stops.append(np.minimum(at + width, offsets[d + 1]))
        owner, start, stop = (np.concatenate(x) for x in (owners, starts, stops))
        order = np.lexsort((start, owner))
        out += _filters(owner[order], _HASH(data, start[order], stop[order]), j - i)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: of each filter of the shorter chain the best overlap above chance in the other, by the filters' bits."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    score = 0.0
    for x, n in zip(a, na.tolist(), strict=True):
        both = np.bitwise_count(b & x).sum(1, dtype=np.int64)
        most = np.minimum(nb, n)
        chance = n * nb / FILTER_BITS
        floor = chance + 0.1 * np.maximum(0, most - chance)
        score += n * float(np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return score / int(na.sum())


def _with_next(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(bucket, ghost, id, doc_id, text), where each bucket holds a range of ids and, last, the row that follows it.

    The driver sees a bound and a first id for each bucket; texts move once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = min(4000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.approxQuantile("id", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    # An id that many rows share (a null one, say) is cut by the hash of the text as often as the quantiles name it.
    bounds = [(c, -(1 << 63) + k * (1 << 64) // m) for c, m in sorted(Counter(int(c) for c in cuts).items()) for k in range(m)]
    pairs = [F.struct(F.lit(c).cast("long").alias("id"), F.lit(t).cast("long").alias("th")) for c, t in bounds]
    edges = F.array(*pairs) if pairs else F.array().cast("array<struct<id:bigint,th:bigint>>")
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda b: (b["id"] < F.col("id")) | ((b["id"] == F.col("id")) & (b["th"] <= F.col("th"))))))
    heads = sorted((r.bucket, r.f.id, r.f.th) for r in rows.groupBy("bucket").agg(F.min(F.struct("id", "th")).alias("f")).collect())
    follows = spark.createDataFrame([(heads[k - 1][0], h[1], h[2]) for k, h in enumerate(heads)], "before int, id long, th long")
    rows = rows.join(F.broadcast(follows), ["id", "th"], "left")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    before = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, before))))
    rows = rows.select(F.col("to.bucket").alias("bucket"), F.col("to.ghost").alias("ghost"), "id", "th", "doc_id", "text")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "ghost", "id", "th").select("bucket", "ghost", "doc_id", "text")


def fingerprint(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints (hexadecimal) and likenesses of each row, against the next by id.

    The edited text has its last quarter replaced by the start of the next text. Null texts count as empty, null ids as
    the smallest; equal ids are in the order of the texts' hashes; a lone row follows itself. An empty text has an empty
    fingerprint, alike (1.0) only to another. Long texts are worked on some windows at a time; a worker holds a text, its
    edited form and the next one.
    """
    rank = docs.sparkSession.sparkContext.broadcast(rarity(docs, text))

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """rows: all but the last are answered, except ghosts."""
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        texts = [r[3] for r in rows]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in own]
        raw = [t.encode() for t in edited]
        made = digests([t.encode() for t in texts] + raw, rank.value)
        plain, changed = made[: len(rows)], made[len(rows) :]
        hexes = [x.tobytes().hex() for x in plain]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([rows[i][2] for i in own], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw],
                "fingerprint": [hexes[i] for i in own],
                "edited_fingerprint": [x.tobytes().hex() for x in changed],
                "near_edited": pa.array([likeness(plain[i], x) for i, x in zip(own, changed, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(plain[i], plain[i + 1]) for i in own], pa.float64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[3])
                if size > SLICE_BYTES and len(held) > 1:
                    yield work(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield work(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(docs, text, doc_id).mapInArrow(released(run), schema)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))
