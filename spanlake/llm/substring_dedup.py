"""Repeated passages: windows of words that also start in an earlier document, found behind a count-min prefilter.

Partition sketches count the anchors of windows, each once a document, and are merged; the sums bound from above how many
documents hold a window. A second pass takes only windows whose bound is two or more and groups them exactly, by 128
bits of hash. Windows of an anchor that few documents share meet in one task; those of hot anchors are pre-aggregated.

A merged sketch of bounded size goes to all workers. Beyond that bound its cells stay dealt over the tasks that summed
them, and each document's anchors are joined to them. Texts are read a fixed number of times at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from spanlake.llm._common import SpanHasher, add_columns, any_names, binary, checkpoint, mix, pieces, released, rolled, table

WINDOW, GRAM = 50, 8
#: Rows of the sketch, cells of a row for each anchor, least number of parts in which cells are merged and most cells of
#: a part, documents from which an anchor is hot.
ROWS, CELLS, SLICES, SLICE_CELLS, HOT = 2, 6, 64, 1 << 20, 256
#: Cells of a row that are sent to all workers, at most: 128 MB for both rows. Bytes of text to an anchor, about.
MAX_CELLS, ANCHOR_BYTES = 1 << 29, 130
#: How far the wanted cells may be beyond those: at 5 a third of the windows that stand once pass the two rows.
CROWDED = 5

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_HASH = (SpanHasher(71), SpanHasher(72))
_ODD = tuple(np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def words(content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and ends of all words of the texts in content, and the first word of each text (and the end)."""
    gap = _GAP[content]
    edge = np.ones(len(content) + 1, bool)
    edge[1:-1] = gap[1:] != gap[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    at = at[at < len(content)]
    stop = np.append(at[1:], len(content))
    word = ~gap[at]
    start, stop = at[word], stop[word]
    return start, stop, np.searchsorted(start, offsets)


def least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values."""
    if len(x) < n:
        return x[:0]
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def windows(content: np.ndarray, offsets: np.ndarray, hashes: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of one slice: first word of each text, first words of windows, their anchors and as many hashes of them.

    The anchor of a window is the least hash of its runs of GRAM words: equal windows have equal anchors, and windows
    next to each other mostly share one, so that counting anchors bounds the counts of windows from above. Anchors and
    the first of the hashes stand on independent hashes of the words.
    """
    start, stop, first = words(content, offsets)
    n = len(start) - WINDOW + 1
    if n <= 0:
        return first, np.zeros(0, np.int64), np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * hashes
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    h = _HASH[0](content, start, stop)
    anchor = least(rolled(h, GRAM, _ODD[0]), WINDOW - GRAM + 1)[at]
    found = [rolled(_HASH[1](content, start, stop), WINDOW, _ODD[1])[at]] if hashes else []
    if hashes > 1:
        found.append(rolled(h, WINDOW, _ODD[2])[at])
    return first, at, anchor, found


class Sketch:
    """A merged count-min sketch of two rows, kept as one bit a cell (seen at least twice) and the counts of hot cells."""

    def __init__(self, cells: int, bits: list[np.ndarray], hot: list[tuple[np.ndarray, np.ndarray]]):
        self.cells, self.bits, self.hot = cells, bits, hot

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for row in range(ROWS):
            c = cells_of(anchors, row, self.cells)
            out &= (self.bits[row][c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
        return out

    def is_hot(self, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for row, (cells, _) in enumerate(self.hot):
            if not len(cells):
                return np.zeros(len(anchors), bool)
            c = cells_of(anchors, row, self.cells)
            out &= cells[np.minimum(np.searchsorted(cells, c), len(cells) - 1)] == c
        return out


def cells_of(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)[row])
    return (mix(anchors ^ salt) & np.uint64(cells - 1)).astype(np.int64)


def _distinct(anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a slice, each once a document, and the documents."""
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    a, d = anchor[new], doc[new]
    order = np.lexsort((a, d))
    a, d = a[order], d[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    return a[new], d[new]


class Listed:
    """What the sketch says of the anchors in one batch, from the lists that were joined to its rows."""

    def __init__(self, anchors: pa.Array, hot: pa.Array):
        flat, is_hot = np.asarray(anchors.flatten()).view(np.uint64), np.asarray(hot.flatten()) > 0
        self.anchors, self.hot = np.unique(flat), np.unique(flat[is_hot])

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        return _among(anchors, self.anchors)

    def is_hot(self, anchors: np.ndarray) -> np.ndarray:
        return _among(anchors, self.hot)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _slices(batch: pa.RecordBatch, column: int, hashes: int = 0) -> Iterator[tuple]:
    """First row, first words of windows and of texts, anchors, documents and hashes of the windows of each slice."""
    content, offsets, _ = binary(batch.column(column))
    for i, j in pieces(np.diff(offsets)):
        own = offsets[i : j + 1]
        first, at, anchor, h = windows(content[own[0] : own[-1]], own - own[0], hashes)
        yield i, at, first, anchor, np.searchsorted(first, at, "right") - 1, h


def sketch(docs: DataFrame, cells: int, hot_at: int = HOT) -> Sketch:
    """Partition sketches, sent as their cells that are not zero, merged a slice of the cells at a time."""
    slices = max(SLICES, cells // SLICE_CELLS)
    width = cells // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            a = np.concatenate(held)
            out = {"slice": [], "row": [], "cells": [], "counts": []}
            for row in range(ROWS):
                c, n = np.unique(cells_of(a, row, cells), return_counts=True)
                edges = np.searchsorted(c, np.arange(slices + 1) * width)
                for s in range(slices):
                    x = slice(edges[s], edges[s + 1])
                    if x.stop > x.start:
                        for name, v in (("slice", s), ("row", row), ("cells", (c[x] - s * width).astype(np.uint32).tobytes()), ("counts", np.minimum(n[x], 65535).astype(np.uint16).tobytes())):
                            out[name].append(v)
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("slice", pa.int32()), ("row", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]))

        for b in batches:
            for _, _, _, anchor, doc, _ in _slices(b, 0):
                held.append(_distinct(anchor, doc)[0])
                size += len(held[-1])
                if size > 1 << 21:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for s, row, c, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                total = sums.setdefault((s, row), np.zeros(width, np.uint16))
                c = np.frombuffer(c, np.uint32)
                total[c] = np.minimum(total[c].astype(np.int64) + np.frombuffer(n, np.uint16), 65535)
        for (s, row), total in sums.items():
            hot = np.flatnonzero(total >= hot_at)
            yield pa.RecordBatch.from_pydict({"slice": [s], "row": [row], "bits": [np.packbits(total >= 2, bitorder="little").tobytes()], "hot": [(hot + s * width).tobytes()], "n": [total[hot].astype(np.int64).tobytes()]})

    sent = docs.select(F.coalesce(F.col("__text"), F.lit("")).cast("binary").alias("t")).mapInArrow(released(count), "slice int, row int, cells binary, counts binary")
    merged = sent.repartition(slices, "slice", "row").mapInArrow(released(merge), "slice long, row long, bits binary, hot binary, n binary").collect()
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(ROWS)]
    hot: list[list] = [[] for _ in range(ROWS)]
    for r in sorted(merged, key=lambda r: r.slice):
        bits[r.row][r.slice * width // 8 : (r.slice + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
        hot[r.row].append((np.frombuffer(r.hot, np.int64), np.frombuffer(r.n, np.int64)))
    return Sketch(cells, bits, [tuple(np.concatenate([x[k] for x in h]) if h else np.zeros(0, np.int64) for k in (0, 1)) for h in hot])


def _covered(at: np.ndarray) -> bytes:
    """Word ranges (from, to) that windows at these first words cover, as int32 pairs."""
    if not len(at):
        return b""
    new = np.flatnonzero(np.diff(at, prepend=-(1 << 40)) > WINDOW)
    last = np.append(new[1:], len(at)) - 1
    return np.column_stack((at[new], at[last] + WINDOW)).astype(np.int32).tobytes()


def listed(docs: DataFrame, cells: int, hot_at: int = HOT) -> DataFrame:
    """docs that have an anchor of a cell counted twice or more, with these (__anchors) and whether they are hot (__hot).

    The sketch has one row here, whose cells stay where they are summed: each task sums its own cells first.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = (np.asarray(b.column(i)) for i in (0, 1))
            for row, _, _, anchor, doc, _ in _slices(b, 2):
                a, d = _distinct(anchor, doc)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + d]), pa.array(keys[row + d]), pa.array(a.view(np.int64)), pa.array(cells_of(a, 0, cells))], names=["__id", "__key", "anchor", "cell"])

    rows = docs.select("__id", "__key", F.coalesce(F.col("__text"), F.lit("")).cast("binary")).mapInArrow(released(emit), "__id long, __key long, anchor long, cell long")
    sums = rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # Plain exchanges on either side, so that Spark can split the rows of very common anchors.
    own = rows.join(sums.hint("merge"), "cell").groupBy("__id", "__key")
    lists = own.agg(F.collect_list("anchor").alias("__anchors"), F.collect_list((F.col("n") >= hot_at).cast("int")).alias("__hot"))
    return docs.join(checkpoint(lists).hint("merge"), ["__id", "__key"])


def _sent(docs: DataFrame, sent) -> DataFrame:
    return docs.select("__id", "__key", F.coalesce(F.col("__text"), F.lit("")).cast("binary"), *([] if sent else ["__anchors", "__hot"]))


def _cold(docs: DataFrame, sent=None) -> DataFrame:
    """Covered ranges from anchors of few documents: all runs of an anchor meet in one task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = (np.asarray(b.column(i)) for i in (0, 1))
            counted = sent.value if sent else Listed(b.column(3), b.column(4))
            for row, at, first, anchor, doc, h in _slices(b, 2, 1):
                keep = np.flatnonzero(counted.repeated(anchor))
                keep = keep[~counted.is_hot(anchor[keep])]
                at, anchor, doc, h1 = at[keep], anchor[keep], doc[keep], h[0][keep]
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
                s = np.flatnonzero(new)
                edges = np.append(s, len(at)).astype(np.int32)
                own = doc[s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[s].view(np.int64)), pa.array(ids[row + own]), pa.array(keys[row + own]), pa.array((at[s] - first[own]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges), pa.array(h1.view(np.int64)))],
                    names=["anchor", "id", "key", "at", "h"],
                )

    def resolve(ids, keys, ats, anchors, lengths, h):
        run = np.repeat(np.arange(len(ids)), lengths)
        a, d = anchors[run], ids[run]
        order = np.lexsort((d, h, a))
        a, d, h = a[order], d[order], h[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
        least_id = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = np.zeros(len(a), bool)
        late[order] = d > least_id
        offset = np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at, run = (ats[run] + offset)[late], run[late]
        edges = np.flatnonzero(np.diff(run, prepend=-1))
        hit = run[edges]
        spans = [_covered(x) for x in np.split(at, edges[1:])] if len(edges) else []
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(keys[hit]), pa.array(spans, pa.binary())], names=["id", "key", "spans"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows come sorted by anchor; whole anchors are resolved as soon as enough windows are there.
        held: list[tuple] = []
        size = 0

        def merged():
            return [np.concatenate([x[k] for x in held]) for k in range(6)]

        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(4)
            lengths = np.diff(np.asarray(lists.offsets))
            held.append((np.asarray(b.column(1)), np.asarray(b.column(2)), np.asarray(b.column(3)), np.asarray(b.column(0)), lengths, np.asarray(lists.flatten())))
            size += len(held[-1][5])
            if size > 1 << 20:
                ids, keys, ats, anchors, lengths, h = merged()
                cut = int(np.searchsorted(anchors, anchors[-1]))
                if cut:
                    flat = int(lengths[:cut].sum())
                    yield resolve(ids[:cut], keys[:cut], ats[:cut], anchors[:cut], lengths[:cut], h[:flat])
                    held = [(ids[cut:], keys[cut:], ats[cut:], anchors[cut:], lengths[cut:], h[flat:])]
                    size = len(held[0][5])
                else:
                    held = [(ids, keys, ats, anchors, lengths, h)]
        if held:
            yield resolve(*merged())

    rows = _sent(docs, sent).mapInArrow(released(emit), "anchor long, id long, key long, at int, h array<long>")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(released(group), "id long, key long, spans binary")


def _hot(docs: DataFrame, sent=None) -> DataFrame:
    """Covered ranges from anchors that many documents share: least ids are pre-aggregated by window, then joined."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = (np.asarray(b.column(i)) for i in (0, 1))
            counted = sent.value if sent else Listed(b.column(3), b.column(4))
            for row, at, first, anchor, doc, h in _slices(b, 2, 2):
                keep = np.flatnonzero(counted.is_hot(anchor))
                keep = keep[counted.repeated(anchor[keep])]
                if not len(keep):
                    continue
                at, doc, h1, h2 = at[keep], doc[keep], h[0][keep], h[1][keep]
                order = np.lexsort((at, h2, h1, doc))
                at, doc, h1, h2 = at[order], doc[order], h1[order], h2[order]
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                s = np.flatnonzero(new)
                own = doc[s]
                spans = [_covered(x) for x in np.split(at - first[doc], s[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(h1[s].view(np.int64)), pa.array(h2[s].view(np.int64)), pa.array(ids[row + own]), pa.array(keys[row + own]), pa.array(spans, pa.binary())], names=["h1", "h2", "id", "key", "spans"])

    rows = _sent(docs, sent).mapInArrow(released(emit), "h1 long, h2 long, id long, key long, spans binary")
    ids = checkpoint(rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("most > least").select("h1", "h2", "least"))
    # Both sides are plain exchanges, so that Spark can split the partitions of very common windows.
    return rows.join(ids.hint("merge"), ["h1", "h2"]).where("id > least").select("id", "key", "spans")


@any_names
def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot_at: int = HOT, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs with spans: the word ranges of each text that windows of documents with a smaller id cover.

    A null id counts as the smallest; rows with equal ids do not count as earlier than each other. Null, empty and short
    texts have no windows. A column of docs by the name of spans gives way. Rows stay as they are, also repeated ones. A
    worker holds one text whole, with about 20 bytes a byte of the longest. max_cells bounds the sketch that is sent to
    all workers (1 bit a cell and row); results do not depend on it.
    """
    docs = docs.drop("spans").withColumns({"__id": F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).cast("long"), "__text": F.col(text), "__key": F.xxhash64(text)})
    size = docs.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    needed = max(1 << 16, CELLS * size // ANCHOR_BYTES)
    cells = 1 << int(needed - 1).bit_length()
    if needed <= CROWDED * max_cells:
        made = sketch(docs, min(cells, max_cells), hot_at)
        sent = docs.sparkSession.sparkContext.broadcast(made)
        found = _cold(docs, sent)
        if all(len(h[0]) for h in made.hot):
            found = found.unionByName(_hot(docs, sent))
    else:
        own = listed(docs, cells, hot_at)
        found = _cold(own).unionByName(_hot(own.where(F.array_contains("__hot", 1))))
    spans = found.groupBy("id", "key").agg(F.collect_list("spans").alias("spans"))
    joined = docs.join(spans.withColumnsRenamed({"id": "__id", "key": "__key"}), ["__id", "__key"], "left")
    return joined.drop("__id", "__key", "__text")


@any_names
def kept_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """After repeated_spans(): n_words, n_removed and kept (the words that stay, joined by one space)."""
    fields = [StructField("n_words", LongType(), False), StructField("n_removed", LongType(), False), StructField("kept", BinaryType(), False)]

    def work(cols):
        n, removed, kept = [], [], []
        for t, spans in zip(cols[0], cols[1], strict=True):
            w = (t.as_py() or b"").split()
            n.append(len(w))
            if spans.is_valid:
                gone = np.zeros(len(w) + 1, np.int32)
                for s in spans.as_py():
                    pairs = np.frombuffer(s, np.int32)
                    np.add.at(gone, pairs[::2], 1)
                    np.add.at(gone, pairs[1::2], -1)
                stay = np.cumsum(gone)[:-1] == 0
                w = [x for x, k in zip(w, stay.tolist(), strict=True) if k]
            removed.append(n[-1] - len(w))
            kept.append(b" ".join(w))
        return [n, removed, kept]

    return add_columns(docs, [F.col(text).cast("binary"), F.col("spans")], fields, work).drop("spans")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept_words(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)),
least AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (g) WHERE doc_id > first_id),
removed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
FROM doc LEFT JOIN removed USING (doc_id)
"""
