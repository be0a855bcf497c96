"""Sharding by histogram sort: probe keys are counted across all partitions, round by round, until the splitters are exact.

A round counts, for each interval between probes, exact bytes, rows and the least and greatest key. Only intervals that
hold an unmet splitter get new probes. When every splitter meets the tolerance, the rows move once. No round moves rows,
and what the driver sees is a row for each probe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField

from spanlake.llm._common import add_columns, any_names, checkpoint, released, table

#: New probes for each splitter that is still open, a round.
PROBES = 64
_LOW = 1 << 63


def _whole(k1: int, k2: int) -> int:
    return (k1 << 64) + k2 + _LOW


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([k >> 64 for k in keys], np.int64), np.array([(k & (1 << 64) - 1) - _LOW for k in keys], np.int64)


def _at(p1: np.ndarray, p2: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """How many probes are at or below each key."""
    left, right = np.searchsorted(p1, k1, "left"), np.searchsorted(p1, k1, "right")
    for a in np.unique(left[left < right]):
        own = (left == a) & (right > a)
        b = right[own][0]
        left[own] = a + np.searchsorted(p2[a:b], k2[own], "right")
    return left


def _histogram(rows: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(interval, bytes, rows, least key, greatest key) of each interval that has rows."""
    p1, p2 = _halves(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for b in batches:
            k1, k2, size = (b.column(i).to_numpy() for i in range(3))
            if not len(k1):
                continue
            at = _at(p1, p2, k1, k2)
            order = np.lexsort((k2, k1, at))
            at, k1, k2, size = at[order], k1[order], k2[order], size[order]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            stops = np.append(starts[1:], len(at))
            for i, n, size_, a, z in zip(at[starts].tolist(), (stops - starts).tolist(), np.add.reduceat(size, starts).tolist(), starts.tolist(), (stops - 1).tolist(), strict=True):
                low, high = (int(k1[a]), int(k2[a])), (int(k1[z]), int(k2[z]))
                if (s := seen.get(i)) is None:
                    seen[i] = [size_, n, low, high]
                else:
                    seen[i] = [s[0] + size_, s[1] + n, min(s[2], low), max(s[3], high)]
        if seen:
            yield pa.RecordBatch.from_pydict({"i": list(seen), "size": [s[0] for s in seen.values()], "n": [s[1] for s in seen.values()]} | {f"{name}{h + 1}": [s[which][h] for s in seen.values()] for name, which in (("low", 2), ("high", 3)) for h in (0, 1)})

    found = rows.select("__k1", "__k2", "__size").mapInArrow(released(count), "i long, size long, n long, low1 long, low2 long, high1 long, high2 long")
    found = found.groupBy("i").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min(F.struct("low1", "low2")).alias("low"), F.max(F.struct("high1", "high2")).alias("high"))
    return sorted((r.i, r["size"], r.n, _whole(*r.low), _whole(*r.high)) for r in found.collect())


def splitters(rows: DataFrame, n_shards: int, tolerance: int = 0) -> tuple[list[int], dict[int, int], int]:
    """Least keys of shards 1 to n - 1, rows below each probe that was counted, and the rounds it took.

    Shard s starts at the first key below which at least s / n of all bytes are. With a tolerance (bytes), an interval
    that holds no more than that is not searched further.
    """
    first, last = -_LOW, _LOW - 1
    probes = [_whole(first + i * (1 << 64) // (PROBES * n_shards), first) for i in range(PROBES * n_shards)]
    below: dict[int, int] = {}
    found: dict[int, int] = {}
    rounds = 0
    while True:
        rounds += 1
        hist = _histogram(rows, probes)
        total = sum(h[1] for h in hist)
        if not total:
            return [], {}, rounds
        sizes = np.cumsum([0] + [h[1] for h in hist]).tolist()
        counts = np.cumsum([0] + [h[2] for h in hist]).tolist()
        for j, h in enumerate(hist):
            below[h[3]] = counts[j]
        again: dict[int, int] = {}
        for s in range(1, n_shards):
            if s in found:
                continue
            j = next((j for j in range(len(hist)) if sizes[j + 1] * n_shards >= s * total), len(hist) - 1)
            # Keys of interval j have between sizes[j] and sizes[j + 1] bytes below them.
            if sizes[j] * n_shards >= s * total:
                found[s] = hist[j][3]
            elif hist[j][3] == hist[j][4] or hist[j][1] <= tolerance:
                found[s] = hist[j + 1][3] if j + 1 < len(hist) else _whole(last, last)
            else:
                again[j] = again.get(j, 0) + 1
        if not again:
            break
        probes = sorted({h[3] for h in hist} | {_whole(first, first)} | {hist[j][3] + 1 + i * (hist[j][4] - hist[j][3]) // (PROBES * m) for j, m in again.items() for i in range(PROBES * m)})
        probes = sorted(set(probes) | {hist[j][4] for j in again})
    return [found[s] for s in range(1, n_shards)], below, rounds


@any_names
def shard(docs: DataFrame, key: list[Column], size: Column, n_shards: int, tolerance: int = 0) -> DataFrame:
    """docs with shard (0 to n - 1, near equal sums of `size`) and slot (gapless from 0 in each shard, by key).

    The two longs of `key` order the rows; rows with one key share a shard. A negative or null size counts as 0, a null
    key as the least. Empty input gives empty output; with fewer rows than shards some shards stay empty.
    """
    low = F.lit(-_LOW)
    rows = docs.withColumns({"__k1": F.coalesce(key[0], low), "__k2": F.coalesce(key[1], low), "__size": F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")})
    rows = checkpoint(rows)
    ends, below, _ = splitters(rows, n_shards, tolerance)
    bounds = sorted(set(below) | set(ends)) or [0]
    n_below, known = [], sorted(below)
    n_rows = None
    for b in bounds:
        if b not in below:  # the end of the last shard with rows
            n_rows = rows.count() if n_rows is None else n_rows
        n_below.append(below.get(b, n_rows))
    del known
    of_shard = np.searchsorted(np.array(ends, object), np.array(bounds, object), "right") if ends else np.zeros(len(bounds), np.int64)
    starts = {}
    for b, s in zip(n_below, of_shard.tolist(), strict=True):
        starts.setdefault(s, b)
    base = np.array([b - starts[s] for b, s in zip(n_below, of_shard.tolist(), strict=True)], np.int64)
    of_shard = np.asarray(of_shard, np.int64)
    p1, p2 = _halves(bounds)

    def place(cols):
        at = _at(p1, p2, cols[0].to_numpy(), cols[1].to_numpy()) - 1
        return [pa.array(of_shard[at].astype(np.int32)), pa.array(at), pa.array(base[at])]

    placed = add_columns(rows, [F.col("__k1"), F.col("__k2")], [StructField("shard", IntegerType(), False), StructField("__at", LongType(), False), StructField("__base", LongType(), False)], place)
    rank = F.row_number().over(Window.partitionBy("__at").orderBy("__k1", "__k2"))
    return placed.withColumn("slot", F.col("__base") + rank - 1).drop("__k1", "__k2", "__size", "__at", "__base")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are next to each other in the order (hash of the text, doc_id): a group is cut only by a splitter."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("text_key"),
    )
    out = shard(docs, [F.col("text_key"), F.col("doc_id")], F.col("size"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE_SQL = r"""
WITH poly AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v
    FROM range(0, 256) r(i))),
doc AS (
  SELECT doc_id, coalesce(text, '') AS body, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k
  FROM documents),
summed AS (
  SELECT doc.*, CAST(coalesce(sum(size) OVER (ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS below,
         CAST(sum(size) OVER () AS HUGEINT) AS total
  FROM doc),
placed AS (SELECT summed.*, CAST((below * 40) // total AS INTEGER) AS shard FROM summed),
bytes AS (
  SELECT doc_id, k, list_transform(range(1, strlen(body) * 2, 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS b
  FROM (SELECT doc_id, k, body, hex(encode(body)) AS h FROM doc)),
crc AS (
  SELECT doc_id, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM bytes, poly)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed JOIN crc USING (doc_id, k)
"""
