"""Shared plumbing of the training-data operators: Arrow pass-through maps, vectorised byte hashing, table access."""

from __future__ import annotations

import ctypes
import hashlib
import inspect
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from spanlake.sources.shared import shared_folder

BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that add_columns() answers at a time, so that what it returns stays small whatever a record batch holds.
STEP_ROWS = 1024
#: Bytes of text that one vectorised step works on; bounds a Python worker's memory whatever the batch holds.
SLICE_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of no more than BATCH_ROWS texts: two workers and their executor hold a few of them at a time."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and Spark plans by sizes that are known.

    DataFrame.checkpoint() would keep the estimates of the plan, and those of joins of joins double their digits each
    round until the driver runs out of memory.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_prefix(docs: DataFrame) -> str:
    """A beginning that no column's name has."""
    prefix = "own_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "own_"
    return prefix


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator for tables with columns of any names that it isn't told to read.

    Names that begin with two underscores, hold a dot or other such characters, or capitals, are put out of its way and
    come back after it, unless a new column has the name, in capitals or not: then the old one is gone.
    """
    signature = inspect.signature(operator)

    @wraps(operator)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        bound = signature.bind(docs, *args, **named)
        bound.apply_defaults()
        given = [y for x in bound.arguments.values() for y in (x if isinstance(x, list | tuple) else [x])]
        read = {x for x in given if isinstance(x, str)}
        strict = any(isinstance(x, Column) for x in given)  # expressions may name columns in capitals
        prefix = free_prefix(docs)
        odd = {c: f"{prefix}{k}" for k, c in enumerate(docs.columns) if c not in read and (c.startswith("__") or not c.isidentifier() or not strict and c != c.lower())}
        if not odd:
            return operator(docs, *args, **named)
        out = operator(docs.withColumnsRenamed(odd), *args, **named)
        now = {c.lower() for c in out.columns}
        return out.drop(*[n for c, n in odd.items() if c.lower() in now]).withColumnsRenamed({n: c for c, n in odd.items() if c.lower() not in now})

    return run


def pieces(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row has a range of its own."""
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def binary(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of an Arrow string or binary array, without a Python object for each row."""
    if not (pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)):
        array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    starts = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.ones(len(array), bool) if not array.null_count else np.asarray(array.is_valid())
    return content, starts, valid


def release() -> None:
    """Give freed memory back to the system: workers wait for other tasks, and what they hold counts meanwhile."""
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run(), with release() at the end of a task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def add_columns(df: DataFrame, inputs: list[Column], fields: list[StructField], work: Callable[[list[pa.Array]], list], drop: tuple[str, ...] = (), close: Callable[[], object] | None = None) -> DataFrame:
    """df with more columns, made from `inputs` by `work` some rows at a time; no shuffle.

    A column of df that has the name of a new one gives way to it. Rows, their order and all other columns stay, except
    those in `drop`, which are not sent back. `close` is called at the end of each task.
    """
    small_batches(df.sparkSession)
    new = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in new]
    names = [f"__in{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], *[c.alias(n) for c, n in zip(inputs, names, strict=True)])
    schema = StructType(kept + fields)
    arrow = to_arrow_schema(schema)
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                b = whole.slice(at, STEP_ROWS)
                made = work([b.column(n_kept + i) for i in range(len(names))])
                out = [b.column(i) for i in range(n_kept)]
                for x, f in zip(made, arrow.names[n_kept:], strict=True):
                    kind = arrow.field(f).type
                    out.append(x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([c if c.type == k.type else c.cast(k.type) for c, k in zip(out, arrow, strict=True)], names=arrow.names)
        if close:
            close()

    return source.mapInArrow(released(run), schema)


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = (x ^ (x >> S30)) * M1
    x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class SpanHasher:
    """64-bit hashes of byte spans: eight bytes a step, each step mixed, so that no two steps can cancel out.

    State and increment come from the seed alone, so all workers agree, and hashers of two seeds share neither: two
    spans that collide in one do so in the other by chance only. Spans of more than LONG bytes are hashed by BLAKE2 with
    the seed as its key.
    """

    LONG = 1024

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.state, self.step = rng.integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.key = seed.to_bytes(8, "little")

    def __call__(self, content: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(content) + 8, np.uint8)
        padded[: len(content)] = content
        words = np.ndarray((len(content) + 1,), "<u8", padded, strides=(1,))
        size = stop - start
        with np.errstate(over="ignore"):
            out = mix(size.astype(np.uint64) * self.step + self.state)
            live = np.flatnonzero((size > 0) & (size <= self.LONG))
            at, left, h = start[live], size[live], out[live]
            while len(live):
                h = mix((h + self.step) ^ (words[at] & _KEEP[np.minimum(left, 8)]))
                out[live] = h
                on = np.flatnonzero(left > 8)
                live, at, left, h = live[on], at[on] + 8, left[on] - 8, h[on]
        for k in np.flatnonzero(size > self.LONG).tolist():
            body = padded[start[k] : stop[k]]
            out[k] = int.from_bytes(hashlib.blake2b(body, digest_size=8, key=self.key).digest(), "little")
        return out


def combined(a: np.ndarray, b: np.ndarray, odd: np.uint64) -> np.ndarray:
    """One hash of two, in their order."""
    return mix(a * odd + b)


def rolled(h: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """Hash of each n consecutive hashes, by doubling: blocks of 1, 2, 4, ... hashes are mixed pair by pair."""
    many = len(h) - n + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    out, done, span, block = None, 0, 1, h
    with np.errstate(over="ignore"):
        while done < n:
            if n & span:
                part = block[done : done + many]
                out = part if out is None else combined(out, part, odd)
                done += span
            if done < n:
                block = combined(block[:-span], block[span:], odd)
                span *= 2
    return out if n > 1 else out.copy()
