"""Benchmark decontamination with a generalised suffix automaton over the words of normalised test items.

The automaton is built over word ids, so one step takes a word. Training words are streamed through it; the length of
the longest match that ends at each word decides: where it reaches the window, the last `window` words are a window of
some item. Items shorter than the window count as one window and are found as whole items on the suffix links.

Hashes of all item windows come first: documents in which none of them stands pass without the automaton, and it is
built, some documents at a time, of the items that they may hold. So its size follows what is found, not the benchmark.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from spanlake.llm._common import SpanHasher, add_columns, any_names, binary, pieces, rolled, table

#: Words are runs of letters, digits and bytes from 0x80; A-Z become a-z. One table turns all other bytes to spaces.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CLASS = np.frombuffer(_BYTES, np.uint8)
_HASH = SpanHasher(31)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: UTF-8 bytes of items the driver takes at a time; the hashes of their windows take about three times that in a worker.
BLOCK_BYTES = 32 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


class Automaton:
    """Generalised suffix automaton of several word sequences, with the items that hold each state's window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int]] = []
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, k))
        #: Items at the state whose strings have at least `window` words, and short items that end there whole.
        self.items: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for state, k in ends:
            seen = state
            while self.len[seen] >= window and k not in self.items.setdefault(seen, set()):
                self.items[seen].add(k)
                seen = self.link[seen]
        self.shortest = window
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                self.shortest = min(self.shortest, len(words))
                state = 0
                for w in words:
                    state = self.next[state][self.ids[w]]
                self.whole.setdefault(state, []).append((len(words), k))
        # Short items also end where a longer string ends: hand them down the suffix links, shortest strings first.
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            if up := self.whole.get(self.link[s]):
                self.whole[s] = self.whole.get(s, []) + up

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, end, items) of each occurrence of a window."""
        if len(words) < self.shortest:
            return
        ids = np.array(list(map(self.ids.get, words, repeat(-1))), np.int64)
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        nxt, link, length, window = self.next, self.link, self.len, self.window
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = match = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                while state and c not in nxt[state]:
                    state = link[state]
                    match = length[state]
                if (to := nxt[state].get(c)) is None:
                    match = 0
                else:
                    state, match = to, match + 1
                    while match >= window and length[link[state]] >= window:
                        state = link[state]
                        match = length[state]
                    if match >= window:
                        yield i - window, i, self.items[state]
                    for n, k in self.whole.get(state, ()):
                        if n <= match:
                            yield i - n, i, {k}


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items as the driver takes them: all at once up to BLOCK_BYTES, else in as many hash parts as that needs."""
    rows = items.select(F.col(item_id).cast("string").alias("k"), F.col(text).cast("binary").alias("t")).where("t is not null and k is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("t") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    for p in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == p)
        yield [(r.k, bytes(r.t)) for r in part.collect()]


def hashed_words(content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in content, and the first word of each text (and the end)."""
    text = _CLASS[content]
    gap = text == 32
    edge = np.ones(len(text) + 1, bool)
    edge[1:-1] = gap[1:] != gap[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    at = at[at < len(text)]
    stop = np.append(at[1:], len(text))
    word = ~gap[at]
    start, stop = at[word], stop[word]
    return _HASH(text, start, stop), np.searchsorted(start, offsets)


class Windows:
    """Hashes of the windows of items, by length in words, with the items that hold them."""

    def __init__(self, texts: list[bytes], window: int):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        content = np.frombuffer(b"".join(texts), np.uint8)
        h, first = hashed_words(content, np.cumsum([0, *map(len, texts)]))
        size = np.diff(first)
        item = np.repeat(np.arange(len(texts)), size)
        for n in np.unique(np.minimum(size[size > 0], window)).tolist():
            x = rolled(h, n, _ODD)
            at = np.flatnonzero(item[: len(x)] == item[n - 1 :]) if n == window else first[:-1][size == n]
            order = np.lexsort((item[at], x[at]))
            self.tables[n] = x[at][order], item[at][order].astype(np.int32)

    def found(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and items that may share a window, a row for each such pair or more."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for n, (keys, owner) in self.tables.items():
            x = rolled(h, n, _ODD)
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x)
            at = at[doc[at] == doc[at + n - 1]]
            lo, hi = np.searchsorted(keys, x[at]), np.searchsorted(keys, x[at], "right")
            many = hi - lo
            docs.append(np.repeat(doc[at], many))
            items.append(owner[np.arange(int(many.sum())) + np.repeat(lo - (np.cumsum(many) - many), many)])
        return np.concatenate(docs), np.concatenate(items)


_built: dict[str, tuple] = {}


def _index(key: str, packed: bytes, window: int) -> tuple[list[str], list[bytes], Windows]:
    """Ids and texts of the items of one part, and their windows; a worker keeps the parts of the last few calls."""
    if key not in _built:
        if len(_built) > 3:
            _built.clear()
        items = pickle.loads(packed)
        _built[key] = [k for k, _ in items], [t for _, t in items], Windows([t for _, t in items], window)
    return _built[key]


@any_names
def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, cut: bool = False) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (flat array of word positions: from, to, from, to, ...) and item_ids (sorted strings).

    cut: the text comes back without the words that are hit, as remove_spans() leaves it.

    Benchmarks beyond BLOCK_BYTES are taken in hash parts, one after the other, each in one pass over the texts. A null
    or empty text has no words and no hit. Items that are null, empty or without words match nothing; items
    with equal ids count once. No row is dropped or added, whatever the ids. A worker holds one text whole, with about
    20 bytes a byte of it.
    """
    fields = [StructField("n_words", LongType(), False), StructField("n_hit", LongType(), False), StructField("hit_spans", ArrayType(IntegerType(), False), False), StructField("item_ids", ArrayType(StringType(), False), False)]
    sc = docs.sparkSession.sparkContext
    first, parts = True, blocks(items, item_id, item_text)
    part, after = next(parts), next(parts, None)
    while part is not None:
        last = cut and after is None
        packed = pickle.dumps(part)
        sent, key, with_old = sc.broadcast(packed), hashlib.md5(packed).hexdigest() + f"-{window}", not first

        def work(cols, sent=sent, key=key, with_old=with_old, last=last):
            names, texts, index = _index(key, sent.value, window)
            content, offsets, _ = binary(cols[0].fill_null(b""))
            n_words, spans, found = [], [], []
            for i, j in pieces(np.diff(offsets)):
                own = offsets[i : j + 1]
                h, first = hashed_words(content[own[0] : own[-1]], own - own[0])
                n_words += np.diff(first).tolist()
                docs_, items_ = index.found(h, first)
                some = np.unique(items_).tolist()
                automaton = Automaton([(names[k], words_of(texts[k])) for k in some], window) if some else None
                suspect = np.zeros(j - i, bool)
                suspect[docs_] = True
                for d, maybe in enumerate(suspect.tolist(), i):
                    hit, got = [], set()
                    if with_old:
                        old = cols[1][d].as_py()
                        hit, got = list(zip(old[::2], old[1::2], strict=True)), set(cols[2][d].as_py())
                    if maybe:
                        for a, b, ks in automaton.matches(words_of(content[offsets[d] : offsets[d + 1]].tobytes())):
                            hit.append((a, b))
                            got.update(names[some[k]] for k in ks)
                    flat: list[int] = []
                    for a, b in sorted(hit):
                        if flat and a <= flat[-1]:
                            flat[-1] = max(flat[-1], b)
                        else:
                            flat += (a, b)
                    spans.append(flat)
                    found.append(sorted(got))
            kept = [[_without(t.as_py(), x) for t, x in zip(cols[0], spans, strict=True)]] if last else []
            return [n_words, [sum(x[1::2]) - sum(x[::2]) for x in spans], spans, found, *kept]

        docs = add_columns(docs, [F.col(text).cast("binary"), *([F.col("hit_spans"), F.col("item_ids")] if with_old else [])], fields + [StructField(text, StringType())] * last, work)
        first, part, after = False, after, next(parts, None)
    return docs


def _without(t: bytes | None, spans: list[int]) -> str | None:
    """The text without the words from spans[0] to spans[1], from spans[2] to spans[3] and so on, and what is between them."""
    if t is None or not spans:
        return None if t is None else t.decode()
    edges = np.diff(np.concatenate(([0], np.frombuffer(t.translate(_BYTES), np.uint8) != 32, [0])).astype(np.int8))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        kept.append(t[at : starts[a]])
        at = stops[b - 1]
    return b"".join([*kept, t[at:]]).decode()


@any_names
def remove_spans(docs: DataFrame, text: str = "text", max_coverage: float = 0.5) -> DataFrame:
    """After scan(): cut the hit words out of the text and drop documents of which more than `max_coverage` is hit.

    Text between words goes with the words it stands between; all else stays as it was. Documents without a hit are
    untouched, null and empty ones included.
    """
    fields = [StructField(text, StringType(), True)]

    def work(cols):
        return [[_without(t.as_py(), spans) for t, spans in zip(cols[0], cols[1].to_pylist(), strict=True)]]

    order = docs.columns
    return add_columns(docs.where(F.col("n_hit") <= F.lit(float(max_coverage)) * F.col("n_words")), [F.col(text).cast("binary"), F.col("hit_spans")], fields, work).select(*[f"`{c}`" for c in order])


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """remove_spans() of scan() in one pass over the texts: docs with the columns of scan() and texts without hit words."""
    found = scan(docs, items, text, item_id, item_text, window, cut=True)
    return found.where(F.col("n_hit") <= F.lit(float(max_coverage)) * F.col("n_words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, LEAST(len(w), 10) AS n, array_to_string(w[i:i + LEAST(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, GREATEST(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
hit AS (
  SELECT d.doc_id, d.i, win.n, win.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) d
  JOIN win ON win.n = d.n AND win.g = d.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
