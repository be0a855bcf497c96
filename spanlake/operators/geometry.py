"""Spans to boxes on pages: from positioned items, or from recognised words."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from spanlake.functions.patterns import SPACES
from spanlake.operators.model import _SPACE, _all

BOX = "struct<x:double,y:double,width:double,height:double>"
#: Fields of a page's items and of recognised words.
ITEM = {"str": "string", "x": "double", "y": "double", "font_h": "double", "width": "double", "has_eol": "boolean"}
WORD = {"text": "string", "x0": "double", "y0": "double", "x1": "double", "y1": "double"}
#: Entities that a page meets at a time.
BLOCK = 256


def merge_boxes(boxes: Column) -> Column:
    """Boxes sorted by y and x, with those joined that touch (within 2 points) on a line."""
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(*[b[c].cast("double").alias(c) for c in ("y", "x", "width", "height")])))
    ordered = F.transform(ordered, lambda b: F.struct(*[b[c].alias(c) for c in ("x", "y", "width", "height")]))

    def step(acc: Column, b: Column) -> Column:
        p = F.try_element_at(acc, F.lit(-1))
        near = (F.abs(b["y"] - p["y"]) < p["height"] * 0.5) & (b["x"] <= p["x"] + p["width"] + 2)
        left = F.least(p["x"], b["x"])
        wide = F.struct(left.alias("x"), p["y"].alias("y"), (F.greatest(p["x"] + p["width"], b["x"] + b["width"]) - left).alias("width"), F.greatest(p["height"], b["height"]).alias("height"))
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wide))).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(ordered, F.array().cast(f"array<{BOX}>"), step)


def _merged(boxes: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    out: list[tuple[float, float, float, float]] = []
    for x, y, w, h in sorted(boxes, key=lambda b: (b[1], b[0])):
        if out and abs(y - out[-1][1]) < out[-1][3] * 0.5 and x <= out[-1][0] + out[-1][2] + 2:
            px, py, pw, ph = out[-1]
            left = min(px, x)
            out[-1] = (left, py, max(px + pw, x + w) - left, max(ph, h))
        else:
            out.append((x, y, w, h))
    return out


class _Items:
    """The text of a page's items, laid out once for all that is looked for."""

    def __init__(self, strs: list[str], x: Sequence, y: Sequence, font_h: Sequence, width: Sequence, eols: Sequence):
        self.strs = strs
        self.x, self.y, high, self.width = (np.asarray(v, np.float64) for v in (x, y, font_h, width))
        lens, self.size = np.fromiter(map(len, strs), np.int64, len(strs)), np.where(high == 0, 12.0, np.abs(high))
        mean = np.where(lens > 0, self.width / np.maximum(lens, 1), self.size * 0.5)[:-1]
        line = np.abs(np.diff(self.y)) > self.size[:-1] * 0.5
        apart = self.x[1:] - self.x[:-1] - self.width[:-1] > mean * 1.5
        every = "".join(strs)
        if strs and lens.min() > 0 and "\n" not in every and " " not in every:  # then lengths alone say where all stands
            ended = np.array(eols, bool)
            gaps = np.where(line, np.where(ended[:-1], 0, 2), apart)
            between = [("", " ", "\n", "\n", "\n ")[k] for k in (gaps + 3 * ended[:-1]).tolist()]
            self.text = "".join([t for pair in zip(["", *between], strs, strict=True) for t in pair]) + "\n" * int(ended[-1])
            starts = np.concatenate(([0], np.cumsum(lens[:-1] + (gaps > 0) + ended[:-1])))
            self.starts, self.ends = starts.tolist(), (starts + lens).tolist()
            return
        parts, starts, at, broken, last = [], [], 0, False, ""
        for s, eol, gap in zip(strs, eols, [0, *np.where(line, 2, apart).tolist()], strict=False):  # no items have no gaps
            if gap == 2 and not broken:
                parts.append("\n")
                at, broken = at + 1, True
            elif gap == 1 and last[-1:] != " " and s[:1] != " ":
                parts.append(" ")
                at, broken = at + 1, False
            starts.append(at)
            if s or eol:
                parts.append(s + "\n" if eol else s)
                at, broken = at + len(s) + bool(eol), bool(eol) or s[-1] == "\n"
            last = s
        self.text, self.starts = "".join(parts), starts
        self.ends = (np.array(starts, np.int64) + lens).tolist()

    def boxes(self, needle: str, page_height: float) -> list[tuple[float, float, float, float]]:
        if not needle:
            return []
        boxes = []
        for at in _all(self.text, needle):
            for k in range(bisect_right(self.ends, at), len(self.strs)):
                a, n = self.starts[k], len(self.strs[k])
                if a >= at + len(needle):
                    break
                x, y, wide, size = (float(v[k]) for v in (self.x, self.y, self.width, self.size))
                lo, hi = max(0, at - a), min(n, at + len(needle) - a)
                if lo or hi != n:
                    mean = wide / n if n else size * 0.6
                    x, wide = x + lo * mean, (hi - lo) * mean
                boxes.append((x - size * 0.1, page_height - y - size, wide + size * 0.2, size * 1.4))
        return _merged(boxes)


@lru_cache(1 << 16)
def _letters(word: str) -> int:
    """A bit for the first and one for the second of each character, in 32 classes: a word has no more bits that another lacks than their edit distance."""
    bits = 0
    for c in word:
        once = 1 << (ord(c) & 31)
        bits |= once << 32 if bits & once else once
    return bits


def _distances(part: str, words: list[str]) -> list[int]:
    """Edit distances from a text to words, a word's column at a time in the bits of an integer (Myers, Hyyrö)."""
    places: dict[str, int] = {}
    for k, c in enumerate(part):
        places[c] = places.get(c, 0) | 1 << k
    full, top, out = (1 << len(part)) - 1, 1 << len(part) - 1, []
    for word in words:
        more, less, d = full, 0, len(part)
        for c in word:
            same = places.get(c, 0)
            level = (((same & more) + more) ^ more) | same
            up, down = less | ~(level | more) & full, more & level
            if up & top:
                d += 1
            elif down & top:
                d -= 1
            up, same = up << 1 | 1, same | less
            more, less = (down << 1 | ~(same | up)) & full, up & same & full
        out.append(d)
    return out


class _Words:
    """Recognised words of a page, prepared once for all that is looked for."""

    def __init__(self, texts: list[str], x0: Sequence, y0: Sequence, x1: Sequence, y1: Sequence):
        self.edges = x0, y0, x1, y1
        trimmed = [t.strip(SPACES) for t in texts]
        self.at = [k for k, t in enumerate(trimmed) if t]
        self.kept = [t for t in trimmed if t]
        self.low = [t.lower() for t in self.kept]
        self.joined = " ".join(self.low)
        self.distinct: dict[str, list[int]] | None = None

    def _box(self, k: int) -> tuple[float, float, float, float]:
        x0, y0, x1, y1 = (e[self.at[k]] for e in self.edges)
        return x0, y0, x1 - x0, y1 - y0

    def _run(self, a: int, b: int) -> list[tuple[float, float, float, float]]:
        return _merged([self._box(k) for k in range(a, b)])

    def _equal(self, low: str) -> tuple[int, int] | None:
        """The first run of words that is the text."""
        if " " not in low:  # no run of two
            return (k, k + 1) if (k := next((k for k, t in enumerate(self.low) if t == low), -1)) >= 0 else None
        for a, first in enumerate(self.low):
            text, b = first, a + 1
            while len(text) < len(low) and b < len(self.low) and low.startswith(text):
                text, b = f"{text} {self.low[b]}", b + 1
            if text == low:
                return a, b
        return None

    def _near(self, part: str, most: int) -> dict[int, int]:
        """Distances of the words that are no further off than `most`, by place."""
        if self.distinct is None:
            self.distinct = {}
            for k, t in enumerate(self.low):
                self.distinct.setdefault(t, []).append(k)
            self.names = list(self.distinct)
            self.bits = np.array([_letters(t) for t in self.names], np.uint64)
            self.sizes = np.array([len(t) for t in self.names])
        bits = np.uint64(_letters(part))
        able = (np.abs(self.sizes - len(part)) <= most) & (np.bitwise_count(self.bits & ~bits) <= most) & (np.bitwise_count(bits & ~self.bits) <= most)
        names = [self.names[i] for i in np.flatnonzero(able).tolist()]
        return {k: d for t, d in zip(names, _distances(part, names), strict=True) if d <= most for k in self.distinct[t]}

    def boxes(self, needle: str) -> list[tuple[float, float, float, float]]:
        low = needle.lower().strip(SPACES)
        if not low or not self.kept:
            return []
        if low in self.joined:
            if run := self._equal(low):
                return self._run(*run)
            inside = [self._box(k) for k, t in enumerate(self.low) if low in t]
            if inside:
                return _merged(inside)
        parts = [w for w in _SPACE.split(low) if w]
        near = [self._near(p, max(2, math.ceil(len(p) * 0.3))) for p in parts]
        total = max(3, math.ceil(len(low) * 0.2))
        for a in sorted(near[0]):
            far = [n.get(a + k) for k, n in enumerate(near)]
            if None not in far and sum(far) <= total:
                return self._run(a, a + len(parts))
        if low in self.joined:
            for a in range(len(self.kept)):
                text = ""
                for b in range(a, min(a + 10, len(self.kept))):
                    text += (" " if b > a else "") + self.kept[b]
                    if low in text.lower():
                        return self._run(a, b + 1)
                    if len(text) > len(low) + 20:
                        break
        return []


def item_boxes(needle: str, items: list[dict], page_height: float) -> list[tuple[float, float, float, float]]:
    """Boxes, from the top left, of every place of a text in a page's items; parts of an item by its mean character width."""
    return _Items(*([i[c] for i in items] for c in ITEM)).boxes(needle, page_height)


def word_boxes(needle: str, words: list[dict]) -> list[tuple[float, float, float, float]]:
    """Boxes of a text among recognised words: equal runs, words that hold it, near runs, neighbours that hold it."""
    return _Words(*([w[c] for w in words] for c in WORD)).boxes(needle)


def is_scan(items: Column) -> Column:
    """Whether a page has no text items, so that its words come from recognition."""
    return F.coalesce(F.size(items), F.lit(0)) <= 0


def _structs(table: DataFrame, name: str, fields: dict[str, str]) -> Column:
    """A column of arrays of structs, with these fields alone."""
    kind = f"array<struct<{','.join(f'{c}:{t}' for c, t in fields.items())}>>"
    held = table.schema[name].dataType
    if held.simpleString() == kind or not isinstance(held, ArrayType):
        return F.col(name).cast(kind).alias(name)
    return F.transform(name, lambda i: F.struct(*[i[c].cast(t).alias(c) for c, t in fields.items()])).alias(name)


def _listed(column: pa.ListArray, names: Sequence[str]) -> Callable[[int], list | None]:
    """What gives the fields, by name, of the structs in a row: texts as lists, numbers as arrays; None for null."""
    starts, values, valid = column.offsets.to_numpy(), column.values, column.is_valid().to_numpy(zero_copy_only=False)
    fields = [values.field(c) for c in names]
    plain = [f if pa.types.is_string(f.type) or pa.types.is_large_string(f.type) else f.to_numpy(zero_copy_only=False) for f in fields]

    def row(r: int) -> list | None:
        a, b = int(starts[r]), int(starts[r + 1])
        return [f[a:b].to_numpy(zero_copy_only=False).tolist() if isinstance(f, pa.Array) else f[a:b] for f in plain] if valid[r] else None

    return row


def overlays(entities: DataFrame, pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, page_index, entity_id, boxes) of entities (doc_id, entity_id, start_pos, end_pos, text) on pages.

    pages: doc_id, page_index, height, text_start, text_end, items, words. A page without items is a scan: all entities
    of its document are looked for among its words; other pages take the entities that overlap them. Pages meet lists of
    up to BLOCK entities, so that what a page holds is not repeated for each. Where both tables are dealt by doc_id
    already, nothing is dealt anew.
    """
    kinds = {"doc": pages.schema[doc_id].dataType, "page": pages.schema["page_index"].dataType, "entity": entities.schema["entity_id"].dataType}
    out = StructType([StructField(doc_id, kinds["doc"]), StructField("page_index", kinds["page"]), StructField("entity_id", kinds["entity"]), StructField("boxes", ArrayType(StructType([StructField(c, DoubleType()) for c in ("x", "y", "width", "height")])))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, words, asked = (batch.column(c) for c in ("items", "words", "asked"))
            item, word, text = _listed(items, ITEM), _listed(words, WORD), _listed(asked, ["text"])
            heights, starts = batch.column("height").to_pylist(), asked.offsets.to_numpy().tolist()
            rows, at, sizes, flat = [], [], [0], []
            for r in range(batch.num_rows):
                given = item(r)
                on_items = bool(given and given[0])
                page = _Items(*given) if on_items else _Words(*(word(r) or [[]] * len(WORD)))
                for k, t in enumerate(text(r)[0]):
                    found = page.boxes(t or "", heights[r]) if on_items else page.boxes(t or "")
                    if found:
                        rows.append(r)
                        at.append(starts[r] + k)
                        flat += found
                        sizes.append(len(flat))
            values = np.array(flat, np.float64).reshape(-1, 4)
            boxes = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(4)], ["x", "y", "width", "height"]))
            ids = asked.values.field("entity_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in (doc_id, "page_index")), ids, boxes], names=out.names)

    listed = entities.groupBy(doc_id).agg(F.collect_list(F.struct("entity_id", "start_pos", "end_pos", "text")).alias("all"))
    slices = F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(BLOCK)), lambda a: F.slice(F.col("all"), a, BLOCK))
    blocks = listed.select(doc_id, F.explode(slices).alias("block"))
    own = pages.select(doc_id, "page_index", F.col("height").cast("double").alias("height"), "text_start", "text_end", _structs(pages, "items", ITEM), _structs(pages, "words", WORD))
    on = own.join(blocks.hint("shuffle_hash"), doc_id)
    within = F.filter("block", lambda e: is_scan(F.col("items")) | ((e["start_pos"] < F.col("text_end")) & (e["end_pos"] > F.col("text_start"))))
    on = on.withColumn("asked", F.transform(within, lambda e: F.struct(e["entity_id"].alias("entity_id"), e["text"].alias("text")))).where(F.size("asked") > 0)
    return on.select(doc_id, "page_index", "height", "items", "words", "asked").mapInArrow(find, out)


def page_boxes(over: DataFrame, accepted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, page_index, boxes): all boxes of the accepted entities of each page."""
    kept = over.join(accepted.where("accepted").select(doc_id, "entity_id"), [doc_id, "entity_id"], "left_semi")
    return kept.groupBy(doc_id, "page_index").agg(merge_boxes(F.flatten(F.collect_list("boxes"))).alias("boxes"))


def unmapped(entities: DataFrame, over: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Entities for which no page has a box: they would stay visible."""
    return entities.join(over, [doc_id, "entity_id"], "left_anti")
