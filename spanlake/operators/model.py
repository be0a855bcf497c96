"""Detection by a model: overlapping chunks, answers from a pluggable backend, parsing, and location in the whole text."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from spanlake.functions.patterns import MODEL_TYPES

#: Characters of a chunk and of what two neighbours share.
CHUNK, OVERLAP = 1500, 200
INSTRUCTION = 'List the personal data in the text as a JSON array of {"type", "text"} objects. Types: PERSON, ORGANIZATION, LOCATION, ADDRESS, ACCOUNT_NUMBER. Copy each text exactly; answer with the array only.'

_WS = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACE = re.compile(f"[{_WS}]+")
_WORD = re.compile(f"[^{_WS}]+")
_EDGES = re.compile(f"^[{_WS}]+|[{_WS}]+$")


class Backend(Protocol):
    """Answers prompts, a batch at a time. It is made once in each Python worker by open()."""

    def open(self) -> None: ...

    def answer(self, system: str, prompts: list[str]) -> list[str]: ...


class FirstWords:
    """A stand-in for tests: names the first words of each chunk as a person."""

    def __init__(self, n: int = 2):
        self.n = n

    def open(self) -> None:
        pass

    def answer(self, system: str, prompts: list[str]) -> list[str]:
        return [json.dumps([{"type": "PERSON", "text": " ".join(p.split("\n\n", 1)[1].split()[: self.n])}]) for p in prompts]


def cut(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(offset, length) of the chunks: each ends after the last sentence end or else space of its second half."""
    out, pos, n = [], 0, len(text)
    while pos < n:
        if pos + size >= n:
            out.append((pos, n - pos))
            break
        low = pos + size // 2
        end = max(text.rfind(c, low, pos + size) for c in "\n.!?")
        if end < 0:
            end = text.rfind(" ", low, pos + size)
        step = end + 1 - pos if end >= 0 else size
        out.append((pos, step))
        pos += max(step - overlap, step // 2)
    return out


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a row for each chunk: idx, offset, chunk; texts without characters have none."""

    @F.pandas_udf("array<struct<offset:int,len:int>>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"offset": a, "len": n} for a, n in cut(t or "")])

    rows = docs.select("*", F.posexplode(parts(F.col(text))).alias("idx", "__c"))
    return rows.withColumn("offset", F.col("__c.offset")).withColumn("chunk", F.substring(F.col(text), F.col("offset") + 1, F.col("__c.len"))).drop("__c")


def prompt(chunk: Column) -> Column:
    return F.concat(F.lit("Find the personal data in this text:\n\n"), chunk)


class Constant:
    """A stand-in for tests: names one and the same text in each chunk."""

    def __init__(self, text: str, kind: str = "PERSON"):
        self.reply = json.dumps([{"type": kind, "text": text}])

    def open(self) -> None:
        pass

    def answer(self, system: str, prompts: list[str]) -> list[str]:
        return [self.reply] * len(prompts)


def infer(rows: DataFrame, backend: Backend, chunk: str = "chunk", timed: bool = False) -> DataFrame:
    """rows with raw_response, the backend's answer to each chunk, and, if timed, ms: the share of its batch's time."""
    source = rows.withColumn("__prompt", prompt(F.col(chunk)))
    schema = StructType([*rows.schema.fields, StructField("raw_response", StringType()), *[StructField("ms", DoubleType())] * timed])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend.open()
        for b in batches:
            began = time.perf_counter()
            b["raw_response"] = backend.answer(INSTRUCTION, b["__prompt"].tolist()) if len(b) else []
            if timed:
                b["ms"] = (time.perf_counter() - began) * 1000 / max(1, len(b))
            yield b.drop(columns="__prompt")

    return source.mapInPandas(run, schema)


def parse(raw: str | None) -> list[dict[str, str]]:
    """Valid items of an answer: thoughts and fences go, the outermost array is taken, trailing commas are mended."""
    text = re.sub(r"<think>[\s\S]*?</think>", "", _EDGES.sub("", raw or ""), flags=re.I)
    text = re.sub(rf"^```(?:json)?[{_WS}]*\n?", "", _EDGES.sub("", text), flags=re.I)
    text = _EDGES.sub("", re.sub(rf"\n?```[{_WS}]*$", "", text))
    a, z = text.find("["), text.rfind("]")
    if a < 0 or z <= a:
        return []
    try:
        found = json.loads(re.sub(rf",[{_WS}]*\]", "]", text[a : z + 1]), parse_constant=_refuse)
    except ValueError:
        return []
    return [{"type": x["type"], "text": x["text"]} for x in found if isinstance(x, dict) and isinstance(x.get("type"), str) and isinstance(x.get("text"), str) and len(x["text"]) > 1]


def _refuse(name: str):
    raise ValueError(name)


_ITEMS = ArrayType(StructType([StructField("type", StringType()), StructField("text", StringType())]))


def parse_response(raw: Column) -> Column:
    @F.pandas_udf(_ITEMS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(parse)

    return run(raw)


def category_of(kind: str) -> str | None:
    return MODEL_TYPES.get(_EDGES.sub("", kind.upper()))


@lru_cache(1 << 16)
def distance(a: str, b: str) -> int:
    """Edit distance with unit costs."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(last, row[j], row[j - 1])
    return row[-1]


def distances(a: Column, b: Column) -> Column:
    """distance() as a column."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else distance(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def word_limit(word: Column, share: float) -> Column:
    return F.greatest(F.lit(2), F.ceil(F.length(word) * F.lit(share)))


def _all(text: str, needle: str) -> Iterator[int]:
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + 1)


def locate(needle: str, text: str, taken: set[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, exact) of a model's text in the source, ranges already taken left out.

    As it stands, at every place; else in any case and spacing; else, for four characters or more, the first run of
    words that is close word by word, but not equal.
    """
    plain = _EDGES.sub("", _SPACE.sub(" ", needle)).lower()
    if not plain:
        return []
    found = [(a, a + len(needle), True) for a in _all(text, needle) if (a, a + len(needle)) not in taken]
    if found:
        return found
    words, low = plain.split(" "), text.lower()
    loose = re.compile(rf"[{_WS}]*".join(map(re.escape, words)))
    for a in _all(low, words[0]):
        m = loose.match(low, a)
        if m and (a, m.end()) not in taken:
            found.append((a, m.end(), False))
    if found or len(plain) < 4:
        return found
    source = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    limits = [max(2, math.ceil(len(w) * 0.25)) for w in words]
    for i in range(len(source) - len(words) + 1):
        total = 0
        for (s, _, _), w, most in zip(source[i : i + len(words)], words, limits, strict=True):
            d = most + 1 if abs(len(s) - len(w)) > most else distance(s, w)
            if d > most:
                break
            total += d
        else:
            span = (source[i][1], source[i + len(words) - 1][2])
            if total and span not in taken:
                return [(*span, False)]
    return []


def place(text: str, answers: list[list[dict[str, str]]], mode: str = "strict") -> list[dict]:
    """Entities of one text from its chunks' items in order, sorted by start.

    mode strict: ranges found for earlier items are taken for later ones, which may then match looser. mode fast: each
    distinct item is located by itself, and equal ranges count once.
    """
    taken: set[tuple[int, int]] = set()
    out, seen = [], set()
    for items in answers:
        for x in items:
            category = category_of(x["type"])
            if category is None or mode == "fast" and (category, x["text"]) in seen:
                continue
            seen.add((category, x["text"]))
            for a, b, exact in locate(x["text"], text, taken if mode == "strict" else set()):
                if (a, b) in taken:
                    continue
                taken.add((a, b))
                out.append({"start_pos": a, "end_pos": b, "category": category, "text": x["text"], "confidence": 0.95 if exact else 0.8})
    return sorted(out, key=lambda e: e["start_pos"])


def detect(docs: DataFrame, backend: Backend, doc_id: str = "doc_id", text: str = "text", mode: str = "strict") -> DataFrame:
    """(doc_id, entity columns) of a model's entities; chunks are answered in parallel, each text is located in one call."""
    answered = infer(chunks(docs.select(doc_id, text), text).drop(text), backend)
    answers = answered.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("idx", "raw_response"))).alias("__a"))
    kind = "array<struct<start_pos:int,end_pos:int,category:string,text:string,confidence:double>>"

    @F.pandas_udf(kind)
    def run(texts: pd.Series, raws: pd.Series) -> pd.Series:
        return pd.Series([place(t or "", [parse(r["raw_response"]) for r in a], mode) for t, a in zip(texts, raws, strict=True)])

    rows = docs.select(doc_id, text).join(answers, doc_id).select(doc_id, F.explode(run(F.col(text), F.col("__a"))).alias("e"))
    return rows.select(doc_id, "e.*")
