"""Arrow functions by name, for use in SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanlake.operators import geometry as G
from spanlake.operators import model as L

_SPAN = "array<struct<start_pos:int,end_pos:int,exact:boolean>>"


def _boxes(found: list[tuple[float, float, float, float]]) -> list[dict]:
    return [dict(zip(("x", "y", "width", "height"), map(float, b), strict=True)) for b in found]


def _rows(values) -> list[dict]:
    return list(values) if values is not None else []


def register(spark: SparkSession) -> list[str]:
    """Register chunk_text(text), locate_spans(needle, text), item_boxes(needle, items, height) and word_boxes(needle, words).

    Null arguments count as empty. Returns the names.
    """

    @F.pandas_udf("array<struct<offset:int,len:int>>")
    def chunk_text(text: pd.Series) -> pd.Series:
        return pd.Series([[{"offset": a, "len": n} for a, n in L.cut(t or "")] for t in text], dtype=object)

    @F.pandas_udf(_SPAN)
    def locate_spans(needle: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([[{"start_pos": a, "end_pos": b, "exact": exact} for a, b, exact in L.locate(n or "", t or "", set())] for n, t in zip(needle, text, strict=True)], dtype=object)

    @F.pandas_udf(f"array<{G.BOX}>")
    def item_boxes(needle: pd.Series, items: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([_boxes(G.item_boxes(n or "", _rows(i), h)) for n, i, h in zip(needle, items, height, strict=True)], dtype=object)

    @F.pandas_udf(f"array<{G.BOX}>")
    def word_boxes(needle: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([_boxes(G.word_boxes(n or "", _rows(w))) for n, w in zip(needle, words, strict=True)], dtype=object)

    made = {"chunk_text": chunk_text, "locate_spans": locate_spans, "item_boxes": item_boxes, "word_boxes": word_boxes}
    for name, function in made.items():
        spark.udf.register(name, function)
    return list(made)
