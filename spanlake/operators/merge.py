"""Pattern and model entities as one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.operators import detect as patterns
from spanlake.operators import model


def _plain(e: Column, source: str) -> Column:
    return F.struct(e["start_pos"].cast("int").alias("start_pos"), e["end_pos"].cast("int").alias("end_pos"), e["category"].alias("category"), e["text"].alias("text"), F.lit(source).alias("source"))


def merge(regex: Column, model: Column) -> Column:
    """Pattern spans and those model spans whose exact range no pattern has, sorted by start; patterns first on ties."""
    ranges = F.transform(regex, lambda e: F.struct(e["start_pos"].cast("int").alias("s"), e["end_pos"].cast("int").alias("e")))
    new = F.filter(model, lambda e: ~F.array_contains(ranges, F.struct(e["start_pos"].cast("int").alias("s"), e["end_pos"].cast("int").alias("e"))))
    both = F.concat(F.transform(regex, lambda e: _plain(e, "regex")), F.transform(new, lambda e: _plain(e, "ner")))
    keyed = F.transform(both, lambda e, i: F.struct(e["start_pos"].alias("k"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def detect_all(docs: DataFrame, backend: model.Backend | None = None, doc_id: str = "doc_id", text: str = "text", mode: str = "strict") -> DataFrame:
    """(doc_id, entities) of patterns and then, where there is a backend, of a model: without one, of patterns alone.

    doc_id tells the rows apart. Only ids and entities move to meet each other, no text.
    """
    found = patterns.detect(docs.select(doc_id, text), text).drop(text)
    if backend is None:
        return found.select(doc_id, merge(F.col("entities"), F.array().cast("array<struct<start_pos:int,end_pos:int,category:string,text:string>>")).alias("entities"))
    spans = F.struct("start_pos", "end_pos", "category", "text")
    more = model.detect(docs, backend, doc_id, text, mode).groupBy(doc_id).agg(F.array_sort(F.collect_list(spans)).alias("__model"))
    none = F.array().cast("array<struct<start_pos:int,end_pos:int,category:string,text:string>>")
    return found.join(more, doc_id, "left").select(doc_id, merge(F.col("entities"), F.coalesce("__model", none)).alias("entities"))
