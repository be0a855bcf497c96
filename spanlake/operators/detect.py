"""Detection by pattern: all matches with offsets, in one narrow stage without Python.

Entities are kept in the document's row as an array of structs whose field order is the sort order: start, pattern. The
later of two overlapping matches goes, by a fold that remembers the end of the last match kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.patterns import PATTERNS, java
from spanlake.functions.text import let

ENTITY = "struct<start_pos:int,pattern:int,end_pos:int,category:string,text:string>"
#: Matches that a fold appends to one array; longer lists are folded block by block, so that cost is in proportion.
BLOCK = 256


def _blocks(items: Column) -> Column:
    last = F.greatest(F.lit(0), F.ceil(F.size(items) / F.lit(BLOCK)) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def pattern_matches(text: Column, index: int) -> Column:
    """Array of all matches of one pattern, left to right; a text without one costs a single scan."""
    category, flags, source = PATTERNS[index]
    regex = java(source, flags)
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    empty = F.lit(None).cast(f"array<{ENTITY}>")
    first = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast(f"array<{ENTITY}>")).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = (acc["at"] + F.length(pair["gap"])).cast("int")
        end = (start + F.length(pair["hit"])).cast("int")
        one = F.struct(start.alias("start_pos"), F.lit(index).alias("pattern"), end.alias("end_pos"), F.lit(category).alias("category"), pair["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def shifted(e: Column, by: Column) -> Column:
        return F.struct((e["start_pos"] + by).alias("start_pos"), e["pattern"].alias("pattern"), (e["end_pos"] + by).alias("end_pos"), e["category"].alias("category"), e["text"].alias("text"))

    def append(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda e: shifted(e, acc["at"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["outs"], F.array(moved)).alias("outs"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{ENTITY}>>").alias("outs"))
    matches = let(pairs, lambda p: F.flatten(F.aggregate(F.transform(_blocks(p), lambda b: F.aggregate(b, first, step)), whole, append)["outs"]))
    able = {"EMAIL": text.contains("@")}.get(category, text.rlike("[0-9]"))
    return F.when(able & text.rlike(regex), matches).otherwise(F.array().cast(f"array<{ENTITY}>"))


def candidates(text: Column) -> Column:
    """Matches of all patterns in the order start, pattern."""
    return F.array_sort(F.concat(*[pattern_matches(text, i) for i in range(len(PATTERNS))]))


def keep_first(sorted_spans: Column, kind: str = ENTITY) -> Column:
    """Greedy removal of overlaps: a span stays if it starts at or after the end of the last that stayed."""
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        more = F.struct(x["end_pos"].alias("end"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.when(x["start_pos"] >= acc["end"], more).otherwise(acc)

    def append(acc: Column, block: Column) -> Column:
        kept = F.aggregate(block, F.struct(acc["end"].alias("end"), none.alias("out")), step)
        return let(kept, lambda k: F.struct(k["end"].alias("end"), F.concat(acc["outs"], F.array(k["out"])).alias("outs")))

    whole = F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
    return let(sorted_spans, lambda s: F.flatten(F.aggregate(_blocks(s), whole, append)["outs"]))


def entities(text: Column) -> Column:
    """Entities of a text; null and empty texts have none."""
    return F.when(text.rlike("[0-9@]"), keep_first(candidates(text))).otherwise(F.array().cast(f"array<{ENTITY}>"))


def detect(docs: DataFrame, text: str = "text", out: str = "entities") -> DataFrame:
    """docs with an array of entities."""
    return docs.withColumn(out, entities(F.col(text)))


def explode_entities(docs: DataFrame, doc_id: str, column: str = "entities") -> DataFrame:
    """A row for each entity, with ordinal, source, confidence, acceptance and a key that any run gives alike."""
    # The outer form: Spark would else look for empty arrays first, and detect everything twice.
    rows = docs.select(F.col(doc_id), F.posexplode_outer(column).alias("ord", "e")).where("e is not null")
    return rows.select(
        doc_id,
        "ord",
        F.col("e.start_pos").alias("start_pos"),
        F.col("e.end_pos").alias("end_pos"),
        F.col("e.category").alias("category"),
        F.col("e.text").alias("text"),
        F.lit("regex").alias("source"),
        F.lit(1.0).alias("confidence"),
        F.lit(True).alias("accepted"),
        F.concat_ws("-", F.col(doc_id), F.col("e.start_pos"), F.col("e.end_pos"), F.col("e.category")).alias("entity_id"),
    )
