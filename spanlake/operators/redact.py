"""Redaction of accepted spans in a text, acceptance rules, and the segments of a reviewed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.text import let

BLOCK = "█"


def accepted(spans: Column, rules: Column | None = None) -> Column:
    """The spans to redact: by their own flag, or by a map of category to flag, where absent ones count as accepted."""
    return F.filter(spans, (lambda e: e["accepted"]) if rules is None else lambda e: F.coalesce(rules[e["category"]], F.lit(True)))


def _replacement(e: Column, style: str) -> Column:
    return F.repeat(F.lit(BLOCK), F.length(e["text"])) if style == "blocks" else F.lit("[REDACTED]")


def unite(spans: Column) -> Column:
    """Overlapping spans as one, so that no half of an entity is left over; input sorted by start."""
    kind = "struct<start_pos:int,end_pos:int,text:string>"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        one = F.struct(x["start_pos"].cast("int").alias("start_pos"), x["end_pos"].cast("int").alias("end_pos"), x["text"].alias("text"))
        end = F.greatest(last["end_pos"], one["end_pos"])
        wide = F.struct(last["start_pos"].alias("start_pos"), end.alias("end_pos"), F.repeat(F.lit(BLOCK), end - last["start_pos"]).alias("text"))
        return F.when(one["start_pos"] < last["end_pos"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wide))).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(spans, F.array().cast(f"array<{kind}>"), step)


def redact(text: Column, spans: Column, style: str = "text", mode: str = "safe") -> Column:
    """text with each span replaced.

    mode safe: overlapping spans are united first. mode compat: spans are spliced one by one from the last start to the
    first, equal starts in their order, so that overlapping spans cut into what earlier ones left.
    """
    if mode == "compat":
        ordered = F.array_sort(F.transform(spans, lambda e, i: F.struct((-e["start_pos"]).alias("k"), i.alias("i"), e.alias("e"))))
        return F.aggregate(ordered, text, lambda acc, x: F.concat(F.substring(acc, F.lit(1), x["e"]["start_pos"]), _replacement(x["e"], style), F.substring(acc, x["e"]["end_pos"] + 1, F.length(acc))))
    spans = F.array_sort(F.transform(spans, lambda e: F.struct(e["start_pos"].alias("start_pos"), e["end_pos"].alias("end_pos"), e["text"].alias("text"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(x["end_pos"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start_pos"] - acc["at"]), _replacement(x, style)).alias("out"))

    return let(F.aggregate(unite(spans), first, step), lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def segments(text: Column, spans: Column) -> Column:
    """The text as an array of (text, category), category null between the spans, which come sorted by start."""
    kind = "struct<text:string,category:string>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    plain = F.lit(None).cast("string")

    def part(a: Column, b: Column, category: Column) -> Column:
        return F.array(F.struct(F.substring(text, a + 1, b - a).alias("text"), category.alias("category")))

    def step(acc: Column, x: Column) -> Column:
        own = part(x["start_pos"], x["end_pos"], x["category"])
        gap = F.when(x["start_pos"] > acc["at"], part(acc["at"], x["start_pos"], plain)).otherwise(F.array().cast(f"array<{kind}>"))
        return F.struct(x["end_pos"].cast("int").alias("at"), F.concat(acc["out"], gap, own).alias("out"))

    def close(done: Column) -> Column:
        return F.when(done["at"] < F.length(text), F.concat(done["out"], part(done["at"], F.length(text).cast("int"), plain))).otherwise(done["out"])

    return let(F.aggregate(spans, first, step), close)
