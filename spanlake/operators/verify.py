"""Leak check: are strings that were redacted still in the output's bytes?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.text import let

def distinct_strings(strings: Column) -> Column:
    """Strings that differ in more than case, the first of each."""
    first = F.array().cast("array<struct<l:string,t:string>>")

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda a: a["l"] == F.lower(x)), acc).otherwise(F.concat(acc, F.array(F.struct(F.lower(x).alias("l"), x.alias("t")))))

    return F.transform(F.aggregate(strings, first, step), lambda a: a["t"])


def leaks(data: Column, strings: Column, utf8: bool = True) -> Column:
    """The first place of each string in the bytes: as it is, in any case, in UTF-16BE, and (an extension) in UTF-8.

    Bytes are taken as one character each, so that a place is a byte offset.
    """

    def search(s: Column, view: Column, low: Column) -> Column:
        # A byte view holds characters below 256; in UTF-16BE they stand as a zero byte and themselves.
        forms = [("exact", F.instr(view, s)), ("any case", F.instr(low, F.lower(s))), ("utf-16", F.instr(view, F.decode(F.encode(s, "UTF-16BE"), "ISO-8859-1")))]
        if utf8:
            forms += [("utf-8", F.instr(view, F.decode(F.encode(s, "UTF-8"), "ISO-8859-1"))), ("utf-8 any case", F.instr(low, F.lower(F.decode(F.encode(F.lower(s), "UTF-8"), "ISO-8859-1"))))]
        found = F.filter(F.array(*[F.struct(s.alias("text"), (at - 1).cast("int").alias("byte_offset"), F.lit(name).alias("form")) for name, at in forms]), lambda x: x["byte_offset"] >= 0)
        return F.slice(found, 1, 1)

    def scan(views: Column) -> Column:
        return F.flatten(F.transform(distinct_strings(strings), lambda s: search(s, views["view"], views["low"])))

    return let(let(F.decode(data, "ISO-8859-1"), lambda v: F.struct(v.alias("view"), F.lower(v).alias("low"))), scan)


def clean_metadata(columns: list[str]) -> list[Column]:
    """Blank descriptive metadata and epoch dates, for the columns that are there."""
    blank = {c: F.lit("").alias(c) for c in ("title", "author", "subject", "keywords", "creator")}
    dates = {c: F.lit(0).cast("timestamp").alias(c) for c in ("created", "modified")}
    return [(blank | dates | {"xmp": F.lit(None).cast("string").alias("xmp")}).get(c, F.col(c)) for c in columns]
