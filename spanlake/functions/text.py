"""Column functions with the exact semantics that the detection and report operators need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.patterns import CATEGORIES, MODEL_TYPES, SPACE_JAVA, SPACES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def normalize_spaces(c: Column) -> Column:
    """Runs of white space as one space, trimmed, in lower case."""
    return F.lower(trim(F.regexp_replace(c, f"[{SPACE_JAVA}]+", " ")))


def item_key(c: Column) -> Column:
    return trim(F.lower(c))


def round_half_up(c: Column, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, over doubles."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def repair_spaced_capitals(c: Column) -> Column:
    """Four or more capitals, each a space apart, become a word: C A R D becomes CARD."""
    spaced = r"(?<![A-Za-z])[A-Z] (?:[A-Z] ){2,}[A-Z](?![A-Za-z])"
    gaps, found = F.split(c, spaced, -1), F.regexp_extract_all(c, F.lit(spaced), F.lit(0))
    joined = F.zip_with(gaps, F.transform(found, lambda m: F.replace(m, F.lit(" "), F.lit(""))), lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit(""))))
    return F.when(F.size(found) == 0, c).otherwise(F.array_join(joined, ""))


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code point offset in UTF-16 units."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), offset), "UTF-16BE")) / 2).cast("int")


def category_label(c: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in CATEGORIES for x in pair])
    return F.coalesce(labels[c], c)


def model_category(c: Column) -> Column:
    """The category of a model's type, null where it is unknown."""
    known = F.create_map(*[F.lit(x) for pair in MODEL_TYPES.items() for x in pair])
    return known[trim(F.upper(c))]


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def utc_clock(time: Column) -> Column:
    """A moment as date and time of day in UTC, whatever the session's zone; years beyond 9999 have no plus, those below 0 no zeros."""
    seconds = F.unix_seconds(time)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    date = F.regexp_replace(day.cast("string"), r"^\+|(?<=^-)0+", "")
    return F.concat(date, F.lit(" "), F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60))


def duration(ms: Column) -> Column:
    whole = F.floor(ms + F.lit(0.5)).cast("string")
    return F.when(ms < 100, F.concat(whole, F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", ms / F.lit(1000.0)), F.lit("s")))


def output_name(name: Column, kind: str) -> Column:
    """Name of the redacted pdf, the redacted text or the report that goes with a file."""
    ending, default = {"pdf": ("_redacted.pdf", "redacted.pdf"), "text": ("_redacted.txt", "redacted.txt"), "report": ("_redaction_report.txt", "redaction_report.txt")}[kind]
    return F.coalesce(F.regexp_replace(name, r"(?i)\.pdf$", ending), F.lit(default))


def pad_end(c: Column, width: int) -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def pad_start(c: Column, width: int) -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, " "))
