"""Page text from positioned items, page offsets, text quality, and entities on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import let, repair_spaced_capitals, round_half_up, trim

#: Score below which a page is sent to recognition.
THRESHOLD = 0.3


def _join_items(items: Column) -> Column:
    """Text of items in order: a new line where the line changes, a space where the gap is wide."""
    kind = "struct<text:string,x:double,y:double,h:double,w:double,s:string,any:boolean>"
    first = F.struct(F.lit("").alias("text"), *[F.lit(0.0).alias(c) for c in "xyhw"], F.lit("").alias("s"), F.lit(False).alias("any")).cast(kind)

    def step(acc: Column, i: Column) -> Column:
        height = F.when(F.abs(acc["h"]) > 0, F.abs(acc["h"])).otherwise(12.0)
        width = F.when(F.length(acc["s"]) > 0, acc["w"] / F.length(acc["s"])).otherwise(height * 0.5)
        gap = i["x"] - (acc["x"] + acc["w"])
        apart = (gap > width * 1.5) & ~acc["s"].endswith(" ") & ~i["str"].startswith(" ")
        between = F.when(~acc["any"] | acc["text"].endswith("\n"), "").when(F.abs(i["y"] - acc["y"]) > height * 0.5, "\n").when(apart, " ").otherwise("")
        text = F.concat(acc["text"], between, i["str"], F.when(i["has_eol"], "\n").otherwise(""))
        return F.struct(text.alias("text"), i["x"].alias("x"), i["y"].alias("y"), i["font_h"].alias("h"), i["width"].alias("w"), i["str"].alias("s"), F.lit(True).alias("any")).cast(kind)

    return trim(F.regexp_replace(F.aggregate(items, first, step)["text"], "\n{3,}", "\n\n"))


def page_text(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) from rows (keys, item_idx, str, x, y, font_h, width, has_eol); items without a string are left out."""
    fields = [F.col("item_idx"), F.col("str"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "font_h", "width")], F.coalesce("has_eol", F.lit(False)).alias("has_eol")]
    listed = items.where("str is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    return listed.select(*keys, repair_spaced_capitals(_join_items(F.col("items"))).alias("text"))


def page_offsets(pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """pages with text_start and text_end in the document's text, where pages are joined by an empty line."""
    before = Window.partitionBy(doc_id).orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return pages.withColumn("text_start", start).withColumn("text_end", F.col("text_start") + F.length("text"))


def document_text(pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda p: p["text"])
    return pages.groupBy(doc_id).agg(F.array_join(texts, "\n\n").alias("text"))


def page_slice(text: Column, start: Column, end: Column) -> Column:
    """The part of a document's text that a page takes."""
    return F.substring(text, start + 1, end - start)


def fuse(pages: DataFrame, recognised: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """pages with the recognised text where there is one, and offsets in the fused text."""
    seen = recognised.select(doc_id, "page_index", F.col("text").alias("__seen"))
    both = pages.join(seen, [doc_id, "page_index"], "left").withColumn("text", F.coalesce(F.nullif("__seen", F.lit("")), "text")).drop("__seen", "text_start", "text_end")
    return page_offsets(both, doc_id)


def page_quality(strings: Column, width: Column, height: Column) -> Column:
    """Struct of score (two decimals), needs_vision (by the exact score) and reason, from a page's item strings."""
    lengths = F.transform(strings, lambda s: F.length(trim(s)))
    zero = F.struct(*[F.lit(0).alias(k) for k in ("chars", "filled", "single")])
    counted = F.aggregate(lengths, zero, lambda a, n: F.struct((a["chars"] + n).alias("chars"), (a["filled"] + (n > 0).cast("int")).alias("filled"), (a["single"] + (n == 1).cast("int")).alias("single")))

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    def result(score: Column, needs: Column, reason: Column) -> Column:
        return F.struct(score.cast("double").alias("score"), needs.alias("needs_vision"), reason.cast("string").alias("reason"))

    def measure(n: Column) -> Column:
        ratio = n["single"] / F.nullif(n["filled"], F.lit(0))
        density = n["chars"] / (width * height / F.lit(1000.0))
        exact = clamp(F.lit(1.0) - (ratio - F.lit(0.2)) / F.lit(0.4)) * F.lit(0.6) + clamp((density - F.lit(0.5)) / F.lit(2.5)) * F.lit(0.4)
        return F.struct(n["chars"].alias("chars"), ratio.alias("ratio"), density.alias("density"), exact.alias("exact"))

    def judge(m: Column) -> Column:
        poor = m["exact"] < THRESHOLD
        why = (
            F.when(m["ratio"] > 0.6, F.concat(F.lit("Many single-character items ("), F.floor(m["ratio"] * 100 + 0.5).cast("string"), F.lit("%)")))
            .when(m["density"] < 0.5, "Sparse text, mostly images")
            .otherwise(F.concat(F.lit("Poor text (score "), F.format_string("%.2f", m["exact"]), F.lit(")")))
        )
        blank = result(F.lit(0.0), F.lit(True), F.lit("No readable text"))
        return F.when(m["chars"] == 0, blank).otherwise(result(round_half_up(m["exact"]), poor, F.when(poor, why)))

    none = result(F.lit(0.0), F.lit(True), F.lit("No text items, an image perhaps"))
    return F.when(F.size(strings) <= 0, none).otherwise(let(let(counted, measure), judge))


def document_quality(pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, needs_vision, pages): mean of the rounded page scores, and the pages to recognise, joined by commas."""
    bad = F.array_sort(F.collect_list(F.when(F.col("needs_vision"), F.col("page_index"))))
    return pages.groupBy(doc_id).agg(round_half_up(F.avg("score")).alias("score"), F.some("needs_vision").alias("needs_vision"), F.array_join(bad.cast("array<string>"), ",").alias("pages"))


def entities_on_pages(entities: DataFrame, pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Each entity with each page that it overlaps; the document is the join key, so documents stay together."""
    p = pages.select(doc_id, "page_index", "text_start", "text_end")
    return entities.join(p, doc_id).where("start_pos < text_end and end_pos > text_start")


def first_page(entities: DataFrame, pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return entities_on_pages(entities, pages, doc_id).groupBy(doc_id, "entity_id").agg(F.min("page_index").alias("page_index"))
