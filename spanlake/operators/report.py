"""Report aggregates over entity rows (category, text, source, accepted, confidence, ord, entity_id) and a rendered report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import category_label, item_key, pad_end, pad_start


def _count(c: Column | str) -> Column:
    return F.count_if(F.col(c) if isinstance(c, str) else c)


def summary(entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Found, redacted and kept entities, and the redacted ones by source."""
    return entities.groupBy(*(by or [])).agg(
        F.count("*").alias("found"),
        _count("accepted").alias("redacted"),
        _count(~F.col("accepted")).alias("kept"),
        _count(F.col("accepted") & (F.col("source") == "regex")).alias("by_regex"),
        _count(F.col("accepted") & (F.col("source") == "ner")).alias("by_model"),
    )


def by_category(entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    return entities.groupBy(*(by or []), "category").agg(F.count("*").alias("found"), _count("accepted").alias("redacted"))


def items(entities: DataFrame, by: list[str]) -> DataFrame:
    """Distinct items, redacted and kept apart, with the text of the first and their number."""
    return entities.groupBy(*by, "category", "accepted", item_key(F.col("text")).alias("item")).agg(F.min_by("text", "ord").alias("text"), F.count("*").alias("n"))


def groups(entities: DataFrame, by: list[str]) -> DataFrame:
    """Equal texts of a category as one reviewable group."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "entity_id"))), lambda x: x["entity_id"])
    return entities.groupBy(*by, "category", item_key(F.col("text")).alias("item")).agg(
        F.min_by("text", "ord").alias("text"),
        ids.alias("ids"),
        F.every("accepted").alias("all_accepted"),
        F.every(~F.col("accepted")).alias("none_accepted"),
        F.min_by("entity_id", "ord").alias("first_id"),
        F.min("confidence").alias("confidence"),
    )


def category_groups(entities: DataFrame, by: list[str]) -> DataFrame:
    """Distinct and all entities of each category, and whether all, none or some are accepted."""
    state = F.when(F.every("accepted"), "all").when(F.every(~F.col("accepted")), "none").otherwise("mixed")
    return entities.groupBy(*by, "category").agg(F.count_distinct(item_key(F.col("text"))).alias("n_unique"), F.count("*").alias("n_total"), state.alias("state"))


def rollup(entities: DataFrame) -> DataFrame:
    """Accepted entities by category and source with subtotals: an extension for corpora."""
    return entities.where("accepted").rollup("category", "source").agg(F.count("*").alias("n"))


def scan_metrics(docs: DataFrame, entities: str = "entities", text: str = "text") -> DataFrame:
    """One row: documents, characters, documents with entities, and entities."""
    return docs.agg(F.count("*").alias("documents"), F.sum(F.length(text)).alias("characters"), F.count_if(F.size(entities) > 0).alias("with_entities"), F.sum(F.size(entities)).alias("entities"))


def queue_state(queue: DataFrame) -> DataFrame:
    """Progress of files (idx, status): done, share finished, whether all are, and the next pending index."""
    finished = F.col("status").isin("done", "skipped")
    return queue.agg(F.count_if(F.col("status") == "done").alias("done"), (F.count_if(finished) / F.count("*")).alias("share"), F.every(finished).alias("complete"), F.min(F.when(F.col("status") == "pending", F.col("idx"))).alias("next_idx"))


# Per cent at which each phase of a file stands, and what its share adds.
PHASES = {"parse": (10, 0), "engine": (15, 0), "detect": (20, 0), "recognise": (25, 15), "model": (20, 30), "infer": (50, 30), "review": (80, 0), "redact": (85, 0), "done": (100, 0)}


def progress(phase: Column, share: Column) -> Column:
    """Per cent of a file's way, from its phase and the share (0 to 1) of the phase that is done; 0 for other phases."""
    out = F.lit(0)
    for name, (start, more) in PHASES.items():
        out = F.when(phase == name, F.lit(start) + F.floor(F.coalesce(share, F.lit(0.0)) * more + 0.5)).otherwise(out)
    return out.cast("int")


def sample_words(words: Column, n: int = 20) -> Column:
    """The texts of the first words of a page, for a log line about a page on which nothing was found."""
    return F.transform(F.slice(words, 1, n), lambda w: w["text"])


def render(entities: DataFrame, doc_id: str, clock: Column, name: Column | None = None) -> DataFrame:
    """(doc_id, report): the report of each document as text. Categories and items are in the order they are first seen."""
    found = by_category(entities, [doc_id]).join(entities.groupBy(doc_id, "category").agg(F.min("ord").alias("first")), [doc_id, "category"])
    label = category_label(F.col("category"))
    rows = found.withColumn("line", F.concat(pad_end(label, 16), F.lit(" found: "), pad_start(F.col("found").cast("string"), 3), F.lit("   redacted: "), pad_start(F.col("redacted").cast("string"), 3)))
    lists = entities.groupBy(doc_id, "category", "accepted", item_key(F.col("text")).alias("item")).agg(F.min_by("text", "ord").alias("text"), F.min("ord").alias("first"), F.count("*").alias("n"))
    lists = lists.withColumn("line", F.concat(F.lit("  - "), F.when(F.col("accepted"), F.lit("")).otherwise(F.concat(F.lit("["), label, F.lit("] "))), F.col("text"), F.when(F.col("accepted") & (F.col("n") > 1), F.concat(F.lit(" (x"), F.col("n"), F.lit(")"))).otherwise("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "line"))), lambda x: x["line"])
    kept = lists.where("not accepted").groupBy(doc_id).agg(ordered.alias("kept_lines"))
    gone = lists.where("accepted").groupBy(doc_id, "category").agg(ordered.alias("lines")).join(found.select(doc_id, "category", "first"), [doc_id, "category"])
    gone = gone.groupBy(doc_id).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat(F.array(F.concat(F.lit("["), label, F.lit("]"))), "lines").alias("lines")))), lambda x: x["lines"])).alias("gone_lines"))
    out = summary(entities, [doc_id]).join(rows.groupBy(doc_id).agg(ordered.alias("category_lines")), doc_id).join(gone, doc_id, "left").join(kept, doc_id, "left")
    none = F.array().cast("array<string>")

    def titled(title: str, lines: Column) -> Column:
        return F.concat(F.array(F.lit(title), F.lit("-" * len(title))), lines, F.array(F.lit("")))

    head = F.array(F.lit("PERSONAL DATA REPORT"), F.lit("=" * 20), *([F.concat(F.lit("File: "), name)] if name is not None else []), F.concat(F.lit("Date: "), clock, F.lit(" UTC")), F.lit(""))
    totals = F.array(*[F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in (("Found", "found"), ("Redacted", "redacted"), ("Kept", "kept"), ("By pattern", "by_regex"), ("By model", "by_model"))])
    lines = F.concat(
        head,
        titled("SUMMARY", totals),
        titled("BY CATEGORY", F.col("category_lines")),
        titled("REDACTED", F.coalesce("gone_lines", none)),
        F.when(F.col("kept") > 0, titled("KEPT", F.coalesce("kept_lines", none))).otherwise(none),
        F.array(F.lit("--- end ---")),
    )
    return out.select(doc_id, F.array_join(lines, "\n").alias("report"))
