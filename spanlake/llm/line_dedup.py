"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling; later copies of repeated runs go.

Equal texts are one sequence; of their rows only those with the least id are not later copies as a whole. A round ranks
suffixes by their first 2h lines: the pairs of the rank at a line and the rank h lines on are sorted over all tasks, and
the place of a pair is the new rank. Suffixes alone at their rank are resolved and leave; the others at one rank are an
interval of the suffix array with a common prefix of 2h lines or more, and the least position of it is the first copy.
Only repeated suffixes move, so rounds shrink with depth. The overlapping intervals of 1, 2, 4, ... lines cover every
maximal repeated run, and a rule of length looks at the whole run.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from spanlake.llm._common import SpanHasher, add_columns, any_names, binary, checkpoint, pieces, released, table

#: Bytes of a whole run from which its later copies go; 0: all of them. Parts that the rows of a repeated text are dealt to.
MIN_BYTES, SALTS = 0, 16
_HASH = (SpanHasher(41), SpanHasher(42))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _says(line: bytes) -> bool:
    """Whether a letter, digit or mark is in the line."""
    return any(unicodedata.category(c)[0] in "LNM" for c in line.decode())


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs with the id (null: the least number) and a 128-bit key of the text; a null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), "__k1": F.xxhash64(body), "__k2": F.xxhash64(F.md5(body.cast("binary")), F.lit(1)), "__text": body})


def _lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, line, id, r1, r2): each line of each text that has a letter, digit or mark, numbered among those that are not blank, with the least id of the text and the line's 128-bit id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, offsets, _ = binary(batch.column(3))
            own_columns = [np.asarray(batch.column(k)) for k in range(3)]
            for i, j in pieces(np.diff(offsets)):
                own = offsets[i : j + 1]
                text, own = content[own[0] : own[-1]], own - own[0]
                if not len(text):
                    continue
                breaks = np.flatnonzero(text == 10)
                starts = np.unique(np.concatenate((breaks + 1, own[:-1])))
                starts = starts[starts < len(text)]
                doc = np.searchsorted(own, starts, "right") - 1
                stops = np.minimum(np.append(breaks, len(text))[np.searchsorted(breaks, starts)], own[doc + 1])
                solid = np.concatenate(([0], np.cumsum(~_BLANK[text], dtype=np.int32)))
                full = solid[stops] > solid[starts]
                starts, stops, doc = starts[full], stops[full], doc[full]
                first = np.searchsorted(doc, np.arange(j - i))
                line = np.arange(len(doc)) - first[doc]
                plain = np.concatenate(([0], np.cumsum(_PLAIN[text], dtype=np.int32)))
                says = plain[stops] > plain[starts]
                for k in np.flatnonzero(~says).tolist():
                    says[k] = _says(text[starts[k] : stops[k]].tobytes())
                starts, stops, doc, line = starts[says], stops[says], doc[says], line[says]
                cols = [*(c[i + doc] for c in own_columns), line, *(h(text, starts, stops).view(np.int64) for h in _HASH)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["k1", "k2", "id", "line", "r1", "r2"])

    rows = docs.select("__k1", "__k2", "__id", F.col("__text").cast("binary")).mapInArrow(released(run), "k1 long, k2 long, id long, line long, r1 long, r2 long")
    return rows.groupBy("k1", "k2", "line").agg(F.min("id").alias("id"), F.first("r1").alias("r1"), F.first("r2").alias("r2"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Suffixes that share a pair (r1, r2), with the pair's rank in the order of pairs and whether an earlier one has it (late)."""
    position = F.struct("id", "k1", "k2", "line")
    pairs = rows.groupBy("r1", "r2").agg(F.count("*").alias("c"), F.min(position).alias("f")).where("c > 1")
    # Parts hold ranges of pairs in order, so that numbers that rise with part and row are ranks.
    pairs = pairs.select("r1", "r2", "f").repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2")
    pairs = checkpoint(pairs.withColumn("rank", F.monotonically_increasing_id()))
    return rows.join(pairs.hint("merge"), ["r1", "r2"]).select("k1", "k2", "id", "line", "h", "rank", (position > F.col("f")).alias("late"))


def suffix_intervals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> list[DataFrame]:
    """For depths of 1, 2, 4, ... lines, the suffixes that share at least as many: (k1, k2, id, line, rank, late, h).

    (k1, k2) is the key of the text, id its least id, line the first line, h the depth; rows of one rank are an interval.
    late: an earlier position is in the interval, by id, key of the text and line.
    """
    levels = [checkpoint(_ranked(_lines(_keyed(docs, text, doc_id)).withColumn("h", F.lit(1).cast("long"))))]
    while not levels[-1].isEmpty():
        # The depth is a column, not a constant, so that all rounds share their compiled code.
        now = levels[-1]
        ahead = now.select("k1", "k2", (F.col("line") - F.col("h")).alias("line"), F.col("rank").alias("r2"))
        pairs = now.select("k1", "k2", "id", "line", F.col("rank").alias("r1"), (2 * F.col("h")).alias("h")).join(ahead, ["k1", "k2", "line"])
        levels.append(checkpoint(_ranked(pairs)))
    return levels[:-1]


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(k1, k2, id, first, gone): of each text with any, the blocks (line, lines) that also stand earlier, and its least id.

    Earlier is a smaller id, a smaller key of the text, or a smaller line of the same text. first, the least id, is there
    for texts that stand under several; gone is empty for texts without a block.
    """
    late = [x.where("late").select("k1", "k2", "id", F.struct("line", F.col("h").alias("lines")).alias("block")) for x in suffix_intervals(docs, text, doc_id)]
    copies = _keyed(docs, text, doc_id).groupBy(F.col("__k1").alias("k1"), F.col("__k2").alias("k2")).agg(F.min("__id").alias("first"), F.max("__id").alias("last"))
    every = copies.where("last > first").select("k1", "k2", F.col("first").alias("id"), "first", F.lit(None).cast("struct<line:long,lines:long>").alias("block"))
    for x in late:
        every = every.unionByName(x.withColumn("first", F.lit(None).cast("long")))
    return every.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("first").alias("first"), F.collect_list("block").alias("gone"))


@any_names
def remove_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs with the later copies of repeated line runs cut from the text, and n_lines, n_removed and removed_all.

    A run is as long as lines that stand earlier follow each other; min_bytes is of the whole run without line breaks.
    Lines without a letter, digit or mark are kept and stand in no run. A null or empty text has no lines. A null id
    counts as the smallest; rows with equal ids and texts are one document, not earlier than each other. Texts without a
    repeated run stay as they are to the byte; removed_all marks texts of which every line that is not blank went.
    Columns of docs that have the name of a new one give way.
    """
    order = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_all")]
    # Rows meet what is known of their text in a part that their id names, so that a text with very many copies is dealt
    # to SALTS tasks. Only the part of the least id needs the blocks.
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    gone = repeated_lines(docs, text, doc_id).withColumn("own", salt)
    gone = gone.withColumn("salt", F.explode(F.when(F.col("first").isNull(), F.array("own")).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    gone = gone.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("salt").alias("__salt"), F.col("first").alias("__first"), F.when(F.col("salt") == F.col("own"), F.col("gone")).alias("__gone"))
    rows = _keyed(docs.select(*[f"`{c}`" for c in order]), text, doc_id).drop("__text").withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
    joined = rows.join(gone.hint("merge"), ["__k1", "__k2", "__salt"], "left")
    joined = joined.withColumn("__copy", F.coalesce(F.col("__id") > F.col("__first"), F.lit(False))).drop("__id", "__k1", "__k2", "__salt", "__first")
    fields = [StructField(text, StringType()), StructField("n_lines", LongType(), False), StructField("n_removed", LongType(), False)]

    def work(cols):
        texts, n_lines, n_removed = [], [], []
        for t, blocks, copy in zip(cols[0], cols[1], cols[2].to_pylist(), strict=True):
            t = t.as_py()
            lines = (t or b"").split(b"\n")
            full = [i for i, x in enumerate(lines) if x.strip()]
            n_lines.append(len(full))
            blocks = blocks.as_py() or ()
            if not copy and not blocks:
                texts.append(None if t is None else t.decode())
                n_removed.append(0)
                continue
            out = np.zeros(len(full) + 1, np.int64)
            for b in blocks:
                out[b["line"]] += 1
                out[b["line"] + b["lines"]] -= 1
            late = np.array([_says(lines[x]) for x in full], bool) if copy else np.cumsum(out)[:-1] > 0
            cover = np.diff(np.concatenate(([0], late, [0])))
            runs = zip(np.flatnonzero(cover > 0).tolist(), np.flatnonzero(cover < 0).tolist(), strict=True)
            drop = {x for a, b in runs if sum(len(lines[x]) for x in full[a:b]) >= min_bytes for x in full[a:b]}
            texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop).decode())
            n_removed.append(len(drop))
        return [texts, n_lines, n_removed]

    out = add_columns(joined, [F.col(text).cast("binary"), F.col("__gone"), F.col("__copy")], fields, work).drop("__gone", "__copy")
    return out.select(*[f"`{c}`" for c in order], "n_lines", "n_removed").withColumn("removed_all", (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "removed_all", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, i, ls[i] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM doc)),
told AS (SELECT doc_id, i, l, regexp_matches(l, '[^\x20\x09-\x0D]') AS solid, regexp_matches(l, '[\p{L}\p{N}\p{M}]') AND row_number() OVER (PARTITION BY l ORDER BY doc_id, i) > 1 AS gone FROM line),
per AS (SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM told GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, n_removed > 0 AND n_removed = n_lines AS removed_all, sha256(kept) AS kept_sha256
FROM per
"""
