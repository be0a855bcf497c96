"""A cleaning pipeline over documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import decontaminate, line_dedup, near_dedup, sampled_pieces, toxicity
from spanlake.llm._common import free_prefix, table
from spanlake.sources.shared import shared_folder

#: The part of a document's words in benchmark windows above which the document goes whole.
MAX_COVERAGE = 0.5


def _cleaned(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stage keeps, with the columns of docs: all but doc_id and text are out of its way under names of their own."""
    prefix = free_prefix(docs)
    own = {c: f"{prefix}{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = stage(docs.withColumnsRenamed(own))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars again after a text changed, where the column is there."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below one half. Null and empty texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _cleaned(docs, lambda d: toxicity.score(d, model).where("score < 0.5"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of line runs; documents of which nothing else was left go."""
    return _sized(_cleaned(docs, lambda d: line_dedup.remove_lines(d).where("not removed_all")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the least id (null ids last), and one of the rows that repeat it."""
    return _cleaned(docs, lambda d: near_dedup.near_duplicates(d).where("kept").dropDuplicates(["class_key"]))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows; documents with more than MAX_COVERAGE of such words go."""
    items = table(spark, sf_dir, "benchmark")
    return _sized(_cleaned(docs, lambda d: decontaminate.clean(d, items, max_coverage=MAX_COVERAGE)))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the sampled piece ids of each text, their number and hash, and whether they decode to the text."""
    out = sampled_pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], keep_text=False)
    return out.select("doc_id", "lang", "source", "n_pieces", "ids", "ids_sha256", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", remove_benchmark),
    ("sentencepiece_encoding", to_pieces),
]

#: Models, components and samples have no SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what they write goes to a new folder in the shared checkpoint folder.

    A stage's table is removed once the next one is written; the last stays, as the result is read from it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
