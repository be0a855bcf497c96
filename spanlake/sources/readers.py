"""Where documents come from and where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.text import output_name, trim


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a row for each file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of .pdf files; a parser of one's own turns content into items for operators.pages."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select(F.col("path").alias("doc_id"), "content")


def table(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def pasted(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that are not blank, trimmed."""
    return df.withColumn(text, trim(F.col(text))).where(F.length(text) > 0)


def write_redacted(df: DataFrame, path: str, name: str = "name", redacted: str = "redacted") -> None:
    """Redacted texts as Parquet with the name of the file each belongs in."""
    df.withColumn("output_name", output_name(F.col(name), "text")).select(name, "output_name", redacted).write.mode("errorifexists").parquet(path)


def write_reports(df: DataFrame, path: str, name: str = "name") -> None:
    df.withColumn("output_name", output_name(F.col(name), "report")).write.mode("errorifexists").parquet(path)
