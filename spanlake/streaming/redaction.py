"""Detection and redaction of documents as they arrive. All of it works row by row, so there is no state to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlake.operators.detect import detect
from spanlake.operators.redact import redact


def redacted(docs: DataFrame, text: str = "text", style: str = "text") -> DataFrame:
    """docs, batch or stream, with entities and redacted."""
    return detect(docs, text).withColumn("redacted", redact(F.col(text), F.col("entities"), style))


def start(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string", style: str = "text", available_now: bool = True) -> StreamingQuery:
    """Redact what is in (and, unless available_now, what comes to) a Parquet folder into another."""
    docs = spark.readStream.schema(schema).parquet(source)
    writer = redacted(docs, style=style).drop("text").writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
