"""Secrets in documents that arrive: the scan keeps no state, so each is scanned once as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftmark.operators.findings import secret_findings
from siftmark.operators.rules import SECRETS, Rule, match_files


def stream_findings(files: DataFrame, rules: tuple[Rule, ...] = SECRETS) -> DataFrame:
    """Findings of a streaming DataFrame (file, text)."""
    return secret_findings(match_files(files, rules))


def scan_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Scans the Parquet files of documents (doc_id, text) in source that no earlier call has, and adds the findings to sink."""
    docs = spark.readStream.schema(schema).parquet(source).select(F.col("doc_id").cast("string").alias("file"), "text")
    return stream_findings(docs).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
