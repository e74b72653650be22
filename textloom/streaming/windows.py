"""Preparation and window features are stateless, so they run on streams as they are; document means keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import heuristics
from textloom.operators.prepare import PrepareOptions, prepare
from textloom.sources.readers import EXAMPLE_SCHEMA


def stream_examples(spark: SparkSession, path: str, schema: str = EXAMPLE_SCHEMA + ", seq long") -> DataFrame:
    """Examples from files of JSON lines as they arrive."""
    return spark.readStream.schema(schema).json(path)


def stream_window_features(examples: DataFrame, options: PrepareOptions | None = None) -> DataFrame:
    """Window rows of arriving examples (append mode)."""
    return heuristics.window_features(prepare(examples, options))


def stream_document_scores(windows: DataFrame) -> DataFrame:
    """Running mean score and windows of each text (update or complete mode)."""
    keyed = windows.select(F.col("meta.text_id").alias("text_id"), "heuristics_score").filter("text_id <> ''")
    return keyed.groupBy("text_id").agg(F.avg("heuristics_score").alias("heuristics_score"), F.count("*").alias("windows"))
