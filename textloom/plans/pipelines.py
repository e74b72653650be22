"""Flows: files to texts and prepared examples, and prepared examples to feature files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import normalize_text
from textloom.operators import aggregate, heuristics, scoring
from textloom.operators.prepare import PrepareOptions, prepare, split_into_windows
from textloom.sources.readers import read_files, read_prepared
from textloom.sources.writers import output_names, write_documents, write_jsonl

#: Fixed value: what stands between windows in one text.
SEPARATOR = "\n\n--- WINDOW ---\n\n"


def normalized_files(spark: SparkSession, path: str, most: int | None = None, overlap: int = 0, separator: str = SEPARATOR) -> DataFrame:
    """(path, seq, raw, text): each file's text, normalised, and with a budget cut into windows that are joined again."""
    files = read_files(spark, path).withColumnRenamed("text", "raw").withColumn("text", normalize_text(F.col("raw")))
    if most is not None:
        files = split_into_windows(files, most, overlap).withColumn("text", F.array_join("windows", separator)).drop("windows")
    return files.select("path", "seq", "raw", "text")


def prepared_files(files: DataFrame, options: PrepareOptions) -> DataFrame:
    """Prepared examples of the raw texts, labelled 0, without metadata of their own."""
    raw = files.select(F.col("raw").alias("text"), F.lit(0).alias("label"), "seq")
    return prepare(raw, options)


@dataclass(frozen=True)
class ScoreOptions:
    out_dir: str | None = None
    aggregate_doc: bool = False
    with_heuristics: bool = False
    observer: Callable[[], scoring.Scorer] | None = None
    performer: Callable[[], scoring.Scorer] | None = None
    two_model: scoring.TwoModelOptions = field(default_factory=scoring.TwoModelOptions)
    model: Callable[[], scoring.Scorer] | None = None
    model_id: str = "model"
    max_tokens: int = 512


def score(spark: SparkSession, prepared_path: str, o: ScoreOptions) -> list[str]:
    """Write the feature files that are asked for; their paths."""
    prepared, out = read_prepared(spark, prepared_path), []

    def keep(kind: str, rows: DataFrame, docs: DataFrame | None, skip_empty: bool) -> None:
        windows_path, doc_path = output_names(prepared_path, o.out_dir, kind)
        write_jsonl(rows.drop("seq"), windows_path)
        out.append(windows_path)
        if docs is not None and write_documents(docs, doc_path, skip_empty):
            out.append(doc_path)

    if o.with_heuristics:
        windows = heuristics.window_features(prepared)
        keep("heuristics", windows, heuristics.document_means(windows) if o.aggregate_doc else None, True)
    if o.observer and o.performer:
        rows = scoring.two_model_features(prepared, o.observer, o.performer, o.two_model)
        keep("binoculars", rows, aggregate.aggregate_documents(rows, "binoculars_features") if o.aggregate_doc else None, False)
    if o.model:
        rows = scoring.logits_features(prepared, o.model, o.model_id, o.max_tokens)
        keep("logits", rows, aggregate.aggregate_documents(rows, "logits_features") if o.aggregate_doc else None, False)
    return out
