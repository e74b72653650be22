"""Heuristic features of windows, their score, and means by document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from textloom.functions import kernels, stats
from textloom.session import ship_package

FEATURES = (
    "distinct_3gram_ratio longest_repeat_ngram repeated_sentence_ratio sentence_len_var punctuation_entropy stopword_ratio_var "
    "char_trigram_entropy word_entropy n_sentences n_words n_chars"
).split()
INTEGERS = ("longest_repeat_ngram", "n_sentences", "n_words", "n_chars")
TYPE = StructType([StructField(n, IntegerType() if n in INTEGERS else DoubleType()) for n in FEATURES])


def feature_struct(texts: pa.Array) -> pa.Array:
    """The features of each text; null counts as empty."""
    kinds = [pa.int32() if n in INTEGERS else pa.float64() for n in FEATURES]
    rows = [kernels.features(t) for run in kernels.text_runs(texts) for t in run]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(FEATURES)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(FEATURES))


@F.arrow_udf(TYPE)
def features(texts: pa.Array) -> pa.Array:
    """The eleven features as a struct."""
    return feature_struct(texts)


def score(f: Column) -> Column:
    """In [0, 1]; high for repetition and low variety, drawn to one half for short texts."""
    c, x = stats.clamp01, f.getField
    repetition = (c((0.80 - x("distinct_3gram_ratio")) / 0.30) + c((x("longest_repeat_ngram") - 6.0) / 10.0) + c((x("repeated_sentence_ratio") - 0.02) / 0.15)) / 3.0
    evenness = (c((8.0 - x("sentence_len_var")) / 12.0) + c((1.6 - x("punctuation_entropy")) / 1.6) + c((0.020 - x("stopword_ratio_var")) / 0.020)) / 3.0
    poverty = (c((3.5 - x("char_trigram_entropy")) / 2.0) + c((6.5 - x("word_entropy")) / 3.0)) / 2.0
    gate = c((x("n_words") - 80) / 200.0)
    raw = 0.5 * repetition + 0.3 * evenness + 0.2 * poverty
    raw = F.when(gate < 0.25, 0.6 * raw + 0.2).otherwise(raw)
    return c(0.5 + gate * (raw - 0.5))


def window_features(prepared: DataFrame) -> DataFrame:
    """label, seq, meta, features, heuristics_score of each prepared example. One visit to a worker for each text."""
    ship_package(prepared.sparkSession)
    own = prepared.select("label", "seq", "meta", "text")
    schema = StructType([*own.schema.fields[:3], StructField("features", TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], feature_struct(batch.column("text"))], names=schema.names)

    return own.mapInArrow(run, schema).withColumn("heuristics_score", score(F.col("features")))


def kept_meta(meta: StructType) -> list[str]:
    """Fields of meta that a document row keeps, apart from text_id."""
    return [n for n in meta.fieldNames() if n not in ("text_id", "window_index", "window_text_id", "window_estimated_tokens", "level")]


def document_means(windows: DataFrame) -> DataFrame:
    """Means by text_id; label and meta of the first window. Groups of an empty or null id are left out.

    The score is the mean of the windows' scores. Sums are partial before the one shuffle.
    """
    kind = windows.schema["meta"].dataType
    order = F.struct("seq", F.coalesce("meta.window_index", F.lit(0)))
    means = F.struct(*[F.avg(F.col(f"features.{n}").cast("double")).alias(n) for n in FEATURES])
    grouped = windows.withColumn("text_id", F.col("meta.text_id")).filter("text_id <> ''").groupBy("text_id")
    docs = grouped.agg(means.alias("features"), F.avg("heuristics_score").alias("heuristics_score"), F.min_by(F.struct("label", "meta"), order).alias("first"), F.min("seq").alias("seq"))
    meta = F.struct("text_id", *[F.col(f"first.meta.`{n}`") for n in kept_meta(kind)], F.lit("doc").alias("level"))
    return docs.select(F.col("first.label").alias("label"), "seq", meta.alias("meta"), "features", "heuristics_score")


def compute_heuristics(prepared: DataFrame, aggregate_doc: bool = True) -> DataFrame:
    """Window rows, and with aggregate_doc document rows after them; meta.level tells them apart."""
    windows = window_features(prepared)
    kind = windows.schema["meta"].dataType
    as_double = F.struct(*[F.col(f"features.{n}").cast("double").alias(n) for n in FEATURES])
    names = [n for n in kind.fieldNames() if n != "level"]
    level = lambda v: F.lit(v).cast("string").alias("level")
    out = windows.withColumn("features", as_double).withColumn("meta", F.struct(*[F.col(f"meta.`{n}`") for n in names], level(None)))
    if not aggregate_doc:
        return out
    docs = document_means(windows)
    there = docs.schema["meta"].dataType.fieldNames()
    full = [F.col(f"meta.`{n}`") if n in there else F.lit(None).cast(kind[n].dataType).alias(n) for n in names]
    return out.unionByName(docs.withColumn("meta", F.struct(*full, level("doc"))))


def by_level(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Window rows (also those without a level) and document rows."""
    is_doc = F.col("meta.level").eqNullSafe("doc")
    return rows.filter(~is_doc), rows.filter(is_doc)
