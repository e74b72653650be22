"""Document aggregates of any struct of window features: means and population deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StructType, VariantType


def id_text(column: Column, kind: DataType) -> Column:
    """An id as text; null where it is missing, empty, or a number that is zero."""
    if isinstance(kind, VariantType):
        text = F.try_variant_get(column, "$", "string")
        return F.when((F.schema_of_variant(column) != "STRING") & text.isin("0", "0.0", "false"), F.lit(None)).otherwise(F.nullif(text, F.lit("")))
    return F.when(column != 0, column.cast("string")) if isinstance(kind, NumericType) else F.nullif(column.cast("string"), F.lit(""))


def document_id(meta: StructType, doc_id_key: str = "text_id") -> Column:
    """The first of the key, doc_id and text_id that is there and neither empty nor zero, else 'unknown'."""
    found = []
    for key in (doc_id_key, "doc_id", "text_id"):
        if key in meta.fieldNames():
            found.append(id_text(F.col("meta").getField(key), meta[key].dataType))
        elif "extra" in meta.fieldNames():
            found.append(id_text(F.col("meta.extra").getItem(key), meta["extra"].dataType.valueType))
    return F.coalesce(*found, F.lit("unknown"))


def aggregate_documents(windows: DataFrame, feature_key: str, doc_id_key: str = "text_id") -> DataFrame:
    """label, seq, meta and ``feature_key`` with mean_* and std_* of its numeric fields, names in order.

    Fields that are not numbers are left out, and what is null in every window is null; groups without features give no row. One shuffle, partial sums before it.
    """
    kinds = windows.schema[feature_key].dataType
    names = sorted(f.name for f in kinds.fields if isinstance(f.dataType, (NumericType, BooleanType)))
    value = lambda n: F.col(f"{feature_key}.{n}").cast("double")
    sums = [x for n in names for x in (F.avg(value(n)).alias(f"mean_{n}"), F.stddev_pop(value(n)).alias(f"std_{n}"))]
    keyed = windows.withColumn("_doc", document_id(windows.schema["meta"].dataType, doc_id_key))
    order = F.struct("seq", F.coalesce("meta.window_index", F.lit(0))) if "window_index" in windows.schema["meta"].dataType.fieldNames() else F.col("seq")
    grouped = keyed.groupBy("_doc").agg(*sums, F.min_by("label", order).alias("label"), F.min("seq").alias("seq"), F.count(feature_key).alias("_n")).filter("_n > 0")
    meta = F.struct(F.lit("doc").alias("level"), F.col("_doc").alias(doc_id_key))
    fields = [f"{p}_{n}" for n in names for p in ("mean", "std")]
    return grouped.select("label", "seq", meta.alias("meta"), F.struct(*fields).alias(feature_key))
