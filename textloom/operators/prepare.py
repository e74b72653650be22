"""Examples to prepared examples: filter, identifiers, windows. One lazy plan without a shuffle.

An example has text, and optionally label (of any type), meta and seq (its place in the source, of any type with an
order). Meta is a map or a struct. A prepared example has text, label, seq and meta, a struct of the identifiers, the
fields of a struct it came with, and a map it came with as ``extra``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions import kernels
from textloom.functions.text import estimated_tokens, text_id
from textloom.session import ship_package

IDENTIFIERS = ("text_id", "estimated_tokens", "window_index", "window_text_id", "window_estimated_tokens")
PREPARED = "struct<keep: boolean, text_id: string, estimated_tokens: int, windows: array<string>>"


@dataclass(frozen=True)
class PrepareOptions:
    max_estimated_tokens: int | None = None
    overlap_estimated_tokens: int = 0
    min_estimated_tokens: int = 80
    normalize: bool = False


def examples(df: DataFrame) -> DataFrame:
    """text, label, meta, seq, whichever of them the input has; what it lacks is null, without entries, or the order of its rows."""
    has = set(df.columns)
    return df.select(
        F.col("text"),
        (F.col("label") if "label" in has else F.lit(None).cast("string")).alias("label"),
        (F.col("meta") if "meta" in has else F.create_map().cast("map<string,string>")).alias("meta"),
        (F.col("seq") if "seq" in has else F.monotonically_increasing_id()).alias("seq"),
    )


def keep_text(normalized: Column, least: int = 80) -> Column:
    """Whether a normalised text is long enough."""
    return (normalized != "") & (estimated_tokens(normalized) >= least)


def split_into_windows(df: DataFrame, most: int, overlap: int = 0, text: str = "text", out: str = "windows") -> DataFrame:
    """An array of windows for each text."""
    ship_package(df.sparkSession)

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        rows = [kernels.windows(kernels.normal_form(t), most, overlap) for run in kernels.text_runs(texts) for t in run]
        return pa.array(rows, pa.list_(pa.string()))

    return df.withColumn(out, cut(F.col(text)))


def prepared_texts(o: PrepareOptions):
    """A UDF for all that preparing makes of a text, in one visit to a worker. Marked so that filters don't repeat it."""

    def one(raw: str) -> tuple:
        normal = kernels.normal_form(raw)
        text = normal if o.normalize else raw
        if not normal or kernels.token_estimate(normal) < o.min_estimated_tokens:
            return False, None, None, None
        cut = [text] if o.max_estimated_tokens is None else [w for w in kernels.windows(normal, o.max_estimated_tokens, o.overlap_estimated_tokens) if w]
        return True, hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest(), kernels.token_estimate(text), cut

    @F.arrow_udf(PREPARED)
    def run(texts: pa.Array) -> pa.Array:
        chunks = []
        for part in kernels.text_runs(texts):
            columns = zip(*map(one, part), strict=True)
            kinds = (pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.string()))
            chunks.append(pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["keep", "text_id", "estimated_tokens", "windows"]))
        return pa.concat_arrays(chunks) if chunks else pa.array([], pa.struct([("keep", pa.bool_()), ("text_id", pa.string()), ("estimated_tokens", pa.int32()), ("windows", pa.list_(pa.string()))]))

    return run.asNondeterministic()


def prepare(df: DataFrame, options: PrepareOptions | None = None, observation: Observation | None = None) -> DataFrame:
    """Prepared examples; short texts are left out. ``observation`` learns how many: examples, dropped."""
    ship_package(df.sparkSession)
    o = options or PrepareOptions()
    own = examples(df)
    kind = own.schema["meta"].dataType
    fields = [F.col(f"meta.`{n}`").alias(n) for n in kind.fieldNames() if n not in IDENTIFIERS] if isinstance(kind, StructType) else [F.col("meta").alias("extra")]
    made = own.select("label", "seq", F.struct(*fields).alias("own"), prepared_texts(o)(F.col("text")).alias("made"))
    if observation is not None:
        made = made.observe(observation, F.count("*").alias("examples"), F.count_if(~F.col("made.keep")).alias("dropped"))
    each = made.filter("made.keep").select("label", "seq", "own", "made.text_id", "made.estimated_tokens", F.posexplode("made.windows").alias("at", "text"))
    window = [F.col("at"), text_id(F.col("text")), estimated_tokens(F.col("text"))]
    if o.max_estimated_tokens is None:
        window = [F.lit(None).cast(t) for t in ("int", "string", "int")]
    ids = [c.alias(n) for c, n in zip([F.col("text_id"), F.col("estimated_tokens"), *window], IDENTIFIERS, strict=True)]
    meta = F.struct(*ids, *[F.col(f"own.`{f.name}`") for f in made.schema["own"].dataType.fields])
    return each.select("text", "label", "seq", meta.alias("meta"))
