"""Text, DOCX and PDF files, and lines of JSON, as DataFrames; whatever store Spark reads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import suffix
from textloom.operators.prepare import IDENTIFIERS
from textloom.session import ship_package

#: Fixed value: the name space of word-processing documents.
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Labels and metadata keep the types they have in the file: numbers stay numbers.
EXAMPLE_SCHEMA = "text string, label variant, meta map<string,variant>"


def text_of_txt(data: bytes, encoding: str = "utf-8") -> str:
    """Bytes that don't decode become U+FFFD; line ends become line feeds."""
    return data.decode(encoding, "replace").replace("\r\n", "\n").replace("\r", "\n")


def text_of_docx(data: bytes) -> str:
    """Paragraphs of the body that aren't blank, parted by empty lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORDS}body")
    parts = []
    for p in [] if body is None else body.findall(f"{WORDS}p"):
        marks = {f"{WORDS}tab": "\t", f"{WORDS}br": "\n", f"{WORDS}cr": "\n"}
        runs = [r for e in p for r in ([e] if e.tag == f"{WORDS}r" else e.findall(f"{WORDS}r") if e.tag == f"{WORDS}hyperlink" else [])]
        parts.append("".join((t.text or "") if t.tag == f"{WORDS}t" else marks.get(t.tag, "") for r in runs for t in r).strip())
    return "\n\n".join(p for p in parts if p)


def text_of_pdf(data: bytes) -> str:
    """Texts of all pages, also empty ones, parted by empty lines; needs pypdf on the workers."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf on the workers") from e
    return "\n\n".join((page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(data)).pages)


#: What reads each suffix.
FORMATS = {".txt": text_of_txt, ".docx": text_of_docx, ".pdf": text_of_pdf}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, seq) of each file, in order of the path; a suffix that isn't known raises when its file is read."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for kind, data in zip(batch.column("suffix").to_pylist(), batch.column("content"), strict=True):
                if kind not in FORMATS:
                    raise ValueError(f"Unsupported file type: {kind}")
                texts.append(FORMATS[kind](data.as_buffer().to_pybytes()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    read = files.select("path", suffix(F.col("path")).alias("suffix"), "content").mapInArrow(run, "path string, text string")
    return read.withColumn("seq", place(F.col("path"), F.lit(0), F.lit(0)))


def place(file: Column, start: Column, row: Column) -> Column:
    """Where a row stands in its source. Its order is that of the files' paths and lines, however they are dealt to tasks."""
    return F.struct(file.alias("file"), start.cast("long").alias("start"), row.cast("long").alias("row"))


def read_jsonl(spark: SparkSession, path: str, schema: str = EXAMPLE_SCHEMA) -> DataFrame:
    """Lines of JSON under a fixed schema; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Prepared examples: the identifiers typed, all other metadata as ``extra``, and ``seq``, their place in the files.

    An id that is null counts as 'None'.
    """
    meta, here = F.col("meta"), F.col("_metadata")
    seq = place(here["file_path"], here["file_block_start"], F.monotonically_increasing_id()).alias("seq")
    named = lambda n, t: F.try_variant_get(meta.getItem(n), "$", t).alias(n)
    own = F.when(F.is_variant_null(meta.getItem("text_id")), F.lit("None")).otherwise(named("text_id", "string")).alias("text_id")
    ids = [own, named("estimated_tokens", "int"), named("window_index", "int"), named("window_text_id", "string"), named("window_estimated_tokens", "int")]
    extra = F.map_filter(F.coalesce(meta, F.expr("cast(map() as map<string,variant>)")), lambda k, _: ~k.isin(*IDENTIFIERS)).alias("extra")
    return read_jsonl(spark, path).select("text", "label", seq, F.struct(*ids, extra).alias("meta"))
