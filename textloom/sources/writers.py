"""Writers: Spark's own, and one file where a flow asks for a single object."""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


def flat_meta(df: DataFrame) -> DataFrame:
    """df with what ``meta`` holds as ``extra`` beside its other entries, and without entries that are null."""
    kind = df.schema["meta"].dataType if "meta" in df.columns else None
    if not isinstance(kind, StructType):
        return df
    extra = [f.name for f in kind.fields if f.name == "extra" and isinstance(f.dataType, MapType)]
    ids = F.struct(*[F.col(f"meta.`{n}`").alias(n) for n in kind.fieldNames() if n not in extra])
    entries = F.parse_json(F.to_json(ids)).cast("map<string,variant>")
    if extra:
        own = F.parse_json(F.to_json(F.coalesce("meta.extra", F.create_map().cast(kind["extra"].dataType)), {"ignoreNullFields": "false"})).cast("map<string,variant>")
        entries = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(entries), k)), entries)
    return df.withColumn("meta", entries)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of files with one object a line, UTF-8."""
    flat_meta(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_texts(df: DataFrame, path: str, column: str = "text", one_each: bool = False) -> None:
    """A folder of files that hold the texts as they are, each with a line feed behind it; with one_each a file for each text."""
    out = df.select(F.col(column).alias("value")).write.mode("overwrite")
    (out.option("maxRecordsPerFile", 1) if one_each else out).text(path)


@contextmanager
def created(spark: SparkSession, path: str) -> Iterator[Callable[[str], None]]:
    """Gives a function that adds text to a new UTF-8 file, in any store the session knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        yield lambda text: out.write(bytearray(text.encode()))
    finally:
        out.close()


def put(spark: SparkSession, path: str, content: str) -> None:
    with created(spark, path) as add:
        add(content)


def shown(row: str, depth: int) -> str:
    """A document row as indented JSON; features without a value are left out."""
    obj = {k: {n: x for n, x in v.items() if x is not None} if isinstance(v, dict) and k != "meta" else v for k, v in json.loads(row).items()}
    return json.dumps(obj, ensure_ascii=False, indent=2).replace("\n", "\n" + " " * depth)


def write_documents(df: DataFrame, path: str, skip_empty: bool = False) -> bool:
    """Document rows in one file: one alone as the bare object, otherwise {"docs": [...]}, in order of seq. Whether it wrote.

    Rows pass through the driver one partition at a time, whatever their number. For files that many tasks write, see write_jsonl.
    """
    rows = flat_meta(df.orderBy("seq").drop("seq"))
    lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line")).toLocalIterator(prefetchPartitions=True)
    first, second = next(lines, None), next(lines, None)
    if first is None and skip_empty:
        return False
    with created(df.sparkSession, path) as add:
        if first is None:
            add('{\n  "docs": []\n}\n')
        elif second is None:
            add(shown(first["line"], 0) + "\n")
        else:
            add('{\n  "docs": [\n    ' + shown(first["line"], 4))
            for row in itertools.chain([second], lines):
                add(",\n    " + shown(row["line"], 4))
            add("\n  ]\n}\n")
    return True


def output_names(prepared_path: str, out_dir: str | None, kind: str) -> tuple[str, str]:
    """Paths of a kind's windows and documents, after the prepared file's name."""
    stem = PurePosixPath(prepared_path).stem.replace("_prepared", "")
    folder = out_dir or os.path.dirname(prepared_path) or "."
    return f"{folder}/{stem}_{kind}_windows.jsonl", f"{folder}/{stem}_{kind}_doc.json"
