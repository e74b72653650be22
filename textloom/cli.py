"""Command line: ``python -m textloom.cli get-text ...`` and ``python -m textloom.cli score ...``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from textloom.operators.prepare import PrepareOptions
from textloom.operators.scoring import TwoModelOptions, transformers_scorer
from textloom.plans import pipelines
from textloom.sources.writers import put, write_jsonl, write_texts


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom")
    kinds = top.add_subparsers(dest="kind", required=True)
    a = kinds.add_parser("get-text", help="files to normalised texts and prepared examples")
    a.add_argument("--input_path", required=True)
    a.add_argument("--output_path")
    a.add_argument("--max_estimated_tokens", type=int)
    a.add_argument("--overlap_estimated_tokens", type=int, default=0)
    a.add_argument("--window_separator", default=pipelines.SEPARATOR)
    a.add_argument("--print", action="store_true")
    a.add_argument("--prepare_examples", action="store_true")
    a.add_argument("--normalize", action="store_true")
    b = kinds.add_parser("score", help="prepared examples to feature files")
    b.add_argument("--prepared_path", required=True)
    b.add_argument("--out_dir")
    for name in ("aggregate_doc", "with_heuristics", "with_binoculars", "bino_use_bfloat16", "with_logits"):
        b.add_argument(f"--{name}", action="store_true")
    b.add_argument("--bino_observer_id", default="Qwen/Qwen2.5-1.5B")
    b.add_argument("--bino_performer_id", default="Qwen/Qwen2.5-1.5B-Instruct")
    b.add_argument("--bino_max_tokens", type=int, default=512)
    b.add_argument("--bino_mode", choices=("low-fpr", "accuracy"), default="low-fpr")
    b.add_argument("--bino_device_1")
    b.add_argument("--bino_device_2")
    b.add_argument("--logits_model_id", default="Qwen/Qwen3-0.6B")
    b.add_argument("--logits_max_tokens", type=int, default=512)
    b.add_argument("--device")
    return top


def get_text(spark: SparkSession, a: argparse.Namespace) -> None:
    files = pipelines.normalized_files(spark, a.input_path, a.max_estimated_tokens, a.overlap_estimated_tokens, a.window_separator)
    if a.print:
        for row in files.select("text").toLocalIterator():
            print(row["text"])
        return
    stem, kind = os.path.splitext(a.input_path)
    out = a.output_path or stem + ("_text.txt" if kind.lower() == ".txt" else ".txt")  # never over the input
    found = files.select("text").limit(2).collect()
    if len(found) == 1:
        put(spark, out, found[0]["text"])
    else:
        write_texts(files, out)
    print(f"Saved: {out}")
    if a.prepare_examples:
        options = PrepareOptions(a.max_estimated_tokens, a.overlap_estimated_tokens, normalize=a.normalize)
        path = os.path.splitext(out)[0] + "_prepared.jsonl"
        write_jsonl(pipelines.prepared_files(files, options).drop("seq"), path)
        print(f"Saved prepared examples to: {path}")


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    two = a.with_binoculars
    options = pipelines.ScoreOptions(
        a.out_dir,
        a.aggregate_doc,
        a.with_heuristics,
        transformers_scorer(a.bino_observer_id, a.bino_device_1, a.bino_use_bfloat16) if two else None,
        transformers_scorer(a.bino_performer_id, a.bino_device_2 or a.bino_device_1, a.bino_use_bfloat16) if two else None,
        TwoModelOptions(a.bino_observer_id, a.bino_performer_id, a.bino_max_tokens, a.bino_mode),
        transformers_scorer(a.logits_model_id, a.device, True) if a.with_logits else None,
        a.logits_model_id,
        a.logits_max_tokens,
    )
    for path in pipelines.score(spark, a.prepared_path, options):
        print(f"Saved: {path}")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("textloom").getOrCreate()
    {"get-text": get_text, "score": score}[a.kind](spark, a)


if __name__ == "__main__":
    main()
