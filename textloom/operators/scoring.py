"""Features of texts under language models, by a pluggable scorer that each Python worker loads once.

A scorer gives token ids and, for a batch of id lists, the logits at each position. Logits never leave the worker: it
sends back one row of features for each text. A byte n-gram scorer comes with the library, its counts taken over whole
tables by Spark; models of the transformers library plug in through ``transformers_scorer`` where it is installed.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from textloom.operators.logits import ACCURACY_THRESHOLD, EPSILON, LOW_FPR_THRESHOLD, SUMMARY
from textloom.session import ship_package


class Scorer(Protocol):
    pad_token_id: int
    vocabulary: dict[str, int]

    def encode(self, text: str, most: int | None) -> list[int]: ...

    def logits(self, batch: list[list[int]]) -> list[np.ndarray]: ...

    # A scorer whose logits depend on nothing but the token at the position may also offer all of them, a row for each
    # token, as ``by_token() -> np.ndarray``. What they give is then looked up, and a text of any length takes little memory.


@dataclass(frozen=True)
class TwoModelOptions:
    observer_id: str = "observer"
    performer_id: str = "performer"
    max_tokens: int | None = 512
    mode: str = "low-fpr"
    batch_size: int = 8

    def __post_init__(self):
        if self.batch_size <= 0:
            raise ValueError("batch_size must be at least 1")

    @property
    def threshold(self) -> float:
        return LOW_FPR_THRESHOLD if self.mode == "low-fpr" else ACCURACY_THRESHOLD


#: Scorers that a worker keeps loaded, the latest used.
MOST_LOADED = 4
_loaded: dict[str, Scorer] = {}


def loaded(factory: Callable[[], Scorer], key: str) -> Scorer:
    """The worker's scorer of this key, which has to tell its content as well as its kind."""
    _loaded[key] = _loaded.pop(key, None) or factory()
    while len(_loaded) > MOST_LOADED:
        _loaded.pop(next(iter(_loaded)))
    return _loaded[key]


def check_same_vocabulary(a: Scorer, b: Scorer) -> None:
    if a.vocabulary != b.vocabulary:
        raise ValueError("the two models' tokenizers are not identical")


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def at_rows(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entropy, greatest probability and margin of each row of logits."""
    logp = log_softmax(x)
    p = np.exp(logp)
    two = np.sort(np.partition(x, x.shape[1] - 2, axis=1)[:, -2:], axis=1)
    return -(p * logp).sum(axis=1), p.max(axis=1), two[:, 1] - two[:, 0]


def summary(true: np.ndarray, entropy: np.ndarray, top1: np.ndarray, margin: np.ndarray, in_top: np.ndarray) -> tuple:
    q = np.quantile(true, [0.1, 0.5, 0.9])
    return (true.mean(), true.std() if len(true) > 1 else 0.0, *q, entropy.mean(), top1.mean(), (top1 > 0.8).mean(), margin.mean(), in_top.mean(), len(true) + 1)


def summarize(ids: list[int], logits: np.ndarray) -> tuple:
    """The eleven features of one sequence; zeros and the true count under three tokens."""
    if len(ids) < 3:
        return (*[0.0] * 10, len(ids))
    x, label = logits[:-1].astype(np.float64), np.array(ids[1:])
    rows = np.arange(len(label))
    in_top = (x > x[rows, label][:, None]).sum(axis=1) < 10
    return summary(log_softmax(x)[rows, label], *at_rows(x), in_top)


class TokenTables:
    """What ``summarize`` takes from the logits, for every token and label of a scorer with ``by_token``."""

    def __init__(self, x: np.ndarray):
        x = x.astype(np.float64)
        self.logp, self.rows = log_softmax(x), at_rows(x)
        self.in_top = np.stack([(row > row[:, None]).sum(axis=1) < 10 for row in x])

    def summarize(self, ids: list[int]) -> tuple:
        if len(ids) < 3:
            return (*[0.0] * 10, len(ids))
        at, label = np.array(ids[:-1]), np.array(ids[1:])
        return summary(self.logp[at, label], *(r[at] for r in self.rows), self.in_top[at, label])


def two_model_means(nll: np.ndarray, other: np.ndarray, cross: np.ndarray, mask: np.ndarray) -> tuple[float, float, float]:
    return nll.mean(), other.mean(), float((cross * mask).sum() / max(1, mask.sum()))


def two_model_row(ids: list[int], observer: np.ndarray, performer: np.ndarray, pad: int) -> tuple[float, float, float]:
    """Mean NLL of both over the labels, and their cross-entropy over labels that are not padding."""
    if len(ids) < 2:
        return 0.0, 0.0, 0.0
    label = np.array(ids[1:])
    o, p, rows = log_softmax(observer[:-1]), log_softmax(performer[:-1]), np.arange(len(label))
    return two_model_means(-o[rows, label], -p[rows, label], -(np.exp(o) * p).sum(axis=1), label != pad)


class TwoTokenTables:
    """What ``two_model_row`` takes from the logits, for every token and label of two scorers with ``by_token``."""

    def __init__(self, observer: np.ndarray, performer: np.ndarray, pad: int):
        self.o, self.p, self.pad = log_softmax(observer), log_softmax(performer), pad
        self.cross = -(np.exp(self.o) * self.p).sum(axis=1)

    def row(self, ids: list[int]) -> tuple[float, float, float]:
        if len(ids) < 2:
            return 0.0, 0.0, 0.0
        at, label = np.array(ids[:-1]), np.array(ids[1:])
        return two_model_means(-self.o[at, label], -self.p[at, label], self.cross[at], label != self.pad)


def _map_texts(df: DataFrame, name: str, fields: str, rows: Callable[[list[str]], list[tuple]]) -> DataFrame:
    """df with a struct column of what ``rows`` gives for the texts of each Arrow batch."""
    ship_package(df.sparkSession)
    inner = _parse_datatype_string(fields)
    names = [f.name for f in inner.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = list(zip(*rows([t or "" for t in batch.column("text").to_pylist()]), strict=True))
                kinds = {"double": pa.float64(), "int": pa.int32(), "string": pa.string()}
                arrays = [pa.array([x.item() if hasattr(x, "item") else x for x in c], kinds[f.dataType.simpleString()]) for c, f in zip(made, inner.fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, names)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, inner)]))


def logits_features(prepared: DataFrame, factory: Callable[[], Scorer], key: str, max_tokens: int | None = 512, timed: bool = False) -> DataFrame:
    """label, seq, meta and logits_features of each window; with ``timed`` also runtime_s. One window at a time.

    ``max_tokens`` counts the scorer's own tokens; None scores whole windows.
    """
    fields = ", ".join(f"{n} double" for n in SUMMARY) + ", n_tokens int" + ", runtime_s double" * timed

    def rows(texts: list[str]) -> list[tuple]:
        scorer, out = loaded(factory, key), []
        tables = TokenTables(scorer.by_token()) if hasattr(scorer, "by_token") else None
        for t in texts:
            began = time.perf_counter()
            ids = scorer.encode(t, max_tokens)
            row = tables.summarize(ids) if tables else summarize(ids, scorer.logits([ids])[0] if len(ids) >= 3 else np.zeros((0, 1)))
            out.append((*row, time.perf_counter() - began) if timed else row)
        return out

    return _map_texts(prepared, "logits_features", fields, rows).drop("text")


def two_model_features(prepared: DataFrame, observer: Callable[[], Scorer], performer: Callable[[], Scorer], options: TwoModelOptions | None = None) -> DataFrame:
    """label, seq, meta and binoculars_features of each window; texts of like length are scored in batches."""
    o = options or TwoModelOptions()
    numbers = ("score_obs_raw", "score_perf_raw", "obs_ppl_nll_mean", "perf_ppl_nll_mean", "xent_mean", "threshold")
    fields = ", ".join(f"{n} double" for n in numbers) + ", mode string, observer_model_id string, performer_model_id string, max_tokens int, batch_size int"
    tail = (o.threshold, o.mode, o.observer_id, o.performer_id, o.max_tokens, o.batch_size)

    def finish(nll: float, other: float, cross: float) -> tuple:
        return (nll / (cross + EPSILON), other / (cross + EPSILON), nll, other, cross, *tail)

    def rows(texts: list[str]) -> list[tuple]:
        a, b = loaded(observer, o.observer_id), loaded(performer, o.performer_id)
        check_same_vocabulary(a, b)
        if hasattr(a, "by_token") and hasattr(b, "by_token"):
            tables = TwoTokenTables(a.by_token(), b.by_token(), a.pad_token_id)
            return [finish(*tables.row(a.encode(t, o.max_tokens))) for t in texts]
        ids = [a.encode(t, o.max_tokens) for t in texts]
        order, out = sorted(range(len(ids)), key=lambda i: len(ids[i])), [()] * len(ids)
        for s in range(0, len(order), o.batch_size):
            part = order[s : s + o.batch_size]
            batch = [ids[i] for i in part]
            for i, x, y in zip(part, a.logits(batch), b.logits(batch), strict=True):
                out[i] = finish(*two_model_row(ids[i], x, y, a.pad_token_id))
        return out

    return _map_texts(prepared, "binoculars_features", fields, rows).drop("text")


class ByteScorer:
    """Bytes as tokens (0 to 255, padding 256), with logits from counts: of a byte alone, or after the byte before."""

    pad_token_id = 256
    vocabulary = {f"<{i:02x}>": i for i in range(256)} | {"<pad>": 256}

    def __init__(self, counts: np.ndarray, after: bool):
        table = np.zeros((257, 257)) if after else np.zeros((1, 257))
        table[:256 if after else 1, :256] = np.log(counts + 1.0)
        table[:, 256] = -30.0
        self.table, self.after = table, after

    def encode(self, text: str, most: int | None) -> list[int]:
        return list(text.encode("utf-8", "surrogatepass")[:most])

    def logits(self, batch: list[list[int]]) -> list[np.ndarray]:
        return [self.table[np.array(ids, np.int64)] if self.after else np.broadcast_to(self.table, (len(ids), 257)) for ids in batch]

    def by_token(self) -> np.ndarray:
        return self.table if self.after else np.broadcast_to(self.table, (257, 257))


def byte_scorers(docs: DataFrame) -> tuple[Callable[[], Scorer], Callable[[], Scorer], str]:
    """Factories of a byte-pair and a single-byte scorer, from counts over all texts (at most 65,536 rows reach the driver).

    The third value is a digest of the counts, for the scorers' keys.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
                total += np.bincount(raw[:-1] * 256 + raw[1:], minlength=65536)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(65536)
    for r in rows:
        pairs[r["pair"]] = r["n"]
    pairs = pairs.reshape(256, 256)
    digest = hashlib.sha1(pairs.tobytes()).hexdigest()[:16]
    return (lambda: ByteScorer(pairs, True)), (lambda: ByteScorer(pairs.sum(axis=0, keepdims=True), False)), digest


def transformers_scorer(model_id: str, device: str | None = None, bfloat16: bool = False, token_env: str = "HF_TOKEN") -> Callable[[], Scorer]:
    """Factory for a causal model of the transformers library, which has to be installed where the workers run."""

    def load() -> Scorer:
        import os

        try:
            import torch
            from transformers import AutoModelForCausalLM, AutoTokenizer
        except ImportError as e:
            raise RuntimeError("this scorer needs torch and transformers on the workers") from e

        class ModelScorer:
            def __init__(self):
                token = os.environ.get(token_env) or None
                self.device = device or ("cuda" if torch.cuda.is_available() else "cpu")
                kind = torch.bfloat16 if bfloat16 and torch.cuda.is_available() else torch.float32
                self.tokenizer = AutoTokenizer.from_pretrained(model_id, token=token)
                if self.tokenizer.pad_token is None:
                    self.tokenizer.pad_token = self.tokenizer.eos_token
                self.model = AutoModelForCausalLM.from_pretrained(model_id, torch_dtype=kind, token=token).to(self.device).eval()
                self.pad_token_id, self.vocabulary = self.tokenizer.pad_token_id, self.tokenizer.get_vocab()

            def encode(self, text: str, most: int | None) -> list[int]:
                return self.tokenizer(text, truncation=most is not None, max_length=most)["input_ids"]

            def logits(self, batch: list[list[int]]) -> list[np.ndarray]:
                longest = max(map(len, batch))
                ids = torch.tensor([x + [self.pad_token_id] * (longest - len(x)) for x in batch], device=self.device)
                mask = torch.tensor([[1] * len(x) + [0] * (longest - len(x)) for x in batch], device=self.device)
                with torch.inference_mode():
                    out = self.model(input_ids=ids, attention_mask=mask).logits.float().cpu().numpy()
                return [y[: len(x)] for x, y in zip(batch, out, strict=True)]

        return ModelScorer()

    return load
