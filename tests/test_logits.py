"""Logit features: columns against hand-computed values, and worker code against the columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import logits, scoring


def frame(spark, ids, x, attended=None):
    rows = [(0, p, [float(v) for v in x[p]], int(t), True if attended is None else attended[p]) for p, t in enumerate(ids)]
    return spark.createDataFrame(rows, "seq_id long, pos int, logits array<double>, token int, attended boolean")


def test_uniform_logits(spark):
    row = logits.summarize_logits(frame(spark, [1, 2, 3], np.zeros((3, 8)))).first()
    assert row["mean_entropy"] == pytest.approx(math.log(8)) and row["mean_logprob"] == pytest.approx(-math.log(8))
    assert row["mean_top1_prob"] == pytest.approx(1 / 8) and row["mean_top1_margin"] == 0 and row["n_tokens"] == 3


def test_top_probability_of_exactly_four_fifths_is_not_over_it(spark):
    x = np.tile(np.log([0.8, 0.1, 0.1]), (3, 1))
    row = logits.summarize_logits(frame(spark, [0, 0, 1], x)).first()
    assert row["frac_top1_gt_0p8"] in (0.0, 1.0)  # rounding of the exponential decides
    assert row["mean_top1_margin"] == pytest.approx(math.log(8))


@pytest.mark.parametrize("n", [1, 2])
def test_short(spark, n):
    row = logits.summarize_logits(frame(spark, list(range(n)), np.ones((n, 4)))).first()
    assert row["n_tokens"] == n and row["mean_logprob"] == 0.0 and row["mean_entropy"] == 0.0


def test_workers_agree_with_columns(spark):
    rng = np.random.default_rng(3)
    ids, x, y = rng.integers(0, 20, 12).tolist(), rng.normal(size=(12, 20)) * 3, rng.normal(size=(12, 20)) * 3
    row = logits.summarize_logits(frame(spark, ids, x)).first()
    assert tuple(row)[1:] == pytest.approx(scoring.summarize(ids, x))
    both = frame(spark, ids, x).withColumnRenamed("logits", "observer").withColumn("performer", F.when(F.col("pos") >= 0, F.lit(None).cast("array<double>")))
    rows = [(0, p, x[p].tolist(), y[p].tolist(), ids[p], True) for p in range(12)]
    both = spark.createDataFrame(rows, "seq_id long, pos int, observer array<double>, performer array<double>, token int, attended boolean")
    made = logits.two_model_scores(both, pad_token_id=ids[5]).first()
    a, b, c = scoring.two_model_row(ids, x, y, ids[5])
    assert (made["obs_ppl_nll_mean"], made["perf_ppl_nll_mean"], made["xent_mean"]) == pytest.approx((a, b, c))
    assert made["score_obs_raw"] == pytest.approx(a / (c + 1e-8)) and made["threshold"] == logits.LOW_FPR_THRESHOLD
    assert logits.two_model_scores(both, 0, "other").first()["threshold"] == logits.ACCURACY_THRESHOLD


def test_masked_labels_do_not_count(spark):
    x = np.random.default_rng(1).normal(size=(5, 6))
    full = logits.summarize_logits(frame(spark, [1, 2, 3, 4, 5], x, [True, True, True, False, False])).first()
    part = logits.summarize_logits(frame(spark, [1, 2, 3], x[:3])).first()
    assert tuple(full)[1:] == pytest.approx(tuple(part)[1:])


def test_scorers(spark):
    docs = spark.createDataFrame([("ab" * 5000,), ("ab",), (None,), ("",)], "text string")
    pair, single, digest = scoring.byte_scorers(docs)
    assert digest == scoring.byte_scorers(docs)[2] != scoring.byte_scorers(docs.limit(0))[2]
    prepared = docs.withColumns({"label": F.lit(None).cast("string"), "seq": F.lit(0), "meta": F.struct(F.lit("t").alias("text_id"))})
    rows = scoring.logits_features(prepared, pair, "test-pair", timed=True).collect()
    assert [r["logits_features"]["n_tokens"] for r in rows] == [512, 2, 0, 0]
    assert rows[0]["logits_features"]["mean_logprob"] < 0 and rows[0]["logits_features"]["runtime_s"] >= 0
    two = scoring.two_model_features(prepared, pair, single, scoring.TwoModelOptions("test-pair", "test-single", batch_size=2)).collect()
    assert two[0]["binoculars_features"]["obs_ppl_nll_mean"] < two[0]["binoculars_features"]["perf_ppl_nll_mean"]
    assert two[0]["binoculars_features"]["batch_size"] == 2
    with pytest.raises(ValueError):
        scoring.TwoModelOptions(batch_size=0)
    other = scoring.ByteScorer(np.zeros((1, 256)), False)
    other.vocabulary = {}
    with pytest.raises(ValueError):
        scoring.check_same_vocabulary(pair(), other)


def test_byte_queries_score_whole_windows(spark):
    from textloom import queries

    folder = "/root/testdata/sf0.001"
    sizes = {(r["seq"], r["window_index"]): len(r["text"].encode()) for r in queries.windows(spark, folder).select("seq", "meta.window_index", "text").collect()}
    made = {(r["seq"], r["window_index"]): r["n_tokens"] for r in queries.scored_windows(spark, folder).collect()}
    assert made == sizes and max(sizes.values()) > 512
    # scores of documents, from the logits of whole windows one by one
    pair, single = (f() for f in scoring.byte_scorers(queries.table(spark, folder, "documents"))[:2])
    wanted = {}
    for r in queries.windows(spark, folder).select("meta.text_id", "text").collect():
        ids = list(r["text"].encode())
        nll, _, cross = scoring.two_model_row(ids, pair.logits([ids])[0], single.logits([ids])[0], 256)
        wanted.setdefault(r["text_id"], []).append((nll / (cross + 1e-8), cross))
    rows = {r["text_id"]: r for r in queries.two_model_windows(spark, folder).collect()}
    assert rows.keys() == wanted.keys()
    for k, parts in wanted.items():
        assert (rows[k]["score_obs_raw"], rows[k]["xent_mean"]) == pytest.approx(tuple(np.mean(parts, axis=0)), abs=1e-5)


def test_look_up_equals_logits():
    rng = np.random.default_rng(6)
    a, b = scoring.ByteScorer(rng.integers(0, 50, (256, 256)), True), scoring.ByteScorer(rng.integers(0, 50, (1, 256)), False)
    for s in (a, b):
        tables = scoring.TokenTables(s.by_token())
        for n in (0, 2, 3, 5000):
            ids = rng.integers(0, 256, n).tolist()
            assert tables.summarize(ids) == pytest.approx(scoring.summarize(ids, s.logits([ids])[0] if n else np.zeros((0, 1))))
    ids = [*rng.integers(0, 256, 3000).tolist(), 256]
    assert scoring.TwoTokenTables(a.by_token(), b.by_token(), 256).row(ids) == pytest.approx(scoring.two_model_row(ids, a.logits([ids])[0], b.logits([ids])[0], 256))


def test_workers_keep_a_few_scorers():
    made = [scoring.loaded(lambda i=i: f"scorer {i}", f"keep-{i}") for i in range(scoring.MOST_LOADED + 2)]
    assert made[-1] == "scorer 5" and len(scoring._loaded) == scoring.MOST_LOADED and "keep-0" not in scoring._loaded


class Tensor:
    """As much of a tensor as the scorer asks for."""

    def __init__(self, x):
        self.x = np.asarray(x)

    float = cpu = lambda self: self

    def numpy(self):
        return self.x


def test_transformers_scorer_on_a_stub(monkeypatch):
    """A model whose logits are one for each token, and 9 at its successor; padding and masks as asked for."""
    import contextlib
    import sys
    import types

    calls = []

    class Tokenizer:
        pad_token, eos_token, pad_token_id = None, "</s>", 7

        def __call__(self, text, truncation, max_length):
            ids = [ord(c) - 97 for c in text]
            return {"input_ids": ids[:max_length] if truncation else ids}

        def get_vocab(self):
            return {chr(97 + i): i for i in range(8)}

    class Model:
        def to(self, device):
            calls.append(device)
            return self

        def eval(self):
            return self

        def __call__(self, input_ids, attention_mask):
            calls.append((input_ids.x.tolist(), attention_mask.x.tolist()))
            return types.SimpleNamespace(logits=Tensor(np.eye(8)[(input_ids.x + 1) % 8] * 9))

    torch = types.ModuleType("torch")
    torch.cuda, torch.float32, torch.bfloat16 = types.SimpleNamespace(is_available=lambda: False), "float32", "bfloat16"
    torch.tensor, torch.inference_mode = lambda x, device: Tensor(x), contextlib.nullcontext
    library = types.ModuleType("transformers")
    library.AutoTokenizer = types.SimpleNamespace(from_pretrained=lambda name, token: Tokenizer())
    library.AutoModelForCausalLM = types.SimpleNamespace(from_pretrained=lambda name, torch_dtype, token: calls.append((name, torch_dtype)) or Model())
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "transformers", library)
    scorer = scoring.transformers_scorer("some-model", bfloat16=True)()
    assert calls[:2] == [("some-model", "float32"), "cpu"] and scorer.tokenizer.pad_token == "</s>"
    assert scorer.encode("abcdef", 4) == [0, 1, 2, 3] and scorer.encode("abcdef", None) == [0, 1, 2, 3, 4, 5]
    x, y = scorer.logits([[0, 1, 2], [4, 4]])
    assert calls[2] == ([[0, 1, 2], [4, 4, 7]], [[1, 1, 1], [1, 1, 0]]) and x.shape == (3, 8) and y.shape == (2, 8)
    assert scoring.summarize([0, 1, 2], x)[0] == pytest.approx(-np.log1p(7 * np.exp(-9)))
    nll, other, cross = scoring.two_model_row([0, 1, 2], x, x, scorer.pad_token_id)
    assert nll == other == pytest.approx(np.log1p(7 * np.exp(-9))) and cross > nll
    scoring.check_same_vocabulary(scorer, scoring.transformers_scorer("other")())


def test_transformers_scorer_names_what_is_missing(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "torch", None)
    with pytest.raises(RuntimeError, match="torch"):
        scoring.transformers_scorer("some-model")()
