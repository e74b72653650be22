"""Properties over many random texts, checked in a few plans."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import heuristics
from textloom.operators.prepare import PrepareOptions, prepare, split_into_windows

PARTS = ["word", "Ünï", "a.b", ". ", "! ", "? ", "\n", "\n\n", "\n\n\n\n", " ", "  ", "\t", "\r\n", " ", "\\n", "Big", "3", "\"Q\"", "ﬁ", "x" * 60, "don't", "—", "²"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 220)))) for i in range(400)]
    return spark.createDataFrame(rows, "seq long, text string").repartition(4).cache()


def plain_normalize(t):
    """The definition, step by step."""
    t = unicodedata.normalize("NFKC", t).replace("\\r\\n", "\n").replace("\\n", "\n").replace("\r\n", "\n")
    t = re.sub("[\r\x0b\x0c\x85  ]", "\n", t).strip()
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", t))


def tokens(t):
    return (len(t) + 3) // 4


def plain_windows(t, most):
    """Greedy packing written as loops over units."""
    t = plain_normalize(t)
    if not t or tokens(t) <= most:
        return [t] if t else []
    out, now, used, kind = [], "", 0, "p"
    for p in (p.strip() for p in t.split("\n\n")):
        if not p:
            continue
        large = tokens(p) > most
        units = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])", p) if s.strip()] if large else [p]
        for i, u in enumerate(units):
            opens = (large and i == 0) or (not large and kind == "s") or used + tokens(u) > most
            if now and opens:
                out.append(now)
                now, used = "", 0
            now = f"{now}{' ' if large else chr(10) * 2}{u}" if now else u
            used += tokens(u)
            kind = "s" if large else "p"
    return [*out, now] if now else out


def test_normalization_is_its_definition_and_idempotent(texts):
    once = tx.normalize_text(F.col("text"))
    for r in texts.select("text", once.alias("a")).withColumn("b", tx.normalize_text(F.col("a"))).collect():
        assert r["a"] == plain_normalize(r["text"])
        assert r["b"] == plain_normalize(r["a"])


@pytest.mark.parametrize("most", [8, 30])
def test_windows_are_the_greedy_packing(texts, most):
    for r in split_into_windows(texts, most).collect():
        assert r["windows"] == plain_windows(r["text"], most)


def test_scores_stay_in_range_and_short_texts_get_one_half(texts):
    rows = heuristics.window_features(prepare(texts, PrepareOptions(min_estimated_tokens=1))).collect()
    assert rows and all(0 <= r["heuristics_score"] <= 1 for r in rows)
    assert all(r["heuristics_score"] == 0.5 for r in rows if r["features"]["n_words"] <= 80)
    assert all(0 <= r["features"]["distinct_3gram_ratio"] <= 1 and r["features"]["char_trigram_entropy"] >= 0 for r in rows)


def test_words_and_sentences_are_those_of_python(texts):
    for r in texts.select("text", tx.words(F.col("text")).alias("w"), tx.sentences(F.col("text")).alias("s")).collect():
        assert r["w"] == re.sub(r"[^\w\s]", " ", r["text"].lower()).split()
        assert r["s"] == [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", r["text"].strip()) if p and p.strip()]
