"""Text kernels on hand-made rows; expected values follow from the definitions."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import kernels, stats
from textloom.functions import text as tx
from textloom.operators import heuristics


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, wanted",
    [
        (None, ""),
        ("", ""),
        ("a\r\nb\rc", "a\nb\nc"),
        ("a\u0085b c d\x0be\x0cf", "a\nb\nc\nd\ne\nf"),
        ("a\\nb\\r\\nc\\rd", "a\nb\nc\\rd"),
        ("  a  \t b  \n\n\n\nb ", "a b \n\nb"),
        ("ａ１ ﬁ", "a1 fi"),
        ("a \n \n \n b", "a \n \n \n b"),
        ("\x1c　x\x1f", "x"),
    ],
)
def test_normalize(spark, text, wanted):
    assert value(spark, text, tx.normalize_text) == wanted


def test_strip_takes_what_python_takes(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    df = spark.createDataFrame([(c, f"{c}x{c}y{c}") for c in spaces], "c string, text string")
    for row in df.select("c", tx.strip(F.col("text")).alias("v")).collect():
        assert row["v"] == f"x{row['c']}y", hex(ord(row["c"]))


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("é" * 316, 79), ("é" * 317, 80)])
def test_estimated_tokens(spark, text, n):
    assert value(spark, text, tx.estimated_tokens) == n


def test_sentences(spark):
    assert value(spark, " A b. C d!  e\n\nf? g.h ", tx.sentences) == ["A b.", "C d!", "e", "f?", "g.h"]
    assert value(spark, "Eins. Zwei. äh. Ährig. \"So\". 3", tx.packing_sentences) == ["Eins.", "Zwei. äh. Ährig.", "\"So\".", "3"]


def test_words(spark):
    assert value(spark, "Don't a_b X-Y² 3", tx.words) == ["don", "t", "a_b", "x", "y²", "3"]
    assert value(spark, " ... ", tx.words) == []


def test_normalize_sentence(spark):
    assert value(spark, " (Hello,   World!) ", tx.normalize_sentence) == "hello, world"


@pytest.mark.parametrize("path, wanted", [("/a/b.TXT", ".txt"), ("x.tar.Gz", ".gz"), ("/a.b/c", ""), ("/a/.bashrc", "")])
def test_suffix(spark, path, wanted):
    assert value(spark, path, tx.suffix) == wanted


def test_text_id_is_sha1(spark):
    import hashlib

    assert value(spark, "Grüße", tx.text_id) == hashlib.sha1("Grüße".encode()).hexdigest()


def measures(tokens):
    known = {}
    return kernels.gram_measures(np.array([known.setdefault(t, len(known)) for t in tokens], np.int64))


def test_repetition():
    assert measures(["a"] * 3)[0] == 1.0
    assert measures(["a"] * 5)[0] == pytest.approx(1 / 3)
    block = [f"w{i}" for i in range(12)]
    assert measures(block * 2)[1] == 12
    assert measures((block * 2)[:23])[1] == 11
    assert measures(["a", "a", "a", "a"])[1] == 2
    assert measures(block)[1] == 0
    repeated = heuristics.FEATURES.index("repeated_sentence_ratio")
    assert kernels.features("A b.\na  B!\n?\n!")[repeated] == 0.5
    assert kernels.features("A")[repeated] == 0.0


def test_grams_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        x = rng.integers(0, rng.integers(1, 12), rng.integers(0, 40)).tolist()
        grams = {n: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for n in range(2, 13)}
        longest = 0
        while longest < 12 and (n := max(2, longest + 1)) * 2 <= len(x) and len(set(grams[n])) < len(grams[n]):
            longest = n
        ratio = 1.0 if len(x) < 4 else len(set(grams[3])) / len(grams[3])
        assert kernels.gram_measures(np.array(x, np.int64)) == (ratio, longest)


def test_numbers(spark):
    row = spark.range(1).select(
        stats.clamp01(F.lit(-2.0)).alias("a"),
        stats.clamp01(F.lit(3.0)).alias("b"),
        F.isnan(stats.clamp01(F.lit(float("nan")))).alias("c"),
        stats.safe_div(F.lit(1.0), F.lit(0.0), 7.0).alias("d"),
        stats.sample_variance(F.array(F.lit(1.0), F.lit(3.0))).alias("e"),
        stats.sample_variance(F.array(F.lit(1.0))).alias("f"),
        stats.punctuation_entropy(F.lit("a.b,c.d,")).alias("g"),
        stats.punctuation_entropy(F.lit("abc")).alias("h"),
        stats.stopword_ratio(F.array(F.lit("the"), F.lit("x"))).alias("i"),
    ).first()
    assert tuple(row) == (0.0, 1.0, True, 7.0, 2.0, 0.0, 1.0, 0.0, 0.5)


def test_nfkc_matches_python(spark):
    texts = [chr(c) + "a" for c in range(0xA0, 0x2300)]
    made = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.normalize_text(F.col("text")).alias("v")).collect()
    breaks = str.maketrans(dict.fromkeys("\u2028\u2029", "\n"))
    assert all(r["v"] == unicodedata.normalize("NFKC", r["text"]).translate(breaks).strip() for r in made)
