"""Windows, filters, features and aggregates."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import aggregate, heuristics
from textloom.operators.prepare import PrepareOptions, prepare, split_into_windows


def split(spark, text, most, overlap=0):
    return split_into_windows(spark.createDataFrame([(text,)], "text string"), most, overlap).first()["windows"]


def test_windows(spark):
    assert split(spark, None, 5) == []
    assert split(spark, " short ", 5) == ["short"]
    # paragraphs of 2, 2 and 2 tokens under a budget of 4
    assert split(spark, "aaaaaaaa\n\nbbbbbbbb\n\ncccccccc", 4) == ["aaaaaaaa\n\nbbbbbbbb", "cccccccc"]
    # a paragraph over the budget goes by sentences; the paragraph after it starts a window
    text = "Aaa bbb ccc. Ddd eee fff. Ggg hhh iii.\n\nzz"
    assert split(spark, text, 6) == ["Aaa bbb ccc. Ddd eee fff.", "Ggg hhh iii.", "zz"]
    # a sentence over the budget is a window of its own
    assert split(spark, "A" * 40 + ". Bb.\n\n" + "cc", 4) == ["A" * 40 + ".", "Bb.", "cc"]


def test_overlap(spark):
    assert split(spark, "aaaaaaaa\n\nbbbbbbbb\n\ncccccccc", 2, 1) == ["aaaaaaaa", "aaaa\n\nbbbbbbbb", "bbbb\n\ncccccccc"]


def test_prepare_filters_on_normalized_length(spark):
    df = spark.createDataFrame([(0, "x" * 316), (1, "x" * 317), (2, None), (3, "y" + " " * 400)], "seq long, text string")
    rows = prepare(df).collect()
    assert [(r["seq"], r["meta"]["estimated_tokens"], r["meta"]["window_index"]) for r in rows] == [(1, 80, None)]
    assert prepare(df, PrepareOptions(min_estimated_tokens=79)).count() == 2


def test_prepare_keeps_raw_text_unless_told(spark):
    df = spark.createDataFrame([("a\r\n" * 200, "1", {"k": "v"})], "text string, label string, meta map<string,string>")
    raw, normal = prepare(df).first(), prepare(df, PrepareOptions(normalize=True)).first()
    assert "\r" in raw["text"] and "\r" not in normal["text"]
    assert raw["meta"]["extra"] == {"k": "v"} and raw["label"] == "1"


def score_of(spark, **changes):
    base = dict(distinct_3gram_ratio=0.5, longest_repeat_ngram=16, repeated_sentence_ratio=0.17, sentence_len_var=0.0, punctuation_entropy=0.0, stopword_ratio_var=0.0, char_trigram_entropy=1.5, word_entropy=3.5, n_sentences=1, n_words=280, n_chars=1)
    row = spark.createDataFrame([tuple((base | changes).values())], ", ".join(f"{n} {'int' if n.startswith(('n_', 'longest')) else 'double'}" for n in base))
    return row.select(heuristics.score(F.struct(*base)).alias("s")).first()["s"]


def test_score(spark):
    # repetition 1, evenness (2/3 + 1 + 1) / 3, poverty 1
    raw = 0.5 + 0.3 * (8 / 9) + 0.2
    assert score_of(spark) == pytest.approx(raw)
    assert score_of(spark, n_words=80) == 0.5
    assert score_of(spark, n_words=180) == pytest.approx(0.5 + 0.5 * (raw - 0.5))
    assert score_of(spark, n_words=129) == pytest.approx(0.5 + 0.245 * (0.6 * raw + 0.2 - 0.5))


@pytest.fixture(scope="module")
def window_rows(spark):
    text = "The cat sat on the mat. The cat sat on the mat. A dog, it ran; far away!\n\n"
    other = " ".join(f"word{i} is here." for i in range(60))
    df = spark.createDataFrame([(0, text * 12, "0"), (1, other, "1"), (2, other, "0")], "seq long, text string, label string")
    return prepare(df, PrepareOptions(max_estimated_tokens=64)).cache()


def test_levels_and_means(spark, window_rows):
    own, docs = heuristics.by_level(heuristics.compute_heuristics(window_rows))
    assert own.count() == window_rows.count() and docs.count() == 2  # equal texts share an id
    both = {r["meta"]["text_id"]: r for r in docs.collect()}
    for key, row in both.items():
        mine = [r for r in own.collect() if r["meta"]["text_id"] == key]
        assert row["heuristics_score"] == pytest.approx(sum(r["heuristics_score"] for r in mine) / len(mine))
        assert row["features"]["n_words"] == pytest.approx(sum(r["features"]["n_words"] for r in mine) / len(mine))
        assert row["label"] == min(mine, key=lambda r: (r["seq"], r["meta"]["window_index"]))["label"]


def test_generic_aggregate(spark):
    schema = "label string, seq long, meta struct<doc_id: long, text_id: string>, f struct<a: double, b: int, c: string, d: boolean>"
    rows = [("x", 0, (0, "t"), (1.0, 2, "s", True)), ("y", 1, (0, "t"), (3.0, 2, "s", False)), ("z", 2, (7, "t"), (5.0, 1, "s", True)), ("w", 3, (0, ""), None), ("v", 4, (None, None), (1.0, 1, "q", True))]
    out = {r["meta"]["doc_id"]: r for r in aggregate.aggregate_documents(spark.createDataFrame(rows, schema), "f", "doc_id").collect()}
    assert set(out) == {"t", "7", "unknown"}  # zero and empty ids don't count
    assert out["t"]["f"].asDict() == {"mean_a": 2.0, "std_a": 1.0, "mean_b": 2.0, "std_b": 0.0, "mean_d": 0.5, "std_d": 0.5}
    assert out["t"]["label"] == "x" and out["7"]["f"]["std_a"] == 0.0 and out["unknown"]["label"] == "w"
