"""Quality rules: counts over each text, then a hashed n-gram log-likelihood ratio.

Character trigrams are hashed into ``BUCKETS``. Two multinomials over the buckets are counted on whole tables, with
the same prior share added: the trusted target (documents labelled of good quality) and the raw corpus (all
documents). So a trigram weighs log (observed + 1) / (expected + 1), where expected is its raw count scaled to the
target's size. A document's score is the mean over its trigrams, so length does not matter; it is kept if the base
rules pass and the score is at least ``THRESHOLD``: the target may explain it worse than the corpus does by half a
nat a trigram, which spares documents that are only rare, such as those of a small language. Counting
gives one row for each bucket and task, summed before and after a shuffle of at most BUCKETS keys; the driver and the
scoring tasks hold one table of BUCKETS numbers whatever the input.

Null text has no words, so the base rules fail it. Texts under three characters score 0. Rows with equal doc_id are
each scored; if any label of a doc_id is good, its rows are trusted. Without trusted rows only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name, pick, sized, text_slices, word_hashes
from textloom.session import ship_package

BUCKETS, THRESHOLD, MIN_WORDS = 65521, -0.5, 50
#: Factors of the trigram hash.
FACTORS = (73856093, 19349663, 83492791)
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def trigram_buckets(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    return (c[:-2] * FACTORS[0] + c[1:-1] * FACTORS[1] + c[2:] * FACTORS[2]) % BUCKETS


def repeat_words(hashes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(hashes) < 4:
        return 0
    key = hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[i : len(key) + i] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(word_hashes().of(words))


def bucket_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, raw, target) over all documents."""
    ship_package(docs.sparkSession)
    own = pick(docs, "doc_id", "text")
    trusted = labels.filter("quality = 1").select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, texts in text_slices(batch.column("text")):
                total += np.bincount(np.concatenate([trigram_buckets(t) for t in texts]), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("text").mapInArrow(run, "bucket int, n long").select("bucket", F.lit(name).alias("kind"), "n")

    # trusted texts are read once more rather than joined to a flag: raw counts then never shuffle a text
    both = count(own, "raw").unionByName(count(own.join(sized(trusted), "doc_id", "left_semi"), "target"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind)
    return both.groupBy("bucket").agg(of("raw"), of("target"))


def ratio_table(counts: DataFrame) -> np.ndarray | None:
    """log p_target - log p_raw of each bucket; at most BUCKETS rows come to the driver."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return None
    return np.log((target + 1) / (raw * (target.sum() / raw.sum()) + 1))


def score_documents(docs: DataFrame, labels: DataFrame, struct: str = "") -> DataFrame:
    """The rules' columns for each document; with ``struct``, its own columns and the rules' as a struct of that name."""
    ratio = ratio_table(bucket_counts(docs, labels))
    own = docs.schema.names if struct else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, texts in text_slices(batch.column("text")):
                rows = []
                for text in texts:
                    n = base_counts(text)
                    failed = n[0] < MIN_WORDS or 100 * n[4] > 50 * n[0]
                    at = trigram_buckets(text)
                    score = round(float(ratio[at].mean()), 6) if ratio is not None and len(at) else 0.0
                    rows.append((*n, failed, score, not failed and score >= THRESHOLD))
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                if own:
                    yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), pa.StructArray.from_arrays(columns, names)], names=[*own, struct])
                else:
                    yield pa.RecordBatch.from_arrays([ids[a:b], *columns], names=["doc_id", *names])

    if own:
        from pyspark.sql.types import StructField, StructType, _parse_datatype_string

        rules = _parse_datatype_string(RULES)
        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(struct, StructType(rules.fields[1:]))]))
    return pick(docs, "doc_id", "text").mapInArrow(run, RULES)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    rules = free_name(docs, "rules")
    return score_documents(docs, labels, rules).filter(F.col(rules).getField("kept")).select(*[F.col(f"`{n}`") for n in docs.schema.names])


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g3 AS (SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
       FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (
          SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g3) WHERE c > 1) GROUP BY r),
cs AS (SELECT r, doc_id, list_transform(regexp_extract_all(t, '(?s).'), lambda x: unicode(x)::BIGINT) AS c FROM d),
b AS (SELECT r, doc_id, (c[i] * {FACTORS[0]} + c[i + 1] * {FACTORS[1]} + c[i + 2] * {FACTORS[2]}) % {BUCKETS} AS k
      FROM (SELECT r, doc_id, c, unnest(generate_series(1, len(c) - 2)) AS i FROM cs)),
n AS (SELECT k, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS target FROM b GROUP BY k),
s AS (SELECT sum(raw) AS sr, sum(target) AS st FROM n),
l AS (SELECT k, ln((target + 1) / (raw * (st / sr) + 1)) AS v FROM n, s),
sc AS (SELECT r, round(avg(v), 6) AS score FROM b JOIN l USING (k) GROUP BY r),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0)::BIGINT AS word_chars,
        (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(CASE WHEN (SELECT st FROM s) > 0 THEN sc.score END, 0) AS score
      FROM w LEFT JOIN rep USING (r) LEFT JOIN sc USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND score >= ({THRESHOLD}) AS kept
FROM f
"""
